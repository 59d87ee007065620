"""Ingestion: what is to be done with a file, from its name and a snippet, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parsers by extension, how their text is chunked, extensions that need OCR or are tables.
PARSERS = {
    ".pdf": "pdf", ".docx": "docx", ".doc": "doc", ".odt": "odt", ".rtf": "rtf", ".csv": "csv", ".xlsx": "xlsx", ".xls": "xlsx", ".mdb": "mdb", ".sql": "sql",
    ".jpg": "image", ".jpeg": "image", ".png": "image", ".bmp": "image", ".tif": "image", ".tiff": "image", ".webp": "image", ".pptx": "pptx", ".zip": "zip",
}
CHUNKING = {"pdf": "page", "csv": "row", "xlsx": "row", "mdb": "row", "docx": "paragraph", "doc": "paragraph", "odt": "paragraph", "rtf": "paragraph"}
TABLES, IMAGES, SNIPPETS = ("csv", "xlsx", "mdb"), ("image",), ("pdf", "docx", "csv")
MEDICAL = (
    r"(?Ui)\b(?:patient|hospital|clinic|diagnosis|prescription|discharge|medical|health|lab\s*report|radiology|pathology|doctor|physician|insurance\s*claim|icd|cpt|"
    r"medication|dosage|allergy|vitals|ehr|abha|ayushman|weight|height|blood\s*(?:group|pressure|sugar)|hemoglobin|cholesterol|creatinine|glucose|mrn)\b"
)
SNIPPET_CHARS, MAX_BYTES, PDF_PAGE_CHARS = 1000, 100 * 1024 * 1024, 150


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))


def _of(table: dict[str, str], key: Column, otherwise: str | None) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in sum(table.items(), ())]), key), F.lit(otherwise))


def hidden(path: Column) -> Column:
    """Files of systems, not of people: beginning with a dot, or within __MACOSX."""
    return F.regexp_extract(path, r"[^/\\]*$", 0).startswith(".") | path.contains("__MACOSX")


def needs_pdf_ocr(text: Column, pages: Column) -> Column:
    """Whether a PDF's first pages (three at most) have under 150 characters each."""
    return F.length(F.coalesce(text, F.lit(""))) < PDF_PAGE_CHARS * F.least(pages, F.lit(3))


def plan(files: DataFrame) -> DataFrame:
    """files (path, snippet, size) with extension, parser, chunking, flags, doc_type and error."""
    out = files.withColumn("extension", extension(F.col("path"))).withColumn("parser", _of(PARSERS, F.col("extension"), None))
    snippet = F.when(F.col("parser").isin(*SNIPPETS), F.left(F.coalesce("snippet", F.lit("")), F.lit(SNIPPET_CHARS))).otherwise(F.lit(""))
    name = F.regexp_extract(F.col("path"), r"[^/\\]*$", 0)
    out = out.withColumns({
        "chunking": _of(CHUNKING, F.col("parser"), "full"),
        "is_structured": F.coalesce(F.col("parser").isin(*TABLES), F.lit(False)),
        "needs_ocr": F.coalesce(F.col("parser").isin(*IMAGES), F.lit(False)),
        "is_medical": F.lower(F.concat_ws(" ", name, snippet)).rlike(MEDICAL),
    })
    kind = F.when(F.col("is_medical"), "medical").when(F.col("is_structured"), "structured").when(F.col("needs_ocr"), "ocr_heavy").otherwise("generic")
    error = F.when(hidden(F.col("path")), "hidden file").when(F.col("size") > MAX_BYTES, "too large").when(F.col("parser").isNull() | F.col("parser").isin("pptx", "zip"), "No parser available")
    return out.withColumns({"doc_type": kind, "error": error})
