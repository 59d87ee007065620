"""Redaction: what stands for a value, and texts with values or spans replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, offsets
from ..functions import text as T
from . import postprocess, scan

# Types always hidden as a whole; digits that stay of others; labels.
ALWAYS_FULL = ("password", "cvv", "ssn")
KEEP = {"credit_card": 4, "bank_account": 4, "aadhaar": 4, "phone": 4, "pan": 0}
LABELS = {
    "name": "[PERSON_NAME]", "address": "[ADDRESS]", "email": "[EMAIL]", "corporate_email": "[CORPORATE_EMAIL]", "phone": "[PHONE_NUMBER]", "dob": "[DATE_OF_BIRTH]",
    "aadhaar": "[AADHAAR_NUMBER]", "pan": "[PAN_NUMBER]", "passport": "[PASSPORT_NUMBER]", "voter_id": "[VOTER_ID]", "driving_license": "[DL_NUMBER]", "ssn": "[SSN]",
    "credit_card": "[CARD_NUMBER]", "bank_account": "[ACCOUNT_NUMBER]", "upi": "[UPI_ID]", "ifsc": "[IFSC_CODE]", "cvv": "[CVV]", "expiry": "[EXPIRY_DATE]",
    "password": "[PASSWORD]", "user_id": "[USER_ID]", "organization": "[ORGANIZATION]", "occupation": "[OCCUPATION]", "employee_id": "[EMPLOYEE_ID]",
    "diagnosis": "[MEDICAL_DIAGNOSIS]", "allergies": "[ALLERGY_RECORD]", "treatment_history": "[TREATMENT_HISTORY]", "prescription": "[PRESCRIPTION]",
    "immunization": "[IMMUNIZATION_RECORD]", "blood_group": "[BLOOD_GROUP]", "mrn": "[MEDICAL_RECORD_NUMBER]", "insurance_policy": "[INSURANCE_POLICY]",
    "insurance_provider": "[INSURANCE_PROVIDER]", "educational_qualification": "[QUALIFICATION]", "city": "[CITY]", "pincode": "[PINCODE]", "ip_address": "[IP_ADDRESS]",
    "nationality": "[NATIONALITY]", "gender": "[GENDER]", "age": "[AGE]", "marital_status": "[MARITAL_STATUS]",
}
MODES = ("full", "partial", "contextual", "mask")


def replacement(value: Column, pii_type: Column, mode: str = "contextual") -> Column:
    """full, partial, contextual or mask; an unknown mode counts as contextual."""
    crossed = F.repeat(F.lit("X"), F.length(value))
    label = F.coalesce(postprocess.by_type(pii_type, LABELS, None), F.concat(F.lit("["), F.upper(pii_type), F.lit("]")))
    number, keep = T.digits(value), postprocess.by_type(pii_type, KEEP, 4)
    partial = F.when((keep > 0) & (F.length(number) > keep), F.concat(F.repeat(F.lit("X"), F.length(number) - keep), F.right(number, keep))).otherwise(crossed)
    out = F.when(pii_type.isin(*ALWAYS_FULL), crossed)
    if mode not in ("full", "partial", "mask"):
        return out.otherwise(label)
    if mode == "partial":
        return out.otherwise(partial)
    return out.when(pii_type.isin(*KEEP), partial).otherwise(crossed if mode == "full" else label)


def redaction_map(entities: DataFrame, mode: str = "contextual", types: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, value, replacement): one for each value, the last entity's; blank values have none."""
    rows = entities.where(F.col("pii_type").isin(*types)) if types else entities
    rows = rows.where("value <> ''").withColumn("replacement", replacement(F.col("value"), F.col("pii_type"), mode))
    return rows.groupBy("doc_id", "value").agg(F.max_by("replacement", F.struct("ord", "start")).alias("replacement"))


def redact_by_value(docs: DataFrame, mapped: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, redacted, n_values): each value replaced wherever it stands, the longest first."""
    pairs = mapped.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("_n"), "value", "replacement"))).alias("_m"))
    done = F.aggregate("_m", F.col("_t"), lambda t, m: F.replace(t, m["value"], m["replacement"]))
    rows = docs.select("doc_id", F.col(text).alias("_t")).join(pairs, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("_m").isNull(), F.col("_t")).otherwise(done).alias("redacted"), F.coalesce(F.size("_m"), F.lit(0)).alias("n_values"))


def merged_spans(entities: DataFrame) -> DataFrame:
    """(doc_id, start, end, pii_type, value): spans that meet as one, with the type and value of the longest of them."""
    order = Window.partitionBy("doc_id").orderBy("start", F.col("end").desc(), "ord")
    rows = entities.where("start >= 0 and end > start").withColumn("_reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_new", (F.col("_reach").isNull() | (F.col("start") >= F.col("_reach"))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("pii_type", "value"), F.struct((F.col("end") - F.col("start")).alias("n"), -F.col("start"), -F.col("ord"))).alias("x")
    return rows.groupBy("doc_id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), best).select("doc_id", "start", "end", "x.*")


def replaced_in(t: Column, spans: Column, mode: str = "contextual") -> Column:
    """t with each of the spans replaced; they are in order and don't meet. What stands between them and what replaces
    them is joined once, so time grows with the text, not with spans x text."""
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
    said = lambda s: F.substr(t, s["start"] + 1, s["end"] - s["start"])
    parts = F.transform(spans, lambda s, i: F.concat(F.substr(t, before(i) + 1, s["start"] - before(i)), replacement(said(s), s["pii_type"], mode)))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, t).otherwise(F.concat(F.array_join(parts, ""), F.substr(t, F.element_at(spans, -1)["end"] + 1)))


def redact_by_span(docs: DataFrame, entities: DataFrame, mode: str = "contextual", text: str = "text") -> DataFrame:
    """(doc_id, redacted, n_spans): the text with each merged span replaced, whatever form its value has there.

    For spans that come from elsewhere, as from models; redact_texts finds and replaces in one pass.
    """
    spans = entities.where("start >= 0 and end > start").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "ord", "pii_type")).alias("_m"))
    rows = docs.select("doc_id", F.col(text).alias("_t")).join(spans, "doc_id", "left").withColumn("_s", merged(proper(F.col("_t"), F.coalesce("_m", F.array().cast("array<struct<start:int,end:int,ord:int,pii_type:string>>")))))
    return rows.select("doc_id", replaced_in(F.col("_t"), F.col("_s"), mode).alias("redacted"), F.size("_s").alias("n_spans"))


def proper(t: Column, found: Column) -> Column:
    """array<struct<start, end, ord, pii_type>> of array<MATCH>: what is to be replaced in t. The pattern of e-mail addresses
    takes a word before them that ends a sentence for a part of them; such words stay."""
    address = lambda m: T.address(F.substr(t, m["start"] + 1, m["end"] - m["start"]))
    start = lambda m: F.when(m["pii_type"] == "email", m["end"] - F.length(address(m))).otherwise(m["start"])
    return F.transform(found, lambda m: F.struct(start(m).alias("start"), m["end"].alias("end"), m["ord"].alias("ord"), m["pii_type"].alias("pii_type")))


def merged(found: Column) -> Column:
    """array<struct<start, end, pii_type>> of array<MATCH>: spans that meet as one, with the type of the longest of them."""
    order = F.array_sort(F.transform(F.filter(found, lambda m: m["end"] > m["start"]), lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("_e"), m["ord"].alias("ord"), m["pii_type"].alias("pii_type"))))
    state = {"start": F.lit(-1), "end": F.lit(-1), "size": F.lit(-1), "pii_type": F.lit("")}

    def step(acc: Column, x: Column):
        """A span goes out when the next one doesn't meet it; an empty one at the end of all lets the last one out."""
        end, size = -x["_e"], -x["_e"] - x["start"]
        meets = x["start"] < acc["end"]
        longer = size > acc["size"]
        pick = lambda joined, own: F.when(meets, joined).otherwise(own)
        after = {
            "start": pick(acc["start"], x["start"]), "end": pick(F.greatest(acc["end"], end), end), "size": pick(F.greatest(acc["size"], size), size),
            "pii_type": pick(F.when(longer, x["pii_type"]).otherwise(acc["pii_type"]), x["pii_type"]),
        }
        return after, F.struct(acc["start"].alias("start"), acc["end"].alias("end"), acc["pii_type"].alias("pii_type")), ~meets & (acc["start"] >= 0)

    last = F.struct(F.lit((1 << 31) - 1).alias("start"), F.lit(-((1 << 31) - 1)).alias("_e"), F.lit(0).alias("ord"), F.lit("").alias("pii_type"))
    return arrays.emitted(F.concat(order, F.array(last)), state, step, "struct<start:int,end:int,pii_type:string>")


def redact_texts(docs: DataFrame, types: tuple[str, ...] | None = None, mode: str = "contextual", text: str = "text", keep: tuple[str, ...] = ("doc_id",), use_nlp: bool = True) -> DataFrame:
    """(keep, redacted, n_spans): every match of the patterns replaced where it stands, each row on its own: one read of
    the text, no shuffle, no join. All matches count, also those that resolution would fold into one entity."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_t")).withColumn("_l", F.lower("_t"))
    rows = rows.withColumn("_m", scan.found_in(F.coalesce("_t", F.lit("")), F.coalesce("_l", F.lit("")), types, use_nlp=use_nlp)).withColumn("_s", merged(proper(F.coalesce("_t", F.lit("")), F.col("_m"))))
    return rows.select(*keep, replaced_in(F.col("_t"), F.col("_s"), mode).alias("redacted"), F.size("_s").alias("n_spans"))


def redact_originals(docs: DataFrame, types: tuple[str, ...] | None = None, mode: str = "contextual", text: str = "text", use_nlp: bool = True) -> DataFrame:
    """(doc_id, redacted, n_spans): the text as it was given, with every match in its whole normal form replaced."""
    rows = offsets.normalised(docs, text).withColumn("_l", F.lower("normalised"))
    rows = rows.withColumn("_s", merged(proper(F.col("original"), scan.original_found(F.col("normalised"), F.col("_l"), F.col("origin"), types, use_nlp))))
    return rows.select("doc_id", replaced_in(F.col("original"), F.col("_s"), mode).alias("redacted"), F.size("_s").alias("n_spans"))


def verify(redacted: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, pii_type, value): what can still be read in (doc_id, redacted): as it is, in plain form, or by 6 digits.

    A value of an e-mail address may begin with the end of a sentence, which stands apart in the text: what is looked for,
    and given out, is then the longest of its ends that begins after a full stop and can be read.
    """
    rows = entities.select("doc_id", "pii_type", "value").join(redacted.select("doc_id", "redacted"), "doc_id")
    local = F.split(F.substring_index("value", "@", 1), r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(local)), lambda i: F.array_join(F.slice(local, i, F.size(local)), "."))
    after = F.concat(F.lit("@"), F.substring_index("value", "@", -1))
    read = F.get(F.filter(F.transform(ends, lambda x: F.concat(x, after)), lambda x: ~x.startswith("@") & F.col("redacted").contains(x)), F.lit(0))
    rows = rows.withColumn("value", F.when((F.col("pii_type") == "email") & F.col("value").contains("@"), F.coalesce(read, "value")).otherwise(F.col("value")))
    number, plain = T.digits(F.col("value")), T.plain_key(F.col("value"))
    seen = F.col("redacted").contains(F.col("value")) | ((plain != "") & T.plain_key(F.col("redacted")).contains(plain)) | ((F.length(number) >= 6) & T.digits(F.col("redacted")).contains(number))
    return rows.where(seen).drop("redacted")


def redact_cells(rows: DataFrame, key: str, columns: tuple[str, ...], types: tuple[str, ...] | None = None, mode: str = "contextual") -> DataFrame:
    """rows with the named columns redacted cell by cell, as strings; ``key`` tells rows apart."""
    cells = rows.select(F.col(key), F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])).alias("field", "cell"))
    cells = cells.select(F.struct(key, "field").alias("doc_id"), F.col("cell").alias("text"))
    done = redact_texts(cells, types, mode, use_nlp=False)
    back = done.groupBy(F.col(f"doc_id.{key}").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("doc_id.field", "redacted"))).alias("_cells"))
    return rows.join(back, key).select(*[F.col("_cells")[c].alias(c) if c in columns else F.col(c) for c in rows.columns])
