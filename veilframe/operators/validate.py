"""Checks of entities against their document, and of both against a ground truth, as tables of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import resolve, scan

# Types compared by digits; patterns of what should not be missed, and what their text must hold.
NUMERIC = ("aadhaar", "ssn", "credit_card", "bank_account", "phone", "mrn", "nhs_number", "iban")
CRITICAL = {
    "aadhaar": (r"(?U)(?<!\d)\d{4}\s\d{4}\s\d{4}(?!\d)", r"\p{Nd}{4}"),
    "pan": (r"(?U)\b[A-Z]{5}[0-9]{4}[A-Z]\b", "[0-9]{4}"),
    "email": (r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "@"),
    "phone": (r"(?U)(?<!\d)(?:\+91[\s\-]?)?[6-9]\d{9}(?!\d)", r"\p{Nd}{9}"),
    "credit_card": (r"(?U)\b(?:\d[ -]*?){16}\b", r"\p{Nd}"),
}
# Types whose values have a form that can be checked.
STRUCTURED = ("pan", "aadhaar", "phone", "email", "credit_card", "voter_id")
ISSUE = ("doc_id", "severity", "code", "pii_type", "value", "start", "end")


def _issue(rows: DataFrame, severity: Column | str, code: Column | str, **columns: Column) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    given = {"severity": as_column(severity), "code": as_column(code)} | columns
    return rows.select(*[given[c].alias(c) if c in given else F.col(c) for c in ISSUE])


def span_mismatches(entities: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Entities whose value is neither at their span nor anywhere in the text."""
    rows = entities.where("start >= 0 and end >= 0").join(docs.select("doc_id", F.col(text).alias("_t")), "doc_id")
    said = F.substr(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start"))
    bare = lambda x: F.lower(F.regexp_replace(x, r"(?U)[\s\-_]", ""))
    same = (bare(said) == bare(F.col("value"))) | (F.col("pii_type").isin(*NUMERIC) & (T.digits(said) == T.digits(F.col("value")))) | F.lower("_t").contains(F.lower("value"))
    return _issue(rows.where(~same), "warning", "SPAN_VALUE_MISMATCH")


def overlaps(entities: DataFrame) -> DataFrame:
    """Pairs of entities of different types whose spans meet, each pair once.

    A join within the document. Long documents are cut into blocks of positions, so only spans near each other are
    compared; a pair counts in the block where it begins to overlap.
    """
    block = 1024
    rows = entities.where("start >= 0 and end > start").select("doc_id", "pii_type", "value", "start", "end", "ord")
    rows = rows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    a, b = rows.alias("a"), rows.alias("b")
    first = F.struct("a.ord", "a.start", "a.end", "a.value") < F.struct("b.ord", "b.start", "b.end", "b.value")
    met = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a._b") == F.col("b._b")) & (F.col("a.pii_type") != F.col("b.pii_type")) & (F.col("a.end") > F.col("b.start")) & (F.col("b.end") > F.col("a.start")) & first)
    met = met.where(F.floor(F.greatest("a.start", "b.start") / block) == F.col("a._b"))
    return met.select(
        F.col("a.doc_id").alias("doc_id"), F.lit("warning").alias("severity"), F.lit("SPAN_OVERLAP_CONFLICT").alias("code"), F.concat_ws("+", "a.pii_type", "b.pii_type").alias("pii_type"),
        F.concat_ws(" / ", "a.value", "b.value").alias("value"), F.least("a.start", "b.start").alias("start"), F.greatest("a.end", "b.end").alias("end"),
    )


def false_positives(entities: DataFrame) -> DataFrame:
    """Values that don't have their type's form."""
    kind, value = F.col("pii_type"), F.col("value")
    code = (
        F.when((kind == "aadhaar") & (F.length(T.digits(value)) != 12), "FP_AADHAAR_DIGIT_COUNT")
        .when((kind == "pan") & ~F.upper(value).rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), "FP_PAN_FORMAT")
        .when((kind == "email") & ~value.rlike(r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"), "FP_EMAIL_FORMAT")
        .when((kind == "credit_card") & ~T.luhn(value), "FP_CC_LUHN_FAIL")
        .when((kind == "name") & (F.size(T.words(value)) < 2), "LOW_CONF_SINGLE_TOKEN_NAME")
    )
    info = F.when(code.isin("FP_EMAIL_FORMAT", "LOW_CONF_SINGLE_TOKEN_NAME"), "info").otherwise("warning")
    return _issue(entities.where(code.isNotNull()), info, code)


def missed(entities: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """What a second look by strict patterns finds and no entity of its type holds."""
    t = F.col("_t")
    kind = "array<struct<pii_type:string,m:string,start:int,end:int>>"

    def of(name: str, pattern: str, gate: str) -> Column:
        found = F.transform(scan.occurrences(t, pattern), lambda x: F.struct(F.lit(name).alias("pii_type"), x["m"].alias("m"), x["start"].alias("start"), x["end"].alias("end")))
        return F.when(t.rlike(gate), found).otherwise(F.array().cast(kind))

    arrays = [of(name, *how) for name, how in CRITICAL.items()]
    seen = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t")).select("doc_id", F.explode(F.concat(*arrays)).alias("x")).select("doc_id", "x.*")
    seen = seen.withColumn("value", T.stripped(F.col("m"))).withColumn("_d", T.digits(F.col("m")))
    known = entities.select(F.col("doc_id").alias("_doc"), F.col("pii_type").alias("_kind"), F.lower("value").alias("_v"), T.digits(F.col("value")).alias("_vd"))
    low = F.lower("value")
    same = (F.col("doc_id") == F.col("_doc")) & (F.col("pii_type") == F.col("_kind")) & (F.col("_v").contains(low) | low.contains(F.col("_v")) | ((F.col("_d") != "") & (F.col("_d") == F.col("_vd"))))
    return _issue(seen.join(known, same, "left_anti"), "warning", "POSSIBLE_MISSED_ENTITY")


def _sensitive(entities: DataFrame) -> DataFrame:
    return entities.where(resolve.rank(F.col("sensitivity")) >= 3)


def unredacted(entities: DataFrame, redactions: DataFrame) -> DataFrame:
    """Entities from Medium up whose value no redaction (doc_id, value) of their document has."""
    done = redactions.select("doc_id", F.lower("value").alias("_v")).distinct()
    rows = _sensitive(entities).withColumn("_v", F.lower("value")).join(done, ["doc_id", "_v"], "left_anti")
    return _issue(rows, "warning", "UNREDACTED_SENSITIVE_ENTITY")


def coverage(entities: DataFrame, redactions: DataFrame) -> DataFrame:
    """(doc_id, coverage): the share of entities from Medium up that are redacted."""
    done = redactions.select("doc_id", F.lower("value").alias("_v"), F.lit(1).alias("_hit")).distinct()
    rows = _sensitive(entities).withColumn("_v", F.lower("value")).join(done, ["doc_id", "_v"], "left")
    return rows.groupBy("doc_id").agg((F.count("_hit") / F.count("*")).alias("coverage"))


def report(entities: DataFrame, issues: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, n_entities, n_warnings, n_infos, passed); strict: warnings fail too, else only errors do."""
    n = entities.groupBy("doc_id").agg(F.count("*").alias("n_entities"))
    said = issues.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}s") for s in ("error", "warning", "info")])
    out = n.join(said, "doc_id", "full_outer").fillna(0)
    return out.select("doc_id", "n_entities", "n_warnings", "n_infos", (F.col("n_errors") + (F.col("n_warnings") if strict else 0) == 0).alias("passed"))


def scores(entities: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) of distinct (pii_type, lower-case value) against truth's."""
    keys = [*by, "pii_type", "_v"]
    side = lambda df, name: df.select(*[F.col(c) for c in (*by, "pii_type")], F.lower("value").alias("_v")).distinct().withColumn(name, F.lit(1))
    both = side(entities, "_e").join(side(truth, "_g"), keys, "full_outer")
    n = both.groupBy(*by).agg(F.count_if(F.col("_e").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_e").isNull()).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select(*by, "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def well_formed(pii_type: Column, value: Column) -> Column:
    """Whether a value of a structured type has its form; other types have none to break."""
    number, token = T.digits(value), F.upper(F.regexp_replace(value, r"(?U)\W", ""))
    return (
        F.when(pii_type == "pan", token.rlike(r"\A[A-Z]{5}\p{Nd}{4}[A-Z]\z"))
        .when(pii_type == "aadhaar", F.length(number) == 12)
        .when(pii_type == "phone", F.length(number).isin(10, 12))
        .when(pii_type == "email", T.stripped(value).rlike(r"\A[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\z"))
        .when(pii_type == "voter_id", token.rlike(r"\A[A-Z]{3}\p{Nd}{7}\z"))
        .otherwise(F.lit(True))
    )


def stated(text: Column, value: Column) -> Column:
    """Whether a text holds an answer's value. A number of under six digits must stand by itself: within a longer number its
    digits are there by chance. From six digits on, numbers are compared by digits alone."""
    number, low = T.digits(value), T.stripped(T.one_space(value))
    said = F.concat(F.lit(r"\Q"), F.replace(low, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    whole = F.concat(F.when(low.rlike(r"^\p{Nd}"), r"(?<!\p{Nd})").otherwise(""), said, F.when(low.rlike(r"\p{Nd}\z"), r"(?!\p{Nd})").otherwise(""))
    short = F.length(number).between(1, 5) & ~value.rlike(r"\p{L}")
    return resolve.holds(text, value) & F.when(short, F.regexp(T.one_space(text), whole)).otherwise(True)


def answer_scores(answers: DataFrame, entities: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_answers, hallucinations, format_errors, missing) of a model's answers (doc_id, pii_type, value): those that
    their text doesn't hold, those without their type's form, and values that patterns find and the model did not give.

    Documents that neither says anything of have no row. Answers meet their text once, so a text moves once.
    """
    rows = answers.where(F.trim("value") != "").join(docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t")), "doc_id")
    said = rows.groupBy("doc_id").agg(
        F.count("*").alias("n_answers"),
        F.count_if(~stated(F.col("_t"), F.col("value"))).alias("hallucinations"),
        F.count_if(F.col("pii_type").isin(*STRUCTURED) & ~well_formed(F.col("pii_type"), F.col("value"))).alias("format_errors"),
    )
    side = lambda df: df.where(F.col("pii_type").isin(*STRUCTURED)).select("doc_id", "pii_type", F.lower(F.regexp_replace("value", r"(?U)\W", "")).alias("_k")).distinct()
    lost = side(entities).join(side(answers), ["doc_id", "pii_type", "_k"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("missing"))
    return said.join(lost, "doc_id", "full_outer").fillna(0).select("doc_id", "n_answers", "hallucinations", "format_errors", "missing")


def hallucinated(answers: DataFrame, entities: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Values of structured types that a model gave (doc_id, pii_type, value) and patterns did not find."""
    known = entities.select("doc_id", "pii_type", resolve.key(F.col("pii_type"), F.col("value")).alias("_k"))
    rows = answers.where(F.col("pii_type").isin(*types)).withColumn("_k", resolve.key(F.col("pii_type"), F.col("value")))
    return rows.join(known, ["doc_id", "pii_type", "_k"], "left_anti").drop("_k")
