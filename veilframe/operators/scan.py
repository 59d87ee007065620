"""Detection: the registry's patterns and the label-anchored names over a text column, as a table of matches.

matches: doc_id, pii_type, value, start, end, confidence, source, context, ord. Spans are whole matches in the scanned
text, half-open; ord is the type's place in the registry and, with start, gives the order of a list of matches.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, offsets, registry
from ..functions import text as T

MATCH = "struct<pii_type:string,value:string,start:int,end:int,confidence:double,source:string,context:string,ord:int>"

#: What a text must hold for a type's pattern to match; texts without it are not looked at. A pattern of one pass, or
#: some of several: words in lower case, "=" words as they are, "re:" patterns.
GATES: dict[str, tuple[str, ...] | str] = {
    "aadhaar": r"\p{Nd}{4}", "pan": r"\p{Nd}{4}", "passport": ("passport",), "voter_id": r"\p{Nd}{7}", "driving_license": r"\p{Nd}{7}",
    "ssn": ("ssn", "security", "s.s.n", "taxpayer"), "abha_number": ("abha",), "credit_card": r"\p{Nd}[ -]*\p{Nd}[ -]*\p{Nd}[ -]*\p{Nd}",
    "bank_account": r"[0-9]{9}", "upi": "@", "ifsc": r"0[A-Za-z0-9]{6}", "iban": r"[A-Z]{2}\p{Nd}{2}", "nhs_number": ("nhs",), "expiry": ("exp", "valid"),
    "cvv": ("cvv", "cvc", "code"), "annual_income": ("income", "salary", "ctc", "pay"), "credit_score": ("score", "cibil"), "user_id": ("user", "login"),
    "password": ("pass", "pwd"), "marital_status": ("marital",), "allergies": ("allerg",), "prescription": ("prescribe", "medication", "tablet", "capsule", "mg"),
    "immunization": ("vaccin", "immuniz", "booster"), "blood_group": "[ABO][+-]", "mrn": ("mrn", "patient", "record"), "insurance_policy": ("policy",),
    "employee_id": ("emp",), "corporate_email": "@", "email": "@", "phone": r"\p{Nd}{3}", "pincode": r"[0-9]{6}|\p{Nd}{6}", "weight": r"\p{Nd}", "height": r"\p{Nd}",
    "age": r"\p{Nd}", "lab_test_results": ("lab", "blood", "urine", "hemoglobin", "cholesterol", "glucose", "creatinine", "bp"),
    "insurance_account_number": ("insurance",), "contact": ("contact",), "father_name": ("/o", "father", "pita", "fname", "f.name", r"re:(?Ui)(?:son|daughter|wife|care)\s+of", r"re:\p{Nd}\r?\n[A-Za-z]"), "gender": ("male", "transgender", "binary", "other", "पुरुष", "महिला", "પુરુષ", "મહિલા", "ਪੁਰਸ਼", "ਔਰਤ"),
    "educational_qualification": ("=B.", "=BSc", "=BTech", "=BE", "=BCom", "=BA", "=M.", "=MSc", "=MTech", "=ME", "=MBA", "=MPhil", "=MBBS", "=Ph", "=iploma", "=achelor", "=aster", "=octorate", "=raduate"), "ip_address": r"\p{Nd}\.\p{Nd}", "dob": r"\p{Nd}", "address": ("addr", "residence", "पता", "ঠিকানা", "পতা", "முகவரி", "చిరునామా"),
}


def _local_part() -> str:
    r"""What stands before the @ of an address: the language of C+(W*\.W*C+)*W*, with C as in "c" and W as in "w" below, and
    not a word less of it, in time proportional to the text.

    A text is runs of C with blanks between them, and each gap needs a full stop at one of its sides. A full stop can't be
    all of one address's part and lead over a gap too, so a chain of runs that are one full stop each is parts and leads by
    turns: it is taken as a whole, by whether their number is even. The choice at each run is the one that leaves most to
    what follows, so none is tried twice. A run that an earlier one leads to begins no match, as the earlier one would have.
    """
    c, w = r"[A-Za-z0-9._%+\-]", r"[ \t\n]"
    gap = f"{w}{{1,8}}"
    alone = rf"\.(?!{c})"
    pair = rf"(?:{w}++{alone}{w}++{alone})"
    run = rf"(?!{alone}){c}++"
    over = rf"{w}++{alone}{pair}*+{w}++{run}"  # full stops of an odd number
    given = rf"(?<={c}\.){pair}*+{w}++{run}"  # the run before has one to give
    own = rf"{pair}*+{w}++\.(?={c}){run}"  # the next run begins with one
    spent = rf"{pair}*+{w}++\.\.(?!{c})"  # .. of which one leads and the other is the part, with none to give
    after = rf"(?:{spent})*+(?:{over}|{own}|(?={pair}*+{w}*+@))"
    led = (rf"{c}\.{gap}", rf"{c}{gap}\.{gap}", rf"{c}{gap}")
    how = (rf"(?!{alone})", "", rf"\.{c}*+(?<!\.)")
    from_match = (rf"\.{gap}", rf"{gap}\.{gap}", gap)  # from the end of the last match there may be too little before
    fresh = "".join(rf"(?!(?<={x})(?<!\G{y}){z})" for x, y, z in zip(led, from_match, how, strict=True))
    begin = rf"(?:(?<!{c}){fresh}{c}++|\G{alone}{after}|\G{run})"
    end = rf"(?:{pair}*+{w}*+@|(?<={c}\.){pair}*+{w}++{alone}{w}*+@)"
    return rf"{begin}(?:{over}|{given}|{own}|{spent}{after})*+{end}"


#: The same matches without trying every start of a run or recursing for every label; a domain has at most 127 labels.
SAFER = {
    "email": _local_part() + r"[ \t\n]*+[A-Za-z0-9\-]+(?:[ \t\n]*\.[ \t\n]*[A-Za-z0-9\-]+){0,126}[ \t\n]*\.[ \t\n]*[A-Za-z]{2,}",
    "corporate_email": registry.BY_ID["corporate_email"].pattern.replace("[A-Za-z0-9._%+\\-]+@", "(?:(?<![A-Za-z0-9._%+\\-])|\\G)[A-Za-z0-9._%+\\-]++@"),
}

# What a value is made of, by type.
DIGITS = ("credit_card", "phone", "aadhaar")
COMPACT = ("pan", "driving_license", "passport", "ifsc", "ssn", "nhs_number")
FIRST_GROUP = ("dob", "bank_account", "user_id", "password", "insurance_policy", "mrn", "employee_id", "allergies", "gender", "age", "pincode")

# Patterns of names by their labels, as (before, name, after).
NAMES = (
    (r"(?i:(?:full\s+)?name\s*[:\-]\s*)", r"(?i:[A-Z][A-Za-z\s\.]{1,40})", r"(?:\n|\r|$|\s{2,})"),
    (r"^", r"[A-Z][A-Z\s\.]{4,50}", r"\r?\n(?:[A-Z\s\.]{1,50}\r?\n)?(?:DOB|Date\s+of\s+Birth|Year\s+of\s+Birth)"),
    (r"^\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}\r?\n", r"[A-Z]{2,}(?:\s+[A-Z]{2,}){1,3}", r"\r?\n"),
    (r"(?i:(?:elector(?:'?s)?\s*name|voter\s*name)\s*[:\-]?\s*)", r"(?i:[A-Z][A-Za-z\s\.]{2,40})", r"(?:\n|\r|$)"),
    (r"(?:S\/O|D\/O|Father'?s?\s*(?:Name)?)[^\n]*\n", r"[A-Z]{2,}(?:\s+[A-Z]{2,}){1,3}", r"(?=\s*\n)"),
)
NAME_CONFIDENCE = 0.92
NAME_NOISE = (
    "INDIA", "GOVERNMENT", "GOVT", "DEPARTMENT", "COMMISSION", "AADHAAR", "INCOME", "TAX", "ELECTION", "VOTER", "AUTHORITY", "IDENTIFICATION",
    "UNIQUE", "PERMANENT", "ACCOUNT", "NUMBER",
)


def java_pattern(t: registry.PiiType) -> str:
    """A registry pattern for the JVM: Unicode classes, line feed as the only line end, the absolute end as \\z."""
    p = SAFER.get(t.id, t.pattern)
    flags = "Ud"
    if p.startswith("(?i") and ")" in p[:6]:
        own, p = p[2 : p.index(")")], p[p.index(")") + 1 :]
        flags += own
    return f"(?{flags}){p}".replace(r"\Z", r"\z")


def gate(text: Column, lower: Column, kind: str) -> Column:
    what = GATES.get(kind)
    if what is None:
        return F.lit(True)
    if what == "@":
        return text.contains("@")
    if isinstance(what, str):
        return text.rlike(what)
    looks = [text.rlike(w[3:]) if w.startswith("re:") else text.contains(w[1:]) if w.startswith("=") else lower.contains(w) for w in what]
    return functools.reduce(lambda a, b: a | b, looks)


#: Characters of a pattern that is long: of the registry only that of e-mail addresses, which has no groups.
LONG = 2000
LOOK = "struct<m:string,gap:string,g1:string,g2:string>"
FOUND = "struct<m:string,start:int,end:int,g1:string,g2:string>"


def look(text: Column, pattern: str, groups: Sequence[int] = ()) -> Column:
    """array<LOOK>: what a pattern matches, what stands before each match, and the groups asked for; at the end what stands
    after the last one."""
    of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) if g in groups else F.array().cast("array<string>")
    # split() compiles its pattern anew for each text, which a long one makes slow; this is the same for a pattern without groups
    gap = F.split(text, pattern, -1) if groups or len(pattern) < LONG else F.regexp_extract_all(text, F.lit(rf"\G([\s\S]*?)(?:{pattern}|\z)"), F.lit(1))
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gap.alias("gap"), of(1).alias("g1"), of(2).alias("g2"))


def located(looks: Column) -> Column:
    """array<FOUND> of array<LOOK>: where a match starts follows from the lengths of what stands before it."""

    def step(acc: Column, x: Column):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        return {"at": end}, F.struct(x["m"].alias("m"), start.alias("start"), end.alias("end"), x["g1"].alias("g1"), x["g2"].alias("g2")), x["m"].isNotNull()

    return arrays.emitted(looks, {"at": F.lit(0)}, step, FOUND)


def occurrences(text: Column, pattern: str, groups: Sequence[int] = ()) -> Column:
    """array<FOUND>: all matches of a pattern with spans and the groups asked for."""
    return located(look(text, pattern, groups))


def _given(x: Column, otherwise: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) != "", x).otherwise(otherwise)


def value_of(kind: str, x: Column) -> Column:
    """The value that a match of a type stands for; null if it is none."""
    raw = T.stripped(x["m"])
    number = T.digits(raw)
    if kind == "credit_card":
        return F.when(T.luhn(raw), number)
    if kind == "phone":
        return F.when((number == "") | number.startswith("91") | (F.length(number) >= 10), _given(number, raw))
    if kind == "aadhaar":
        return _given(number, raw)
    if kind == "voter_id":
        return F.upper(F.regexp_replace(_given(x["g1"], _given(x["g2"], raw)), r"(?U)[\s.\-]+", ""))
    if kind == "father_name":
        value = F.rtrim(T.stripped(_given(x["g2"], _given(x["g1"], raw))), F.lit("."))
        return F.when((F.size(T.words(value)) != 1) | (F.length(value) > 2), value)
    if kind in COMPACT:
        return T.no_space(raw)
    if kind in FIRST_GROUP:
        return T.stripped(_given(x["g1"], raw))
    if kind == "email":
        value = F.regexp_replace(raw, r"[ \t\n\r]+", "")
        return F.when(value.contains("@"), value)
    if kind == "upi":
        return F.when(~raw.rlike(r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"), raw)
    return raw


def _groups(kind: str) -> tuple[int, ...]:
    return (1, 2) if kind in ("voter_id", "father_name") else (1,) if kind in FIRST_GROUP else ()


def _match(kind: str, order: int, text: Column, x: Column, value: Column, start: Column, end: Column, confidence: float) -> Column:
    return F.struct(F.lit(kind).alias("pii_type"), value.alias("value"), start.alias("start"), end.alias("end"), F.lit(confidence).alias("confidence"), F.lit("regex").alias("source"), T.context(text, x["start"], x["end"]).alias("context"), F.lit(order).alias("ord"))


def _typed(t: registry.PiiType, order: int, text: Column, found: Column) -> Column:
    """array<MATCH> of a type's array<FOUND>."""
    every = F.transform(found, lambda x: _match(t.id, order, text, x, value_of(t.id, x), x["start"], x["end"], 1.0))
    return F.filter(every, lambda m: m["value"].isNotNull())


def _name_look(number: int, text: Column, lower: Column) -> tuple[Column, Column]:
    """(whether a text may hold such names, array<LOOK>)."""
    before, name, after = NAMES[number]
    seen = (lower.contains("name"), text.contains("DOB") | text.contains("Birth"), text.rlike(r"\p{Nd}[/.\-]\p{Nd}"), lower.contains("name"), text.contains("/O") | text.contains("Father"))[number]
    return seen, look(text, f"(?Udm)({before})({name}){after}", (1, 2))


def _named(number: int, text: Column, found: Column) -> Column:
    """array<MATCH> of the array<FOUND> of names by one kind of label."""

    def match(x: Column) -> Column:
        value = F.rtrim(T.stripped(x["g2"]), F.lit("."))
        parts = T.words(value)
        noise = F.array(*map(F.lit, NAME_NOISE))
        good = (F.length(value) >= 3) & F.exists(parts, lambda w: ~F.array_contains(noise, F.upper(w))) & F.exists(parts, lambda w: F.length(w) >= 3)
        start = x["start"] + F.length(x["g1"])
        return _match("name", len(registry.TYPES) + number, text, x, F.when(good, value), start, start + F.length(x["g2"]), NAME_CONFIDENCE)

    return F.filter(F.transform(found, match), lambda m: m["value"].isNotNull())


def found_in(t: Column, lower: Column, types: Sequence[str] | None = None, exclude: Sequence[str] = (), use_nlp: bool = True, names: bool | None = None) -> Column:
    """array<MATCH> of a text column and its lower case. Patterns that aren't wanted are not run.

    One fold tells where the matches of all patterns are, so that the plan stays small however many there are.
    """
    skip = {*exclude, *(registry.MODEL_PREFERRED if use_nlp else ())}
    wanted = [(i, k) for i, k in enumerate(registry.TYPES) if k.pattern and k.id not in skip and (types is None or k.id in types)]
    names = (types is None or "name" in types) if names is None else names
    looks = [(gate(t, lower, k.id), look(t, java_pattern(k), _groups(k.id))) for _, k in wanted] + ([_name_look(n, t, lower) for n in range(len(NAMES))] if names else [])
    if not looks:
        return F.array().cast(f"array<{MATCH}>")
    every = F.transform(F.array(*[F.when(seen, found).otherwise(F.array().cast(f"array<{LOOK}>")) for seen, found in looks]), located)

    def matches(found: Column) -> Column:
        own = [_typed(k, i, t, F.get(found, F.lit(n))) for n, (i, k) in enumerate(wanted)]
        return F.concat(*own, *([_named(n, t, F.get(found, F.lit(len(wanted) + n))) for n in range(len(NAMES))] if names else []))

    return arrays.bound(every, matches)


def scan(docs: DataFrame, text: str = "text", types: Sequence[str] | None = None, exclude: Sequence[str] = (), use_nlp: bool = True, names: bool | None = None) -> DataFrame:
    """matches of docs (doc_id, text), one pass and no shuffle; the text itself stays behind.

    types: only these; exclude: not these; use_nlp: not those that models are trusted with; names: also label-anchored
    names (by default where types has no say).
    """
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_l", F.lower("_t"))
    return rows.select("doc_id", F.explode(found_in(F.col("_t"), F.col("_l"), types, exclude, use_nlp, names)).alias("x")).select("doc_id", "x.*")


def original_found(t: Column, lower: Column, origin: Column, types: Sequence[str] | None = None, use_nlp: bool = True) -> Column:
    """array<MATCH> of a normal form, spans being those of the original (see offsets)."""

    def moved(m: Column) -> Column:
        at = offsets.original_span(m["start"], m["end"], origin)
        own = {"start": at["start"], "end": at["end"]}
        return F.struct(*[own.get(c, m[c]).alias(c) for c in ("pii_type", "value", "start", "end", "confidence", "source", "context", "ord")])

    return F.transform(found_in(t, lower, types, use_nlp=use_nlp), moved)


def original_scan(docs: DataFrame, text: str = "text", types: Sequence[str] | None = None, use_nlp: bool = True) -> DataFrame:
    """matches of the whole normal form of docs (every compatibility form, NFKC); spans are places in the text as it was given."""
    rows = offsets.normalised(docs, text).withColumn("_l", F.lower("normalised"))
    return rows.select("doc_id", F.explode(original_found(F.col("normalised"), F.col("_l"), F.col("origin"), types, use_nlp)).alias("x")).select("doc_id", "x.*")


def field_scan(rows: DataFrame, key: str, columns: Sequence[str] | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """(key, field, matches...): every cell of the columns scanned on its own, without suppression for models."""
    columns = columns or [c for c in rows.columns if c != key]
    cells = rows.select(F.col(key), F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])).alias("field", "cell")).where("cell is not null")
    found = scan(cells.select(F.struct(key, "field").alias("doc_id"), "cell"), "cell", types, use_nlp=False, names=False)
    return found.select(F.col(f"doc_id.{key}").alias(key), F.col("doc_id.field").alias("field"), *[c for c in found.columns if c != "doc_id"])


def counts(matches: DataFrame, *by: str) -> DataFrame:
    """Matches or entities of each type."""
    return matches.groupBy(*by, "pii_type").agg(F.count("*").alias("n"))
