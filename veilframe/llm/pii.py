"""PII: regular expressions propose spans, validators confirm them, context words adjust the score. Native only.

Each kind is looked for on its own, leftmost first and without overlap; a match that its validator refuses goes, and what
it covered is not looked at again. IBANs differ: each place where one may begin is looked at, and it ends where its country's
length says, or for a country without one at the last border that makes it valid. Patterns use possessive quantifiers and look-behind where the plain form would try
every start within a long run: same matches, time in proportion to the text, no recursion.

Definitions. A null text is empty: counts 0, no spans. Positions count code points from 0, ends are exclusive. Spans of
different kinds may overlap. Rows are independent: repeated rows give repeated results, a null id stays null, and other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from .common import own_columns

#: Characters before and after a span in which context words count; characters that an IBAN may have at most.
NEARBY, LONGEST = 40, 50
SPAN = "struct<start:int,kind:int,end:int,score:double>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def byte_parts(m: Column) -> Column:
    """Whether all four parts are at most 255, whatever zeros they begin with."""
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)"
    return m.rlike(rf"^{part}(?:\.{part}){{3}}$")


def luhn(m: Column) -> Column:
    d = digits(m)
    return F.length(d).between(14, 19) & F.call_function("luhn_check", d)


def phone_digits(m: Column) -> Column:
    return F.length(digits(m)).between(10, 15)


def mod97(m: Column) -> Column:
    """The check of an IBAN: the first four characters at the end, letters as 10 to 35, remainder 1."""
    m = F.replace(m, F.lit(" "))
    turned = F.split(F.concat(F.substr(m, F.lit(5)), F.substr(m, F.lit(1), F.lit(4))), "")
    value = F.aggregate(turned, F.lit(0), lambda acc, c: (F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55)) % 97)
    return F.length(m).between(15, 34) & (value == 1)


def ssn_parts(m: Column) -> Column:
    """No part of zeros, no area that is never given out."""
    return ~m.rlike("^(?:000|666|9)") & ~m.rlike("^....00") & ~m.endswith("0000")


def mixed(m: Column) -> Column:
    """Something that was made, not a word: letters and digits in what follows the name, or a known form."""
    return m.rlike("[:=].*[0-9]") & m.rlike("[:=].*[A-Za-z]") | m.rlike("^(?:AKIA|ghp_|-----)")


def always(m: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    name: str
    gate: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    #: What must not stand right before or after.
    neighbour: str = ""


#: In the order in which spans of one start are listed; the first four are the base.
KINDS = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", always, 0.9, "e-?mail|contact|write|correo|courriel"),
    Kind("ip", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", byte_parts, 0.6, "address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13}", r"[0-9](?:[\x20-]?[0-9])++", luhn, 0.8, "card|visa|master|credit|debit|carte|tarjeta|karte"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", phone_digits, 0.6, "phone|tel|call|mobile|fax|whatsapp"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?s:.?)))[A-Z]{2}", mod97, 0.9, "iban|account|bank|konto|compte|cuenta", "[A-Za-z0-9]"),
    Kind("secret", r"[:=]|AKIA|ghp_|-----", r"(?:(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\x22']?\x20?[:=]\x20?[\x22']?[A-Za-z0-9+/_=-]{16,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)", mixed, 0.8, "key|login|account|auth|bearer"),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]{3}-[0-9]{2}-[0-9]{4}", ssn_parts, 0.5, "ssn|social security|tax", "[0-9-]"),
)
BASE, IBAN = 4, 4

#: The length of an IBAN by its country.
IBAN_SIZES = {country: int(size) for size, countries in (x.split(":") for x in (
    "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV", "22:BG BH CR DE GB GE IE ME RS VA",
    "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HN HU LB NI PL SV",
    "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
)) for country in countries.split()}


def iban_size(tail: Column) -> Column:
    """Of the IBAN that tail begins with; null if there is none."""
    sizes = F.create_map(*[F.lit(x) for item in IBAN_SIZES.items() for x in item])
    country = F.try_element_at(sizes, F.left(tail, F.lit(2)))
    one = F.lit(1)

    def ends(n: Column) -> Column:
        border = F.substr(tail, n, one).rlike("[A-Z0-9]") & ~F.substr(tail, n + 1, one).rlike(KINDS[IBAN].neighbour)
        own = F.length(F.replace(F.left(tail, n), F.lit(" ")))
        return border & (own == F.coalesce(country, own))

    lengths = F.filter(F.sequence(F.length(tail), F.lit(15), F.lit(-1)), ends)
    return F.get(F.filter(lengths, lambda n: mod97(F.left(tail, n))), F.lit(0))


def _of(number: Column, values: list[Column]) -> Column:
    """The value of a kind, only that one being computed."""
    out = F.when(number == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(number == i, v)
    return out


def spans(text: Column) -> Column:
    """array<SPAN> of all kinds in text, kind by kind, each by start.

    Starts add up the lengths of what matched and of what stands between. Of an IBAN the match is its first two letters; what
    may follow is captured, so that a refused proposal covers nothing.
    """
    row = "struct<m:string,g:string,tail:string>"
    looks = []
    for i, k in enumerate(KINDS):
        found = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
        tail = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(1)) if i == IBAN else F.array().cast("array<string>")
        zipped = F.arrays_zip(found.alias("m"), F.split(text, k.pattern, -1).alias("g"), tail.alias("tail"))
        looks.append(F.struct(F.lit(i).alias("k"), F.when(text.rlike(k.gate), zipped).otherwise(F.array().cast(f"array<{row}>")).alias("z")))

    def following(z: Column) -> Column:
        """What stands after each match, from the last one back."""

        def step(acc: Column, x: Column):
            after = F.left(F.concat(x["g"], F.coalesce(x["m"], F.lit("")), acc["h"]), F.lit(NEARBY + LONGEST))
            return {"h": after}, F.struct(x["m"], x["g"], x["tail"], acc["h"].alias("after")), None

        return F.reverse(arrays.emitted(F.reverse(z), {"h": F.lit("")}, step, row[:-1] + ",after:string>"))

    def kind_spans(look: Column) -> Column:
        k = look["k"]

        def step(acc: Column, x: Column):
            start = acc["at"] + F.length(x["g"])
            size = F.length(x["m"])
            whole = F.when(k == IBAN, iban_size(x["tail"])).otherwise(size)
            before = F.right(F.concat(acc["before"], x["g"]), F.lit(NEARBY))
            after = F.substr(x["after"], whole - size + 1, F.lit(NEARBY))
            beside = _of(k, [~before.rlike(f"{c.neighbour}$") & ~after.rlike(f"^{c.neighbour}") if c.neighbour and i != IBAN else F.lit(True) for i, c in enumerate(KINDS)])
            valid = _of(k, [F.lit(True) if i == IBAN else c.valid(x["m"]) for i, c in enumerate(KINDS)])
            # arrays_zip pads the matches with one null, beside the text's last part
            good = F.coalesce(x["m"].isNotNull() & whole.isNotNull() & (start >= acc["free"]) & valid & beside, F.lit(False))
            said = F.lower(F.concat_ws("\n", before, after))
            score = F.round(_of(k, [F.lit(c.score) + F.when(said.rlike(c.context), 0.1).otherwise(0.0) for c in KINDS]), 2)
            span = F.struct(start.alias("start"), k.alias("kind"), (start + whole).alias("end"), score.alias("score"))
            tail = F.right(F.concat(before, F.coalesce(x["m"], F.lit(""))), F.lit(NEARBY))
            return {"at": start + F.coalesce(size, F.lit(0)), "free": F.when(good, start + whole).otherwise(acc["free"]), "before": tail}, span, good

        return arrays.emitted(following(look["z"]), {"at": F.lit(0), "free": F.lit(0), "before": F.lit("")}, step, SPAN)

    return F.flatten(F.transform(F.filter(F.array(*looks), lambda x: F.size(x["z"]) > 1), kind_spans))


def pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and spans, array<SPAN> of all kinds. One pass over the texts, no shuffle."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    return rows.select(*keep, spans(F.col("_text")).alias("spans"))


def _said(found: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the base kinds; all spans with their number and scores."""
    found = pii(own_columns(docs, "doc_id", "text")).select("doc_id", F.array_sort("spans").alias("every"))  # a struct's order is start, then kind
    count = lambda i: F.size(F.filter("every", lambda x: x["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS[:BASE])],
        F.sha2(F.encode(_said(F.filter("every", lambda x: x["kind"] < BASE)), "UTF-8"), 256).alias("base_sha256"),
        _said(F.col("every")).alias("spans"),
        F.size("every").cast("long").alias("n_spans"),
        F.array_join(F.transform("every", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def _sql() -> str:
    """The same in SQL: matches and what stands between them give starts; plain patterns, as that engine doesn't retry."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}",
    }
    number = "regexp_replace(m, '[^0-9]', '', 'g')"
    digit = f"CAST(substr(reverse({number}), i, 1) AS INT)"
    turned = "substr(replace(m, ' ', ''), 5) || left(replace(m, ' ', ''), 4)"
    mod = f"list_reduce(list_prepend(0, list_transform(string_split({turned}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE 1000 + ascii(c) - 55 END)), lambda acc, v: CASE WHEN v < 1000 THEN acc * 10 + v ELSE acc * 100 + v - 1000 END % 97)"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INT) > 255)) = 0",
        "card": f"length({number}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({number}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} ELSE {digit} * 2 - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
        "phone": f"length({number}) BETWEEN 10 AND 15",
        "iban": f"length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND {mod} = 1",
        "secret": "regexp_matches(m, '[:=].*[0-9]') AND regexp_matches(m, '[:=].*[A-Za-z]') OR regexp_matches(m, '^(?:AKIA|ghp_|-----)')",
        "ssn": "NOT regexp_matches(m, '^(?:000|666|9)|^....00|0000$')",
    }
    parts = []
    for n, k in enumerate(KINDS):
        p = plain.get(k.name, k.pattern).replace("'", "''")
        beside = f"AND NOT regexp_matches(g, '{k.neighbour}$') AND NOT regexp_matches(after, '^{k.neighbour}')" if k.neighbour else ""
        parts.append(f"""
  SELECT doc_id, {n} AS kind, '{k.name}' AS name, s AS "start", s + length(m) AS "end", round({k.score} + CASE WHEN regexp_matches(lower(substr(t, CAST(greatest(s - {NEARBY}, 0) + 1 AS BIGINT), CAST(least(s, {NEARBY}) AS BIGINT)) || chr(10) || substr(t, CAST(s + length(m) + 1 AS BIGINT), {NEARBY})), '{k.context}') THEN 0.1 ELSE 0 END, 2)::DOUBLE AS score FROM (
    SELECT doc_id, t, ms[i] AS m, gs[i] AS g, gs[i + 1] AS after, list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s FROM (
      SELECT doc_id, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gs FROM d))) WHERE ({valid[k.name]}) {beside}""")
    said = "string_agg(name || ':' || \"start\" || ':' || \"end\", ',' ORDER BY \"start\", kind)"
    counts = ", ".join(f"count(*) FILTER (WHERE name = '{k.name}') AS n_{k.name}" for k in KINDS[:BASE])
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), span AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce({said} FILTER (WHERE kind < {BASE}), '')) AS base_sha256, coalesce({said} FILTER (WHERE name IS NOT NULL), '') AS spans,
  count(name) AS n_spans, coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY "start", kind) FILTER (WHERE name IS NOT NULL), '') AS scores FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id"""


SQL = _sql()
