"""Column functions over text: clean-up, normal form, keys, checks, context and masks. Built-in expressions only."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters without meaning, by code point: zero-width, direction marks, soft hyphen, object replacement.
ZERO_WIDTH = (0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069, 0x00AD, 0xFEFF, 0xFFFC)
# Arabic marks as ranges of code points.
ARABIC_MARKS = ((0x0610, 0x061A), (0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06DC), (0x06DF, 0x06E4), (0x06E7, 0x06E8), (0x06EA, 0x06ED))
# Quotes, dashes, spaces and ligatures with what stands for them; zeros of the digit blocks.
PLAIN = {0x2018: "'", 0x2019: "'", 0x201C: '"', 0x201D: '"', 0x2013: "-", 0x2014: "-", 0x2015: "-", 0x00A0: " ", 0x200A: " ", 0x2009: " "}
LONGER = {0x2026: "...", 0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl"}
DIGIT_ZEROS = (0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0660, 0x06F0, 0x07C0, 0x1040, 0x17E0, 0x1810, 0x1946, 0xFF10)
#: Below lie ASCII and the letters of western languages, of which few have a plain equivalent.
COMMON = 0x180
#: Characters around a match that make its context.
CONTEXT = 40


def _chars(ranges) -> str:
    return "".join(f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges)


def clean_ocr(text: Column) -> Column:
    """Without zero-width, private and Arabic marks, with runs of tabs and of one punctuation mark as one.

    Canonical composition is left to sources: no expression of Spark does it.
    """
    out = F.regexp_replace(text, f"[{_chars([(c, c) for c in ZERO_WIDTH])}{_chars([(0xE000, 0xF8FF)])}{_chars(ARABIC_MARKS)}]+", "")
    out = F.regexp_replace(out, "\t{3,}", "\t")
    return F.regexp_replace(out, r"(?U)([^\w\s])\1{2,}", "$1")


@functools.cache
def _single() -> tuple[str, str]:
    """Code points whose compatibility form is one other character, as the two arguments of translate()."""
    table = dict(PLAIN)
    table |= {z + i: str(i) for z in DIGIT_ZEROS for i in range(10)}
    for c in range(0x80, 0x10000):
        form = unicodedata.normalize("NFKC", chr(c))
        if c not in table and c not in LONGER and not 0xD800 <= c < 0xE000 and len(form) == 1 and form != chr(c):
            table[c] = form
    return "".join(map(chr, table)), "".join(table.values())


def normalise(text: Column) -> Column:
    """The normal form that detection works on.

    Control characters but tab, line feed and carriage return, and four zero-width ones, go; quotes, dashes, digits and
    other characters with a plain equivalent become it; at most two blanks and three line feeds stand in a row. Texts that
    hold no such character, as most in Latin letters don't, skip the tables.
    """
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}\x{200C}\x{200D}\x{FEFF}]+", "")
    plain = F.translate(out, *_single())
    for c, form in LONGER.items():
        plain = F.replace(plain, F.lit(chr(c)), F.lit(form))
    special = [c for c in _single()[0] if ord(c) < COMMON]
    odd = "".join(f"\\x{{{ord(c):X}}}" for c in special) + f"\\x{{{COMMON:X}}}-\\x{{10FFFF}}"
    out = F.when(text.rlike(f"[{odd}]"), plain).otherwise(out)
    out = F.regexp_replace(out, r"([ \t]{2})[ \t]+", "$1")
    out = F.regexp_replace(out, r"(\n{3})\n+", "$1")
    # one look at single characters, the others by plain search, so that texts in normal form are not rewritten
    control = "".join(f"\\x{{{c:X}}}" for c in (*range(9), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F))
    touched = text.contains("   ") | text.contains("\t") | text.contains("\n\n\n\n") | text.rlike(f"[{control}{odd}]")
    return F.when(touched, out).otherwise(text)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\D", "")


def no_space(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", "")


def one_space(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", " ")


def stripped(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def words(x: Column) -> Column:
    return F.when(stripped(x) == "", F.array().cast("array<string>")).otherwise(F.split(stripped(x), r"(?U)\s+"))


def identity_key(x: Column) -> Column:
    """Letters and digits in lower case."""
    return F.lower(F.regexp_replace(x, r"(?U)[\W_]+", ""))


def plain_key(x: Column) -> Column:
    """Lower case, one space at most, ASCII letters and digits."""
    return F.regexp_replace(one_space(F.lower(x)), "[^a-z0-9 ]", "")


def address(x: Column) -> Column:
    """An e-mail address as it stands in a text, without the ends of sentences that its pattern takes in before it."""
    return F.regexp_replace(x, r"\A[^@]*[A-Za-z0-9._%+\-]\.[ \t\n]+(?=[A-Za-z0-9_%+\-][^@]*@)", "")


def luhn(x: Column) -> Column:
    """At least 13 digits that pass the check of card numbers."""
    d = digits(x)
    return (F.length(d) >= 13) & F.call_function("luhn_check", d)


def context(text: Column, start: Column, end: Column) -> Column:
    lo = F.greatest(start - CONTEXT, F.lit(0))
    return stripped(F.substr(text, lo + 1, end + CONTEXT - lo))


def mask(pii_type: Column, value: Column) -> Column:
    """A value as a report may show it."""
    compact = stripped(one_space(value))
    number, token = digits(compact), F.upper(F.regexp_replace(compact, r"(?U)\W", ""))
    head = F.when(F.length(compact) <= 2, F.lit("***")).otherwise(F.concat(F.left(compact, F.lit(2)), F.lit("***")))
    ten = F.right(number, F.lit(10))
    left, right = (lambda x, n: F.left(x, F.lit(n))), (lambda x, n: F.right(x, F.lit(n)))
    return (
        F.when(compact == "", F.lit("***"))
        .when((pii_type == "pan") & (F.length(token) >= 10), F.concat(left(token, 5), F.lit("****"), right(token, 1)))
        .when((pii_type == "aadhaar") & (F.length(number) >= 12), F.concat(left(number, 4), F.lit(" **** "), F.substr(number, F.lit(9), F.lit(4))))
        .when((pii_type == "email") & compact.contains("@"), F.concat(left(F.substring_index(compact, "@", 1), 2), F.lit("***@"), F.substr(compact, F.locate("@", compact) + 1)))
        .when((pii_type == "phone") & (F.length(number) >= 10), F.concat(left(ten, 2), F.lit("******"), right(ten, 2)))
        .when((pii_type == "credit_card") & (F.length(number) >= 12), F.concat(left(number, 4), F.lit(" **** **** "), right(number, 4)))
        .when((pii_type == "voter_id") & (F.length(token) >= 10), F.concat(left(token, 3), F.lit("****"), right(token, 3)))
        .when((pii_type == "dob") & (F.length(number) >= 8), F.concat(F.lit("**/**/"), right(number, 4)))
        .otherwise(head)
    )


def ocr_like(text: Column) -> Column:
    """Whether a text of 50 characters or more has mostly lines of under 30 characters, or words of under 4 on average."""
    lines, parts = F.split(text, "\n"), words(text)
    short = F.size(F.filter(lines, lambda x: F.length(stripped(x)).between(1, 29))) / F.size(lines)
    mean = F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(F.size(parts), F.lit(1))
    return (F.length(text) >= 50) & ((short > 0.6) | (mean < 4.0))
