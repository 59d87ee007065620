"""Scripts of a text's words, and the detection engines that follow from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays

# Scripts as (name, first and last code point, language); letters beyond these count as latin.
SCRIPTS = (
    ("devanagari", 0x0900, 0x097F, "hi"), ("bengali", 0x0980, 0x09FF, "bn"), ("gurmukhi", 0x0A00, 0x0A7F, "pa"), ("gujarati", 0x0A80, 0x0AFF, "gu"),
    ("odia", 0x0B00, 0x0B7F, "or"), ("tamil", 0x0B80, 0x0BFF, "ta"), ("telugu", 0x0C00, 0x0C7F, "te"), ("kannada", 0x0C80, 0x0CFF, "kn"),
    ("malayalam", 0x0D00, 0x0D7F, "ml"), ("arabic", 0x0600, 0x06FF, "ar"), ("hebrew", 0x0590, 0x05FF, "he"), ("cjk", 0x4E00, 0x9FFF, "zh"),
    ("hiragana", 0x3040, 0x309F, "ja"), ("katakana", 0x30A0, 0x30FF, "ja"), ("hangul", 0xAC00, 0xD7AF, "ko"), ("cyrillic", 0x0400, 0x04FF, "ru"),
    ("thai", 0x0E00, 0x0E7F, "th"),
)
INDIC = tuple(s[0] for s in SCRIPTS[:9])
ARABIC, CJK = ("arabic", "hebrew"), ("cjk", "hiragana", "katakana", "hangul")
NON_LATIN = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for _, lo, hi, _ in SCRIPTS)
#: Texts of fewer words get patterns only; a share from which a text counts as mixed.
FEW_WORDS, MIXED = 6, 0.10
# A script's least share to be named, the mixed share from which a text isn't English, how fast one is sure.
RARE, NOT_ENGLISH, SURE = 0.02, 0.15, 1.5


def script_of(word: Column) -> Column:
    """The script of a word's first letter, null for a word without letters."""

    def of(code: Column) -> Column:
        out = F.when(code == 0, F.lit(None).cast("string"))
        for name, lo, hi, _ in SCRIPTS:
            out = out.when(code.between(lo, hi), F.lit(name))
        return out.otherwise(F.lit("latin"))

    return arrays.bound(F.ascii(F.regexp_extract(word, r"\p{L}", 0)), of)


def word_scripts(text: Column) -> Column:
    """array<string>: the scripts of the words that have letters, in order."""
    return F.transform(F.filter(F.split(text, r"(?U)\s+"), lambda w: w.rlike(r"\p{L}")), script_of)


def profile(text: Column) -> Column:
    """struct: dominant script (the first of the most frequent), its share, the mixed share, families, distribution.

    Only a text that holds a character of another script is looked at word by word; all others are latin.
    """
    lettered = text.rlike(r"\p{L}")
    names_ = ("dominant_script", "dominant_share", "mixed_ratio", "n_scripts", "has_indic", "has_arabic", "has_cjk", "distribution", "script_langs", "share")

    def struct(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(values, names_, strict=True)])

    def counted(found: Column) -> Column:
        each = F.transform(F.array_distinct(found), lambda s, i: F.struct((-F.size(F.filter(found, lambda x: x == s))).alias("n"), i.alias("i"), s.alias("script")))
        return F.struct(F.array_sort(each).alias("by"), F.size(found).alias("all"))

    def described(c: Column) -> Column:
        """Of the scripts, most frequent first, and of all words that have letters."""
        by, share_of = c["by"], lambda x: -x["n"] / c["all"]
        names, top = F.transform(by, lambda x: x["script"]), F.get(by, F.lit(0))
        share = F.coalesce(share_of(top), F.lit(1.0))
        return struct(
            F.coalesce(top["script"], F.lit("latin")), F.round(share, 3), F.round(1 - share, 3), F.size(names), *[F.arrays_overlap(names, F.array(*map(F.lit, family))) for family in (INDIC, ARABIC, CJK)],
            F.map_from_entries(F.transform(by, lambda x: F.struct(x["script"], F.round(share_of(x), 3)))), F.transform(F.filter(by, lambda x: share_of(x) >= RARE), lambda x: language(x["script"])), share,
        )

    mixed = arrays.bound(arrays.bound(word_scripts(text), counted), described)
    none = F.map_from_entries(F.array().cast("array<struct<script:string,share:double>>"))
    latin = struct(F.lit("latin"), F.lit(1.0), F.lit(0.0), lettered.cast("int"), *[F.lit(False)] * 3, F.when(lettered, F.create_map(F.lit("latin"), F.lit(1.0))).otherwise(none), F.when(lettered, F.array(F.lit("en"))).otherwise(F.array().cast("array<string>")), F.lit(1.0))
    return F.when(text.rlike(f"[{NON_LATIN}]"), mixed).otherwise(latin)


def language(script: Column) -> Column:
    """The language that a script stands for, English for latin."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for name, _, _, lang in SCRIPTS for x in (name, lang)]), script), F.lit("en"))


def languages(p: Column, latin: Column | None = None) -> Column:
    """struct<primary_lang, is_english, is_multilingual, script_langs, confidence> of a profile. A script says nothing of which
    language a latin text is in: ``latin`` may (null: unknown), as a column of a language model's answers."""
    alone = (p["dominant_script"] == "latin") & (p["mixed_ratio"] < NOT_ENGLISH)
    own = language(p["dominant_script"])
    primary = own if latin is None else F.when(alone, F.coalesce(latin, own)).otherwise(own)
    english = alone & primary.isin("en", "en-gb", "en-us")
    sure = F.least(p["share"] * SURE, F.lit(1.0))
    return F.struct(primary.alias("primary_lang"), english.alias("is_english"), (p["n_scripts"] > 1).alias("is_multilingual"), p["script_langs"].alias("script_langs"), F.round(sure, 3).alias("confidence"))


def engine(text: Column, p: Column) -> Column:
    """none, patterns, multilingual or latin: which semantic engine runs beside the patterns."""
    return (
        F.when(~text.rlike(r"(?U)\S"), F.lit("none"))
        .when(~text.rlike(rf"(?U)\A\s*+(?:\S++\s*+){{{FEW_WORDS}}}"), F.lit("patterns"))
        .when(p["has_indic"] | p["has_arabic"] | p["has_cjk"], F.lit("multilingual"))
        .when((p["dominant_script"] == "latin") | (p["n_scripts"] > 1) | (p["mixed_ratio"] > MIXED), F.lit("latin"))
        .otherwise(F.lit("patterns"))
    )
