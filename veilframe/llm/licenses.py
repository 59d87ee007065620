"""License scans: ordered signature rules behind a keyword gate, overlaps resolved by priority and containment. Native only.

A text is put into normal form (words in lower case with one space between them), on which rules are regular expressions.
A rule family is looked at only where one of its needles occurs, each match of its rules having one. Each detection is an
interval of words; one that lies within another of no lower priority goes, and so does the lower of two equal intervals.
Base detections (three fixed phrases) always stay.

Definitions. A null or empty text has no words: counts 0, words null, labels empty, score 0. Word numbers start at 0.
Rows are independent: repeated rows give repeated results, a null id stays null, other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from .common import own_columns

#: What separates words, over lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_PRIORITY = 10


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int


def _versions(*v: str) -> dict[str, str]:
    """From a version's words in normal form to its name: "2 0" to "2.0"."""
    return {x.replace(".", " "): x for x in v}


# Families as (label, keyword, names in normal form, versions).
FAMILIES = (
    ("gpl", "general public", ("gnu general public license", "gnu gpl", "general public license"), _versions("1", "2", "3", "2.0", "3.0")),
    ("lgpl", "lesser general", ("gnu lesser general public license", "lesser general public license", "gnu lgpl"), _versions("2", "3", "2.1", "3.0")),
    ("lgpl", "library general", ("gnu library general public license", "library general public license"), _versions("2", "2.0")),
    ("agpl", "affero", ("gnu affero general public license", "affero general public license", "gnu agpl"), _versions("1", "3", "3.0")),
    ("apache", "apache", ("apache license", "apache software license", "apache public license"), _versions("1.0", "1.1", "2.0", "2")),
    ("mpl", "mozilla", ("mozilla public license", "mozilla public licence"), _versions("1.0", "1.1", "2.0")),
    ("epl", "eclipse", ("eclipse public license",), _versions("1.0", "2.0")),
    ("cddl", "common development", ("common development and distribution license",), _versions("1.0", "1.1")),
    ("eupl", "european union", ("european union public licence", "european union public license"), _versions("1.0", "1.1", "1.2")),
    ("osl", "open software", ("open software license",), _versions("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic free", ("academic free license",), _versions("1.2", "2.0", "2.1", "3.0")),
    ("artistic", "artistic", ("artistic license", "perl artistic license"), _versions("1.0", "2.0")),
    ("gfdl", "free documentation", ("gnu free documentation license", "free documentation license"), _versions("1.1", "1.2", "1.3")),
    ("bsl", "boost software", ("boost software license",), _versions("1.0")),
    ("zpl", "zope", ("zope public license",), _versions("1.1", "2.0", "2.1")),
    ("psf", "python software", ("python software foundation license",), _versions("2")),
    ("php", "php license", ("php license",), _versions("3.0", "3.01")),
    ("ms-pl", "microsoft public", ("microsoft public license",), {}),
    ("ms-rl", "microsoft reciprocal", ("microsoft reciprocal license",), {}),
    ("cecill", "cecill", ("cecill free software license agreement", "cecill license", "licence cecill"), _versions("1.0", "2.0", "2.1")),
    ("isc", "isc license", ("isc license", "isc licence"), {}),
    ("mit", "mit license", ("mit license", "mit licence", "mit expat license"), {}),
    ("bsd", "bsd", ("bsd license", "bsd licence", "new bsd license", "simplified bsd license", "modified bsd license", "revised bsd license"), {}),
    ("zlib", "zlib", ("zlib license", "zlib libpng license"), {}),
    ("wtfpl", "what the fuck", ("do what the fuck you want to public license",), _versions("1", "2")),
    ("unlicense", "unlicense", ("the unlicense", "unlicense license"), {}),
    ("ofl", "open font", ("sil open font license", "open font license"), _versions("1.0", "1.1")),
)
# Creative Commons kinds in normal form, and whole sentences of notices: (label, words, priority).
CC_KINDS = {"by": "cc-by", "by sa": "cc-by-sa", "by nc": "cc-by-nc", "by nd": "cc-by-nd", "by nc sa": "cc-by-nc-sa", "by nc nd": "cc-by-nc-nd"}
CC_NAMES = {"attribution": "cc-by", "attribution sharealike": "cc-by-sa", "attribution share alike": "cc-by-sa", "attribution noncommercial": "cc-by-nc", "attribution noderivatives": "cc-by-nd", "attribution noncommercial sharealike": "cc-by-nc-sa", "attribution noncommercial noderivatives": "cc-by-nc-nd"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 60),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", 60),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 60),
    ("bsd-3-clause", "neither the name of", 30),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented", 60),
    ("apache-2.0", "you may not use this file except in compliance with the license", 60),
    ("apache-2.0", "http www apache org licenses license 2 0", 70),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 65),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", 66),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 70),
    ("public-domain", "released into the public domain", 50),
    ("public-domain", "dedicated to the public domain", 50),
    ("public-domain", "this work is in the public domain", 50),
    ("cc0", "cc0 1 0 universal", 55),
    ("unlicense", "this is free and unencumbered software released into the public domain", 60),
    ("warranty", "the software is provided as is without warranty of any kind", 20),
    ("warranty", "without even the implied warranty of merchantability or fitness for a particular purpose", 20),
    ("proprietary", "proprietary and confidential", 40),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", 45),
    ("copyright", "this work is protected by copyright", 15),
    ("no-derivatives", "may not be reproduced distributed or transmitted in any form", 35),
)
SPDX = ("mit", "isc", "zlib", "unlicense", "bsl 1 0", "wtfpl", "cc0 1 0", "0bsd", "ncsa", "postgresql", "python 2 0", "x11", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause")
FORMS = ("version {v}", "v {v}", "v{v}", "{v}")


def _rules() -> tuple[Rule, ...]:
    """All rules, by priority: a version in the text outranks a bare name, an identifier outranks both."""
    out = []
    for label, keyword, names, versions in FAMILIES:
        for name, (v, said), form in product(names, versions.items(), FORMS):
            out.append(Rule(f"{label}-{said}", f"{name} {form.format(v=v)}(?: or (?:any )?later(?: version)?)?", keyword, 50 + len(v)))
        out += [Rule(label, name, keyword, 40) for name in names]
        for v, said in versions.items():
            out.append(Rule(f"{label}-{said}", f"spdx license identifier {label} {v}(?: only| or later)?", "spdx", 90 + len(v)))
    for said, label in CC_KINDS.items():
        out += [Rule(f"{label}-{v.replace(' ', '.')}", f"(?:cc )?{said} {v}", f"{said} {v}", 52 + len(said)) for v in CC_VERSIONS]
    for said, label in CC_NAMES.items():
        out += [Rule(f"{label}-{v.replace(' ', '.')}", f"creative commons {said} {v}(?: international| unported)?", "creative commons", 60 + len(said)) for v in CC_VERSIONS]
        out.append(Rule(label, f"creative commons {said}", "creative commons", 45 + len(said)))
    out += [Rule(said.replace(" ", "-"), f"spdx license identifier {said}", "spdx", 92) for said in SPDX]
    out += [Rule(label, words, " ".join(words.split()[:3]), p) for label, words, p in NOTICES]
    return tuple(sorted(out, key=lambda r: (-r.priority, -len(r.pattern), r.pattern)))


RULES = _rules()
DETECTION = "struct<start:int,end:int,priority:int,label:string>"
#: One look for all families: no text without one of these stems has a detection.
GATE = (
    r"licen[sc]e|public|apache|bsd|spdx|creative commons|reserved|copyright|permission|redistribution|altered source|source code form|proprietary|unauthorized|"
    r"cc by|cc0|cecill|gnu|warranty|name of|reproduced|by (?:n[cd] |sa )*[1-4] [05]"
)


def _groups() -> list[tuple[str, list[Rule]]]:
    by: dict[str, list[Rule]] = {}
    for r in RULES:
        by.setdefault(r.keyword, []).append(r)
    return sorted(by.items())


def fixed_part(pattern: str) -> str:
    """What stands in every match of a rule: its pattern without the optional groups, which begin or end it."""
    fixed = max(re.split(r"\(\?:.*\)\?", pattern), key=len)
    if not fixed or re.search(r"[^a-z0-9 ]", fixed):
        raise ValueError(f"no fixed part in {pattern!r}")
    return fixed


def needles(keyword: str, rules: list[Rule]) -> list[str]:
    """The keyword, and the shortest names among its rules that lack it: every match has one of these."""
    out = [keyword]
    for fixed in sorted({fixed_part(r.pattern) for r in rules}, key=lambda x: (len(x), x)):
        if not any(n in fixed for n in out):
            out.append(fixed)
    return out


def lower_ascii_words(text: Column) -> Column:
    """The words in order with a space before and after each: " one two ".

    lower() also folds letters beyond ASCII, which are parts of words either way and stand in no rule.
    """
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), GAP, " ")), F.lit(" "))


def spelled(pattern: str) -> list[str]:
    """All that a rule can match: its optional groups, which hold no others but in their alternatives, taken and left out."""
    m = re.search(r"\(\?:((?:[^()]|\([^()]*\)\??)*)\)\?", pattern)
    if not m:
        return [pattern]
    return [x for choice in ("", *m[1].split("|")) for x in spelled(pattern[: m.start()] + choice + pattern[m.end() :])]


def _words(x: Column) -> Column:
    """Spaces in x."""
    return F.length(x) - F.length(F.replace(x, F.lit(" ")))


def _detections(norm: Column, hit: Column, groups: list[tuple[Column, list[Rule]]]) -> Column:
    """array<struct<start, end, rule>>, in words, end exclusive: what the rules of each group find where its gate is open.

    rule counts through all groups: the first rule of the group that fits a match as a whole, by a table of all that rules
    can match. One fold over matches serves all groups, so that the plan stays small.
    """
    table: dict[str, int] = {}
    looks, number = [], 0
    for k, (gate, rules) in enumerate(groups):
        for i, r in enumerate(rules):
            for words in spelled(r.pattern):
                table.setdefault(f"{k}:{words}", number + i)
        number += len(rules)
        bounded = f"(?<= )(?:{'|'.join(r.pattern for r in rules)})(?= )"
        zipped = F.arrays_zip(F.regexp_extract_all(norm, F.lit(bounded), F.lit(0)).alias("m"), F.split(norm, bounded, -1).alias("g"))
        looks.append(F.struct(F.lit(str(k)).alias("k"), F.when(hit & gate, zipped).otherwise(F.array().cast("array<struct<m:string,g:string>>")).alias("z")))
    # a literal, which is made into a map once
    known = F.str_to_map(F.lit("\n".join(f"{k}={v}" for k, v in table.items())), F.lit("\n"), F.lit("="))

    def found(look: Column) -> Column:
        def step(acc: Column, x: Column):
            start = acc["at"] + _words(x["g"])
            end = start + _words(x["m"])
            rule = F.try_element_at(known, F.concat_ws(":", look["k"], x["m"])).cast("int")
            return {"at": F.coalesce(end, start)}, F.struct((start - 1).alias("start"), end.alias("end"), rule.alias("rule")), x["m"].isNotNull()

        return arrays.emitted(look["z"], {"at": F.lit(0)}, step, "struct<start:int,end:int,rule:int>")

    open_ = F.filter(F.array(*looks), lambda x: F.size(x["z"]) > 1)
    return F.flatten(F.transform(open_, found))


def survivors(found: Column) -> Column:
    """Without intervals that lie within another one of no lower priority; of equal ones the first label stays.

    Sorted by start, longest, highest and first label first, an interval lies only within ones before it. One pass keeps the
    furthest end of each priority so far: an interval goes if some priority not below its own reaches its end.
    """
    order = lambda a, b: (
        F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        .when(a["end"] != b["end"], F.when(a["end"] > b["end"], -1).otherwise(1))
        .when(a["priority"] != b["priority"], F.when(a["priority"] > b["priority"], -1).otherwise(1))
        .when(a["label"] != b["label"], F.when(a["label"] < b["label"], -1).otherwise(1))
        .otherwise(0)
    )

    def kept(levels: Column) -> Column:
        def step(acc: Column, x: Column):
            rank = F.array_position(levels, x["priority"]).cast("int")
            reach = F.array_max(F.slice(acc["far"], rank, F.size(levels)))
            far = F.transform(acc["far"], lambda v, i: F.when(i + 1 == rank, F.greatest(v, x["end"])).otherwise(v))
            return {"far": far}, x, reach < x["end"]

        return arrays.emitted(F.array_sort(found, order), {"far": F.array_repeat(F.lit(-1), F.size(levels))}, step, DETECTION)

    return arrays.bound(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["priority"]))), kept)


def license_scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns ``keep`` with n_words, n_base, first_word, last_word, base_labels, labels, detections and score.

    One pass over the texts, no shuffle. score is the highest priority among what was found, out of 100.
    """
    n = F.col("_n")
    has = lambda k, rules: reduce(Column.__or__, [n.contains(x) for x in needles(k, rules)])
    groups = [(n.contains(f" {p} "), [Rule(name, p, p, BASE_PRIORITY)]) for p, name in BASE] + [(has(k, rules), rules) for k, rules in _groups()]
    every = [r for _, rules in groups for r in rules]
    priorities = F.split(F.lit(",".join(str(r.priority) for r in every)), ",").cast("array<int>")
    labels = F.split(F.lit(",".join(r.label for r in every)), ",")
    said = lambda x: F.struct(x["start"], x["end"], F.get(priorities, x["rule"]).alias("priority"), F.get(labels, x["rule"]).alias("label"))
    none = F.array().cast(f"array<{DETECTION}>")
    found = own_columns(docs, *keep, "text").select(*keep, lower_ascii_words(F.col("text")).alias("_n")).withColumn("_hit", n.rlike(GATE))
    found = found.select(*keep, F.when(F.length(n) > 2, _words(n) - 1).otherwise(F.lit(0)).cast("long").alias("n_words"), _detections(n, F.col("_hit"), groups).alias("_all"))
    found = found.select(*keep, "n_words", *[F.transform(F.filter("_all", test), said).alias(name) for name, test in (("_base", lambda x: x["rule"] < len(BASE)), ("_own", lambda x: x["rule"] >= len(BASE)))])
    found = found.withColumn("detections", F.when(F.size("_own") > 0, survivors(F.col("_own"))).otherwise(none))
    names = lambda c: F.array_distinct(F.transform(c, lambda x: x["label"]))
    starts = F.transform("_base", lambda x: x["start"].cast("long"))
    return found.select(
        *keep,
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(names(F.col("_base"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names(F.col("_base")), names(F.col("detections")))), ",").alias("labels"),
        (F.coalesce(F.array_max(F.transform(F.concat("_base", "detections"), lambda x: x["priority"])), F.lit(0)) / 100.0).alias("score"),
        "detections",
    )


def digest(docs: DataFrame) -> DataFrame:
    return license_scan(docs).drop("detections")


def _sql() -> str:
    """The same in SQL. Words stand between two blanks there, so that neighbouring matches needn't share one."""
    double = lambda p: p.replace(" ", "  ")
    groups = [(p, p, f"'{name}'", str(BASE_PRIORITY), True) for p, name in BASE]
    for keyword, rules in _groups():
        whole = " ".join(f"WHEN regexp_full_match(m, ' (?:{double(r.pattern)}) ') THEN" + " {}" for r in rules)
        name, priority = whole.format(*(f"'{r.label}'" for r in rules)), whole.format(*(r.priority for r in rules))
        groups.append((keyword, "|".join(r.pattern for r in rules), f"CASE {name} END", f"CASE {priority} END", False))
    count = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    parts = []
    for keyword, pattern, name, priority, base in groups:
        p = f" (?:{double(pattern)}) "
        parts.append(f"""
  SELECT doc_id, {str(base).lower()} AS base, s // 2 AS s, s // 2 + {count("m")} // 2 AS e, {priority} AS priority, {name} AS label FROM (
    SELECT doc_id, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda x: {count("x")})) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: {count("x")})), 0) AS s FROM (
      SELECT doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(w, '{p}') AS ms, regexp_split_to_array(w, '{p}') AS gs FROM d WHERE contains(w, '{double(" " + keyword if base else keyword)}'))))""")
    return f"""WITH t AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g') AS x FROM documents),
d AS (SELECT doc_id, CASE WHEN trim(x) = '' THEN '' ELSE ' ' || replace(trim(x), ' ', '  ') || ' ' END AS w FROM t),
hit AS ({" UNION ALL ".join(parts)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, priority DESC, label) AS n FROM hit WHERE NOT base),
walk AS (
  SELECT * FROM ranked x WHERE NOT EXISTS (SELECT 1 FROM ranked y WHERE y.doc_id = x.doc_id AND y.n <> x.n AND y.s <= x.s AND y.e >= x.e AND y.priority >= x.priority
    AND (y.s < x.s OR y.e > x.e OR y.priority > x.priority OR y.n < x.n))
), every AS (
  SELECT doc_id, true AS base, s, label, priority FROM hit WHERE base UNION ALL SELECT doc_id, false, NULL, label, priority FROM walk
)
SELECT d.doc_id, any_value(CAST({count("w")} // 2 AS BIGINT)) AS n_words, count(*) FILTER (WHERE base) AS n_base, CAST(min(s) AS BIGINT) AS first_word, CAST(max(s) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(priority), 0) / 100::DOUBLE AS score
FROM d LEFT JOIN every USING (doc_id) GROUP BY d.doc_id"""


SQL = _sql()
