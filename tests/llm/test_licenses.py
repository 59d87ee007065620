import random
import re

from veilframe.llm import licenses as L

BASE = [(p.split(), n) for p, n in L.BASE]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, n) for p, n in BASE for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in places}))


TEXTS = [
    None, "", " \n\t", "word", "cc by", "CC-BY cc by, cc  by", "x cc by cc by y", "ccby xcc by", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "All Rights Reserved. all rights reserved" * 3,
    "général public licence é cc by é", "general public license " * 500, "K cc by", "a" * 200_000, "SPDX-License-Identifier: MIT and BSD license",
    "Released under the MIT License.", "CC BY-SA 4.0", "all rights\x85reserved",
]


def test_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "x"), (None, "cc by", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = L.license_scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "cc by" if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text and text[:60]
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    by = {r.doc_id: r.labels for r in got}
    assert by[8] == "apache-2.0" and by[9] == "gpl,gpl-3" and by[16] == "mit" and by[17] == "cc-by,cc-by-sa-4.0" and by[15] == "bsd,mit"


def brute_survivors(found):
    """Each interval against all others."""
    place = sorted(range(len(found)), key=lambda k: (found[k][0], -found[k][1], -found[k][2], found[k][3]))
    rank = {k: i for i, k in enumerate(place)}
    gone = lambda k, o: found[o][0] <= found[k][0] and found[o][1] >= found[k][1] and found[o][2] >= found[k][2] and (found[o][:3] != found[k][:3] or rank[o] < rank[k])
    return [found[k] for k in place if not any(gone(k, o) for o in range(len(found)) if o != k)]


def test_containment(spark):
    rng = random.Random(4)
    rows = [[(0, 5, 40, "a"), (1, 3, 40, "b"), (1, 3, 60, "c"), (4, 7, 10, "d"), (0, 5, 30, "e")], [(0, 10, 90, "a"), (2, 12, 10, "b"), (3, 9, 50, "c")], []]
    for n in (3, 10, 300):
        starts = [(rng.randrange(n), rng.randrange(1, 9)) for _ in range(n)]
        rows += [[(s, s + size, rng.choice((10, 20, 20, 30)), rng.choice("abc")) for s, size in starts]]
    df = spark.createDataFrame([(r,) for r in rows], f"f array<{L.DETECTION}>")
    got = [[tuple(x) for x in r[0]] for r in df.select(L.survivors(df.f)).collect()]
    assert got == [brute_survivors(r) for r in rows]
    assert [x[3] for x in got[0]] == ["a", "c", "d"] and [x[3] for x in got[1]] == ["a", "b"]


def test_labels_against_brute_force(spark):
    """All rules in Python, leftmost first within a family, on texts that are made of names, versions and notices."""
    rng = random.Random(7)
    parts = [name for _, _, names, _ in L.FAMILIES for name in names] + [w for _, w, _ in L.NOTICES] + ["version 2", "v2.0", "3.0", "or any later version", "spdx license identifier", "cc by sa 4 0", "creative commons attribution", "2 0 unported", "x"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(150)]
    want = []
    for t in texts:
        n = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)) + " "
        found = []
        for _, rules in L._groups():
            for m in re.finditer(f"(?<= )(?:{'|'.join(r.pattern for r in rules)})(?= )", n):
                r = next(r for r in rules if re.fullmatch(r.pattern, m[0]))
                start = n[: m.start()].count(" ") - 1
                found.append((start, start + m[0].count(" ") + 1, r.priority, r.label))
        want.append([x for x in brute_survivors(found)])
    got = {r.doc_id: r for r in L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, w in enumerate(want):
        assert sorted(map(tuple, got[i].detections)) == sorted(w), texts[i]
        assert got[i].labels == ",".join(sorted({x[3] for x in w} | set(filter(None, got[i].base_labels.split(",")))))


def test_many_detections_in_one_text(spark):
    df = spark.createDataFrame([(1, "mit license " * 100_000)], "doc_id long, text string")
    r = L.license_scan(df).first()
    assert r.labels == "mit" and len(r.detections) == 100_000 and r.detections[-1].start == 199_998


def test_spelled():
    assert L.spelled("a(?: or (?:any )?later(?: version)?)?") == ["a", *("a or later", "a or later version", "a or any later", "a or any later version")]
    for r in L.RULES:
        assert all(re.fullmatch(r.pattern, x) for x in L.spelled(r.pattern))


def test_empty_table(spark):
    assert L.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rules_are_many_and_ordered():
    assert len(L.RULES) > 300 and [r.priority for r in L.RULES] == sorted((r.priority for r in L.RULES), reverse=True)


def test_every_name_alone(spark):
    rows = [(label, name) for label, _, names, _ in L.FAMILIES for name in names]
    rows += [(f"{label}-{said}", f"{name} version {v}") for label, _, names, versions in L.FAMILIES for name in names for v, said in versions.items()]
    rows += [(label, f"creative commons {name}") for name, label in L.CC_NAMES.items()] + [(label, words) for label, words, _ in L.NOTICES]
    df = spark.createDataFrame([(i, f"x {text.upper()}.") for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in L.license_scan(df).collect()}
    assert [(text, label) for i, (label, text) in enumerate(rows) if label not in got[i]] == []


def test_needles_are_in_every_rule():
    for keyword, rules in L._groups():
        for r in rules:
            assert any(n in L.fixed_part(r.pattern) for n in L.needles(keyword, rules)) and re.search(L.GATE, L.fixed_part(r.pattern))
