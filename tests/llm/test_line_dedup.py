import hashlib
import random

import pytest
from veilframe.llm import common, line_dedup as L


def brute(rows, min_docs=2):
    blank = " \t\n\v\f\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(blank))
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_docs or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(n, seed=0):
    rng = random.Random(seed)
    lines = ["short", "", "  A Line Of Words \t", "a line of words", "ÄÖÜäöüß 12345", "äÖÜäöüß 12345", "x" * 10, "x" * 9, "日本語日本語日本語日", *(f"only {i} stands here" for i in range(99))]
    rows = [(rng.choice([i, i, i - 1]), "\n".join(rng.choices(lines, k=rng.randint(0, 9)))) for i in range(n)]
    return [*rows, (None, "a line of words"), (None, None), (7, None), (8, ""), (9, "w\n" * 20_000 + "a line of words")]


@pytest.mark.parametrize("share", [common.HOT_SHARE, 30, 0])
def test_against_brute_force(spark, monkeypatch, share):
    """With all keys hot, some, and none."""
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = corpus(300)
    df = spark.createDataFrame([(i, t, "n", "k") for i, t in rows], "doc_id long, text string, n string, key string")
    assert sorted((tuple(r) for r in L.digest(df).collect()), key=repr) == brute(rows)


def test_more_documents(spark):
    rows = corpus(200, 3)
    got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=4).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=repr) == brute(rows, 4)


def test_empty_table(spark):
    assert L.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clean(spark, tmp_path):
    table = common.written(spark.range(3), "numbers")
    assert table.count() == 3
    common.clean(spark)
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.parquet(table.inputFiles()[0]).count()
