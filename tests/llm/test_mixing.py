import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from veilframe.llm import mixing as M


def brute(rows, weights=(3, 1, 2), share=1.5, most=2):
    """rows: (doc_id, text, source). Sorted (doc_id, size, source_size, target, taken)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))

    def good(t):
        return max(0.05, 1 - 4 * (1 - len(re.sub(r"[!$%&*#|]+", "", t)) / len(t))) if t else 1.0

    def key(i, t):
        u = (int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / good(t)

    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(total.values())
    while open_:
        over = [s for s in open_ if w[s] * left / sum(w[x] for x in open_) > most * total[s] or total[s] == 0]
        for s in over:
            target[s] = float(most * total[s])
        open_ -= set(over)
        left -= sum(target[s] for s in over)
        if not over:
            target |= {s: w[s] * left / sum(w[x] for x in open_) for s in open_}
            break
    out = []
    for s in order:
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest = math.floor(target[s]) - epochs * total[s]
        for i, t in sorted(((i, t) for i, t, x in rows if x == s), key=lambda r: (key(*r), r[0] is not None, r[0] or 0, size(r[1]), good(r[1]))):
            part = max(0, min(size(t), rest))
            rest -= size(t)
            out.append((i, size(t), total[s], target[s], epochs * size(t) + part))
    return sorted(out, key=repr)


def corpus(n):
    rng = random.Random(n)
    rows = [(i, " ".join(rng.choices(["word", "a", "$$$!!", "x\ty"], [5, 5, rng.randint(0, 9), 1], k=rng.randint(0, 40))), rng.choice("aaaabc")) for i in range(n)]
    same = [(None, "no id at all", "b")] * 7 + [(3, "three times the same", "a")] * 3 + [(3, "three times the other", "a")]
    return [*rows, *same, (None, None, None), (n, "", "empty"), (n + 1, "no source " * 9, None)]


@pytest.mark.parametrize("bucket", [2000, 10])
def test_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(M, "ROWS_AT_ONCE", 3)
    rows = corpus(400)
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, source string, size int, n string")
    got = sorted(map(tuple, M.digest(df).collect()), key=repr)
    want = brute(rows)
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_buckets_are_even_whatever_the_quality(spark):
    """A tenth of the rows is junk, whose keys reach twenty times further."""
    n, parts = 20_000, 40
    classes = [0] * M.CLASSES
    classes[0], classes[-1] = n // 10, n - n // 10
    rows = spark.range(n).select(M.exponential_key(M.F.col("id"), M.F.when(M.F.col("id") % 10 == 0, 0.05).otherwise(1.0)).alias("key"))
    of = M.F.floor(parts * M.share_below(M.F.col("key"), M.F.array(*map(M.F.lit, classes)), M.F.lit(n)))
    found = Counter(r.b for r in rows.select(of.alias("b")).collect())
    assert len(found) == parts and max(found.values()) < 1.3 * n / parts


def test_repeated_rows(spark):
    rows = corpus(120)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.text) for r in M.repeated(df, ("doc_id", "text", "source")).collect())
    for source in "abc":
        words = sum(len((t or "").split()) * got[i, t] / sum((i, t) == (a, b) for a, b, _ in rows) for i, t, s in rows if s == source)
        target = next(r.target for r in M.groups(df).where(f"source = '{source}'").collect())
        assert abs(words - target) <= 40
    assert M.repeated(df.limit(0), ("doc_id", "text")).count() == 0 and M.digest(df.limit(0)).count() == 0


def test_native(spark):
    plan = M.digest(spark.createDataFrame(corpus(5), "doc_id long, text string, source string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
