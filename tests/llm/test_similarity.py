import random

import numpy as np
from veilframe.llm import similarity as S
from veilframe.llm.simhash_dedup import fingerprint, hashes, shingles


def words(rng, n):
    return ["w%d" % rng.randint(0, 5000) for _ in range(n)]


def corpus():
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        base = words(rng, rng.randint(30, 300))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 6, 30])):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randint(0, 99)
            texts.append(" ".join(copy).upper())
    rng.shuffle(texts)
    return [*texts, None, "", "one two", "One  two", "x " * 30_000]


def alike(a, b):
    x, y = set(shingles(a, 5)), set(shingles(b, 5))
    return len(x & y) / len(x | y) >= 0.8 if x | y else True


def brute(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike(texts[i], texts[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def test_components_against_all_pairs(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, root string")
    got = {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    kept = sorted(r.doc_id for r in S.one_of_each(df).collect())
    assert kept == sorted(set(brute(texts)))


def test_repeated_and_null_ids(spark):
    a, b = "a b c d e f g h", "i j k l m n o p"
    df = spark.createDataFrame([(1, a), (1, a), (2, b), (None, b), (None, "q r s t u v"), (3, a + " x")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in S.one_of_each(df).collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (None, "q r s t u v")], key=repr)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_one_large_group(spark):
    base = words(random.Random(1), 200)
    rows = [(i, " ".join([*base[: i % 190], f"edit{i}", *base[i % 190 + 1 :]])) for i in range(400)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_bucket_whose_ends_are_unlike_the_rest(spark):
    """A template that all share, at 0.787 below the threshold; pairs that share one more shingle reach 0.802."""
    rng = random.Random(8)
    shared, rows = words(rng, 100), []
    for k in range(60):
        own = lambda: ["own%d" % rng.randrange(1 << 40) for _ in range(13)]
        first = own()
        rows.append(" ".join([*shared, *first]))
        if k % 3 == 0:
            rows.append(" ".join([*shared, first[0], *own()[1:]]))
    rng.shuffle(rows)
    want = brute(rows)
    assert len(set(want)) == 60
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_equal_fingerprints_with_an_unlike_first(spark):
    """Three texts of one fingerprint; the second and third are alike, but share no band and the first is like neither."""
    rng = random.Random(5)
    long = "x " * 1000
    own = lambda n: " ".join("own%d" % rng.randrange(1 << 40) for _ in range(n))
    sketch = lambda t: set(S.bands(np.unique(hashes(t, 5))))
    while True:
        shared = own(40)
        b, c = (f"{long}{shared} {own(5)}" for _ in range(2))
        if not sketch(b) & sketch(c):
            break
    texts = [long + own(45), b, c]
    assert len({fingerprint(hashes(t, 5)) for t in texts}) == 1 and alike(b, c) and brute(texts) == [0, 1, 1]
    got = S.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 1), (2, 1)]
