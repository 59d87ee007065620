import hashlib
import random
import re

import xxhash
from veilframe.llm import fingerprints as P


def brute_fp(text):
    votes, total = [0] * 64, 0
    for w in filter(None, re.split(r"[\x20\x09-\x0D]+", (text or "").lower())):
        h, weight = xxhash.xxh64_intdigest(w.encode(), 42), min(len(w), 16) ** 2
        total += weight
        for b in range(64):
            votes[b] += weight * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def brute(rows):
    """rows: (doc_id, text), ids may be null or repeat."""
    key = lambda i: float("-inf") if i is None else i
    ids = sorted({i for i, _ in rows}, key=key)
    lead = {i: min((t or "" for j, t in rows if j == i), key=lambda t: hashlib.md5(t.encode()).hexdigest()) for i in ids}
    fps = [brute_fp(t) for _, t in rows]
    out = []
    for i, t in rows:
        t, n = t or "", len(t or "")
        after = lead[ids[ids.index(i) - 1]]
        edited = t[: n - n // 3] + after[: n // 3]
        a, b, c = brute_fp(t), brute_fp(edited), brute_fp(after)
        near = lambda x, y: 1 - (x ^ y).bit_count() / 64
        n_near = None if i is None or i % 100 else sum((a ^ f).bit_count() <= 3 for f in fps) - 1
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", near(a, b), near(a, c), n_near))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = ["a", "the", "Straße", "éclair", "日本語", "𝄞𝄞", "longestwordsinthistextareweighted", "x\x1fy"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)]
    rows = [(rng.choice([-1, 1]) * i * 7**rng.randint(0, 9), t) for i, t in enumerate(texts)]
    rows += [(None, "null id"), (None, None), (5, ""), (5, "b b"), (5, "a a a"), (5, "a a a"), (6, "w " * 30_000)]
    rows += [(100 * i, t) for i, t in enumerate(texts[:9], 1)] + [(-500, texts[3]), (100, "second of its id"), (None, None)]
    df = spark.createDataFrame([(i, t, "n", 3) for i, t in rows], "doc_id long, text string, fp string, n long")
    got = sorted((tuple(r) for r in P.digest(df).collect()), key=repr)
    assert got == brute(rows)


def test_ids_of_one_text_each(spark):
    rows = [(50 * i, "some words here " * (i % 4)) for i in range(30)]
    assert sorted((tuple(r) for r in P.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr) == brute(rows)


def test_long_texts_weigh_less(spark):
    df = spark.createDataFrame([("a" * k,) for k in (0, 1, 3, 4, 16, 40)], "term string")
    got = df.select(P.weight(df.term, P.F.lit(5)).alias("a"), P.weight(df.term, P.F.lit(P.LONG_TEXT)).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(0, 0), (1, 1), (9, 1), (16, 1), (256, 16), (256, 16)]


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(3, "one two three")], "doc_id long, text string")
    assert sorted(map(tuple, P.digest(df).collect())) == brute([(3, "one two three")])
    assert P.digest(df.limit(0)).count() == 0


def test_block_tables_find_all(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = list(base)
    for f in base:
        for bits in range(1, 6):
            g = f
            for b in rng.sample(range(64), bits):
                g ^= 1 << b
            fps.append(g)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps + fps[:9]], "fp long")
    q = df.limit(40)
    queries = [r.fp & (1 << 64) - 1 for r in q.collect()]
    got = sorted((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1, r.bits) for r in P.near(q, df, 3, 6).collect())
    assert got == sorted((a, b, (a ^ b).bit_count()) for a in set(queries) for b in set(fps) if (a ^ b).bit_count() <= 3)


def test_native(spark):
    df = spark.createDataFrame([(3, "one two three")], "doc_id long, text string")
    plan = P.digest(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
