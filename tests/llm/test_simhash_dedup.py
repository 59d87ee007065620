import numpy as np
import pytest
import xxhash
from veilframe.llm import components, simhash_dedup as S


def brute_fp(text, words):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        parts = parts.replace(c, " ")
    parts = [p for p in parts.split(" ") if p]
    grams = [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([" ".join(parts)] if parts else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


TEXTS = [None, "", " \n", "one", "One", "one two", "a b c", "A b c", "É b c d", "x " * 40_000, "x " * 40_001, "a b c", "the quick brown fox jumps over the lazy dog"]


def test_fingerprints(spark):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r.fingerprint for r in S.digest(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()}
    assert got == {i: f"{brute_fp(t, 3):016x}" for i, t, _ in rows}
    spark_h = spark.sql("select xxhash64('one two three') h").first().h & (1 << 64) - 1
    assert spark_h == xxhash.xxh64_intdigest(b"one two three", 42)


def clustered(rng, n, near):
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = [base]
    for _ in range(near):
        flips = np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        out.append(out[-1] ^ flips)
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
@pytest.mark.parametrize("block", [16, 1 << 17])
def test_local_pairs_are_all_pairs(radius, block, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = np.random.default_rng(radius)
    points = clustered(rng, 120, 5)
    home = rng.random(len(points)) < 0.6
    got = {tuple(sorted(p)) for i, j in S.pairs(points, home, radius) for p in zip(i.tolist(), j.tolist(), strict=True)}
    near = np.argwhere(np.triu(np.bitwise_count(points[:, None] ^ points) <= radius, 1))
    assert got == {(i, j) for i, j in near.tolist() if home[i] or home[j]}


def test_shards_meet_every_pair():
    rng = np.random.default_rng(3)
    points = clustered(rng, 400, 6)
    node = S.tree(points[rng.permutation(len(points))[:200]], 16)
    homes, where = {}, {}
    for shard, home, at in S.visits(node, points, 2):
        for k in at.tolist():
            where.setdefault(k, set()).add(shard)
            if home:
                assert homes.setdefault(k, shard) == shard
    assert len(homes) == len(points) and len(set(homes.values())) > 8
    for i, j in np.argwhere(np.triu(np.bitwise_count(points[:, None] ^ points) <= 2, 1)).tolist():
        assert homes[i] in where[j] or homes[j] in where[i]


@pytest.mark.parametrize(("rows", "most"), [(40, 1 << 15), (10, 4)])
def test_components_over_shards(spark, monkeypatch, rows, most):
    """Also of shards that are dealt into parts, as there may be no more of them."""
    monkeypatch.setattr(S, "SHARD_ROWS", rows)
    monkeypatch.setattr(S, "MOST_SHARDS", most)
    rng = np.random.default_rng(5)
    points = clustered(rng, 100, 4)
    ids = rng.permutation(len(points))
    df = spark.createDataFrame([(int(np.int64(p.view(np.int64))), int(i)) for p, i in zip(points, ids, strict=True)], "fp long, rep long")
    got = {r.a.rep: r.b.rep for r in components.roots(S.near_links(df, 2)).collect()}
    order = np.argsort(ids)
    want = brute_components([int(p) for p in points[order]], 2)
    assert [got.get(i, i) for i in range(len(points))] == want


def test_long_chains(spark):
    links = [(i + 1, i) for i in range(60)] + [(200, 100), (300, 200), (300, 150)]
    got = {r.a: r.b for r in components.roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {150: 100, 200: 100, 300: 100}


def test_components_of_documents(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 300, 400)]
    texts = [" ".join(words), " ".join(words).upper(), " ".join([*words, "end"]), "solo text here now", None, "", " ".join(words)]
    rows = [(10 + i, t, "c") for i, t in enumerate(texts)] + [(None, "solo text here now", "c"), (None, "nobody else says this", None)]
    got = S.digest(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    fps = [int(r.fingerprint, 16) for r in got]
    root = brute_components(fps, 2)
    for r, k in zip(got, root, strict=True):
        members = [x.doc_id for x, m in zip(got, root, strict=True) if m == k and x.doc_id is not None]
        assert r.component_id == min(members, default=None)
    assert S.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
