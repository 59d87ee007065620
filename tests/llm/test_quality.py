import zlib

import numpy as np
import pytest
from veilframe.llm import quality as Q


def doc(rng, bad):
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(rng.integers(20, 200))]
    return " ".join(w + "$$$" * bad for w in words)


def corpus(n):
    rng = np.random.default_rng(0)
    return [(i, doc(rng, i % 4 == 0), int(i % 4 != 0)) for i in range(n)]


def test_chunks_cover_all_bytes():
    for n in [0, 1, Q.CHUNK, Q.CHUNK + 1, Q.STRIDE * 3 + Q.CHUNK, 5000]:
        data = bytes(i % 256 for i in range(n))
        got = Q.chunks(data)
        assert len(got) == Q.starts(n)
        seen = set()
        for k, c in enumerate(got):
            at = max(0, min(k * Q.STRIDE, n - Q.CHUNK))
            assert bytes(c[c != Q.END].astype(np.uint8)) == data[at : at + Q.CHUNK]
            seen |= set(range(at, min(n, at + Q.CHUNK)))
        assert len(seen) == n
        assert np.array_equal(Q.chunks(data, len(got) - 1), got[-1:])


def brute_score(m, data):
    """The network by its definition, one window of one filter at a time."""
    n = len(data)
    begins = [0] if n <= Q.CHUNK else sorted({min(k * Q.STRIDE, n - Q.CHUNK) for k in range(n)})
    units = []
    for at in begins:
        x = [*data[at : at + Q.CHUNK]]
        live = max(1, min(Q.WINDOWS, -(-len(x) // Q.WINDOW)))
        x += [Q.END] * (Q.CHUNK - len(x))
        pooled = [[max(0.0, max(float(sum(m.table[j][x[s + j]][f] for j in range(Q.WIDTH))) for s in range(w * Q.WINDOW, (w + 1) * Q.WINDOW)) + m.bias[f]) for w in range(live)] for f in range(Q.FILTERS)]
        values = [sum(p) / live for p in pooled] + [max(p) for p in pooled]
        units.append([max(0.0, sum(v * m.mix[i][u] for i, v in enumerate(values)) + m.mix_bias[u]) for u in range(Q.HIDDEN)])
    both = [max(u) for u in zip(*units, strict=True)] + [sum(u) / len(units) for u in zip(*units, strict=True)]
    return 1 / (1 + np.exp(-(sum(v * w for v, w in zip(both, m.out, strict=True)) + m.out_bias[0])))


def test_score_against_brute_force():
    rng = np.random.default_rng(8)
    m = Q.new_model()
    m.bias += rng.standard_normal(Q.FILTERS).astype(np.float32) * 0.3
    texts = [b"", b"\0", b"a", b"ab" * 40, bytes(rng.integers(0, 256, Q.CHUNK)), bytes(rng.integers(0, 256, 900))]
    assert np.allclose(Q.score(m, texts), [brute_score(m, t) for t in texts], atol=1e-5)


def test_nul_characters_hide_nothing():
    m = Q.new_model()
    same = b"word " * 28 + bytes(100)
    assert Q.score(m, [same + b"x" * 60])[0] != Q.score(m, [same + b"q" * 60])[0]


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    m = Q.new_model()
    m.bias += 0.5
    x, first, y = rng.integers(97, 123, (5, Q.CHUNK)).astype(np.uint16), np.array([0, 2]), np.array([1, 0], np.float32)
    x[4, 100:] = Q.END
    for p in m.params():
        p[...] = p.astype(np.float32)

    def loss():
        logit, _ = Q.pooled_logits(m, Q.chunk_values(m, x)[0], first)
        return float(np.mean(np.log1p(np.exp(-logit.astype(np.float64) * (2 * y - 1)))))

    for a, b in zip(Q.gradients(m, x, first, y), Q.gradients(m, x, first, y, block=2), strict=True):
        assert np.allclose(a, b, atol=1e-6)
    for p, g in zip(m.params(), Q.gradients(m, x, first, y), strict=True):
        for k in np.argsort(-np.abs(g).ravel())[:3]:
            at = np.unravel_index(k, p.shape)
            old, e = p[at], 2e-3
            p[at] = old + e
            up = loss()
            p[at] = old - e
            down = loss()
            p[at] = old
            assert (up - down) / (2 * e) == pytest.approx(g[at], rel=0.15, abs=2e-4)


def test_score_does_not_depend_on_company():
    rng = np.random.default_rng(4)
    m = Q.new_model()
    texts = [doc(rng, k % 2).encode() for k in range(9)] + [b"", b"x" * 400_000]
    alone = np.concatenate([Q.score(m, [t]) for t in texts])
    assert np.allclose(Q.score(m, texts), alone, atol=1e-5)


def test_held_out_accuracy(spark):
    rows = corpus(1200)
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t, _ in rows] + [(5000, None, None, 1), (5001, "", "xx", 0), (None, "aa bb", "en", 0)], "doc_id long, text string, lang string, quality int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = Q.digest(docs, labels).collect()
    assert len(got) == len(rows) + 3
    truth, right = {i: q for i, _, q in rows}, []
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id])
    assert len(right) > 300 and np.mean(right) > 0.97


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.digest(docs, labels).collect()] == [0.5]
    assert Q.digest(docs.limit(0), labels).count() == 0
