import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from veilframe.llm import packing as P
from veilframe.llm import tokens


def test_ids_are_those_of_the_tokenizer_file():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    for s in ["", " a  b\n\n c", "It's WE'LL 12345 ½ é", "<|endoftext|> x<|endoftext|>", "日本語 テスト", "!!$$ --   x", "a" * 3000, "\x00\x1c\x85"]:
        assert tokens.ids(tokens.default_path(), s) == t.encode(s, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=5), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_fullest_against_all_subsets(counts, room):
    items = [k for k, n in counts.items() for _ in range(n)]
    best = max(s for r in range(len(items) + 1) for c in combinations(items, r) if (s := sum(c)) <= room)
    got = P.fullest(counts, room)
    assert sum(k * n for k, n in got.items()) == best and all(n <= counts[k] for k, n in got.items())


@given(st.dictionaries(st.integers(1, 63), st.integers(1, 500), max_size=12))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_piece_once(histogram):
    runs, n = P.plan(histogram, 64)
    assert sum(len(v) for v in runs.values()) < 64 * 10
    fill = defaultdict(list)
    for length, rs in runs.items():
        ends = [*(r.first for r in rs[1:]), histogram[length]]
        for r, end in zip(rs, ends, strict=True):
            for rank in range(r.first, end):
                fill[r.sequence + (rank - r.first) // r.each].append((r.offset + (rank - r.first) % r.each * length, length))
    assert sorted(fill) == list(range(n)) and sum(map(len, fill.values())) == sum(histogram.values())
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64


def checked(rows, capacity=P.CAPACITY):
    by = defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= capacity
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_sequences(spark):
    texts = [None, "", "a b c", "word " * 1023, "word " * 1024, "word " * 5000, *["short text"] * 300]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(0, None, 1), (None, "x", 1)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, length int")).collect()
    want = []
    for i, t, _ in rows:
        ids = np.array([*tokens.ids(tokens.default_path(), t or ""), 2], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(P.cuts(len(ids), 1024))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    total = sum(r.length for r in got)
    assert checked(got) <= -(-total // 1024) + 1


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blanks_without_end():
    """A run that the fast encoder refuses has the library's ids."""
    path = tokens.default_path()
    text = "a" + " " * 2_000_000 + "b c"
    got = tokens.ids(path, text)
    assert got == tokens.library(path).encode(text, add_special_tokens=False).ids and got[-1:] == tokens.ids(path, " c")
    for unit in ("x", "1", "!", "\n", "é"):
        assert tokens.ids(path, unit * 300_000) == tokens.library(path).encode(unit * 300_000, add_special_tokens=False).ids


def test_equal_rows(spark):
    df = spark.createDataFrame([(None, "the same row")] * 700 + [(1, "one")], "doc_id long, text string").repartition(2)
    got = P.pack(df).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 701
