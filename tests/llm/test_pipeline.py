import random
from collections import Counter

import pytest
from veilframe.llm import common, mixing

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def text(rng, bad=False):
    return "\n".join(" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) + "$$$" * bad for _ in range(rng.randint(8, 20))) + "." for _ in range(rng.randint(1, 6)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = [[i, text(rng, i % 5 == 0), "en", f"s{i % 3}", 0] for i in range(400)]
    for i in range(2, 100, 10):
        rows[i + 1][1] = rows[i][1]
    rows += [[400, None, None, None, None], [401, "", "en", "s0", 0]]
    for i in range(100, 130):
        rows[i][1] = (rows[i][1] or "") + "\nThis line stands in many documents."
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = common.documents(spark, folder)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = common.written(stage(spark, docs, folder), "test")
        rows = out.collect()
        if name != "best-fit packing":
            assert out.columns == list(corpus_pipeline.COLUMNS) and all(r.doc_id in before for r in rows)
        after = {r.doc_id: r for r in rows}
        if name == "quality classifier":
            wrong = [i for i in before if i is not None and i < 400 and (i in after) != (i % 5 != 0)]
            assert len(wrong) <= 8
        elif name == "line dedup":
            lines = Counter(x.strip().lower() for t in {i: r.text for i, r in after.items()}.values() for x in set(t.split("\n")) if len(x.strip()) >= 10)
            assert after.keys() == before.keys() and max(lines.values()) == 1
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "simhash near-dedup":
            texts = Counter((t or "").lower() for t in before.values())
            assert len(rows) == len(texts) and len(after) == len(rows)
        elif name == "mixing":
            times = Counter(r.doc_id for r in rows)
            assert max(times.values()) <= 2
            for r in mixing.groups(docs).select("source", "target").distinct().collect():
                words = sum(len((x.text or "").split()) for x in rows if x.source == r.source)
                assert abs(words - r.target) <= 120
        else:
            fill = Counter()
            for r in rows:
                fill[r.sequence_id] += r.length
            assert max(fill.values()) <= 1024 and Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
        seen[name], docs = len(rows), out
    assert len(seen) == 5
    assert corpus_pipeline.run(spark, folder).count() == seen["best-fit packing"]


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
