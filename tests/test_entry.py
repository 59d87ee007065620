import sys

import __spark_entry__ as entry_points
import pytest
from veilframe.plans import queries as core

DATA = "/root/testdata/sf0.001"


def test_every_query_has_a_name_of_its_own():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(core.QUERIES) > 80 and set(core.SQL) <= set(core.QUERIES)


def test_core_works_without_the_llm_folder(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("veilframe.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "veilframe.llm", None)
    assert entry_points.queries().keys() == core.QUERIES.keys()


def test_without_the_pipeline_alone(monkeypatch):
    pytest.importorskip("veilframe.llm")
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry_points.queries()


def test_flagship(spark):
    assert {"email", "phone"} <= {r.pii_type for r in entry_points.entry(spark).collect()}
