import pytest
from oracle import DATA, same

from ocellus.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    same(spark, name, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry_imports_without_llm(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "ocellus.llm", None)
    monkeypatch.setitem(sys.modules, "ocellus.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    try:
        assert not [q for q in entry.queries() if q.startswith("op")] and "hamming_topk" in entry.queries()
    finally:
        sys.modules.pop("__spark_entry__", None)
