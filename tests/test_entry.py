import importlib.util
import os

from conftest import ROOT


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    mod = _entry()
    df = mod.entry(spark)
    assert df.count() > 0
    assert {"series", "week_end", "prediction", "lower_bound", "upper_bound"} <= set(df.columns)


def test_every_oracle_has_a_query():
    mod = _entry()
    assert set(mod.oracle_sql()) <= set(mod.queries())


def test_entry_without_the_llm_subpackage(monkeypatch):
    import sys

    for name in [n for n in sys.modules if n.startswith("paxcast.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "paxcast.llm", None)
    mod = _entry()
    assert "weekly_forecast" in mod.queries() and not any(q.startswith("op1_") for q in mod.queries())
    assert set(mod.oracle_sql()) <= set(mod.queries())
