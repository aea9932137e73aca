import importlib
import sys

import __spark_entry__ as e


def test_contract(spark):
    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60
    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["rec", "idx", "x"]


def test_imports_without_the_text_folder(monkeypatch):
    gone = [m for m in sys.modules if m.startswith("pulseforge.llm") or m == "corpus_pipeline"]
    for m in [*gone, "pulseforge.llm", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, m, None)
    import pulseforge

    monkeypatch.delattr(pulseforge, "llm", raising=False)
    again = importlib.reload(e)
    assert "norm_expanding" in again.queries() and not any(k.startswith("op") and k[2].isdigit() for k in again.queries())
    monkeypatch.undo()
    importlib.reload(e)
