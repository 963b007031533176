"""The entry point without what is optional."""

import sys
import warnings


def test_entry_stands_without_the_training_data_operators(monkeypatch):
    import __spark_entry__ as e

    everything = set(e.queries())
    monkeypatch.setitem(sys.modules, "dqspark.llm.queries", None)  # as if a dependency were missing
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        left = set(e.queries())
        assert set(e.oracle_sql()) <= left
    assert left and left <= everything and not any(n.startswith("op") and n[2:3].isdigit() for n in left) and "pipeline" not in left
