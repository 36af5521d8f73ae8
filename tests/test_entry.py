"""The registry and the entry module: no name twice, and no import error but that of absent folders is taken."""

import importlib
import sys

import pytest

from sedge.plans import catalogue


def test_no_name_twice():
    with pytest.raises(ValueError, match="b"):
        catalogue.merged([{"a": 1, "b": 2}, {"b": 3}])
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


class Broken:
    """Finds a module that is there but does not load."""

    def __init__(self, name, error):
        self.name, self.error = name, error

    def find_spec(self, name, path=None, target=None):
        if name == self.name:
            raise self.error


@pytest.mark.parametrize(
    "name, error, raises",
    [
        ("corpus_pipeline", ImportError("cannot import name 'x' from 'sedge.llm.common'", name="sedge.llm.common"), True),
        ("corpus_pipeline", ModuleNotFoundError("No module named 'sedge.llm.chat'", name="sedge.llm.chat"), True),
        ("corpus_pipeline", ModuleNotFoundError("No module named 'numpy'", name="numpy"), True),
        ("corpus_pipeline", ModuleNotFoundError("No module named 'corpus_pipeline'", name="corpus_pipeline"), False),
        ("corpus_pipeline", ModuleNotFoundError("No module named 'sedge.llm'", name="sedge.llm"), False),
    ],
)
def test_entry_takes_no_other_import_error(monkeypatch, name, error, raises):
    for m in ("__spark_entry__", name):
        monkeypatch.delitem(sys.modules, m, raising=False)
    monkeypatch.setattr(sys, "meta_path", [Broken(name, error), *sys.meta_path])
    if raises:
        with pytest.raises(ImportError):
            importlib.import_module("__spark_entry__")
    else:
        entry = importlib.import_module("__spark_entry__")
        assert "pipeline" not in entry.queries() and set(entry.queries()) == set(catalogue.QUERIES)
    sys.modules.pop("__spark_entry__", None)
