from __future__ import annotations

import builtins
import importlib
import os
import sys

import pytest

import __spark_entry__ as driver
from checks import oracle, registry

pytestmark = pytest.mark.skipif(
    not os.path.isdir(driver.SMOKE_DIR), reason="no test tables"
)


def test_entry_gives_rows(spark):
    df = driver.entry(spark)
    assert df.columns[0] == "date"
    assert df.count() == 36


def test_each_query_of_the_engine_has_sql_and_the_other_way_round():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(registry.queries()) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("absent", ["spokeworks.llm", "corpus_pipeline", "public_tokenizers", "xxhash"])
def test_the_engine_does_without_the_operators_for_training_data(monkeypatch, absent):
    real = builtins.__import__

    def refuse(name, globals=None, locals=None, fromlist=(), level=0):
        if name == absent or name.startswith(f"{absent}.") or absent in {f"{name}.{x}" for x in fromlist or ()}:
            raise ModuleNotFoundError(f"No module named {absent!r}", name=absent)
        return real(name, globals, locals, fromlist, level)

    with monkeypatch.context() as m:
        for name in list(sys.modules):
            if name.startswith(("spokeworks.llm", "corpus_pipeline", absent)):
                m.delitem(sys.modules, name)
        m.setattr(builtins, "__import__", refuse)
        alone = importlib.reload(driver)
        assert set(alone.queries()) == set(registry.queries())
        assert set(alone.oracle_sql()) == set(oracle.oracle_sql())
    importlib.reload(driver)
