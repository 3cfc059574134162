import glob
import math
import os

import duckdb
import pytest

from groundwork import plans


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in plans.SQL:
        assert got
        return
    found = duck.execute(plans.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_entry_works_without_the_llm_subpackage(spark, monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name.startswith("groundwork.llm"):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", refuse)
    for name in [n for n in sys.modules if n.startswith("groundwork.llm") or n == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(plans.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
    sys.modules.pop("__spark_entry__", None)


def test_nothing_outside_imports_llm():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "groundwork")
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path, encoding="utf-8") as f:
                assert "groundwork.llm" not in f.read(), path
