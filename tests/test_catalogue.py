"""Every query of the catalogue on the smallest tables, against its oracle in DuckDB where it has one."""

import ast
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from scholia.plans import catalogue
from scholia.plans.views import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        f = float(v)
        return None if math.isnan(f) else round(f, 7)
    return str(v)


def test_no_name_of_a_catalogue_is_given_twice():
    """A query's body reads its constants when it is called: a later constant of the same name would be read instead."""
    for path in Path(catalogue.__file__).parent.glob("*.py"):
        body = ast.parse(path.read_text()).body
        names = [t.id for n in body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)] + [n.name for n in body if isinstance(n, ast.FunctionDef)]
        assert not {n for n, k in Counter(names).items() if k > 1}, path


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert rows or name == "grf_violations"
        return
    got = oracle.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in got.fetchall())
