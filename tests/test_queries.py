"""Every core query against its SQL counterpart on the smallest tables; the entry points."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from qaloom.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]


def cell(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    return x


def same(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([cell(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = df.collect()
    if name in catalogue.ORACLES:
        want = con.sql(catalogue.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert same(df.columns, rows) == same(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_the_llm_subpackage():
    code = "import sys; sys.modules['qaloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('p1_') for k in q) and 'p6_found' in q; import qaloom.plans.catalogue; assert not any(m.startswith('qaloom.llm.') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
