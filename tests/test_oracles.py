"""Every query that SQL can express equals its DuckDB form."""

import duckdb
import pytest

from pulseforge.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rel = con.execute(registry.ORACLES[name])
    names = [c[0] for c in rel.description]
    kinds = {c[0]: str(c[1]) for c in rel.description}
    assert sorted(names) == cols
    want = ordered(tuple(r[names.index(c)] for c in cols) for r in rel.fetchall())
    assert ordered(tuple(r) for r in df.select(*cols).collect()) == want
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


@pytest.mark.parametrize("name", ["stage_one", "ecg_windows", "skna_windows", "beat_vectors"])
def test_recordings_are_ok(spark, name):
    """A recording that fails gives a row too, so their share is looked at."""
    shares = registry.QUERIES[name](spark, DIR).groupBy("status").count().collect()
    assert {r["status"] for r in shares} == {"ok"}, shares
