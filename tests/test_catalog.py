"""Every catalogued query with SQL gives the same rows as DuckDB."""

import math

import duckdb
import pytest

from strandlake.plans import catalog, mapped, roundtrips  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(same(v) for v in r) for r in zip(*[table.column(n).to_pylist() for n in names], strict=True)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, db, name):
    want = db.sql(catalog.ORACLES[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    a, b = rows(catalog.QUERIES[name](spark, SF).toArrow()), rows(want)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    for x, y in zip(a[1], b[1], strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-5) for p, q in zip(x, y, strict=True)), (x, y)


def test_view_checksums(spark):
    from strandlake.sources import fixtures as X

    s = X.seg(spark, "/root/testdata/sf0.01").selectExpr("count(*)", "sum(7 * ind1 + 13 * ind2 + chrid)", "sum(s)", "sum(e)", "sum((s % 9973) * ind1)").first()
    assert tuple(s) == (58465, 19452773, 599243092000, 602211726000, 7393994320)
    r = X.rec(spark, "/root/testdata/sf0.01", line=7).selectExpr("count(*)", "sum(pos * genome)", "sum(allele * pos)").first()
    assert tuple(r) == (8248, 203384031, 12350791)


def test_driver_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
