"""Every query with SQL against DuckDB on the smallest tables, and the driver's contract."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return repr(v) if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    df = entry.queries()[name](spark, sf_dir)
    want = db.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_contract(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
    with pytest.raises(ValueError):
        catalogue.query()(catalogue.QUERIES["o5_head"])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(entry.queries()["flt1_conjunction"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in text and "Exchange" not in text
    assert "o_orderdate" not in text.split("ReadSchema")[1]


def test_first_per_key_prunes_before_the_shuffle(spark, sf_dir):
    text = plan(entry.queries()["w1_distinct_on"](spark, sf_dir))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize(("name", "of"), [("o1_nulls_first", "customer"), ("o3_sort_default", "supplier")])
def test_whole_sorts_keep_all_rows(spark, sf_dir, name, of):
    rows = entry.queries()[name](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/{of}.parquet").count()
    if name == "o1_nulls_first":
        assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
    else:
        assert [(r["x"], r["s_suppkey"]) for r in rows] == sorted((r["x"], r["s_suppkey"]) for r in rows)


def test_leader_margin_reads_all_event_types(spark, sf_dir):
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    assert entry.queries()["w4_leader_margin"](spark, sf_dir).count() == users
