"""Queries against their SQL on tables with odd values: prices of zero."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def rows_of(spark, folder, name):
    """(rows of the query, rows of its SQL) on the tables of a folder, in one order."""
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    text = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    return text(tuple(r) for r in entry.queries()[name](spark, str(folder)).select(*columns).collect()), text(want.fetchall())


@pytest.fixture
def zero_prices(tmp_path):
    """The small tables, every second event of value zero."""
    for f in os.listdir(SMALL):
        if f != "events.parquet":
            os.symlink(f"{SMALL}/{f}", tmp_path / f)
    duckdb.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE value END AS value) FROM '{SMALL}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    return tmp_path


@pytest.mark.parametrize("name", ["bar_features", "research_samples"])
def test_returns_after_a_price_of_zero(spark, zero_prices, name):
    got, want = rows_of(spark, zero_prices, name)
    assert got == want
    assert name == "research_samples" or any("inf" in r for r in got) and any("nan" in r for r in got)


def test_samples_hold_infinite_returns(spark, tmp_path):
    small = "/root/testdata/sf0.01"
    for f in os.listdir(small):
        if f != "events.parquet":
            os.symlink(f"{small}/{f}", tmp_path / f)
    duckdb.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE value END AS value) FROM '{small}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got, want = rows_of(spark, tmp_path, "research_samples")
    assert got == want and any("inf" in r for r in got)


def test_evidence_that_sums_in_another_order_is_stored_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.plans import landing

    plain = landing.v_daily
    last_bits = F.udf(lambda: int.from_bytes(os.urandom(2)) * 1e-9, "double").asNondeterministic()
    monkeypatch.setattr(landing, "v_daily", lambda *a: plain(*a).withColumn("close", F.col("close") + last_bits()))
    got = {r.ticker: (r.n, r.intact) for r in landing.evidence_store(spark, SMALL).collect()}
    want = {r.ticker: (r["count"], r["count"]) for r in plain(spark, SMALL).groupBy("ticker").count().collect()}
    assert got == want


def test_of_lines_with_one_number_the_first_stored_counts(spark, tmp_path):
    for f in os.listdir(SMALL):
        if f != "lineitem.parquet":
            os.symlink(f"{SMALL}/{f}", tmp_path / f)
    same = "CAST(1 + l_linenumber % 2 AS INTEGER) AS l_linenumber, CAST(1 AS BIGINT) AS l_orderkey, CASE WHEN l_partkey % 5 > 0 THEN l_extendedprice END AS l_extendedprice"
    duckdb.execute(f"COPY (SELECT * REPLACE ({same}) FROM '{SMALL}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got, want = rows_of(spark, tmp_path, "sector_heat")
    assert got == want
