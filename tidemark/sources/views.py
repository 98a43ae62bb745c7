"""Market-shaped views of the test tables: each as a DataFrame and as SQL with the same columns.

The names in SQL are those of the functions. A view uses only the tables and views before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: events other than quotes. Receipt lags by event_id % 7 minutes, so it is out of order."""
    return (
        table(spark, sf_dir, "events")
        .where("event_type NOT IN ('signup', 'error')")
        .selectExpr(
            "event_id",
            "user_id % 5 AS target",
            "ts AS exchange_ts",
            "ts + make_interval(0, 0, 0, 0, 0, CAST(event_id % 7 AS INT), 0) AS received_ts",
            "value AS price",
            "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS volume",
            "CASE event_type WHEN 'click' THEN 'buy' WHEN 'view' THEN 'sell' ELSE 'unknown' END AS side",
        )
    )


def v_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where("event_type IN ('signup', 'error')")
        .selectExpr(
            "event_id",
            "user_id % 5 AS target",
            "ts AS exchange_ts",
            "ts + make_interval(0, 0, 0, 0, 0, CAST(event_id % 7 AS INT), 0) AS received_ts",
            "value - 0.5 AS bid",
            "value + 0.5 AS ask",
            "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS depth",
        )
    )


def v_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of ten tickers; bars without a range are left out."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            (F.col("l_suppkey") % 10).alias("ticker"),
            F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
            "l_extendedprice", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        )
        .groupBy("ticker", "date")
        .agg(
            F.min_by("l_extendedprice", "seq").alias("open"),
            F.max("l_extendedprice").alias("high"),
            F.min("l_extendedprice").alias("low"),
            F.avg("l_extendedprice").alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("turnover"),
        )
        .where("high > low")
    )


def v_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed order values by investor group, ticker and week."""
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .selectExpr(
            "o_custkey % 10 AS ticker",
            "CAST(date_trunc('week', o_orderdate) AS DATE) AS date",
            "c_mktsegment AS investor",
            "CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN -o_totalprice END AS net",
        )
    )


def v_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey AS code", "s_name AS name", "n_name AS industry")


def v_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings of ten funds: lots and value by stock."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 10 AS fund", "l_partkey AS code", "l_quantity AS lots", "l_extendedprice / l_quantity AS price", "CAST(l_shipdate AS DATE) AS date")


SQL = {
    "v_ticks": """SELECT event_id, user_id % 5 AS target, ts AS exchange_ts, ts + (event_id % 7) * INTERVAL 1 MINUTE AS received_ts,
        value AS price, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS volume,
        CASE event_type WHEN 'click' THEN 'buy' WHEN 'view' THEN 'sell' ELSE 'unknown' END AS side
        FROM events WHERE event_type NOT IN ('signup', 'error')""",
    "v_quotes": """SELECT event_id, user_id % 5 AS target, ts AS exchange_ts, ts + (event_id % 7) * INTERVAL 1 MINUTE AS received_ts,
        value - 0.5 AS bid, value + 0.5 AS ask, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS depth
        FROM events WHERE event_type IN ('signup', 'error')""",
    "v_daily": """SELECT l_suppkey % 10 AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
        arg_min(l_extendedprice, l_orderkey * 10 + l_linenumber) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
        avg(l_extendedprice) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover
        FROM lineitem GROUP BY 1, 2 HAVING max(l_extendedprice) > min(l_extendedprice)""",
    "v_flow": """SELECT o_custkey % 10 AS ticker, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, c_mktsegment AS investor,
        CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN -o_totalprice END AS net
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_company": "SELECT s_suppkey AS code, s_name AS name, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "v_holdings": """SELECT l_suppkey % 10 AS fund, l_partkey AS code, l_quantity AS lots, l_extendedprice / l_quantity AS price, CAST(l_shipdate AS DATE) AS date
        FROM lineitem""",
}


def with_views(body: str, *names: str, **more: str) -> str:
    """SQL text: the named views, then further ones given by text, then the body."""
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({t})" for n, t in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
