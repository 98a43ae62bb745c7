"""Queries that hold tables against each other: manifests, outcomes, experiments, guidance, opening books, interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import settled, settled_sql
from tidemark.operators import book as B
from tidemark.operators import evaluation as E
from tidemark.operators import samples as P
from tidemark.plans.screening import _FEATURES, _features
from tidemark.registry import query
from tidemark.sources import storage as T
from tidemark.sources.views import table, v_quotes, v_ticks, with_views


@query("SELECT o_custkey, count(*) AS n, sha256(string_agg('order-' || o_orderkey, chr(10) ORDER BY 'order-' || o_orderkey)) AS manifest_hash FROM orders GROUP BY 1")
def ordered_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash over each customer's order ids in their order as texts."""
    x = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("id"))
    return T.manifest_hash(x, ["o_custkey"]).select("o_custkey", "n", "manifest_hash")


@query("""SELECT o_orderkey, CASE WHEN h IS NULL THEN 'missing' WHEN h <> md5(CAST(year(o_orderdate) AS VARCHAR)) THEN 'hash' ELSE 'joined' END AS problem, CASE WHEN h = md5(CAST(year(o_orderdate) AS VARCHAR)) THEN outcome END AS outcome FROM orders
    LEFT JOIN (SELECT l_orderkey, md5(CAST(year(max(l_shipdate)) AS VARCHAR)) AS h, CAST(count(*) AS BIGINT) AS outcome FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) ON l_orderkey = o_orderkey""")
def joined_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their kept lines, which agree where the last was shipped in the year of the order."""
    predictions = table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.year("o_orderdate").cast("string")).alias("source_hash"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    outcomes = lines.agg(F.md5(F.year(F.max("l_shipdate")).cast("string")).alias("source_hash"), F.count("*").alias("outcome"))
    joined, bad = E.outcomes_of_predictions(predictions, outcomes, "o_orderkey", "source_hash")
    return joined.select("o_orderkey", F.lit("joined").alias("problem"), "outcome").unionByName(bad.withColumn("outcome", F.lit(None).cast("long")))


_SIDE = "SELECT o_custkey, max(o_orderstatus) AS dataset_version, CAST(count(*) AS VARCHAR) AS fold_plan, min(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS cost_assumption, max(o_orderpriority) AS label_version, CAST(month(min(o_orderdate)) AS VARCHAR) AS period FROM orders WHERE o_orderkey % 2 = {0} GROUP BY 1"


@query("SELECT o_custkey, array_to_string(list_filter([" + ", ".join(f"CASE WHEN a.{n} IS DISTINCT FROM b.{n} THEN '{n}' END" for n in E.CONTEXT) + f"], lambda x: x IS NOT NULL), ',') AS mismatches FROM ({_SIDE.format(0)}) a JOIN ({_SIDE.format(1)}) b USING (o_custkey)")
def experiment_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's even and odd orders as two experiments: in which parts of their context they differ."""

    def side(k: int) -> DataFrame:
        return table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == k).groupBy("o_custkey").agg(
            F.max("o_orderstatus").alias("dataset_version"), F.count("*").cast("string").alias("fold_plan"), F.min(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("cost_assumption"),
            F.max("o_orderpriority").alias("label_version"), F.month(F.min("o_orderdate")).cast("string").alias("period"),
        )

    return E.incomparable(side(0), side(1), ["o_custkey"]).select("o_custkey", F.array_join("mismatches", ",").alias("mismatches"))


_GUIDE = {
    "pr": "SELECT target, exchange_ts AS snapshot_ts, bid AS best_bid, ask - CASE WHEN depth % 7 = 0 THEN 1 ELSE 0 END AS best_ask, CASE WHEN depth % 2 = 0 THEN ask ELSE bid END AS active_entry, bid - 1 AS patient_entry, ask + depth % 5 - 2 AS take_profit, bid - 2 AS stop_loss FROM v_quotes",
    "pr1": "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY target, snapshot_ts ORDER BY best_bid DESC, best_ask DESC, active_entry DESC, patient_entry DESC, take_profit DESC) AS r FROM pr) WHERE r = 1",
}


@query(with_views("""SELECT t.event_id, CASE WHEN p.snapshot_ts IS NULL THEN 'missing_snapshot' WHEN epoch_us(t.exchange_ts - p.snapshot_ts) / 1e6 > 7200 THEN 'stale_snapshot' WHEN best_ask <= best_bid THEN 'invalid_spread' WHEN NOT (stop_loss <= patient_entry AND patient_entry <= active_entry AND active_entry <= take_profit) THEN 'price_order' END AS problem, p.take_profit
    FROM v_ticks t ASOF LEFT JOIN pr1 p ON t.target = p.target AND t.exchange_ts >= p.snapshot_ts""", "v_ticks", "v_quotes", **_GUIDE))  # fmt: skip
def attached_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as candidates, with the prices of the snapshot before them and what speaks against those."""
    priced = v_quotes(spark, sf_dir).selectExpr(
        "target", "exchange_ts AS snapshot_ts", "bid AS best_bid", "ask - IF(depth % 7 = 0, 1, 0) AS best_ask", "IF(depth % 2 = 0, ask, bid) AS active_entry", "bid - 1 AS patient_entry", "ask + depth % 5 - 2 AS take_profit", "bid - 2 AS stop_loss",
    )
    x = B.guidance(v_ticks(spark, sf_dir).select("event_id", "target", "exchange_ts"), priced, "target", "exchange_ts", 7200.0)
    return x.select("event_id", "problem", "take_profit")


@query(with_views("SELECT event_id, depth % 3 = 0 AND depth % 4 = 0 AS dropped FROM v_quotes", "v_quotes"))
def opening_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of the rests of a depth by 3 and 4, dropped where all are zero."""
    x = v_quotes(spark, sf_dir).selectExpr("event_id", "array(depth % 3, 0) AS bids", "array(0, depth % 4) AS asks")
    return x.select("event_id", P.opening_book_is_empty("bids", "asks").alias("dropped"))


@query(with_views(f"SELECT ticker, date, {settled_sql('momentum1 * volume_ratio', 4)} AS momentum1_x_volume_ratio, {settled_sql('range_pct * close_position', 4)} AS range_pct_x_close_position FROM feats", "v_daily", **_FEATURES))
def feature_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of two pairs of daily features; null where either is."""
    pairs = [("momentum1", "volume_ratio"), ("range_pct", "close_position")]
    x = E.with_interactions(_features(spark, sf_dir), pairs)
    return x.select("ticker", "date", *[settled(f"{a}_x_{b}", 4).alias(f"{a}_x_{b}") for a, b in pairs])
