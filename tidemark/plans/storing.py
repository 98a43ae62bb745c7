"""Queries of segments, evidence, quality reports and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import settled, settled_sql
from tidemark.operators import micro as M
from tidemark.plans.microstructure import _SESSIONS, _calendar
from tidemark.registry import query
from tidemark.sources import storage as T
from tidemark.sources.views import table, v_daily, v_ticks, with_views
from tidemark.streaming import live


@query(with_views("SELECT target, d AS trading_date, count(*) AS record_count, min(exchange_ts) AS first_ts, max(exchange_ts) AS last_ts FROM (SELECT *, CAST(exchange_ts AS DATE) AS d FROM v_ticks WHERE event_id % 9 <> 0) GROUP BY ALL", "v_ticks"))
def segment_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades written as partitioned segments without the ids that are already stored; the manifest of what is there."""
    x = v_ticks(spark, sf_dir).withColumn("trading_date", F.to_date("exchange_ts"))
    known = x.where("event_id % 9 = 0").select("event_id")
    twice = x.unionByName(x.where("event_id % 50 = 0"))
    manifest, _ = T.append_segments(twice, T.shared_folder(spark, "segments"), known, ["target", "trading_date"])
    return manifest.select(F.col("target").cast("long"), "trading_date", "record_count", "first_ts", "last_ts")


@query(with_views("SELECT event_id, user_id AS n FROM (SELECT event_id, 1 AS user_id FROM v_ticks WHERE event_id % 50 = 0 AND event_id % 9 <> 0 UNION ALL SELECT event_id, 1 FROM v_ticks WHERE event_id % 9 = 0 UNION ALL SELECT event_id, 1 FROM v_ticks WHERE event_id % 9 = 0 AND event_id % 50 = 0)", "v_ticks"))
def segment_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose id was taken: a repeat within the append, or an id stored before."""
    x = v_ticks(spark, sf_dir).withColumn("trading_date", F.to_date("exchange_ts"))
    _, taken = T.append_segments(x.unionByName(x.where("event_id % 50 = 0")), T.shared_folder(spark, "segments"), x.where("event_id % 9 = 0").select("event_id"), ["trading_date"])
    return taken.select("event_id", F.lit(1).alias("n"))


_DAY = "make_timestamp(year(date), month(date), day(date), 13, 30, 0.0)"


@query(with_views("SELECT ticker, count(*) AS n, count(*) FILTER (ticker % 3 = 1) AS problems FROM v_daily GROUP BY 1", "v_daily"))
def evidence_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows as evidence, available at 13:30; the clock order is wrong for a third of the tickers."""
    at = lambda hour: F.to_timestamp_ntz(F.concat(F.col("date").cast("string"), F.lit(f" {hour}:30:00")), F.lit("yyyy-MM-dd HH:mm:ss"))
    x = v_daily(spark, sf_dir).select("ticker", "date", "close", "volume", F.lit("market").alias("source"), F.when(F.col("ticker") % 3 == 1, at(15)).otherwise(at(12)).alias("published_at"), at(13).alias("available_at"), at(18).alias("fetched_at"))
    return T.evidence(x, ["close", "volume"]).groupBy("ticker").agg(F.count("*").alias("n"), F.count("problem").alias("problems"))


@query(with_views("SELECT target, count(*) AS n, CAST(0 AS BIGINT) AS duplicates, count(*) FILTER (exchange_ts < top) AS out_of_order, " + settled_sql("max(gap)", 3) + " AS longest_gap_s FROM (SELECT *, max(exchange_ts) OVER (PARTITION BY target ORDER BY received_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, epoch_us(exchange_ts - lag(exchange_ts) OVER (PARTITION BY target ORDER BY exchange_ts, event_id)) / 1e6 AS gap FROM v_ticks) GROUP BY 1", "v_ticks"))
def event_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.quality_report(v_ticks(spark, sf_dir), ["target"]).withColumn("longest_gap_s", settled("longest_gap_s", 3))


@query(with_views("SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN price <= 0 THEN 'INVALID_PRICE' END, CASE WHEN volume < 0 THEN 'NEGATIVE_VOLUME' END, CASE WHEN session = 'CLOSED' THEN 'OUT_OF_SESSION' END, CASE WHEN received_ts - exchange_ts > INTERVAL 5 MINUTE THEN 'STALE' END], lambda x: x IS NOT NULL)) AS reason FROM ticks_s) GROUP BY 1", "v_ticks", "v_quotes", **_SESSIONS))
def event_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.resolve_sessions(v_ticks(spark, sf_dir), _calendar(spark, sf_dir))
    return x.select(F.explode(T.event_problems(x)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(with_views("SELECT target, date_trunc('hour', exchange_ts) AS hour, CAST(row_number() OVER (PARTITION BY target, date_trunc('hour', exchange_ts) ORDER BY exchange_ts) - 1 AS INTEGER) AS place, exchange_ts, price FROM v_ticks", "v_ticks"))
def column_payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays per target and hour, as a provider sends them, back to rows."""
    hour = F.date_trunc("hour", "exchange_ts").cast("timestamp_ntz").alias("hour")
    rows = v_ticks(spark, sf_dir).groupBy("target", hour).agg(F.array_sort(F.collect_list(F.struct("exchange_ts", "price"))).alias("r"))
    arrays = rows.select("target", "hour", F.col("r.exchange_ts").alias("exchange_ts"), F.col("r.price").alias("price"))
    return T.unzip_columns(arrays, ["target", "hour"], ["exchange_ts", "price"])


@query(with_views("SELECT ticker, date, close FROM v_daily WHERE volume >= 1000 UNION ALL SELECT ticker, date, -close FROM v_daily v WHERE NOT EXISTS (SELECT 1 FROM v_daily w WHERE w.ticker = v.ticker AND year(w.date) = year(v.date) AND w.volume >= 1000)", "v_daily"))
def first_source_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each ticker and year the bars of large volume, or all bars, marked by their sign, where there are none."""
    x = v_daily(spark, sf_dir).select("ticker", F.year("date").alias("year"), "date", "close", "volume")
    return T.first_non_empty([x.where("volume >= 1000"), x.withColumn("close", -F.col("close"))], ["ticker", "year"]).select("ticker", "date", "close")


@query("SELECT event_type AS source, count(DISTINCT user_id) AS accepted, (SELECT count(DISTINCT user_id) FROM events) AS requested, " + settled_sql("count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events) * 100") + " AS coverage_pct FROM events WHERE value > 40 GROUP BY 1")
def collection_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind of event the users that it has a large value of."""
    x = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("event_type").alias("source"))
    return T.collection_coverage(x, x.where("value > 40"), "user_id", "source").withColumn("coverage_pct", settled("coverage_pct"))


@query("""SELECT user_id % 5 AS target, time_bucket(INTERVAL 15 MINUTE, ts) AS bar_start, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS trades FROM events
    WHERE event_type NOT IN ('signup', 'error') AND time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events WHERE event_type NOT IN ('signup', 'error')) - INTERVAL 10 MINUTE GROUP BY ALL""")  # fmt: skip
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen-minute bars from the event stream: those that its watermark has closed."""
    trades, _ = live.split(live.read_events(spark, sf_dir))
    x = live.run(live.tumbling_bars(trades, "15 minutes", "10 minutes"), "bars")
    return x.select("target", F.col("bar_start").cast("timestamp_ntz").alias("bar_start"), "open", "high", "low", "close", "trades")


@query("SELECT event_id, user_id % 5 AS target, value FROM events")
def stream_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice on the stream, once in the table."""
    x = live.read_events(spark, sf_dir)
    return live.run(live.distinct_events(x.unionByName(x), "2 hours").select("event_id", "target", "value"), "distinct")


@query("SELECT user_id % 5 AS target, count(*) AS n, count(*) FILTER (ts < top) AS late FROM (SELECT *, max(ts) OVER (PARTITION BY user_id % 5 ORDER BY ts + (event_id % 7) * INTERVAL 1 MINUTE, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events) GROUP BY 1")
def stream_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = live.read_events(spark, sf_dir).withColumn("received_ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, CAST(event_id % 7 AS INT), 0)"))
    return live.run_out_of_order(x, "order").groupBy("target").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))
