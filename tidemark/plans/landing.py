"""Queries of evidence stores, caches, reports, feeds and further streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.scalars import settled, settled_sql
from tidemark.plans.microstructure import _SESSIONS, _calendar
from tidemark.registry import query
from tidemark.sources import storage as T
from tidemark.sources.views import table, v_daily, v_flow, v_ticks, with_views
from tidemark.streaming import live


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = T.market_clock("date")
    x = v_daily(spark, sf_dir).select("ticker", "date", "close", "volume", F.lit("market").alias("source"), at.alias("published_at"), at.alias("available_at"), (at + F.expr("interval 1 hour")).alias("fetched_at"))
    return T.evidence(x, ["close", "volume"])


@query(with_views("SELECT ticker, count(*) AS n, count(*) AS intact, max(date + INTERVAL '13 hours 30 minutes') AS last_available FROM v_daily GROUP BY 1", "v_daily"))
def evidence_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as evidence, stored twice: once each, with hash and id as their content says."""
    path = T.shared_folder(spark, "evidence")
    rows = T.kept(_evidence(spark, sf_dir), "bars")  # averages computed anew may differ in their last bit, and are other evidence then
    T.write_evidence(rows.where("ticker < 6"), path)
    m = T.evidence_manifest(T.write_evidence(rows, path), ["close", "volume"])
    T.forget(rows)
    return m.groupBy("ticker").agg(F.count("*").alias("n"), F.count_if("intact").alias("intact"), F.max("available_at").alias("last_available"))


@query(with_views("SELECT ticker, count(*) AS n, length(sha256('x')) AS hash_length FROM v_daily GROUP BY 1", "v_daily"))
def evidence_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash over the ordered ids of each ticker's evidence."""
    m = T.manifest_hash(_evidence(spark, sf_dir), ["ticker"])
    return m.select("ticker", "n", F.length("manifest_hash").cast("long").alias("hash_length"))


@query(with_views("SELECT ticker, date, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date_trunc('month', date) ORDER BY date DESC) AS r FROM v_daily WHERE date < date_trunc('month', date) + INTERVAL 20 DAY) WHERE r = 1", "v_daily"))
def evidence_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest bar of each ticker and month that was available on the 20th."""
    x = _evidence(spark, sf_dir).withColumn("month", F.trunc("date", "MM")).withColumn("decision", F.date_add("month", 20).cast("timestamp_ntz"))
    return T.evidence_as_of(x, "decision", ["ticker", "month"]).select("ticker", "date", "close")


@query(with_views("SELECT ticker, investor, quality, count(*) AS n, max(available) AS last_available FROM (SELECT ticker, investor, CASE WHEN net > 0 THEN 'explicit' ELSE 'inferred_schedule' END AS quality, CASE WHEN net > 0 THEN date + INTERVAL 16 HOUR ELSE date + INTERVAL 18 HOUR END AS available FROM v_flow) GROUP BY ALL", "v_flow"))
def institutional_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with a stated time where they are positive, else the evening's."""
    stated = F.when(F.col("net") > 0, F.expr("CAST(date AS TIMESTAMP_NTZ) + interval 16 hours"))
    available, quality = T.institutional_clock("date", stated)
    x = v_flow(spark, sf_dir).select("ticker", "investor", available.alias("available"), quality.alias("quality"))
    return x.groupBy("ticker", "investor", "quality").agg(F.count("*").alias("n"), F.max("available").alias("last_available"))


@query(with_views("SELECT target, count(*) AS n FROM v_ticks GROUP BY 1", "v_ticks"))
def checked_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades through a store whose manifest is checked on reading."""
    path = T.shared_folder(spark, "checked")
    manifest, _ = T.append_segments(v_ticks(spark, sf_dir), path, None, ["target"])
    return T.read_segments(spark, path, manifest, ["target"]).groupBy(F.col("target").cast("long").alias("target")).agg(F.count("*").alias("n"))


@query(with_views("SELECT ticker, count(*) AS n FROM v_daily GROUP BY 1", "v_daily"))
def sample_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars through a cache: the second call reads what the first one stored, whatever it is given."""
    folder, x = T.shared_folder(spark, "cache"), v_daily(spark, sf_dir)
    T.cached(x, folder, "a" * 64, "b" * 64)
    return T.cached(x.where("false"), folder, "a" * 64, "b" * 64).groupBy("ticker").agg(F.count("*").alias("n"))


@query(with_views("SELECT DISTINCT ticker, date FROM v_daily WHERE NOT (ticker < 5 OR volume > 1000)", "v_daily"))
def keys_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = v_daily(spark, sf_dir)
    return T.missing_keys(x, x.where("ticker < 5 OR volume > 1000"), ["ticker", "date"])


@query(with_views("SELECT '| ' || ticker || ' | ' || strftime(date, '%Y-%m-%d') || ' | ' || CAST(volume AS BIGINT) || ' |' AS line FROM v_daily", "v_daily"))
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.markdown_rows(v_daily(spark, sf_dir).select("ticker", "date", F.col("volume").cast("long").alias("volume")), ["ticker", "date", "volume"])


@query(with_views("SELECT ticker, date, close FROM v_daily", "v_daily"))
def dumped_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes to NDJSON by ticker, and back with the schema they had."""
    path, x = T.shared_folder(spark, "closes"), v_daily(spark, sf_dir).select("ticker", "date", "close")
    x.write.partitionBy("ticker").json(path)
    return spark.read.schema("date date, close double, ticker long").json(path).select("ticker", "date", "close")


@query(with_views("SELECT ticker, date, CASE WHEN volume > 1000 THEN floor(turnover) END AS turnover FROM v_daily", "v_daily"))
def exchange_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily file as an exchange lands it: thousands separators, dashes for what is unknown."""
    path = T.shared_folder(spark, "exchange")
    text = F.when(F.col("volume") > 1000, F.format_number(F.floor("turnover"), 0)).otherwise("-")
    v_daily(spark, sf_dir).select("ticker", "date", text.alias("turnover")).write.option("header", True).csv(path)
    x = T.exchange_csv(spark, path, ["ticker", "turnover"])
    return x.select(F.col("ticker").cast("long").alias("ticker"), F.to_date("date").alias("date"), F.col("turnover").cast("long").alias("turnover"))


@query("SELECT event_type, CASE WHEN NOT ok THEN 'small' END AS reason, count(*) AS keys, (SELECT count(DISTINCT user_id) FROM events) AS requested, " + settled_sql("count(*) / (SELECT count(DISTINCT user_id) FROM events) * 100") + " AS pct FROM (SELECT event_type, user_id, bool_or(value > 40) AS ok FROM events GROUP BY 1, 2) GROUP BY 1, 2")
def coverage_with_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("event_type", "user_id", F.when(F.col("value") <= 40, "small").alias("why"))
    return T.coverage_with_reasons(x, x, "user_id", "event_type", "why").withColumn("pct", settled("pct"))


@query("SELECT user_id, event_id AS number, 'EP' || event_id || ' ' || event_type AS title, CAST(ts AS DATE) AS published FROM events WHERE event_type <> 'error'")
def feed_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of users by day: an event an item, errors without an episode in the title."""
    title = F.when(F.col("event_type") == "error", "news").otherwise(F.concat(F.lit("EP"), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type")))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><pubDate>"), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit("</pubDate></item>\n"))
    x = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(F.collect_list(item), "").alias("xml"))
    return T.feed_items(x, ["user_id"], "xml").select("user_id", F.col("number").cast("long").alias("number"), "title", "published")


@query(with_views("SELECT ticker, date, volume FROM v_daily WHERE month(date) <> 6 UNION ALL SELECT ticker, date, -volume FROM v_daily WHERE month(date) = 6", "v_daily"))
def live_over_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live bars, and backfilled ones, marked by their sign, where live has none."""
    x = v_daily(spark, sf_dir).select("ticker", "date", "volume")
    return T.prefer(x.where("month(date) <> 6"), x.withColumn("volume", -F.col("volume")), ["ticker", "date"])


@query("SELECT event_id, " + settled_sql("ln(least(greatest(value / 50, 1e-6), 1 - 1e-6) / (1 - least(greatest(value / 50, 1e-6), 1 - 1e-6)))") + " AS logit, " + settled_sql("(user_id - event_id % 5) / (user_id + event_id % 5 + 2)") + " AS imbalance, (event_id % 7) * 60000.0::DOUBLE AS age_ms, value AS number, event_id % 3 <> 0 AS is_date FROM events")
def scalar_functions_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").withColumn("received", F.expr("ts + make_interval(0, 0, 0, 0, 0, CAST(event_id % 7 AS INT), 0)"))
    date = F.when(F.col("event_id") % 3 == 0, "2024-02-30").otherwise("2024-02-29")
    return x.select("event_id", settled(S.logit(F.col("value") / 50)).alias("logit"), settled(S.imbalance(F.array("user_id", F.lit(1)), F.array(F.col("event_id") % 5, F.lit(1), F.lit(9)), 2)).alias("imbalance"), S.age_ms("received", "ts").alias("age_ms"), S.number_of(F.lit("x"), F.concat(F.lit(" "), F.col("value").cast("string"))).alias("number"), S.is_date(date).alias("is_date"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.read_events(spark, sf_dir).withColumn("received", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, CAST(event_id % 12 AS INT))"))


@query(with_views("SELECT user_id % 5 AS target, coalesce(session, 'CLOSED') AS session, count(*) AS n, count(*) FILTER (event_id % 12 > 5) AS stale FROM events LEFT JOIN cal ON ts >= session_start AND ts < session_end GROUP BY ALL", **{k: v for k, v in _SESSIONS.items() if k in ("weekdays", "cal")}))
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live events tagged with their session, written as partitioned segments; stale ones came over five seconds late."""
    x = live.tag_sessions(_stream(spark, sf_dir).withColumn("stale", live.is_stale("received", "ts")), _calendar(spark, sf_dir))
    out = live.run(x.select("event_id", "target", "session", "stale"), "segments", ("target", "session"))
    return out.groupBy("target", "session").agg(F.count("*").alias("n"), F.count_if("stale").alias("stale"))


@query("SELECT user_id % 5 AS target, time_bucket(INTERVAL 15 MINUTE, ts) AS bar_start, CASE WHEN count(*) < 2 THEN 'WAIT' WHEN arg_max(value, event_id) > arg_min(value, event_id) THEN 'LONG' ELSE 'SHORT' END AS signal FROM events WHERE event_type NOT IN ('signup', 'error') AND time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM events WHERE event_type NOT IN ('signup', 'error')) - INTERVAL 10 MINUTE GROUP BY ALL")
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score for each closed bar of the stream."""
    trades, _ = live.split(live.read_events(spark, sf_dir))
    signal = F.when(F.col("trades") < 2, "WAIT").when(F.col("close") > F.col("open"), "LONG").otherwise("SHORT")
    x = live.score_closed_bars(live.tumbling_bars(trades, "15 minutes", "10 minutes"), lambda b: b.withColumn("signal", signal), "scores")
    return x.select("target", F.col("bar_start").cast("timestamp_ntz").alias("bar_start"), "signal")


@query("SELECT target, reason, count(*) AS n FROM (SELECT user_id % 5 AS target, 'LOW_VALUE' AS reason FROM events WHERE value < 5 UNION ALL SELECT user_id % 5, 'CONNECTION_LOST' FROM events WHERE event_type = 'error' UNION ALL SELECT user_id % 5, 'QUEUE_DROP' FROM events, range(3) k(i) WHERE value > 49 AND k.i < event_id % 4) GROUP BY ALL")
def stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of events, lost connections and drops of one stream."""
    x = live.read_events(spark, sf_dir)
    e = x.select("target", F.when(F.col("value") < 5, F.array(F.lit("LOW_VALUE"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    q = live.quality_rows(e, x.select("target", (F.col("event_type") != "error").alias("connected")), x.select("target", F.when(F.col("value") > 49, F.col("event_id") % 4).otherwise(0).alias("dropped")))
    return live.run(q, "quality").groupBy("target", "reason").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, true AS same FROM events")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of a stream's rows against that of the table they came from."""
    columns = ["event_id", "target", "value"]
    out = live.run(live.read_events(spark, sf_dir).select(*columns), "replay")
    batch = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("target"), "value")
    a, b = live.checksum(out, columns), live.checksum(batch, columns).select(F.col("n").alias("m"), F.col("checksum").alias("other"))
    return a.crossJoin(F.broadcast(b)).select("n", ((F.col("n") == F.col("m")) & (F.col("checksum") == F.col("other"))).alias("same"))
