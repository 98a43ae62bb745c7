"""Queries of calendars, contract months, periods and audits of sessions, on the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import settled, settled_sql
from tidemark.operators import calendars as K
from tidemark.operators import micro as M
from tidemark.plans.microstructure import _SESSIONS, _calendar, _sessions
from tidemark.registry import query
from tidemark.sources.views import table, v_daily, v_ticks, with_views

_WED = "CAST(date_trunc('month', {d}) AS DATE) + CAST((3 - isodow(date_trunc('month', {d})) + 7) % 7 + 14 AS INTEGER)"
#: Each user's events of a day are a file; a trading date's evidence is all of them.
_SEG = "SELECT CAST(ts AS DATE) AS d, user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2"
_DAYS = {"seg": _SEG, "tr": "SELECT d, max(b) AS b FROM seg WHERE hour(b) >= 8 GROUP BY 1"}
_PLACED = "SELECT d, min(s) AS night_start, count(*) AS nights FROM (SELECT s, (SELECT min(d) FROM tr WHERE tr.d > s) AS d FROM {nights}) GROUP BY 1"
_CALENDAR = f"""SELECT t.d AS trading_date, CASE WHEN strftime(b, '%H:%M:%S.%f') <= '13:31:00.000000' THEN '13:30' ELSE '13:45' END AS day_close, t.d = {_WED.format(d='t.d')} AS is_expiry, n.night_start, coalesce(n.nights, 0) AS nights FROM tr t LEFT JOIN pl n ON n.d = t.d
    UNION ALL SELECT NULL, NULL, NULL, night_start, nights FROM pl WHERE d IS NULL"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("segment_day"), "user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(with_views(_CALENDAR, **_DAYS, pl=_PLACED.format(nights="(SELECT DISTINCT d - 1 AS s FROM seg WHERE hour(a) < 8)")))
def calendar_from_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.build_calendar(_files(spark, sf_dir))


@query(with_views(_CALENDAR, **_DAYS, hd="SELECT DISTINCT d AS h FROM seg WHERE hour(b) >= 15", tl="SELECT DISTINCT d AS f FROM seg WHERE hour(a) < 8",
    ns="SELECT h AS s FROM hd UNION SELECT coalesce((SELECT max(h) FROM hd WHERE h < f), f - 1) FROM tl", pl=_PLACED.format(nights="ns")))
def calendar_from_minute_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.build_calendar(_files(spark, sf_dir), minute_files=True)


_NEAR = f"SELECT DISTINCT d, CASE WHEN d > w THEN w2 ELSE w END AS expiry FROM (SELECT d, {_WED.format(d='d')} AS w, {_WED.format(d='d2')} AS w2 FROM (SELECT d, CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) AS d2 FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem)))"


@query(with_views("SELECT d AS date, 'TMF' || strftime(expiry, '%Y%m') AS code, expiry FROM near", near=_NEAR))
def near_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, expiry = K.near_contract("date", "TMF")
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct().select("date", code.alias("code"), expiry.alias("expiry"))


@query(with_views("SELECT d AS effective_from, old_code, code AS new_code FROM (SELECT d, code, lag(code) OVER (ORDER BY d) AS old_code FROM (SELECT d, 'TMF' || strftime(expiry, '%Y%m') AS code FROM near)) WHERE old_code <> code", near=_NEAR))
def contract_rollovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, _ = K.near_contract("date", "TMF")
    x = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct().withColumn("code", code)
    return K.rollovers(x, [], "date", ["code"])


@query("SELECT coalesce(s, 'NONE') AS session, period, count(*) AS n, count(DISTINCT e) AS evidence_days FROM (SELECT CASE WHEN h >= 15 OR h < 6 THEN 'NIGHT' WHEN h BETWEEN 8 AND 13 THEN 'DAY' END AS s, CASE WHEN d BETWEEN DATE '2024-01-01' AND DATE '2024-01-10' THEN 'early' WHEN d BETWEEN DATE '2024-01-15' AND DATE '2024-01-20' THEN 'middle' END AS period, CASE WHEN h < 18 THEN d - 1 ELSE d END AS e FROM (SELECT hour(ts) AS h, CAST(ts AS DATE) AS d FROM events)) GROUP BY ALL")
def hours_and_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by the hour, named periods (null outside), and days whose evidence is complete."""
    periods = spark.createDataFrame([("early", "2024-01-01", "2024-01-10"), ("middle", "2024-01-15", "2024-01-20")], "period string, first string, last string").selectExpr("period", "CAST(first AS DATE) AS first", "CAST(last AS DATE) AS last")
    x = table(spark, sf_dir, "events").select("ts", F.to_date("ts").alias("d"))
    x = K.in_periods(x, "d", periods)
    return x.groupBy(F.coalesce(K.session_by_hour("ts"), F.lit("NONE")).alias("session"), "period").agg(F.count("*").alias("n"), F.count_distinct(K.evidence_date("ts")).alias("evidence_days"))


@query(with_views("SELECT ticker, date, CAST(sum(gap) OVER (PARTITION BY ticker ORDER BY date) AS BIGINT) AS block, CAST(year(date) AS VARCHAR) || CASE WHEN month(date) <= 6 THEN 'H1' ELSE 'H2' END AS half FROM (SELECT *, coalesce(year(date) * 12 + month(date) - lag(year(date) * 12 + month(date)) OVER (PARTITION BY ticker ORDER BY date) > 1, false)::INT AS gap FROM v_daily)", "v_daily"))
def series_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of bars between months without one."""
    return K.blocks(v_daily(spark, sf_dir), ["ticker"], "date").select("ticker", "date", "block", K.half_year("date").alias("half"))


@query(with_views("SELECT session, CAST(floor(floor(epoch_us(exchange_ts - session_start) / 6e7) / 30) AS BIGINT) AS bucket, count(*) AS n, max(CAST(floor(epoch_us(exchange_ts - session_start) / 6e7) AS BIGINT)) AS last_minute FROM ticks_s WHERE session <> 'CLOSED' GROUP BY ALL", "v_ticks", "v_quotes", **_SESSIONS))
def session_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute, bucket = K.minute_of_session("exchange_ts", "session_start")
    x = M.resolve_sessions(v_ticks(spark, sf_dir), _calendar(spark, sf_dir)).where("session <> 'CLOSED'")
    return x.groupBy("session", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max(minute).alias("last_minute"))


_SEEN = "SELECT DISTINCT trading_date, session FROM ticks_s WHERE session <> 'CLOSED' AND target = 1 AND price > 30"


@query(with_views("SELECT CAST(d AS DATE) AS date, coalesce(present, '') AS present FROM (SELECT unnest(generate_series((SELECT min(trading_date) FROM sn), (SELECT max(trading_date) FROM sn), INTERVAL 1 DAY)) AS d) LEFT JOIN (SELECT trading_date, string_agg(session, '/' ORDER BY session) AS present FROM sn GROUP BY 1) p ON p.trading_date = d WHERE isodow(d) < 6 AND coalesce(present, '') <> 'DAY/NIGHT'", "v_ticks", "v_quotes", **_SESSIONS, sn=_SEEN))
def weekday_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays on which one target has no dear trade in either session, or in one only."""
    x = M.resolve_sessions(v_ticks(spark, sf_dir), _calendar(spark, sf_dir)).where("session <> 'CLOSED' AND target = 1 AND price > 30").select("trading_date", "session").distinct()
    ends = x.agg(F.min("trading_date").alias("a"), F.max("trading_date").alias("b")).first()
    return K.weekday_coverage(x, F.lit(ends["a"]), F.lit(ends["b"]))


@query(with_views("SELECT DISTINCT CAST(exchange_ts AS DATE) AS trading_date FROM v_ticks WHERE isodow(exchange_ts) > 5", "v_ticks"))
def dates_outside_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = v_ticks(spark, sf_dir).select(F.to_date("exchange_ts").alias("trading_date"))
    return K.missing_from_calendar(x, _calendar(spark, sf_dir))


_PARTS = "SELECT trading_date, session, date_trunc('hour', exchange_ts) AS hour, count(*) AS record_count, min(exchange_ts) AS first_ts, max(exchange_ts) AS last_ts FROM ticks_s WHERE session <> 'CLOSED' GROUP BY ALL"


@query(with_views("""SELECT trading_date, session, CAST(sum(record_count) AS BIGINT) AS records, CAST(sum(hole) AS BIGINT) AS holes, array_to_string(list_filter([CASE WHEN strftime(min(first_ts), '%H:%M') > CASE session WHEN 'DAY' THEN '08:46' ELSE '15:01' END THEN 'late_start' END, CASE WHEN strftime(max(last_ts), '%H:%M') < CASE session WHEN 'DAY' THEN '13:44' ELSE '04:59' END THEN 'early_end' END, CASE WHEN sum(hole) > 0 THEN 'interrupted' END], lambda x: x IS NOT NULL), ',') AS flags
    FROM (SELECT *, coalesce(epoch_us(lead(first_ts) OVER (PARTITION BY trading_date, session ORDER BY first_ts, last_ts) - last_ts) / 1e6 > 600, false)::INT AS hole FROM parts) GROUP BY trading_date, session""", "v_ticks", "v_quotes", **_SESSIONS, parts=_PARTS))  # fmt: skip
def session_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of trades as segments; a hole is over ten minutes here."""
    x = M.resolve_sessions(v_ticks(spark, sf_dir), _calendar(spark, sf_dir)).where("session <> 'CLOSED'")
    parts = x.groupBy("trading_date", "session", F.date_trunc("hour", "exchange_ts").alias("hour")).agg(F.count("*").alias("record_count"), F.min("exchange_ts").alias("first_ts"), F.max("exchange_ts").alias("last_ts"))
    return K.audit_sessions(parts, 600.0).select("trading_date", "session", "records", "holes", F.array_join("flags", ",").alias("flags"))


@query(with_views(f"""SELECT target, trading_date, session, kind, count(*) AS n, CAST(sum(bad) AS BIGINT) AS invalid, {settled_sql('max(gap)', 3)} AS longest_gap_s, {settled_sql("least(1, count(DISTINCT floor(epoch_us(exchange_ts) / 36e8)) / CASE session WHEN 'DAY' THEN 5 ELSE 14 END)")} AS coverage,
    CASE WHEN sum(bad) = 0 AND count(DISTINCT floor(epoch_us(exchange_ts) / 36e8)) >= CASE session WHEN 'DAY' THEN 5 ELSE 14 END THEN 'VALID' ELSE 'INVALID' END AS status
    FROM (SELECT *, coalesce(epoch_us(exchange_ts - lag(exchange_ts) OVER (PARTITION BY target, trading_date, session, kind ORDER BY exchange_ts)) / 1e6, 0) AS gap FROM ev) GROUP BY target, trading_date, session, kind""", "v_ticks", "v_quotes", **_SESSIONS,
    ev="SELECT target, trading_date, session, 'tick' AS kind, exchange_ts, (price < 1)::INT AS bad FROM ticks_s WHERE session <> 'CLOSED' UNION ALL SELECT target, trading_date, session, 'quote', exchange_ts, 0 FROM quotes_s WHERE session <> 'CLOSED'"))
def session_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by hours of a session, as the event table is thin."""
    ticks, quotes = _sessions(spark, sf_dir)
    front = ["target", "trading_date", "session"]
    x = ticks.select(*front, F.lit("tick").alias("kind"), "exchange_ts", F.when(F.col("price") < 1, F.array(F.lit("LOW_PRICE"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    x = x.unionByName(quotes.select(*front, F.lit("quote").alias("kind"), "exchange_ts", F.array().cast("array<string>").alias("reasons")))
    # expected hours are of the session, so they go with the key
    out = K.session_quality(x, F.when(F.col("session") == "DAY", 5).otherwise(14), 3600)
    return out.select(*front, "kind", "n", F.col("invalid").cast("long").alias("invalid"), settled("longest_gap_s", 3).alias("longest_gap_s"), settled("coverage").alias("coverage"), "status")
