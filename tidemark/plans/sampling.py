"""Queries of typed records, bars from minutes, in-bar signals, features and samples, on the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import settled, settled_sql
from tidemark.operators import micro as M
from tidemark.operators import rules as R
from tidemark.operators import samples as P
from tidemark.plans.microstructure import _BF, _LABEL, _SESSIONS, _STATES, _bars, _calendar, _sessions, _states
from tidemark.registry import query
from tidemark.sources.views import table, v_quotes, v_ticks, with_views

_RAW = """SELECT event_id, CASE WHEN event_id % 23 = 0 THEN ' ' ELSE CAST(event_id AS VARCHAR) END AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 17 = 0 THEN '' ELSE '+08:00' END AS tm, CASE WHEN event_id % 19 = 0 THEN 'NaN' WHEN event_id % 29 = 0 THEN '' ELSE CAST(value AS VARCHAR) END AS px,
    CASE WHEN event_id % 31 = 0 THEN '1.5' ELSE CAST(user_id AS VARCHAR) END AS vol FROM events"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        """to_json(named_struct('event_id', CASE WHEN event_id % 23 = 0 THEN ' ' ELSE CAST(event_id AS STRING) END, 'received_at', concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), CASE WHEN event_id % 17 = 0 THEN '' ELSE '+08:00' END), 'exchange_datetime', concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '+08:00'),
        'target_code', 'T', 'close', CASE WHEN event_id % 19 = 0 THEN 'NaN' WHEN event_id % 29 = 0 THEN '' ELSE CAST(value AS STRING) END, 'volume', CASE WHEN event_id % 31 = 0 THEN '1.5' ELSE CAST(user_id AS STRING) END, 'simtrade', 'false')) AS record"""
    )


@query(f"""SELECT wrong, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN trim(id) = '' THEN 'event_id' END, CASE WHEN event_id % 17 = 0 THEN 'received_at' END, CASE WHEN px IN ('NaN', '') THEN 'close' END, CASE WHEN vol = '1.5' THEN 'volume' END], lambda x: x IS NOT NULL), ',') AS wrong FROM ({_RAW})) GROUP BY 1""")
def decoded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records to typed trades: how many rows, and rejects by what is wrong with them."""
    good, bad = P.decode(_records(spark, sf_dir), P.TICK)
    return good.select(F.lit("").alias("wrong")).unionByName(bad.select("wrong")).groupBy("wrong").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, epoch_ms(ts - INTERVAL 8 HOUR) // 1000 AS at_s, value AS close, user_id AS volume FROM (SELECT event_id, date_trunc('second', ts) AS ts, value, user_id FROM events WHERE event_id % 23 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 29 <> 0 AND event_id % 31 <> 0)")
def typed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = P.decode(_records(spark, sf_dir), P.TICK)
    return good.select(F.col("event_id").cast("long").alias("event_id"), F.unix_seconds("exchange_datetime").alias("at_s"), "close", "volume")


@query(with_views("""SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN event_id % 40 = 0 THEN 'SIMTRADE' END, CASE WHEN session = 'CLOSED' THEN 'OUT_OF_SESSION' END, CASE WHEN event_id % 37 = 0 THEN 'TARGET_MISMATCH' END, CASE WHEN kind = 't' AND NOT price > 1 THEN 'INVALID_PRICE' END,
    CASE WHEN kind = 'q' AND price < 1.5 THEN 'INVALID_DEPTH' END, CASE WHEN kind = 'q' AND event_id % 3 = 0 THEN 'CROSSED_BOOK' END], lambda x: x IS NOT NULL)) AS reason FROM (SELECT event_id, session, price, 't' AS kind FROM ticks_s UNION ALL SELECT event_id, session, bid + 0.5, 'q' FROM quotes_s)) GROUP BY 1""", "v_ticks", "v_quotes", **_SESSIONS))  # fmt: skip
def event_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven reasons against trades and quotes."""
    cal = _calendar(spark, sf_dir)
    t = M.resolve_sessions(v_ticks(spark, sf_dir), cal).selectExpr("event_id", "session", "trading_date", "price - 1 AS price", "volume", "CAST(NULL AS ARRAY<DOUBLE>) AS bids", "CAST(NULL AS ARRAY<DOUBLE>) AS asks")
    q = M.resolve_sessions(v_quotes(spark, sf_dir), cal).selectExpr("event_id", "session", "trading_date", "CAST(NULL AS DOUBLE) AS price", "depth AS volume", "CASE WHEN bid + 0.5D < 1.5D THEN CAST(array() AS ARRAY<DOUBLE>) ELSE array(bid) END AS bids", "array(bid + IF(event_id % 3 = 0, 0D, 1D)) AS asks")
    q = q.withColumn("bids", F.when((F.size("bids") == 0) & (F.col("event_id") % 3 == 0), F.array(F.lit(0.0))).otherwise(F.col("bids"))).withColumn("asks", F.when(F.col("event_id") % 3 == 0, F.transform("bids", lambda v: v)).otherwise(F.transform("asks", lambda v: F.greatest(v, F.lit(0.001)))))
    x = t.unionByName(q).selectExpr("*", "event_id % 40 = 0 AS simtrade", "'T' AS target_code", "IF(event_id % 37 = 0, 'U', 'T') AS code")
    return x.select(F.explode(P.event_reasons()).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(with_views("SELECT event_id, last, bid, up AS limit_up, down AS limit_down, (up OR down) AND bid = 0 AS locked FROM (SELECT event_id, price AS last, CASE WHEN volume % 3 = 0 THEN 0 ELSE price - 1 END AS bid, volume % 9 = 0 AS up, volume % 9 = 3 AS down FROM v_ticks)", "v_ticks"))
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades as provider snapshots, numbers as text under a provider's names."""
    x = v_ticks(spark, sf_dir).selectExpr("event_id AS code", "CAST(price AS STRING) AS close", "CAST(IF(volume % 3 = 0, 0, price - 1) AS STRING) AS buy_price", "CAST(IF(volume % 3 = 0, 0, price + 1) AS STRING) AS ask_price", "volume AS total_volume", "CASE volume % 9 WHEN 0 THEN 'LimitUp' WHEN 3 THEN '5' END AS change_type")
    return P.snapshots(x).select(F.col("code").alias("event_id"), "last", "bid", "limit_up", "limit_down", "locked")


@query(with_views("SELECT event_id, price AS best, volume + 2e0 AS volume, diff FROM (SELECT event_id, price, volume, CASE WHEN event_id % 2 = 0 THEN 1e0 END AS diff FROM v_ticks)", "v_ticks"))
def level_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays of two levels to a book; the first bid and the volume of both."""
    x = v_ticks(spark, sf_dir).selectExpr("event_id", "array(price, price - 1) AS bid_price", "array(volume, 2L) AS bid_volume", "array(IF(event_id % 2 = 0, 1, NULL), 0) AS diff_bid_vol", "array(price + 1) AS ask_price", "array(volume) AS ask_volume", "array(1) AS diff_ask_vol")
    b = P.level_book(x, ["event_id"])
    return b.select("event_id", F.col("bids")[0]["price"].alias("best"), F.aggregate("bids", F.lit(0.0), lambda s, v: s + v["volume"]).alias("volume"), F.col("bids")[0]["diff"].alias("diff"))


_MIN = {
    **_SESSIONS,
    "mn": "SELECT target, session_start, session_end, date_trunc('minute', exchange_ts) AS minute, arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM ticks_s WHERE session <> 'CLOSED' GROUP BY ALL",
}


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks, _ = _sessions(spark, sf_dir)
    order = F.struct("exchange_ts", "event_id")
    return ticks.groupBy(*M.KEYS, "session_end", F.date_trunc("minute", F.col("exchange_ts")).cast("timestamp_ntz").alias("minute")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))


@query(with_views("""SELECT target, session_start, width, CAST(bucket AS BIGINT) AS bucket, arg_min(open, minute) AS open, max(high) AS high, min(low) AS low, arg_max(close, minute) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS minutes FROM (SELECT *, floor(epoch_us(minute - session_start) / 6e7 / width) AS bucket FROM mn, (VALUES (15), (60)) k(width))
    WHERE epoch_us(session_end - session_start) / 6e7 >= (bucket + 1) * width GROUP BY ALL""", "v_ticks", "v_quotes", **_MIN))  # fmt: skip
def bars_of_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of 15 and 60 minutes from the minutes with trades, each minute given twice."""
    x = _minutes(spark, sf_dir)
    return P.bars_of_minutes(x.unionByName(x), [15, 60]).drop("conflict")


@query(with_views("SELECT target, strftime(minute, '%Y-%m-%d %H:%M') AS minute, CASE WHEN count(*) OVER (PARTITION BY target, minute) > 1 THEN 'place' ELSE 'plain' END AS kind, price FROM (SELECT target, date_trunc('minute', exchange_ts) - INTERVAL 1 MINUTE AS minute, price FROM v_ticks)", "v_ticks"))
def minute_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of trades as column arrays of minutes; stamps that repeat get their place into the id."""
    x = v_ticks(spark, sf_dir).withColumn("ts", F.date_trunc("minute", F.col("exchange_ts")).cast("timestamp_ntz"))
    arrays = x.groupBy("target", F.date_trunc("hour", F.col("ts")).alias("hour")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "price"))).alias("r")).select("target", "hour", F.col("r.ts").alias("ts"), F.col("r.price").alias("price"))
    y = P.minute_rows(arrays, ["target", "hour"], ["price"])
    return y.select("target", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), F.when(F.col("row_id").rlike(r"-\d{9,}-\d+$"), "place").otherwise("plain").alias("kind"), "price")


@query(with_views("SELECT target, CAST(exchange_ts AS DATE) AS date, arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close, count(*) AS ticks FROM v_ticks WHERE price > 0 GROUP BY ALL", "v_ticks"))
def tick_daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_bars(v_ticks(spark, sf_dir))


@query("SELECT date, expiry, open, close FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY expiry) AS r FROM (SELECT CAST(o_orderdate AS DATE) AS date, strftime(o_orderdate, '%Y') || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS expiry, o_totalprice - 1000 AS open, o_totalprice AS close, o_orderstatus FROM orders) WHERE o_orderstatus <> 'P' AND open > 0 AND close > 0) WHERE r = 1")
def near_month_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listed contracts of a date; those pending are of another session."""
    x = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderdate AS DATE) AS date", "concat(date_format(o_orderdate, 'yyyy'), lpad(CAST(o_orderkey % 12 + 1 AS STRING), 2, '0'), lpad(CAST(o_orderkey AS STRING), 9, '0')) AS expiry", "o_totalprice - 1000 AS open", "o_totalprice AS high", "o_totalprice - 1000 AS low", "o_totalprice AS close", "o_orderstatus")
    return P.near_month(x, "date", "expiry", F.col("o_orderstatus") != "P").select("date", "expiry", "open", "close")


@query(with_views(f"SELECT target, session_start, step, {settled_sql('last_value(seed IGNORE NULLS) OVER w')} AS basis FROM (SELECT *, CASE WHEN trades > 0 AND u IS NOT NULL THEN close - u WHEN row_number() OVER w = 1 THEN midpoint - u END AS seed FROM (SELECT *, CASE WHEN step % 5 <> 0 THEN last_value(bid IGNORE NULLS) OVER w END AS u FROM states WINDOW w AS (PARTITION BY target, session_start ORDER BY step)) WINDOW w AS (PARTITION BY target, session_start ORDER BY step)) WINDOW w AS (PARTITION BY target, session_start ORDER BY step)", "v_ticks", "v_quotes", **_STATES))
def basis_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bid as underlying, unknown on every fifth step."""
    x = _states(spark, sf_dir).withColumn("underlying", F.when(F.col("step") % 5 != 0, F.col("bid")))
    return P.basis_with_carry(x).select(*M.KEYS, "step", settled("basis").alias("basis"))


@query(with_views("SELECT event_id, target FROM (SELECT event_id, target, b, a, lag(b) OVER w AS pb, lag(a) OVER w AS pa FROM (SELECT event_id, target, exchange_ts, floor(price / 5) * 5 AS b, floor(price / 5) * 5 + 1 AS a FROM v_ticks WHERE price >= 5) WINDOW w AS (PARTITION BY target, CAST(exchange_ts AS DATE) ORDER BY exchange_ts, event_id)) WHERE pb IS NULL OR pb <> b OR pa <> a", "v_ticks"))
def quotes_from_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that trades carry, one quote where they change within a day."""
    x = v_ticks(spark, sf_dir).selectExpr("event_id", "target", "CAST(exchange_ts AS DATE) AS day", "exchange_ts", "CAST(floor(price / 5) * 5 AS DOUBLE) AS bid", "1L AS bid_volume", "CAST(floor(price / 5) * 5 + 1 AS DOUBLE) AS ask", "1L AS ask_volume")
    return P.quotes_from_ticks(x, ["target", "day"], ["exchange_ts", "event_id"]).select("event_id", "target")


@query(with_views("SELECT q.event_id, (SELECT arg_min(price, t.exchange_ts) FROM ticks_s t WHERE t.target = q.target AND t.session_start = q.session_start AND t.exchange_ts > q.exchange_ts) AS entry, (SELECT arg_max(price, t.exchange_ts) FROM ticks_s t WHERE t.target = q.target AND t.session_start = q.session_start AND t.exchange_ts <= q.exchange_ts + INTERVAL 2 HOUR) AS exit FROM quotes_s q WHERE q.session <> 'CLOSED'", "v_ticks", "v_quotes", **_SESSIONS))
def entry_and_exit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each quote the first trade after it in its session, and the last by two hours on."""
    ticks, quotes = _sessions(spark, sf_dir)
    ticks = ticks.select(*M.KEYS, "exchange_ts", "price")
    x = P.asof_forward(quotes.select("event_id", *M.KEYS, "exchange_ts"), ticks, M.KEYS, "exchange_ts", "exchange_ts", "price").withColumn("until", F.expr("exchange_ts + interval 2 hours"))
    y = M.asof_backward(x.withColumnRenamed("next_price", "entry"), ticks, M.KEYS, "until", "exchange_ts", ["price"])
    return y.select("event_id", "entry", F.col("price").alias("exit"))


_HOURS = {
    "hb": "SELECT target, CAST(exchange_ts AS DATE) AS day, date_trunc('hour', exchange_ts) AS bar_start, arg_max(price, event_id) AS close, max(price) AS high, min(price) AS low, CAST(sum(volume) AS BIGINT) AS volume FROM v_ticks GROUP BY ALL",
    "cx": "SELECT target, bar_start, lag(close) OVER w AS prev_close, max(high) OVER r - 5 AS res, min(low) OVER r + 5 AS sup, avg(close) OVER r AS mid, avg(volume) OVER r AS va FROM hb WINDOW w AS (PARTITION BY target ORDER BY bar_start), r AS (PARTITION BY target ORDER BY bar_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)",
    "tk": "SELECT t.target, CAST(t.exchange_ts AS DATE) AS day, c.bar_start, t.exchange_ts AS ts, t.event_id, t.price, t.volume, c.prev_close, res, sup, mid, va, coalesce(lag(price) OVER w, prev_close) AS lp, sum(volume) OVER w AS cum FROM v_ticks t JOIN cx c ON c.target = t.target AND c.bar_start = date_trunc('hour', t.exchange_ts) WINDOW w AS (PARTITION BY t.target, c.bar_start ORDER BY t.exchange_ts, t.event_id)",
    "xs": "SELECT *, cum / (greatest(epoch_us(ts - bar_start) / 1e6, 1) / 3600) >= 0.5 * va AS strong FROM tk WHERE mid IS NOT NULL AND va > 0 AND prev_close IS NOT NULL",
    "hits": "SELECT target, bar_start, ts, event_id, 'breakout' AS signal, res AS level FROM xs WHERE prev_close <= res AND lp <= res AND price > res AND strong AND price > mid UNION ALL SELECT target, bar_start, ts, event_id, 'breakdown', sup FROM xs WHERE prev_close >= sup AND lp >= sup AND price < sup AND strong AND price < mid AND NOT (prev_close <= res AND lp <= res AND price > res AND price > mid)",
}


def _contexts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    order = F.struct("exchange_ts", "event_id")
    hour = F.date_trunc("hour", F.col("exchange_ts")).cast("timestamp_ntz")
    ticks = v_ticks(spark, sf_dir).select("target", hour.alias("bar_start"), F.col("exchange_ts").alias("ts"), "exchange_ts", "event_id", "price", "volume")
    b = ticks.groupBy("target", "bar_start").agg(F.max_by("price", order).alias("close"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("volume").alias("volume"))
    w = W.partitionBy("target").orderBy("bar_start")
    r = w.rowsBetween(-4, -1)
    return ticks.drop("exchange_ts"), b.select("target", "bar_start", F.lag("close").over(w).alias("prev_close"), (F.max("high").over(r) - 5).alias("res"), (F.min("low").over(r) + 5).alias("sup"), F.avg("close").over(r).alias("mid"), F.avg("volume").over(r).alias("volume_avg"))


@query(with_views("SELECT target, bar_start, event_id, signal, level FROM (SELECT *, row_number() OVER (PARTITION BY target, bar_start, signal ORDER BY ts, event_id) AS n FROM hits) WHERE n = 1", "v_ticks", **_HOURS))
def inbar_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings inside hourly bars at the tick where the volume's pace suffices."""
    return P.inbar_signals(*_contexts(spark, sf_dir), ["target"], 3600, 0.5).select("target", "bar_start", "event_id", "signal", "level")


@query(with_views("SELECT target, bar_start, event_id, signal, level FROM (SELECT *, row_number() OVER (PARTITION BY target, signal, level ORDER BY ts, event_id) AS n FROM (SELECT target, bar_start, ts, event_id, 'bounce' AS signal, sup AS level FROM tk WHERE prev_close IS NOT NULL AND lp > sup * 1.1 AND price <= sup * 1.1 UNION ALL SELECT target, bar_start, ts, event_id, 'rejection', res FROM tk WHERE prev_close IS NOT NULL AND lp < res * 0.9 AND price >= res * 0.9)) WHERE n = 1", "v_ticks", **_HOURS))
def zone_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.zone_entries(*_contexts(spark, sf_dir), ["target"], 10.0).select("target", "bar_start", "event_id", "signal", "level")


@query(with_views("SELECT count(*) AS common FROM (SELECT DISTINCT target, date_trunc('minute', exchange_ts) AS m FROM v_ticks INTERSECT SELECT DISTINCT target, date_trunc('minute', exchange_ts) FROM v_quotes)", "v_ticks", "v_quotes"))
def common_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of a target with a trade and a quote."""
    minute = F.date_trunc("minute", F.col("exchange_ts")).alias("m")
    return v_ticks(spark, sf_dir).select("target", minute).intersect(v_quotes(spark, sf_dir).select("target", minute)).agg(F.count("*").alias("common"))


_SAMPLE = {
    **_LABEL,
    "lab": "SELECT target, session_start, bar, coalesce(touch, 'NO_TRADE') AS label, coalesce(touch_at, 3) AS outcome_at FROM z WHERE seen = coalesce(touch_at, 3)",
    "ex": "SELECT l.*, b.close + 0.5 AS entry_ask, b.close - 0.5 AS entry_bid, o.close AS exit_close FROM lab l JOIN bars b USING (target, session_start, bar) JOIN bars o ON o.target = l.target AND o.session_start = l.session_start AND o.bar = l.bar + l.outcome_at WHERE o.close IS NOT NULL",
    "smp": """SELECT e.target, e.session_start, e.bar, e.label, e.outcome_at, (e.exit_close - 0.25) - entry_ask AS long_gross, entry_bid - (e.exit_close + 0.25) AS short_gross, f.ret1, f.ret5, f.body_ratio, f.atr5, f.realized_vol, (f.bar + 1) * 60e0 AS from_open,
        (CASE WHEN hour(e.session_start) = 8 THEN 300 ELSE 840 END) - (f.bar + 1) * 60e0 AS to_close, CASE WHEN hour(e.session_start) = 8 THEN 'DAY' ELSE 'NIGHT' END AS session FROM ex e JOIN bf f USING (target, session_start, bar)""",
}


@query(with_views(f"""SELECT target, session_start, bar, label, CAST(outcome_at AS INTEGER) AS outcome_at, {settled_sql('long_gross - 1', 4)} AS long_net, {settled_sql('short_gross - 1', 4)} AS short_net, {settled_sql("CASE label WHEN 'LONG' THEN long_gross - 1 WHEN 'SHORT' THEN short_gross - 1 ELSE 0 END", 4)} AS net, {settled_sql('ret1', 5)} AS ret1, (ret5 IS NULL)::INT::DOUBLE AS ret5_missing, from_open, to_close,
    session || ',' || CASE WHEN realized_vol > 0.002 THEN 'HIGH_VOLATILITY' WHEN realized_vol > 0.0005 THEN 'MEDIUM_VOLATILITY' ELSE 'LOW_VOLATILITY' END || ',' || CASE WHEN abs(ret5) > 0.001 THEN 'TRENDING' ELSE 'RANGING' END || ',NON_EXPIRY_WEEK,' || CASE WHEN from_open <= 30 THEN 'OPENING_30M' WHEN to_close <= 30 THEN 'CLOSING_30M' ELSE 'INTRADAY' END AS regimes
    FROM smp WHERE label <> 'AMBIGUOUS'""", "v_ticks", "v_quotes", **_SAMPLE))  # fmt: skip
def research_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, label, outcome of both sides and regimes of each decision bar; ambiguous labels don't train."""
    b = M.bar_features(_bars(spark, sf_dir))
    e = b.where("complete AND close IS NOT NULL AND atr5 > 0").select(*M.KEYS, "bar", (F.col("close") - 0.5).alias("bid"), (F.col("close") + 0.5).alias("ask"), F.col("atr5").alias("atr"))
    labels = M.triple_barrier(e, b, 3, 0.5, 3.0, 0.75, 2.0).where("label <> 'AMBIGUOUS'").withColumn("outcome_at", F.coalesce("touch_at", F.lit(3)))
    exits = b.where("close IS NOT NULL").select(*M.KEYS, F.col("bar").alias("exit_bar"), (F.col("close") - 0.25).alias("exit_bid"), (F.col("close") + 0.25).alias("exit_ask"))
    x = labels.withColumn("exit_bar", F.col("bar") + F.col("outcome_at")).join(exits, [*M.KEYS, "exit_bar"]).join(b.select(*M.KEYS, "bar", "close", "ret1", "ret5", "realized_vol"), [*M.KEYS, "bar"])
    x = R.net_outcomes(x.withColumn("entry_bid", F.col("close") - 0.5).withColumn("entry_ask", F.col("close") + 0.5), F.lit(1.0))
    day = F.hour("session_start") == 8
    x = x.withColumn("session", F.when(day, "DAY").otherwise("NIGHT")).withColumn("at", F.expr("session_start + make_dt_interval(0, CAST(bar + 1 AS INT))")).withColumn("session_end", F.when(day, F.expr("session_start + interval 5 hours")).otherwise(F.expr("session_start + interval 14 hours")))
    x = x.withColumn("trading_date", F.to_date("session_start")).withColumn("expiry", F.date_add("trading_date", 20))
    x = P.missing_flags(P.time_features(x, "at", "expiry"), ["ret5"])
    tags = F.array_join(R.regime_tags("session", "realized_vol", "ret5", "days_to_expiry", "minutes_from_open", "minutes_to_close"), ",")
    return x.select(*M.KEYS, "bar", "label", F.col("outcome_at").cast("int").alias("outcome_at"), *[settled(n, 4).alias(n) for n in ("long_net", "short_net", "net")], settled("ret1", 5).alias("ret1"), "ret5_missing", F.col("minutes_from_open").alias("from_open"), F.col("minutes_to_close").alias("to_close"), tags.alias("regimes"))


@query(with_views("SELECT target, CAST(bar AS BIGINT) AS bar, h.h AS horizon, sha256(CAST(target AS VARCHAR) || '|' || strftime(session_start + (bar + 1) * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') || '|' || CAST(h.h AS VARCHAR)) AS candidate_id FROM bars, (VALUES (5), (15), (60)) h(h) WHERE complete", "v_ticks", "v_quotes", **_BF))
def decision_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _bars(spark, sf_dir).withColumn("bar_end", F.expr("session_start + make_dt_interval(0, CAST(bar + 1 AS INT))"))
    return P.decision_candidates(x, [5, 15, 60]).select("target", "bar", "horizon", "candidate_id")


@query(with_views("""SELECT multiple, label, count(*) AS n FROM (SELECT multiple, target, session_start, bar, coalesce(max(touch), 'NO_TRADE') AS label FROM (SELECT *, CASE WHEN up AND down THEN 'AMBIGUOUS' WHEN up THEN 'LONG' WHEN down THEN 'SHORT' END AS touch FROM (SELECT *, min(CASE WHEN up OR down THEN k END) OVER (PARTITION BY multiple, target, session_start, bar) AS first FROM xx)) WHERE k <= coalesce(first, 3) GROUP BY ALL HAVING count(*) = coalesce(max(first), 3)) GROUP BY ALL""", "v_ticks", "v_quotes", **_BF,
    xx="SELECT m.multiple, a.target, a.session_start, a.bar, k.k, b.high >= a.close + 0.5 + greatest(m.multiple * a.atr5, 3) AS up, b.low <= a.close - 0.5 - greatest(m.multiple * a.atr5, 3) AS down FROM bf a, (VALUES (0.75::DOUBLE), (1.0::DOUBLE), (1.25::DOUBLE)) m(multiple), (VALUES (1), (2), (3)) k(k), bars b WHERE a.complete AND a.close IS NOT NULL AND a.atr5 > 0 AND b.target = a.target AND b.session_start = a.session_start AND b.bar = a.bar + k.k AND b.complete"))
def atr_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels under three multiples of the range."""
    b = M.bar_features(_bars(spark, sf_dir))
    e = b.where("complete AND close IS NOT NULL AND atr5 > 0").select(*M.KEYS, "bar", (F.col("close") - 0.5).alias("bid"), (F.col("close") + 0.5).alias("ask"), F.col("atr5").alias("atr"))
    out = None
    for k in (0.75, 1.0, 1.25):
        x = M.triple_barrier(e, b, 3, k, 3.0).groupBy("label").agg(F.count("*").alias("n")).select(F.lit(k).alias("multiple"), "label", "n")
        out = x if out is None else out.unionByName(x)
    return out


@query(with_views(f"SELECT event_id, {settled_sql('ask + 0.1')} AS long_entry, {settled_sql('bid - 0.2')} AS long_exit, {settled_sql('bid - 0.1')} AS short_entry, {settled_sql('ask + 0.2')} AS short_exit FROM (SELECT event_id, bid, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ask END AS ask FROM v_quotes) WHERE ask IS NOT NULL UNION ALL SELECT event_id, NULL, NULL, NULL, NULL FROM v_quotes WHERE event_id % 5 = 0", "v_quotes"))
def executable_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of either side with slippage; a fifth of the quotes are crossed."""
    x = v_quotes(spark, sf_dir).withColumn("ask", F.when(F.col("event_id") % 5 == 0, F.col("bid") - 1).otherwise(F.col("ask")))
    return x.select("event_id", *[settled(v).alias(k) for k, v in R.executable("bid", "ask", 0.1, 0.2).items()])
