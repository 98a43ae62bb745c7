"""Queries of sessions, as-of joins, step states, bars, intraday features and labels, on the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import settled, settled_sql
from tidemark.operators import micro as M
from tidemark.registry import query
from tidemark.sources.views import table, v_quotes, v_ticks, with_views

#: Steps of ten minutes, as the event table is thin. The calendar runs from its first date to the one its last night may join.
STEP, AGE = 600, 3600.0

_CAL = {
    "weekdays": "SELECT CAST(d AS DATE) AS d, CAST(d AS DATE) - CASE isodow(d) WHEN 1 THEN 3 ELSE 1 END AS p FROM (SELECT unnest(generate_series((SELECT CAST(min(ts) AS DATE) FROM events), (SELECT CAST(max(ts) AS DATE) + 4 FROM events), INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6",
    "cal": """SELECT d AS trading_date, 'DAY' AS session, d + INTERVAL '8 hours 45 minutes' AS session_start, d + INTERVAL '13 hours 45 minutes' AS session_end FROM weekdays
        UNION ALL SELECT d, 'NIGHT', p + INTERVAL '15 hours', p + INTERVAL '29 hours' FROM weekdays""",
}
_SESSIONS = {**_CAL, **{f"{k}_s": f"SELECT v.*, trading_date, coalesce(session, 'CLOSED') AS session, session_start, session_end FROM v_{k} v LEFT JOIN cal ON exchange_ts >= session_start AND exchange_ts < session_end" for k in ("ticks", "quotes")}}
_STATES = {
    **_SESSIONS,
    "t0": f"SELECT *, CAST(floor(epoch_us(exchange_ts - session_start) / {STEP}e6) AS BIGINT) AS step FROM ticks_s WHERE session <> 'CLOSED'",
    "q0": f"SELECT *, CAST(floor(epoch_us(exchange_ts - session_start) / {STEP}e6) AS BIGINT) AS step FROM quotes_s WHERE session <> 'CLOSED'",
    "t1": """SELECT target, session_start, step, arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close, CAST(sum(volume) AS BIGINT) AS volume,
        count(*) AS trades, CAST(coalesce(sum(volume) FILTER (side = 'buy'), 0) AS BIGINT) AS buy_volume, CAST(coalesce(sum(volume) FILTER (side = 'sell'), 0) AS BIGINT) AS sell_volume,
        CAST(coalesce(sum(volume) FILTER (side = 'unknown'), 0) AS BIGINT) AS unknown_volume, sum(price * volume) AS notional, max(exchange_ts) AS tick_ts FROM t0 GROUP BY ALL""",
    "q1": "SELECT target, session_start, step, arg_max(bid, event_id) AS bid, arg_max(ask, event_id) AS ask, max(exchange_ts) AS quote_ts FROM q0 GROUP BY ALL",
    "span": "SELECT target, session_start, min(step) AS a, max(step) AS b FROM (SELECT target, session_start, step FROM t0 UNION ALL SELECT target, session_start, step FROM q0) GROUP BY ALL",
    "grid": "SELECT target, session_start, unnest(generate_series(a, b)) AS step FROM span",
    "raw": """SELECT g.*, open, high, low, close, coalesce(volume, 0) AS volume, coalesce(trades, 0) AS trades, coalesce(buy_volume, 0) AS buy_volume, coalesce(sell_volume, 0) AS sell_volume,
        coalesce(unknown_volume, 0) AS unknown_volume, coalesce(notional, 0) AS notional, last_value(bid IGNORE NULLS) OVER w AS bid, last_value(ask IGNORE NULLS) OVER w AS ask,
        last_value(quote_ts IGNORE NULLS) OVER w AS quote_ts, last_value(tick_ts IGNORE NULLS) OVER w AS tick_ts
        FROM grid g LEFT JOIN t1 USING (target, session_start, step) LEFT JOIN q1 USING (target, session_start, step)
        WINDOW w AS (PARTITION BY g.target, g.session_start ORDER BY g.step)""",
    "states": f"""SELECT *, coalesce(quote_age_s <= {AGE}, false) AS quote_fresh, CASE WHEN quote_age_s <= {AGE} THEN ask - bid END AS spread, CASE WHEN quote_age_s <= {AGE} THEN (ask + bid) / 2 END AS midpoint
        FROM (SELECT *, (step + 1) * {STEP} - epoch_us(tick_ts - session_start) / 1e6 AS tick_age_s, (step + 1) * {STEP} - epoch_us(quote_ts - session_start) / 1e6 AS quote_age_s FROM raw)""",
}
_BARS = {
    **_STATES,
    "b0": "SELECT *, step // 6 AS bar, least(6, CASE WHEN hour(session_start) = 8 THEN 30 ELSE 84 END - step // 6 * 6) AS expected FROM states",
    "bars": """SELECT target, session_start, bar, arg_min(open, step) FILTER (trades > 0) AS open, max(high) AS high, min(low) AS low, arg_max(close, step) FILTER (trades > 0) AS close,
        CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trades) AS BIGINT) AS trades, CAST(sum(buy_volume) AS BIGINT) AS buy_volume, CAST(sum(sell_volume) AS BIGINT) AS sell_volume,
        CASE WHEN sum(volume) > 0 THEN sum(notional) / sum(volume) END AS vwap, count(*) FILTER (quote_fresh) / max(expected) AS quote_coverage,
        count(*) FILTER (trades > 0) / max(expected) AS tick_coverage, count(*) = max(expected) AND max(expected) = 6 AS complete FROM b0 GROUP BY ALL""",
}
_BW = "WINDOW w AS (PARTITION BY target, session_start ORDER BY bar), p AS (PARTITION BY target, session_start ORDER BY bar ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY target, session_start ORDER BY bar ROWS 4 PRECEDING), g AS (PARTITION BY target, session_start ORDER BY bar ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_BF = {
    **_BARS,
    "bf1": f"""SELECT *, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS true_range,
        close / lag(close) OVER w - 1 AS ret1, close / lag(close, 5) OVER w - 1 AS ret5, sum(CASE WHEN close > open THEN 0 ELSE 1 END) OVER p AS island,
        sum(vwap * volume) OVER p / sum(CASE WHEN vwap IS NOT NULL THEN volume END) OVER p AS session_vwap, sum(vwap * volume) OVER f / sum(CASE WHEN vwap IS NOT NULL THEN volume END) OVER f AS vwap5 FROM bars {_BW}""",
    "bf2": f"""SELECT *, CAST(sum(CASE WHEN close > open THEN 1 ELSE 0 END) OVER (PARTITION BY target, session_start, island ORDER BY bar) AS BIGINT) AS rising_run, avg(true_range) OVER f AS atr5,
        CASE WHEN high > low THEN abs(close - open) / (high - low) WHEN high IS NOT NULL THEN 0 END AS body_ratio, session_vwap - lag(session_vwap) OVER w AS vwap_slope,
        sqrt(sum(ret1 * ret1) OVER f) AS realized_vol, CASE WHEN avg(true_range) OVER g <> 0 THEN true_range / avg(true_range) OVER g END AS range_expansion FROM bf1 {_BW}""",
    "bf": "SELECT *, CASE WHEN atr5 > 0 THEN (close - session_vwap) / atr5 END AS vwap_distance_atr FROM bf2",
}


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = table(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).cast("string").alias("first"), F.date_add(F.to_date(F.max("ts")), 4).cast("string").alias("last")).first()
    return M.weekday_calendar(spark, span["first"] or "2000-01-03", span["last"] or "2000-01-03")


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cal = _calendar(spark, sf_dir)
    return tuple(M.resolve_sessions(v(spark, sf_dir), cal).where("session <> 'CLOSED'") for v in (v_ticks, v_quotes))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.step_states(*_sessions(spark, sf_dir), STEP, AGE)


def _bars(spark: SparkSession, sf_dir: str, n: int = 6) -> DataFrame:
    return M.bars(_states(spark, sf_dir), n, F.when(F.hour("session_start") == 8, 30).otherwise(84))


@query(with_views("SELECT target, session, count(*) AS n, count(DISTINCT trading_date) AS dates, min(exchange_ts) AS first_ts, max(exchange_ts) AS last_ts FROM ticks_s GROUP BY ALL", "v_ticks", "v_quotes", **_SESSIONS))
def session_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.resolve_sessions(v_ticks(spark, sf_dir), _calendar(spark, sf_dir))
    return x.groupBy("target", "session").agg(F.count("*").alias("n"), F.count_distinct("trading_date").alias("dates"), F.min("exchange_ts").alias("first_ts"), F.max("exchange_ts").alias("last_ts"))


@query(with_views("SELECT c.trading_date, c.session FROM cal c ANTI JOIN ticks_s t ON c.trading_date = t.trading_date AND c.session = t.session", "v_ticks", "v_quotes", **_SESSIONS))
def session_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the calendar without any trade."""
    cal = _calendar(spark, sf_dir)
    seen = M.resolve_sessions(v_ticks(spark, sf_dir), cal).select("trading_date", "session").distinct()
    return cal.select("trading_date", "session").join(seen, ["trading_date", "session"], "left_anti")


@query(with_views(f"""SELECT t.event_id, arg_max(q.event_id, (q.exchange_ts, q.event_id)) AS quote_id, max(q.exchange_ts) AS quote_ts, {settled_sql('epoch_us(t.exchange_ts - max(q.exchange_ts)) / 1e6')} AS quote_age_s,
    CASE WHEN max(q.exchange_ts) IS NULL THEN 'MISSING' WHEN epoch_us(t.exchange_ts - max(q.exchange_ts)) / 1e6 > 1800 THEN 'STALE' ELSE 'OK' END AS status
    FROM v_ticks t LEFT JOIN v_quotes q ON t.target = q.target AND strftime(t.exchange_ts, '%Y%m') = strftime(q.exchange_ts, '%Y%m') AND q.exchange_ts <= t.exchange_ts AND q.received_ts <= t.received_ts
    GROUP BY t.event_id, t.exchange_ts""", "v_ticks", "v_quotes"))  # fmt: skip
def quote_asof_two_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By target and delivery month, the month of the event here."""
    ticks, quotes = (v(spark, sf_dir).withColumn("delivery", F.date_format("exchange_ts", "yyyyMM")) for v in (v_ticks, v_quotes))
    return M.asof_quotes(ticks, quotes, ["target", "delivery"], 1800.0).select("event_id", "quote_id", "quote_ts", settled("quote_age_s").alias("quote_age_s"), "status")


@query(with_views("SELECT t.event_id, q.exchange_ts AS matched_ts, q.bid, q.ask FROM v_ticks t ASOF LEFT JOIN v_quotes q ON t.target = q.target AND t.exchange_ts > q.exchange_ts", "v_ticks", "v_quotes"))
def quote_before_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last quote strictly before each trade, by one sort per target."""
    return M.asof_backward(v_ticks(spark, sf_dir), v_quotes(spark, sf_dir), ["target"], "exchange_ts", "exchange_ts", ["bid", "ask"], strict=True).select("event_id", "matched_ts", "bid", "ask")


_STATE_COLS = ["target", "session_start", "step", "open", "high", "low", "close", "volume", "trades", "buy_volume", "sell_volume", "unknown_volume", "bid", "ask", "quote_fresh"]


@query(with_views(f"SELECT {', '.join(_STATE_COLS)}, {settled_sql('notional', 3)} AS notional, {settled_sql('spread')} AS spread, {settled_sql('midpoint')} AS midpoint, {settled_sql('tick_age_s', 3)} AS tick_age_s, {settled_sql('quote_age_s', 3)} AS quote_age_s FROM states", "v_ticks", "v_quotes", **_STATES))
def step_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select(*_STATE_COLS, settled("notional", 3).alias("notional"), *[settled(x).alias(x) for x in ("spread", "midpoint")], *[settled(x, 3).alias(x) for x in ("tick_age_s", "quote_age_s")])


_BAR_COLS = ["target", "session_start", "bar", "open", "high", "low", "close", "volume", "trades", "buy_volume", "sell_volume", "complete"]


@query(with_views(f"SELECT {', '.join(_BAR_COLS)}, {', '.join(f'{settled_sql(x)} AS {x}' for x in ('vwap', 'quote_coverage', 'tick_coverage'))} FROM bars", "v_ticks", "v_quotes", **_BARS))
def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir).select(*_BAR_COLS, *[settled(x).alias(x) for x in ("vwap", "quote_coverage", "tick_coverage")])


@query(with_views(f"SELECT {', '.join(_BAR_COLS)} FROM bars WHERE complete", "v_ticks", "v_quotes", **_BARS))
def research_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir).where("complete").select(*_BAR_COLS)


_BF_COLS = ("ret1", "ret5", "true_range", "atr5", "session_vwap", "vwap5", "body_ratio", "vwap_slope", "vwap_distance_atr", "realized_vol", "range_expansion")


@query(with_views(f"SELECT target, session_start, bar, rising_run, {', '.join(f'{settled_sql(x, 5)} AS {x}' for x in _BF_COLS)} FROM bf", "v_ticks", "v_quotes", **_BF))
def bar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bar_features(_bars(spark, sf_dir)).select("target", "session_start", "bar", "rising_run", *[settled(x, 5).alias(x) for x in _BF_COLS])


@query(with_views(f"""SELECT target, session_start, bar, {settled_sql('CASE WHEN pc <> 0 AND atr5 <> 0 THEN (close - ph) / atr5 END', 5)} AS to_prev_high, {settled_sql('CASE WHEN atr5 <> 0 THEN (close - pl) / atr5 END', 5)} AS to_prev_low, close > ph AS breaks_prev_high
    FROM bf JOIN prev USING (target, session_start)""", "v_ticks", "v_quotes", **_BF,
    ses="SELECT target, session_start, max(high) AS hi, min(low) AS lo, arg_max(close, bar) AS cl FROM bf GROUP BY ALL",
    prev="SELECT target, session_start, lag(hi) OVER w AS ph, lag(lo) OVER w AS pl, coalesce(lag(cl) OVER w, 1) AS pc FROM ses WINDOW w AS (PARTITION BY target ORDER BY session_start)"))
def session_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.session_structure(M.bar_features(_bars(spark, sf_dir)))
    return x.select("target", "session_start", "bar", settled("to_prev_high", 5).alias("to_prev_high"), settled("to_prev_low", 5).alias("to_prev_low"), "breaks_prev_high")


@query(with_views(f"""SELECT target, session_start, step, CAST(sum(buy_volume) OVER w AS BIGINT) AS buy_flow, CAST(sum(sell_volume) OVER w AS BIGINT) AS sell_flow,
    {settled_sql('CASE WHEN sum(buy_volume + sell_volume) OVER w > 0 THEN (sum(buy_volume) OVER w - sum(sell_volume) OVER w) / sum(buy_volume + sell_volume) OVER w END')} AS flow_imbalance,
    {settled_sql('CASE WHEN sum(volume) OVER w > 0 THEN sum(CASE WHEN volume >= 50 THEN volume ELSE 0 END) OVER w / sum(volume) OVER w END')} AS large_share
    FROM states WINDOW w AS (PARTITION BY target, session_start ORDER BY step ROWS 9 PRECEDING)""", "v_ticks", "v_quotes", **_STATES))  # fmt: skip
def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.order_flow(_states(spark, sf_dir)).select(*M.KEYS, "step", "buy_flow", "sell_flow", settled("flow_imbalance").alias("flow_imbalance"), settled("large_share").alias("large_share"))


@query(with_views(f"""SELECT s.target, s.session_start, s.step, {settled_sql('k.level')} AS level, {settled_sql('k.change10')} AS change10, {settled_sql('k.zscore', 4)} AS zscore FROM states s
    ASOF LEFT JOIN known k ON s.target = k.target AND s.session_start = k.session_start AND s.step >= k.step""", "v_ticks", "v_quotes", **_STATES,
    known="""SELECT target, session_start, step, close - midpoint AS level, close - midpoint - lag(close - midpoint, 10) OVER w AS change10,
        CASE WHEN count(*) OVER f > 1 AND stddev_pop(close - midpoint) OVER f > 0 THEN (close - midpoint - avg(close - midpoint) OVER f) / stddev_pop(close - midpoint) OVER f END AS zscore
        FROM states WHERE close - midpoint IS NOT NULL WINDOW w AS (PARTITION BY target, session_start ORDER BY step), f AS (PARTITION BY target, session_start ORDER BY step ROWS 29 PRECEDING)"""))  # fmt: skip
def basis_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.basis_features(_states(spark, sf_dir).withColumn("basis", F.col("close") - F.col("midpoint")), window=30)
    return x.select(*M.KEYS, "step", settled("level").alias("level"), settled("change10").alias("change10"), settled("zscore", 4).alias("zscore"))


@query(with_views("SELECT target, quantile_disc(volume, 0.5) IS NOT NULL AS ok, list_sort(list(volume))[greatest(0, CAST(floor(count(*) * 0.9) AS BIGINT) - 1) + 1] AS threshold FROM v_ticks GROUP BY 1", "v_ticks"))
def volume_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.percentile_volume(v_ticks(spark, sf_dir), ["target"], "volume").select("target", F.lit(True).alias("ok"), "threshold")


@query(with_views(f"""SELECT target, session_start, bar, {settled_sql('ema', 5)} AS ema FROM walk""", "v_ticks", "v_quotes", **_BARS,
    seq="SELECT target, session_start, bar, close, row_number() OVER (PARTITION BY target, session_start ORDER BY bar) AS i FROM bars WHERE close IS NOT NULL",
    walk="""SELECT target, session_start, bar, i, list_reduce(list_transform(list(close) OVER w, lambda v: v), lambda a, v: 0.4 * v + 0.6 * a) AS ema FROM seq
        WINDOW w AS (PARTITION BY target, session_start ORDER BY bar ROWS UNBOUNDED PRECEDING)"""))  # fmt: skip
def bar_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = M.ema(_bars(spark, sf_dir).where("close IS NOT NULL"), "close", 4, M.KEYS, "bar", "ema")
    return x.select(*M.KEYS, "bar", settled("ema", 5).alias("ema"))


_LABEL = {
    **_BF,
    "e": "SELECT target, session_start, bar, close - 0.5 AS bid, close + 0.5 AS ask, greatest(0.5 * atr5, 3) AS width, greatest(0.75 * atr5, 2) AS stop FROM bf WHERE complete AND close IS NOT NULL AND atr5 > 0",
    "x": "SELECT e.*, k.k, b.high, b.low, e.ask + width AS upper, e.bid - stop AS lower, high >= e.ask + width AS up, low <= e.bid - stop AS down FROM e, (VALUES (1), (2), (3)) k(k), bars b WHERE b.target = e.target AND b.session_start = e.session_start AND b.bar = e.bar + k.k AND b.complete",
    "y": "SELECT *, min(CASE WHEN up OR down THEN k END) OVER (PARTITION BY target, session_start, bar) AS first FROM x",
    "z": """SELECT target, session_start, bar, max(first) AS touch_at, count(*) AS seen, max(CASE WHEN up AND down THEN 'AMBIGUOUS' WHEN up THEN 'LONG' WHEN down THEN 'SHORT' END) AS touch,
        greatest(0, max(high - ask)) AS mfe, greatest(0, max(bid - low)) AS mae FROM y WHERE k <= coalesce(first, 3) GROUP BY ALL""",
}


@query(with_views(f"SELECT target, session_start, bar, coalesce(touch, 'NO_TRADE') AS label, touch_at, {settled_sql('coalesce(mfe, 0)', 5)} AS mfe, {settled_sql('coalesce(mae, 0)', 5)} AS mae FROM z WHERE seen = coalesce(touch_at, 3)", "v_ticks", "v_quotes", **_LABEL))
def triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = M.bar_features(_bars(spark, sf_dir))
    e = b.where("complete AND close IS NOT NULL AND atr5 > 0").select(*M.KEYS, "bar", (F.col("close") - 0.5).alias("bid"), (F.col("close") + 0.5).alias("ask"), F.col("atr5").alias("atr"))
    x = M.triple_barrier(e, b, 3, 0.5, 3.0, 0.75, 2.0)
    return x.select(*M.KEYS, "bar", "label", "touch_at", settled("mfe", 5).alias("mfe"), settled("mae", 5).alias("mae"))


@query(with_views("""SELECT width, label, count(*) AS n FROM (SELECT w.width, CASE WHEN max(high) >= close + w.width AND min(low) <= close - w.width THEN 'BOTH' WHEN max(high) >= close + w.width THEN 'LONG' WHEN min(low) <= close - w.width THEN 'SHORT' ELSE 'NO_TRADE' END AS label
    FROM (SELECT * FROM nxt) n, (VALUES (5.0::DOUBLE), (10.0::DOUBLE), (20.0::DOUBLE)) w(width) GROUP BY target, session_start, bar, close, w.width) GROUP BY ALL""", "v_ticks", "v_quotes", **_BARS,
    nxt="SELECT a.target, a.session_start, a.bar, a.close, b.high, b.low FROM bars a JOIN bars b ON a.target = b.target AND a.session_start = b.session_start AND b.bar BETWEEN a.bar + 1 AND a.bar + 3 WHERE a.close IS NOT NULL"))
def barrier_width_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels per barrier width, from the widest move of the next three bars."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*M.KEYS).orderBy("bar").rangeBetween(1, 3)
    x = _bars(spark, sf_dir).withColumn("hi", F.max("high").over(w)).withColumn("lo", F.min("low").over(w)).withColumn("next", F.count("*").over(w)).where("close IS NOT NULL AND next > 0")
    x = x.withColumn("width", F.explode(F.array(F.lit(5.0), F.lit(10.0), F.lit(20.0))))
    up, down = F.col("hi") >= F.col("close") + F.col("width"), F.col("lo") <= F.col("close") - F.col("width")
    label = F.when(up & down, "BOTH").when(up, "LONG").when(down, "SHORT").otherwise("NO_TRADE")
    return x.groupBy("width", label.alias("label")).agg(F.count("*").alias("n"))
