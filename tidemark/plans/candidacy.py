"""Queries of daily candidates, positions of the day before, presets by width and bar records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import settled, settled_sql
from tidemark.operators import candidates as C
from tidemark.operators import daily as D
from tidemark.operators import samples as P
from tidemark.operators import signals as G
from tidemark.plans.sampling import _MIN, _minutes
from tidemark.plans.screening import _FEATURES, _FLOWS, _MARKET, _features, _foreign
from tidemark.registry import query
from tidemark.sources.views import v_daily, v_flow, with_views

_CANDIDATES = {
    **_FEATURES, **_MARKET, **_FLOWS,
    "ev0": "SELECT d.ticker, d.date, d.close, d.date + (15 + d.ticker % 3) * INTERVAL 1 HOUR AS at_, CASE WHEN n.ticker IS NOT NULL THEN d.date + INTERVAL 17 HOUR END AS fat FROM v_daily d LEFT JOIN net n ON n.ticker = d.ticker AND n.date = d.date",
    "ev1": "SELECT ticker, date, greatest(max(at_) OVER (PARTITION BY ticker ORDER BY date ROWS 23 PRECEDING), max(fat) OVER (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)) AS own, CASE WHEN lag(close, 1) OVER w > 0 AND lag(close, 3) OVER w > 0 THEN greatest(at_, lag(at_, 1) OVER w, lag(at_, 3) OVER w) END AS seen FROM ev0 WINDOW w AS (PARTITION BY ticker ORDER BY date)",
    "ev": "SELECT ticker, date, greatest(own, max(seen) OVER (PARTITION BY date)) AS decision_time FROM ev1",
    "cand": """SELECT f.*, m.breadth, m.median_momentum3, f.momentum3 - m.median_momentum3 AS relative_momentum3, CASE WHEN avg_turnover > 0 THEN log10(avg_turnover) END AS avg_turnover_log10, g.foreign_streak, g.foreign_intensity, g.foreign_percentile, e.decision_time FROM feats f
        LEFT JOIN market m ON f.date = m.date LEFT JOIN foreign_t g ON f.ticker = g.ticker AND f.date = g.date JOIN ev e ON e.ticker = f.ticker AND e.date = f.date WHERE """ + " AND ".join(f"{n} IS NOT NULL" for n in C.REQUIRED),
}


def _eight(n: str) -> str:
    """A value as a candidate holds it, with 8 digits, settled to 4."""
    return settled_sql(f"floor(({n}) * 1e8 + 0.5) / 1e8", 4)


@query(with_views(f"SELECT ticker, date, strftime(decision_time, '%Y-%m-%d %H:%M') AS decided, {_eight('close')} AS price, {', '.join(f'{_eight(n)} AS {n}' for n in C.FEATURES)} FROM cand", "v_daily", "v_flow", **_CANDIDATES))
def daily_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 19 features of every candidate and when its last evidence came; bars come at 15, 16 or 17 hours, flows at 17."""
    x = _features(spark, sf_dir)
    bars = v_daily(spark, sf_dir).withColumn("available_at", F.expr("CAST(date AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(15 + ticker % 3 AS INT))"))
    flows = D.daily_net(v_flow(spark, sf_dir).where("investor = 'MACHINERY'"), ["ticker", "date"]).withColumn("available_at", F.expr("CAST(date AS TIMESTAMP_NTZ) + interval 17 hours"))
    y = C.candidates(D.with_market(x, D.market_snapshot(x)), _foreign(spark, sf_dir), C.latest_evidence(bars, flows))
    return y.select("ticker", "date", F.date_format("decision_time", "yyyy-MM-dd HH:mm").alias("decided"), settled("price", 4).alias("price"), *[settled(n, 4).alias(n) for n in C.FEATURES])


_PUBLISHED = {
    "pub": "SELECT ticker, date, CASE WHEN count(*) FILTER (net IS NULL) = 0 THEN sum(net) END AS net FROM v_flow GROUP BY 1, 2",
    "before": "SELECT ticker, date, lag(net) OVER (PARTITION BY ticker ORDER BY date) AS net FROM pub",
    "paired": "SELECT b.ticker, b.date, d.close, b.net FROM before b JOIN v_daily d ON b.ticker = d.ticker AND b.date = d.date WHERE b.net IS NOT NULL",
    "scored": "SELECT *, count(net) OVER w AS k, avg(net) OVER w AS m, stddev_pop(net) OVER w AS s FROM paired WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)",
}


@query(with_views(f"SELECT ticker, date, {settled_sql('close', 4)} AS close, {settled_sql('net', 2)} AS net, {settled_sql('CASE WHEN s > 0 THEN (net - m) / s ELSE 0 END', 4)} AS net_z FROM scored WHERE k = 12", "v_daily", "v_flow", **_PUBLISHED))
def positions_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each week's close beside the flows published the week before, against the 12 weeks before those."""
    x = C.positions_before(D.daily_net(v_flow(spark, sf_dir), ["ticker", "date"]), v_daily(spark, sf_dir), ["net"], 12, "date", ["ticker"])
    return x.select("ticker", "date", settled("close", 4).alias("close"), settled("net", 2).alias("net"), settled("net_z", 4).alias("net_z"))


_WIDTHS = "(VALUES (60), (15), (5)) k(width)"
_WIDE = {
    **_MIN,
    "wb": f"SELECT target, session_start, width, session_start + CAST(floor(epoch_us(minute - session_start) / 6e7 / width) AS BIGINT) * width * INTERVAL 1 MINUTE AS bar_start, arg_min(open, minute) AS open, max(high) AS high, min(low) AS low, arg_max(close, minute) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM mn, {_WIDTHS} WHERE epoch_us(session_end - session_start) / 6e7 >= (floor(epoch_us(minute - session_start) / 6e7 / width) + 1) * width GROUP BY ALL",
}
_PRESET = {**_WIDE}
for _m, (_side, _zone, _n, _ratio) in G.PRESETS.items():
    _w = "WINDOW w AS (PARTITION BY target ORDER BY bar_start)"
    _f = lambda a, b: f"OVER (PARTITION BY target ORDER BY bar_start ROWS BETWEEN {a} AND {b})"
    _t, _v = _f("19 PRECEDING", "CURRENT ROW"), _f(f"{_n - 1} PRECEDING", "CURRENT ROW")
    _left, _right = _f(f"{_side} PRECEDING", "1 PRECEDING"), _f("1 FOLLOWING", f"{_side} FOLLOWING")
    _whole = f"count(*) {_f(f'{_side} PRECEDING', f'{_side} FOLLOWING')} = {2 * _side + 1}"
    _PRESET |= {
        f"a{_m}": f"""SELECT *, CASE WHEN count(*) {_t} = 20 THEN avg(close) {_t} END AS mid, CASE WHEN count(*) {_t} = 20 THEN stddev_pop(close) {_t} END AS dev, CASE WHEN count(*) {_v} = {_n} THEN avg(volume) {_v} END AS volume_avg,
            CASE WHEN {_whole} AND high > max(high) {_left} AND high > max(high) {_right} THEN high END AS ph, CASE WHEN {_whole} AND low < min(low) {_left} AND low < min(low) {_right} THEN low END AS pl FROM wb WHERE width = {_m}""",
        f"b{_m}": f"SELECT *, coalesce(volume_avg > 0 AND volume >= {_ratio} * volume_avg, false) AS strong, lag(ph, {_side}) OVER w AS dh, lag(pl, {_side}) OVER w AS dl FROM a{_m} {_w}",
        f"c{_m}": f"SELECT *, last_value(dh IGNORE NULLS) OVER w AS r0, last_value(dl IGNORE NULLS) OVER w AS s0 FROM b{_m} {_w}",
        f"d{_m}": f"SELECT *, lag(r0) OVER w AS r, lag(s0) OVER w AS s, lag(close) OVER w AS before, {_zone} / 100 AS z FROM c{_m} {_w}",
    }
_SIGNALS = [
    ("breakout", "r", "close > r AND before <= r AND strong AND close > mid"), ("breakdown", "s", "close < s AND before >= s AND strong AND close < mid"),
    ("bounce", "s", "low <= s * (1 + z) AND high >= s * (1 - z) AND low <= mid - 2 * dev AND close >= s AND close > open"), ("rejection", "r", "high >= r * (1 - z) AND low <= r * (1 + z) AND high >= mid + 2 * dev AND close <= r AND close < open"),
]


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = P.bars_of_minutes(_minutes(spark, sf_dir), list(G.PRESETS))
    return x.withColumn("bar_start", F.expr("session_start + make_dt_interval(0, 0, CAST(bucket * width AS INT))"))


@query(with_views(" UNION ALL ".join(f"SELECT target, width, bar_start, '{n}' AS signal, {lv} AS level FROM d{m} WHERE mid IS NOT NULL AND {cond}" for m in G.PRESETS for n, lv, cond in _SIGNALS), "v_ticks", "v_quotes", **_PRESET))
def preset_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level signals of bars of an hour, 15 and 5 minutes, each width under its own preset."""
    return G.preset_signals(_wide(spark, sf_dir), ["target"], "bar_start").select("target", "width", "bar_start", "signal", "level")


@query(with_views(" UNION ALL ".join(f"SELECT target, width, bar_start, {settled_sql('volume_avg', 4)} AS volume_avg, strong FROM b{m}" for m in G.PRESETS), "v_ticks", "v_quotes", **_PRESET))
def strong_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.with_presets(_wide(spark, sf_dir), ["target"], "bar_start")
    return x.select("target", "width", "bar_start", settled("volume_avg", 4).alias("volume_avg"), "strong")


@query(with_views("""SELECT 'derived-kbar-15m-' || target || '-' || CAST(trading_date AS VARCHAR) || '-' || session || '-' || strftime(bar_start, '%Y-%m-%dT%H:%M:%S') AS event_id, bar_start AS exchange_datetime, session, strftime(bar_start + INTERVAL 15 MINUTE, '%Y-%m-%dT%H:%M:%S') AS bar_end, close, volume
    FROM wb JOIN (SELECT session_start, trading_date, session FROM cal) c USING (session_start) WHERE width = 15""", "v_ticks", "v_quotes", **_WIDE))  # fmt: skip
def bar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of 15 minutes as records for an append-only store."""
    from tidemark.plans.microstructure import _calendar

    bars = _wide(spark, sf_dir).where("width = 15").join(_calendar(spark, sf_dir).select("session_start", "trading_date", "session"), "session_start")
    x = C.stored_bars(bars, F.col("target"), F.lit("2024-01-01T00:00:00+08:00"))
    return x.select("event_id", "exchange_datetime", "session", "fields.bar_end", F.col("fields.Close").alias("close"), F.col("fields.Volume").alias("volume"))
