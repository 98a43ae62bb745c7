"""Queries of market facts, regimes, spikes, oscillators and scores, on weekly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import settled, settled_sql
from tidemark.operators import facts as A
from tidemark.operators import micro as M
from tidemark.operators import samples as P
from tidemark.operators import signals as G
from tidemark.operators import validation as V
from tidemark.plans.signalling import _PIVOTS, _pivots, _signals
from tidemark.registry import query
from tidemark.sources.views import v_daily, with_views

_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"
_GEO = {
    "g0": "SELECT *, abs(close - open) / (high - low) AS body_ratio, (high - greatest(open, close)) / (high - low) AS upper_wick, (least(open, close) - low) / (high - low) AS lower_wick, CASE WHEN abs(close - open) / (high - low) < 0.1 THEN 0 WHEN close > open THEN 1 ELSE -1 END AS way, greatest(open, close) AS t, least(open, close) AS b FROM v_daily",
    "g1": f"SELECT *, CASE WHEN lag(t) OVER w IS NULL THEN NULL WHEN least(t - b, lag(t) OVER w - lag(b) OVER w) > 0 THEN greatest(0, least(t, lag(t) OVER w) - greatest(b, lag(b) OVER w)) / least(t - b, lag(t) OVER w - lag(b) OVER w) ELSE 0 END AS overlap, coalesce(way = 0 OR way <> lag(way) OVER w, true)::INT AS isnew FROM g0 {_W}",
    "g2": "SELECT *, sum(isnew) OVER (PARTITION BY ticker ORDER BY date) AS island FROM g1",
    "geo": "SELECT *, CASE WHEN way = 0 THEN 0 ELSE count(*) OVER (PARTITION BY ticker, island ORDER BY date) END AS run FROM g2",
}


@query(with_views(f"SELECT ticker, date, way, run, {', '.join(f'{settled_sql(x)} AS {x}' for x in ('body_ratio', 'upper_wick', 'lower_wick', 'overlap'))} FROM geo", "v_daily", **_GEO))
def bar_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = A.bar_geometry(v_daily(spark, sf_dir))
    return x.select("ticker", "date", "way", "run", *[settled(n).alias(n) for n in ("body_ratio", "upper_wick", "lower_wick", "overlap")])


def _b(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"


_FACT = {
    **_GEO,
    "fct": f"""SELECT *, (close / lag(close) OVER w - 1) * 100 AS change_pct, {', '.join(f"CASE WHEN count(*) {_b(n)} = {n} THEN avg(close) {_b(n)} END AS ma{n}" for n in (5, 10, 20, 60))}, CASE WHEN count(*) {_b(20)} = 20 THEN turnover / avg(turnover) {_b(20)} END AS turnover_ratio,
        CASE WHEN count(*) {_b(20)} = 20 THEN avg(turnover) {_b(5)} / avg(turnover) {_b(20)} END AS turnover_5_20, max(high) {_b(60)} AS swing_high, min(low) {_b(60)} AS swing_low, avg(overlap) {_b(4)} AS overlap5 FROM geo {_W}""",
    "fct2": "SELECT *, CASE WHEN swing_high > swing_low THEN (close - swing_low) / (swing_high - swing_low) * 100 END AS retracement_pct, (close / swing_high - 1) * 100 AS drawdown_pct, CASE WHEN ma20 IS NOT NULL THEN CASE WHEN close >= ma20 THEN 'above' ELSE 'below' END END AS vs20, CASE WHEN ma60 IS NOT NULL THEN CASE WHEN close >= ma60 THEN 'above' ELSE 'below' END END AS vs60 FROM fct",
}
_NUMBERS = ("change_pct", "ma5", "ma10", "ma20", "ma60", "turnover_ratio", "turnover_5_20", "retracement_pct", "drawdown_pct", "overlap5")


@query(with_views(f"SELECT ticker, date, vs20, vs60, swing_high, swing_low, {', '.join(f'{settled_sql(x, 4)} AS {x}' for x in _NUMBERS)} FROM fct2", "v_daily", **_FACT))
def market_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.market_facts(v_daily(spark, sf_dir)).select("ticker", "date", "vs20", "vs60", "swing_high", "swing_low", *[settled(n, 4).alias(n) for n in _NUMBERS])


@query()
def market_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime of each bar; tests compare it with a plain walk over each ticker's bars."""
    return A.regimes(A.market_facts(v_daily(spark, sf_dir))).select("ticker", "date", "regime", "direction", "alternative", "confidence", "pullback_pct")


@query()
def fact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fact_table(A.market_facts(v_daily(spark, sf_dir)))


_SPK = {
    "k0": "SELECT *, CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END AS wy, abs(close - open) / (high - low) > 0.5 AS tr FROM v_daily",
    "k1": f"SELECT *, lag(open) OVER w AS po, lag(close) OVER w AS pc, lag(tr) OVER w AS pt, lag(wy) OVER w AS pw FROM k0 {_W}",
    "k2": "SELECT *, coalesce(tr AND pt AND wy <> 0 AND wy = pw AND CASE WHEN abs(close - open) + abs(pc - po) > 0 THEN greatest(0, least(greatest(open, close), greatest(po, pc)) - greatest(least(open, close), least(po, pc))) / ((abs(close - open) + abs(pc - po)) / 2) ELSE 1 END < 0.30, false) AS linked FROM k1",
    "k3": "SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS isl, count(*) OVER f AS nn, max(high) OVER f AS hi, min(low) OVER f AS lo, last(close) OVER f AS thn FROM k2 WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)",
    "k4": "SELECT ticker, isl, count(*) AS length, max(date) AS ends, first(wy) AS way, arg_min(open, date) AS o, arg_max(close, date) AS c, arg_max(nn, date) AS n, arg_max(hi, date) AS hi, arg_max(lo, date) AS lo, arg_max(thn, date) AS thn FROM k3 GROUP BY 1, 2 HAVING count(*) >= 2",
}


_SPIKES = "SELECT ticker, ends, length, way, CASE WHEN n < 10 THEN NULL WHEN (thn - c) / c * way < 0 AND abs((thn - c) / c * way) * c > abs(c - o) * 0.5 THEN 'reversal' WHEN abs(c - o) > 0 AND hi - lo < abs(c - o) * 0.75 THEN 'trading_range' ELSE 'channel' END AS outcome FROM k4"


@query(with_views(_SPIKES, "v_daily", **_SPK))
def price_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.spikes(v_daily(spark, sf_dir), ["ticker"], "date")


_LINES = {"lb": f"SELECT * FROM (SELECT ticker, date, lag(close) OVER w AS open, greatest(close, lag(close) OVER w) AS high, least(close, lag(close) OVER w) AS low, close FROM v_daily {_W}) WHERE open <> close", **_SPK, "k0": _SPK["k0"].replace("v_daily", "lb")}


@query(with_views(_SPIKES, "v_daily", **_LINES))
def line_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes of bars from close to close, where every two moves one way are one."""
    before = F.lag("close").over(W.partitionBy("ticker").orderBy("date"))
    x = v_daily(spark, sf_dir).select("ticker", "date", before.alias("open"), F.greatest("close", before).alias("high"), F.least("close", before).alias("low"), "close").where("open <> close")
    return A.spikes(x, ["ticker"], "date")


_RUNS = "WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
_WILDER = "list_reduce(list_concat([list_sum(x[{a}:{b}]) / {n}], x[{b} + 1:]), lambda a, v: (a * ({n} - 1) + v) / {n})"
_THIRDS = "list_reduce(list_concat([50.0::DOUBLE], list_filter(list({x}) OVER w, lambda v: v IS NOT NULL)), lambda a, v: a * 2 / 3 + v / 3)"
_OSC = {
    "o0": f"SELECT *, greatest(close - lag(close) OVER w, 0) AS g, greatest(lag(close) OVER w - close, 0) AS l FROM (SELECT *, row_number() OVER w AS i FROM v_daily {_W}) {_W}",
    "o1": f"SELECT *, CASE WHEN count(*) {_b(9)} = 9 THEN CASE WHEN max(high) {_b(9)} > min(low) {_b(9)} THEN (close - min(low) {_b(9)}) / (max(high) {_b(9)} - min(low) {_b(9)}) * 100 ELSE 50 END END AS rsv FROM o0",
    "o2": f"SELECT ticker, date, i, list(CASE WHEN i > 1 THEN g END) OVER w AS gs, list(CASE WHEN i > 1 THEN l END) OVER w AS ls, CASE WHEN rsv IS NOT NULL THEN {_THIRDS.format(x='rsv')} END AS k FROM o1 {_RUNS}",
    "o3": f"SELECT *, CASE WHEN i > 14 THEN {_WILDER.format(a=2, b=15, n=14).replace('x[', 'gs[')} END AS ag, CASE WHEN i > 14 THEN {_WILDER.format(a=2, b=15, n=14).replace('x[', 'ls[')} END AS al, CASE WHEN k IS NOT NULL THEN {_THIRDS.format(x='k')} END AS d FROM o2 {_RUNS}",
}


@query(with_views(f"SELECT ticker, date, {settled_sql('CASE WHEN i > 14 THEN CASE WHEN ag + al > 0 THEN ag / (ag + al) * 100 ELSE 50 END END', 4)} AS rsi, {settled_sql('k', 4)} AS k, {settled_sql('d', 4)} AS d, {settled_sql('3 * k - 2 * d', 4)} AS j FROM o3", "v_daily", **_OSC))
def oscillators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year's bars of a ticker are a task's."""
    return A.oscillators(v_daily(spark, sf_dir), unit=F.year("date")).select("ticker", "date", *[settled(n, 4).alias(n) for n in ("rsi", "k", "d", "j")])


_EMA = "list_reduce(list({x}) OVER w, lambda a, v: {a} * v + (1 - {a}) * a)"
_MACD = {
    "m0": f"SELECT ticker, date, {_EMA.format(x='close', a='(2.0::DOUBLE / 13)')} - {_EMA.format(x='close', a='(2.0::DOUBLE / 27)')} AS macd FROM v_daily {_RUNS}",
    "m1": f"SELECT ticker, date, macd, {_EMA.format(x='macd', a='0.2::DOUBLE')} AS signal FROM m0 {_RUNS}",
}


@query(with_views(f"SELECT ticker, date, {settled_sql('macd', 3)} AS macd, {settled_sql('signal', 3)} AS macd_signal, {settled_sql('macd - signal', 3)} AS macd_histogram FROM m1", "v_daily", **_MACD))
def macd_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.macd(v_daily(spark, sf_dir).select("ticker", "date", "close"), unit=F.year("date")).select("ticker", "date", *[settled(n, 3).alias(n) for n in ("macd", "macd_signal", "macd_histogram")])


_SCORE = {
    **_PIVOTS,
    "dh": f"SELECT ticker, date, pivot_high - lag(pivot_high) OVER w AS dh FROM p2 WHERE pivot_high IS NOT NULL {_W}",
    "dl": f"SELECT ticker, date, pivot_low - lag(pivot_low) OVER w AS dl FROM p2 WHERE pivot_low IS NOT NULL {_W}",
    "st": f"SELECT p2.*, last_value(dh IGNORE NULLS) OVER w AS h, last_value(dl IGNORE NULLS) OVER w AS lw, lag(mid) OVER w AS mb, volume / avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING) AS vr FROM p2 LEFT JOIN dh USING (ticker, date) LEFT JOIN dl USING (ticker, date) {_W}",
    "sc": "SELECT st.ticker, st.date, greatest(-5, least(5, CASE WHEN h > 0 AND lw > 0 THEN 2 WHEN h < 0 AND lw < 0 THEN -2 ELSE 0 END + CASE WHEN st.close > mid THEN 1 WHEN st.close < mid THEN -1 ELSE 0 END + CASE WHEN mid > mb THEN 1 WHEN mid < mb THEN -1 ELSE 0 END + CASE WHEN b.signal = 'breakout' THEN 2 WHEN b.signal = 'breakdown' THEN -2 ELSE 0 END)) AS score, CASE WHEN vr IS NULL THEN 'unknown' WHEN vr >= 1.5 THEN 'strong' WHEN vr >= 1 THEN 'above_average' ELSE 'shrinking' END AS volume_state FROM st LEFT JOIN (SELECT * FROM sig WHERE signal IN ('breakout', 'breakdown')) b ON b.ticker = st.ticker AND b.date = st.date",
}


@query(with_views("SELECT ticker, date, CAST(score AS INTEGER) AS score, CASE WHEN score >= 3 THEN 'bullish' WHEN score >= 1 THEN 'weak_bullish' WHEN score <= -3 THEN 'bearish' WHEN score <= -1 THEN 'weak_bearish' ELSE 'neutral' END AS label, volume_state FROM sc", "v_daily", **_SCORE))
def direction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("ticker").orderBy("date")
    events = _signals(spark, sf_dir).where("signal IN ('breakout', 'breakdown')").select("ticker", "date", "signal")
    x = G.structure_state(_pivots(spark, sf_dir), ["ticker"], "date").withColumn("mid_before", F.lag("mid").over(w)).withColumn("ratio", F.col("volume") / F.avg("volume").over(w.rowsBetween(-9, 0))).join(events, ["ticker", "date"], "left")
    score, label = A.direction_score("structure", "close", "mid", "mid_before", "signal")
    return x.select("ticker", "date", score.alias("score"), label.alias("label"), A.volume_state(F.col("ratio"), 1.5).alias("volume_state"))


@query(with_views(f"""SELECT lookback, hold, count(*) AS n, {settled_sql('corr(ra, rb)', 5)} AS ic FROM (SELECT *, rank() OVER (PARTITION BY lookback, hold ORDER BY bf) + (count(*) OVER (PARTITION BY lookback, hold, bf) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY lookback, hold ORDER BY af) + (count(*) OVER (PARTITION BY lookback, hold, af) - 1) / 2.0 AS rb FROM grid) GROUP BY ALL""", "v_daily",
    led=f"SELECT ticker, date, close, {', '.join(f'close / lag(close, {b}) OVER w - 1 AS p{b}' for b in (4, 13))}, {', '.join(f'lead(close, {h}) OVER w / close - 1 AS f{h}' for h in (1, 4))} FROM v_daily {_W}",
    grid=" UNION ALL ".join(f"SELECT {b} AS lookback, {h} AS hold, p{b} AS bf, f{h} AS af FROM led WHERE p{b} IS NOT NULL AND f{h} IS NOT NULL" for b in (4, 13) for h in (1, 4))))
def momentum_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of past and future returns by lookback and hold."""
    x = P.momentum_grid(v_daily(spark, sf_dir), ["ticker"], "date", [4, 13], [1, 4])
    y = V.rank_correlation(x, ["lookback", "hold"], "before", "after")
    return y.select("lookback", "hold", "n", settled("ic", 5).alias("ic"))
