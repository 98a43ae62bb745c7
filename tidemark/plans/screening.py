"""Queries of the daily features and the stock screen, on weekly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import settled, settled_sql
from tidemark.operators import daily as D
from tidemark.registry import query
from tidemark.sources.views import v_daily, v_flow, with_views

#: The turnover gate at the size of the test tables, where a week's turnover is small.
FIXTURE_GATES = {"turnover": 300_000.0}


def _wma(x: str, n: int) -> str:
    return "(" + " + ".join(f"lag({x}, {k}) OVER w * {n - k}" if k else f"{x} * {n}" for k in range(n)) + f") / {n * (n + 1) / 2}"


def _hma_sql(n: int, out: str, source: str) -> dict[str, str]:
    return {
        f"{out}_raw": f"SELECT *, 2 * {_wma('close', max(1, n // 2))} - {_wma('close', n)} AS raw FROM {source} WINDOW w AS (PARTITION BY ticker ORDER BY date)",
        out + "_t": f"SELECT * EXCLUDE (raw), {_wma('raw', max(1, int(n**0.5)))} AS {out} FROM {out}_raw WINDOW w AS (PARTITION BY ticker ORDER BY date)",
    }


def _pct(now: str, before: str) -> str:
    return f"CASE WHEN {before} > 0 THEN ({now} / {before} - 1) * 100 END"


def _full(x: str, first: int, last: int) -> str:
    edge = lambda k: "CURRENT ROW" if k == 0 else f"{-k} PRECEDING"
    frame = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {edge(first)} AND {edge(last)})"
    return f"CASE WHEN count({x}) {frame} = {last - first + 1} THEN avg({x}) {frame} END"


_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"
_FEATURES = {
    **_hma_sql(9, "hma9", "v_daily"),
    **_hma_sql(20, "hma20", "hma9_t"),
    "slopes": f"SELECT *, {_pct('hma9', 'lag(hma9) OVER w')} AS hma9_slope, {_pct('hma20', 'lag(hma20) OVER w')} AS hma20_slope FROM hma20_t {_W}",
    "feats": f"""SELECT *, hma9_slope - lag(hma9_slope) OVER w AS hma9_acceleration, {_pct('close', 'hma9')} AS close_to_hma9,
        volume / ({_full('volume', -20, -1)}) AS volume_ratio, volume / ({_full('volume', -3, -1)}) AS volume_acceleration,
        {_full('turnover', -19, 0)} AS avg_turnover, {_pct('close', 'lag(close, 1) OVER w')} AS momentum1, {_pct('close', 'lag(close, 3) OVER w')} AS momentum3,
        {_pct('close', 'lag(close, 5) OVER w')} AS momentum5, (high - low) / close * 100 AS range_pct, (close - low) / (high - low) AS close_position FROM slopes {_W}""",
}
_MARKET = {
    "starts": "SELECT d AS date, count(*) AS started FROM (SELECT ticker, min(date) AS d FROM feats GROUP BY 1) GROUP BY 1",
    "days": """SELECT date, count(*) FILTER (momentum1 IS NOT NULL AND momentum3 IS NOT NULL) AS available,
        count(*) FILTER (momentum1 > 0 AND momentum3 IS NOT NULL) AS rising,
        quantile_cont(momentum3, 0.5) FILTER (momentum1 IS NOT NULL AND momentum3 IS NOT NULL) AS med FROM feats GROUP BY 1""",
    "runs": """SELECT days.*, CAST(sum(coalesce(started, 0)) OVER (ORDER BY days.date) AS BIGINT) AS universe FROM days LEFT JOIN starts ON days.date = starts.date""",
    "market": """SELECT date, universe, available, available / universe * 100 AS coverage,
        CASE WHEN available > 0 AND available / universe * 100 >= 80 THEN rising / available END AS breadth,
        CASE WHEN available > 0 AND available / universe * 100 >= 80 THEN med END AS median_momentum3 FROM runs""",
}
_FLOWS = {
    "net": "SELECT ticker, date, CASE WHEN count(*) FILTER (net IS NULL) = 0 THEN sum(net) END AS net FROM v_flow WHERE investor = 'MACHINERY' GROUP BY 1, 2",
    "joined": "SELECT v_daily.*, net.net FROM v_daily LEFT JOIN net ON v_daily.ticker = net.ticker AND v_daily.date = net.date",
    "broken": "SELECT *, sum(CASE WHEN net > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS island FROM joined",
    "runs3": "SELECT *, sum(CASE WHEN net > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, island ORDER BY date) AS run FROM broken",
    "foreign_t": """SELECT *, CASE WHEN net IS NOT NULL THEN CAST(least(run, 20) AS BIGINT) END AS foreign_streak,
        CASE WHEN count(net) OVER t3 = 3 AND sum(volume) OVER t3 > 0 THEN sum(net) OVER t3 / sum(volume) OVER t3 END AS foreign_intensity,
        CASE WHEN count(net) OVER t20 = 20 THEN len(list_filter(list(net) OVER t20, lambda v: v <= net)) / 20 END AS foreign_percentile,
        count(net) OVER t3 / 3 AS coverage3, count(net) OVER t20 / 20 AS coverage20 FROM runs3
        WINDOW t3 AS (PARTITION BY ticker ORDER BY date ROWS 2 PRECEDING), t20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)""",
}
_CLAMP = "greatest({1}, least({2}, {0}))"


def _adj(x: str, low: float, high: float) -> str:
    return f"coalesce(CASE WHEN {x} IS NOT NULL THEN greatest({low}, least({high}, {x})) END, 0)"


_REASONS = [
    *[(f"missing_{n}", f"{n} IS NULL") for n in ("hma9_slope", "hma20_slope", "close_to_hma9", "avg_turnover", "momentum5", "close_position")],
    ("hma9_not_rising", "hma9_slope <= 0"), ("hma20_falling", "hma20_slope < 0"), ("below_hma9", "close_to_hma9 < 0"), ("far_above_hma9", "close_to_hma9 > 6"),
    ("thin_turnover", "avg_turnover < 300000"), ("momentum_too_high", "momentum5 > 18"), ("closed_too_high", "close_position > 0.72"),
]
_SCREEN = {
    "everything": """SELECT f.*, m.breadth, m.median_momentum3, f.momentum3 - m.median_momentum3 AS relative_momentum3, g.foreign_streak, g.foreign_intensity
        FROM feats f LEFT JOIN market m ON f.date = m.date LEFT JOIN foreign_t g ON f.ticker = g.ticker AND f.date = g.date""",
    "screened": "SELECT *, list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in _REASONS) + "], lambda x: x IS NOT NULL) AS reasons, list_filter(["
        + ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in D.SOFT) + f"], lambda x: x IS NOT NULL) AS missing, floor(greatest(0, least(100, 50 + {_adj('(volume_ratio - 1) * 5', -5, 5)} + {_adj('relative_momentum3 * 0.75', -5, 5)}"
        + f" + {_adj('(breadth - 0.5) * 10', -5, 5)} + {_adj('foreign_streak * 1.5', 0, 6)} + {_adj('foreign_intensity * 20', -4, 4)})) * 1e8 + 0.5) / 1e8 AS score FROM everything",
}
_ALL = {**_FEATURES, **_MARKET, **_FLOWS, **_SCREEN}
_FEATURE_NAMES = ("hma9", "hma20", "hma9_slope", "hma20_slope", "hma9_acceleration", "close_to_hma9", "volume_ratio", "volume_acceleration", "avg_turnover", "momentum1", "momentum3", "momentum5", "range_pct", "close_position")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.features(v_daily(spark, sf_dir))


def _foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = D.daily_net(v_flow(spark, sf_dir).where("investor = 'MACHINERY'"), ["ticker", "date"])
    return D.foreign_features(v_daily(spark, sf_dir), net)


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _features(spark, sf_dir)
    x = D.with_market(x, D.market_snapshot(x))
    foreign = _foreign(spark, sf_dir).select("ticker", "date", "foreign_streak", "foreign_intensity")
    return D.screen(x.join(foreign, ["ticker", "date"], "left"), FIXTURE_GATES)


@query(with_views(f"SELECT ticker, date, {', '.join(f'{settled_sql(n, 4)} AS {n}' for n in _FEATURE_NAMES)} FROM feats", "v_daily", **_FEATURES))
def daily_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("ticker", "date", *[settled(n, 4).alias(n) for n in _FEATURE_NAMES])


@query(with_views(f"SELECT date, universe, available, {settled_sql('coverage')} AS coverage, {settled_sql('breadth')} AS breadth, {settled_sql('median_momentum3', 4)} AS median_momentum3 FROM market", "v_daily", **_FEATURES, **_MARKET))
def market_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.market_snapshot(_features(spark, sf_dir))
    return x.select("date", "universe", "available", settled("coverage").alias("coverage"), settled("breadth").alias("breadth"), settled("median_momentum3", 4).alias("median_momentum3"))


@query(with_views(f"SELECT ticker, date, foreign_streak, {settled_sql('foreign_intensity', 2)} AS foreign_intensity, foreign_percentile, {settled_sql('coverage3')} AS coverage3, coverage20 FROM foreign_t", "v_daily", "v_flow", **_FLOWS))
def foreign_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _foreign(spark, sf_dir).select("ticker", "date", "foreign_streak", settled("foreign_intensity", 2).alias("foreign_intensity"), "foreign_percentile", settled("coverage3").alias("coverage3"), "coverage20")


@query(with_views("SELECT ticker, date, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS eligible, score, CAST(5 - len(missing) AS INTEGER) AS soft_available, array_to_string(missing, ',') AS missing, CASE WHEN volume_ratio IS NULL THEN 'unavailable' WHEN volume_ratio < 0.8 THEN 'weak' WHEN volume_ratio < 1 THEN 'below_average' WHEN volume_ratio < 1.5 THEN 'confirmed' ELSE 'strong' END AS volume_level FROM (SELECT * REPLACE (floor(score * 1e4 + 0.5001) / 1e4 AS score) FROM screened)", "v_daily", "v_flow", **_ALL))
def screen_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _screened(spark, sf_dir)
    return x.select("ticker", "date", F.array_join("reasons", ",").alias("reasons"), "eligible", settled("score", 4).alias("score"), "soft_available", F.array_join("missing", ",").alias("missing"), "volume_level")


_RANKED = "SELECT row_number() OVER r AS rank, ticker, date, {score} AS score, CAST(5 - len(missing) AS INTEGER) AS soft_available FROM screened WHERE len(reasons) = 0 WINDOW r AS (ORDER BY score DESC, len(missing), date DESC, ticker)"


@query(with_views("SELECT CAST(rank AS INTEGER) AS rank, ticker, date, score, soft_available FROM (" + _RANKED.format(score=settled_sql("score", 4)) + ") ORDER BY rank LIMIT 50", "v_daily", "v_flow", **_ALL))
def screen_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top-50 report of the screen."""
    return D.ranking(_screened(spark, sf_dir), top=50).select("rank", "ticker", "date", settled("score", 4).alias("score"), "soft_available")


@query(with_views("SELECT reason, count(*) AS n, count(*) FILTER (len(reasons) = 1) AS only_this FROM (SELECT reasons, unnest(reasons) AS reason FROM screened) GROUP BY 1", "v_daily", "v_flow", **_ALL))
def screen_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per rejection reason, and those with that reason only."""
    x = _screened(spark, sf_dir).select("reasons", F.explode("reasons").alias("reason"))
    return x.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.size("reasons") == 1).alias("only_this"))


_STAGES = [("complete", lambda r: r.startswith("missing_")), *[(n, lambda r, n=n: r == n) for n, _ in _REASONS[6:]]]
_STAGE_OF = [[name for name, _ in _REASONS if test(name)] for _, test in _STAGES]


@query(with_views(
    "SELECT s.stage, s.name, (SELECT count(*) FROM firsts WHERE failed IS NULL OR failed > s.stage) AS remaining FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, (n, _) in enumerate(_STAGES)) + ") s(stage, name)",
    "v_daily", "v_flow", **_ALL,
    firsts="SELECT CASE " + " ".join(f"WHEN list_has_any(reasons, {names!r}) THEN {i}" for i, names in enumerate(_STAGE_OF)) + " END AS failed FROM screened",
))
def screen_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows are left after each gate in turn, from one count by first failing stage."""
    from pyspark.sql import Window as W

    failed = F.lit(None).cast("int")
    for i, names in reversed(list(enumerate(_STAGE_OF))):
        failed = F.when(F.arrays_overlap("reasons", F.array(*[F.lit(n) for n in names])), i).otherwise(failed)
    counts = _screened(spark, sf_dir).groupBy(failed.alias("failed")).agg(F.count("*").alias("n"))
    stages = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(_STAGES)], "stage int, name string")
    x = stages.join(counts, F.col("stage") == F.col("failed"), "left")
    everything = counts.agg(F.sum("n").alias("all"))
    lost = F.sum(F.coalesce("n", F.lit(0))).over(W.orderBy("stage").rowsBetween(W.unboundedPreceding, 0))
    return x.crossJoin(F.broadcast(everything)).select("stage", "name", (F.col("all") - lost).alias("remaining"))


_STATE = {**_hma_sql(20, "hma", "v_daily"), "before": f"SELECT *, lag(hma) OVER w AS hma_before, lag(close) OVER w AS close_before FROM (SELECT * REPLACE (floor(hma * 1e4 + 0.5) / 1e4 AS hma) FROM hma_t) {_W}",
    "state": """SELECT *, CASE WHEN hma_before IS NULL THEN 'insufficient_data' WHEN close_before <= hma_before AND close > hma AND hma > hma_before THEN 'bullish_reversal'
        WHEN close_before >= hma_before AND close < hma AND hma < hma_before THEN 'bearish_reversal' WHEN close >= hma AND hma > hma_before THEN 'bullish'
        WHEN close <= hma AND hma < hma_before THEN 'bearish' WHEN close >= hma THEN 'weak_bullish' WHEN close <= hma THEN 'weak_bearish' ELSE 'neutral' END AS trend FROM before""",
}
_ACTION = "CASE trend " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.ACTIONS.items()) + " ELSE 'watch' END"


@query(with_views(f"SELECT ticker, date, trend, {_ACTION} AS action FROM state", "v_daily", **_STATE))
def hma_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.hma_state(v_daily(spark, sf_dir)).select("ticker", "date", "trend", D.hma_action().alias("action"))


@query(with_views("SELECT ticker, date, CASE WHEN close > hma THEN 'buy' ELSE 'sell' END AS signal FROM state WHERE (close_before <= hma_before AND close > hma) OR (close_before >= hma_before AND close < hma)", "v_daily", **_STATE))
def hma_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = D.hma_state(v_daily(spark, sf_dir)).where("crossed_up OR crossed_down")
    return x.select("ticker", "date", F.when(F.col("crossed_up"), "buy").otherwise("sell").alias("signal"))
