"""Daily features by ticker, with windows over (ticker; date) only.

All functions take a DataFrame of bars and give it back with more columns. A window that is not
full, or holds a null, gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, clamp, half_up, pct_change, reasons, total


def by() -> WindowSpec:
    """The window of a ticker in order of date."""
    return W.partitionBy("ticker").orderBy("date")


# Thresholds of the stock screen.
GATES = {"turnover": 20_000_000.0, "hma9_slope": 0.0, "hma20_slope": 0.0, "to_hma_low": 0.0, "to_hma_high": 6.0, "momentum5": 18.0, "position": 0.72}


def wma(x: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    """Weighted moving average, weights 1..n, the newest heaviest; null if any value is."""
    w = w if w is not None else by()
    return total([F.lag(c(x), k).over(w) * (n - k) if k else c(x) * n for k in range(n)]) / (n * (n + 1) / 2)


def with_hma(bars: DataFrame, n: int, out: str, close: str = "close", w: WindowSpec | None = None) -> DataFrame:
    """Hull moving average: WMA over floor(sqrt n) of 2 WMA(n / 2) - WMA(n)."""
    raw = f"_raw_{out}"
    bars = bars.withColumn(raw, 2 * wma(close, max(1, n // 2), w) - wma(close, n, w))
    return bars.withColumn(out, wma(raw, max(1, int(n**0.5)), w)).drop(raw)


def full_avg(x: str | Column, first: int, last: int, w: WindowSpec | None = None) -> Column:
    """Average of the rows first..last around each, null unless all are there and not null."""
    frame = (w if w is not None else by()).rowsBetween(first, last)
    return F.when(F.count(c(x)).over(frame) == last - first + 1, F.avg(c(x)).over(frame))


def lag_pct(x: str, k: int, w: WindowSpec | None = None) -> Column:
    return pct_change(x, F.lag(x, k).over(w if w is not None else by()))


def streak(df: DataFrame, cond: Column, out: str, keys: list[str], order: list[str]) -> DataFrame:
    """How many rows up to each one fulfil cond without a break (gaps and islands)."""
    w = W.partitionBy(*keys).orderBy(*order)
    hold = F.coalesce(cond, F.lit(False))
    df = df.withColumn("_broken", F.sum(F.when(hold, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    island = W.partitionBy(*keys, "_broken").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(hold, 1).otherwise(0)).over(island)).drop("_broken")


def features(bars: DataFrame) -> DataFrame:
    """Hull slopes and acceleration, distance, volumes, turnover, momenta, range and close position."""
    x = with_hma(with_hma(bars, 9, "hma9"), 20, "hma20")
    x = x.withColumn("hma9_slope", lag_pct("hma9", 1)).withColumn("hma20_slope", lag_pct("hma20", 1))
    return x.select(
        "*",
        (F.col("hma9_slope") - F.lag("hma9_slope").over(by())).alias("hma9_acceleration"),
        pct_change("close", "hma9").alias("close_to_hma9"),
        (F.col("volume") / full_avg("volume", -20, -1)).alias("volume_ratio"),
        (F.col("volume") / full_avg("volume", -3, -1)).alias("volume_acceleration"),
        full_avg("turnover", -19, 0).alias("avg_turnover"),
        *[lag_pct("close", k).alias(f"momentum{k}") for k in (1, 3, 5)],
        ((F.col("high") - F.col("low")) / F.col("close") * 100).alias("range_pct"),
        ((F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))).alias("close_position"),
    )


def market_snapshot(observed: DataFrame, minimum_coverage: float = 80.0) -> DataFrame:
    """(date, universe, available, coverage, breadth, median_momentum3) from ticker, date, momentum1, momentum3.

    The universe of a date is the tickers seen by then: a running sum over dates, not a join.
    """
    starts = observed.groupBy("ticker").agg(F.min("date").alias("date")).groupBy("date").agg(F.count("*").alias("started"))
    ok = F.col("momentum1").isNotNull() & F.col("momentum3").isNotNull()
    days = observed.groupBy("date").agg(
        F.count_if(ok).alias("available"),
        F.count_if(ok & (F.col("momentum1") > 0)).alias("rising"),
        F.percentile(F.when(ok, F.col("momentum3")), F.lit(0.5)).alias("median"),
    )
    days = days.join(starts, "date", "left")
    # one row a date: as many as the calendar has, however many tickers
    universe = F.sum(F.coalesce("started", F.lit(0))).over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    days = days.withColumn("universe", universe).withColumn("coverage", F.col("available") / F.col("universe") * 100)
    good = (F.col("available") > 0) & (F.col("coverage") >= minimum_coverage)
    return days.select(
        "date", "universe", "available", "coverage", F.when(good, F.col("rising") / F.col("available")).alias("breadth"), F.when(good, F.col("median")).alias("median_momentum3")
    )


def with_market(daily: DataFrame, market: DataFrame) -> DataFrame:
    """Features joined to the market of their date; Spark broadcasts the dates if they are few."""
    x = daily.join(market.select("date", "breadth", "median_momentum3"), "date", "left")
    return x.withColumn("relative_momentum3", F.col("momentum3") - F.col("median_momentum3"))


def foreign_features(bars: DataFrame, flows: DataFrame) -> DataFrame:
    """Streak (at most 20, broken by null), 3-bar intensity, 20-bar percentile and coverages.

    bars: ticker, date, volume; flows: ticker, date, net.
    """
    x = bars.join(flows.select("ticker", "date", "net"), ["ticker", "date"], "left")
    x = streak(x, F.col("net") > 0, "run", ["ticker"], ["date"])
    three, twenty = by().rowsBetween(-2, 0), by().rowsBetween(-19, 0)
    known3, known20 = F.count("net").over(three), F.count("net").over(twenty)
    past = F.collect_list("net").over(twenty)
    volume3 = F.when(F.count("volume").over(three) == 3, F.sum("volume").over(three))
    return x.select(
        *bars.columns,
        "net",
        F.when(F.col("net").isNotNull(), F.least(F.col("run"), F.lit(20))).alias("foreign_streak"),
        F.when((known3 == 3) & (volume3 > 0), F.sum("net").over(three) / volume3).alias("foreign_intensity"),
        F.when(known20 == 20, F.size(F.filter(past, lambda v: v <= F.col("net"))) / 20).alias("foreign_percentile"),
        (known3 / 3).alias("coverage3"),
        (known20 / 20).alias("coverage20"),
    )


def daily_net(flows: DataFrame, keys: list[str]) -> DataFrame:
    """Net per key; any unknown part makes the whole unknown."""
    return flows.groupBy(*keys).agg(F.when(F.count_if(F.col("net").isNull()) == 0, F.sum("net")).alias("net"))


_NEEDED = ("hma9_slope", "hma20_slope", "close_to_hma9", "avg_turnover", "momentum5", "close_position")
SOFT = ("volume_ratio", "relative_momentum3", "breadth", "foreign_streak", "foreign_intensity")


def gate_reasons(gates: dict[str, float] | None = None) -> Column:
    """Why a row fails the screen, in fixed order; an empty array passes. Limits themselves pass."""
    g = GATES | (gates or {})
    return reasons(
        *[(f"missing_{n}", F.col(n).isNull()) for n in _NEEDED],
        ("hma9_not_rising", F.col("hma9_slope") <= g["hma9_slope"]),
        ("hma20_falling", F.col("hma20_slope") < g["hma20_slope"]),
        ("below_hma9", F.col("close_to_hma9") < g["to_hma_low"]),
        ("far_above_hma9", F.col("close_to_hma9") > g["to_hma_high"]),
        ("thin_turnover", F.col("avg_turnover") < g["turnover"]),
        ("momentum_too_high", F.col("momentum5") > g["momentum5"]),
        ("closed_too_high", F.col("close_position") > g["position"]),
    )


def rank_score() -> Column:
    """50 and five clamped adjustments, a missing one counting 0, in 0..100."""
    parts = [
        clamp((F.col("volume_ratio") - 1) * 5, -5, 5),
        clamp(F.col("relative_momentum3") * 0.75, -5, 5),
        clamp((F.col("breadth") - 0.5) * 10, -5, 5),
        clamp(F.col("foreign_streak") * 1.5, 0, 6),
        clamp(F.col("foreign_intensity") * 20, -4, 4),
    ]
    return half_up(clamp(50 + total([F.coalesce(p, F.lit(0.0)) for p in parts]), 0, 100), 8)


def soft_missing() -> Column:
    return reasons(*[(n, F.col(n).isNull()) for n in SOFT])


def volume_level() -> Column:
    r = F.col("volume_ratio")
    return F.when(r.isNull(), "unavailable").when(r < 0.8, "weak").when(r < 1, "below_average").when(r < 1.5, "confirmed").otherwise("strong")


def screen(daily: DataFrame, gates: dict[str, float] | None = None) -> DataFrame:
    """Features with reasons, eligible, score, soft coverage and volume level."""
    x = daily.withColumn("reasons", gate_reasons(gates)).withColumn("missing", soft_missing())
    return x.select("*", (F.size("reasons") == 0).alias("eligible"), rank_score().alias("score"), (F.lit(len(SOFT)) - F.size("missing")).alias("soft_available"), volume_level().alias("volume_level"))


def ranking(screened: DataFrame, top: int | None = None) -> DataFrame:
    """Eligible rows by score, coverage, date (all descending) and ticker, with rank and percentile.

    The global order is only of the eligible rows; with `top` Spark keeps the best of each partition first.
    """
    order = [F.col("score").desc(), F.col("soft_available").desc(), F.col("date").desc(), F.col("ticker").asc()]
    best = screened.where("eligible")
    if top is not None:
        best = best.orderBy(*order).limit(top)
    w = W.orderBy(*order)
    return best.select("*", F.row_number().over(w).alias("rank"), F.percent_rank().over(w).alias("rank_pct"))


def hma_state(bars: DataFrame, n: int = 20) -> DataFrame:
    """Trend state of every bar by the Hull average, as rounded to 4 digits, and its slope."""
    x = with_hma(bars, n, "hma").withColumn("hma", half_up("hma", 4))
    x = x.withColumn("hma_before", F.lag("hma").over(by())).withColumn("close_before", F.lag("close").over(by()))
    slope, close, hma = F.col("hma") - F.col("hma_before"), F.col("close"), F.col("hma")
    up = (F.col("close_before") <= F.col("hma_before")) & (close > hma)
    down = (F.col("close_before") >= F.col("hma_before")) & (close < hma)
    trend = (
        F.when(F.col("hma_before").isNull(), "insufficient_data")
        .when(up & (slope > 0), "bullish_reversal")
        .when(down & (slope < 0), "bearish_reversal")
        .when((close >= hma) & (slope > 0), "bullish")
        .when((close <= hma) & (slope < 0), "bearish")
        .when(close >= hma, "weak_bullish")
        .when(close <= hma, "weak_bearish")
        .otherwise("neutral")
    )
    return x.select("*", up.alias("crossed_up"), down.alias("crossed_down"), trend.alias("trend"))


ACTIONS = {"bullish_reversal": "buy_watch", "bearish_reversal": "sell_watch", "bullish": "hold_long", "bearish": "avoid_or_reduce"}


def hma_action(trend: str = "trend") -> Column:
    out = F.lit("watch")
    for state, action in ACTIONS.items():
        out = F.when(F.col(trend) == state, action).otherwise(out)
    return out
