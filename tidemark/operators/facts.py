"""Market facts of every bar: geometry, runs, averages, extremes, the regime tree and spikes, with windows by ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import half_up
from tidemark.operators.daily import by
from tidemark.operators.scans import affine_scan, exponential_averages
from tidemark.operators.signals import with_pullbacks

#: Bars of the background, structure and immediate windows, and fewest bars of a judgement.
BACKGROUND, STRUCTURE, IMMEDIATE, LEAST_BARS = 60, 20, 5, 25


def bar_geometry(bars: DataFrame) -> DataFrame:
    """body_ratio, way (1, -1, 0 flat), wicks, the overlap with the bar before, and the run of bars one way."""
    o, h, low, cl = (F.col(n) for n in ("open", "high", "low", "close"))
    span = h - low
    share = lambda x: F.when(span > 0, x / span).otherwise(F.lit(0.0))
    x = bars.withColumn("body_ratio", share(F.abs(cl - o))).withColumn("upper_wick", share(h - F.greatest(o, cl))).withColumn("lower_wick", share(F.least(o, cl) - low))
    x = x.withColumn("way", F.when((span <= 0) | (F.abs(cl - o) / span < 0.1), 0).when(cl > o, 1).otherwise(-1))
    top, bottom = F.greatest(o, cl), F.least(o, cl)
    x = x.withColumn("_top", top).withColumn("_bottom", bottom)
    bt, bb = F.lag("_top").over(by()), F.lag("_bottom").over(by())
    smaller = F.least(F.col("_top") - F.col("_bottom"), bt - bb)
    overlap = F.when(bt.isNull(), None).when(smaller > 0, F.greatest(F.lit(0.0), F.least(F.col("_top"), bt) - F.greatest(F.col("_bottom"), bb)) / smaller).otherwise(F.lit(0.0))
    x = x.withColumn("overlap", overlap)
    new = F.coalesce((F.col("way") == 0) | (F.col("way") != F.lag("way").over(by())), F.lit(True)).cast("int")
    x = x.withColumn("_island", F.sum(new).over(by().rowsBetween(W.unboundedPreceding, 0)))
    run = F.when(F.col("way") == 0, 0).otherwise(F.count("*").over(W.partitionBy("ticker", "_island").orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
    return x.withColumn("run", run).drop("_top", "_bottom", "_island")


def market_facts(bars: DataFrame) -> DataFrame:
    """bars (ticker, date, open, high, low, close, turnover) with the facts that a judgement may cite, as of each bar."""
    back = lambda n: by().rowsBetween(-(n - 1), 0)
    full = lambda n, x: F.when(F.count("*").over(back(n)) == n, x)
    x = bar_geometry(bars).withColumn("_n", F.row_number().over(by()))
    x = x.withColumn("prev_close", F.lag("close").over(by())).withColumn("change_pct", (F.col("close") / F.lag("close").over(by()) - 1) * 100)
    for name, n in (("ma5", 5), ("ma10", 10), ("ma20", STRUCTURE), ("ma60", BACKGROUND)):
        x = x.withColumn(name, full(n, F.avg("close").over(back(n))))
    x = x.withColumn("turnover_ratio", full(STRUCTURE, F.col("turnover") / F.avg("turnover").over(back(STRUCTURE)))).withColumn("turnover_5_20", full(STRUCTURE, F.avg("turnover").over(back(IMMEDIATE)) / F.avg("turnover").over(back(STRUCTURE))))
    x = x.withColumn("turnover20", full(STRUCTURE, F.avg("turnover").over(back(STRUCTURE))))
    # of equal extremes the earliest
    x = x.withColumn("swing_high", F.max("high").over(back(BACKGROUND))).withColumn("swing_low", F.min("low").over(back(BACKGROUND)))
    x = x.withColumn("swing_high_date", F.max_by("date", F.struct("high", -F.unix_date("date"))).over(back(BACKGROUND))).withColumn("swing_low_date", F.min_by("date", F.struct("low", F.unix_date("date"))).over(back(BACKGROUND)))
    span = F.col("swing_high") - F.col("swing_low")
    x = x.withColumn("retracement_pct", F.when(span > 0, (F.col("close") - F.col("swing_low")) / span * 100)).withColumn("drawdown_pct", F.when(F.col("swing_high") > 0, (F.col("close") / F.col("swing_high") - 1) * 100))
    side = lambda ma: F.when(F.col(ma).isNotNull(), F.when(F.col("close") >= F.col(ma), "above").otherwise("below"))
    x = x.withColumn("vs20", side("ma20")).withColumn("vs60", side("ma60")).withColumn("overlap5", F.avg("overlap").over(back(IMMEDIATE - 1)))
    x = x.withColumn("_closes", F.collect_list("close").over(back(STRUCTURE)))
    return with_pullbacks(x, "_closes").drop("_closes")


def regimes(facts: DataFrame) -> DataFrame:
    """facts with regime, direction, alternative and confidence; insufficient_data before LEAST_BARS bars."""
    back = lambda n: by().rowsBetween(-(n - 1), 0)
    x = facts.withColumn("_run5", F.least("run", F.lit(IMMEDIATE)))
    means = {k: (F.avg("overlap").over(back(k - 1)), F.avg("body_ratio").over(back(k))) for k in (3, 4, 5)}
    spike = F.lit(False)
    for k, (overlap, body) in means.items():
        spike = spike | ((F.col("_run5") == k) & (overlap < 0.3) & (body > 0.5))
    x = x.withColumn("_spike", spike)
    depth, ma5, ma20, close = (F.col(n) for n in ("pullback_pct", "ma5", "ma20", "close"))
    trending = F.when(ma5 >= ma20, close >= ma20).otherwise(close <= ma20) & depth.isNotNull()
    known = F.col("_n") >= LEAST_BARS
    label = F.when(~known, "insufficient_data").when(F.col("_spike"), "spike").when(trending & (depth < 30), "tight_channel").when(trending & (depth <= 50), "normal_channel").otherwise("trading_range")
    x = x.withColumn("regime", label)
    agree = F.when(F.col("vs60").isNotNull() & (F.col("vs20") == F.col("vs60")), F.when(F.col("vs20") == "above", "bullish").otherwise("bearish")).otherwise("neutral")
    by_average = F.when(ma5 >= ma20, "bullish").otherwise("bearish")
    is_ = lambda name: F.col("regime") == name
    x = x.withColumn("direction", F.when(~known, "neutral").when(is_("spike"), F.when(F.col("way") > 0, "bullish").otherwise("bearish")).when(is_("trading_range"), agree).otherwise(by_average))
    near = lambda v: F.coalesce(F.abs(depth - v) <= 5, F.lit(False))
    two = ~F.col("_spike") & (F.col("_run5") == 2)
    other = (
        F.when(~known, None).when(is_("spike"), "tight_channel").when(near(30), F.when(is_("tight_channel"), "normal_channel").otherwise("tight_channel"))
        .when(near(50), F.when(is_("normal_channel"), "trading_range").otherwise("normal_channel")).when(two & is_("tight_channel"), "spike")
    )
    against = (F.col("direction") != "neutral") & (F.col("way") != 0) & (F.when(F.col("way") > 0, "bullish").otherwise("bearish") != F.col("direction"))
    minus = lambda cond, v: F.when(cond, v).otherwise(0)
    score = 80 - minus(near(30) | near(50), 15) - minus(against, 10) - minus(F.col("_n") < BACKGROUND, 20) - minus(is_("trading_range") & (F.col("direction") == "neutral"), 5)
    return x.withColumn("alternative", other).withColumn("confidence", F.when(known, F.greatest(F.lit(10), F.least(F.lit(95), score))).otherwise(10)).drop("_run5", "_spike")


# Facts in the order of their ids, the window each is of, and the column it comes from.
FACTS = (
    ("close", "immediate", "close"), ("prevClose", "immediate", "prev_close"), ("changePct", "immediate", "change_pct"), ("ma5", "immediate", "ma5"), ("ma10", "structure", "ma10"), ("ma20", "structure", "ma20"),
    ("ma60", "background", "ma60"), ("closeVsMa20", "structure", "vs20"), ("closeVsMa60", "background", "vs60"), ("turnover", "immediate", "turnover"), ("avgTurnover20", "structure", "turnover20"),
    ("turnoverRatio", "immediate", "turnover_ratio"), ("avgTurnover5over20", "immediate", "turnover_5_20"), ("swingHigh60", "background", "swing_high"), ("swingLow60", "background", "swing_low"),
    ("retracementPct", "background", "retracement_pct"), ("drawdownFromHighPct", "background", "drawdown_pct"), ("trendBarRun", "immediate", "run"), ("trendBarRunDirection", "immediate", "run_direction"),
    ("avgBodyOverlap5", "immediate", "overlap5"), ("pullbackDepthPct", "structure", "pullback_pct"), ("lastBars", "immediate", "last_bars"),
)
TEXT_FACTS = ("vs20", "vs60", "run_direction", "last_bars")
WHOLE_FACTS = ("close", "prev_close", "turnover", "turnover_ratio", "turnover_5_20")
#: Facts that are left out, and so take no id, while a bar lacks its background window.
BACKGROUND_FACTS = ("ma60", "vs60")


def fact_table(facts: DataFrame) -> DataFrame:
    """(ticker, date, fact_id, key, window, value, text): the facts of each bar, numbered in fixed order.

    A fact without a value keeps its id. Bars before LEAST_BARS have one fact, their number. Texts: above or
    below an average, the way of the run, and the geometry of the last bars as JSON.
    """
    wide = F.when(F.col("way") > 0, "up").when(F.col("way") < 0, "down").otherwise("flat")
    plain = F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down").otherwise("flat")
    two = lambda n: half_up(F.col(n).cast("double"), 2)
    bar = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), plain.alias("dir"), two("body_ratio").alias("bodyRatio"), two("upper_wick").alias("upperWickRatio"), two("lower_wick").alias("lowerWickRatio"))
    x = facts.withColumn("run_direction", F.when(F.col("run") == 0, "flat").otherwise(wide)).withColumn("_bar", bar)
    x = x.withColumn("last_bars", F.to_json(F.collect_list("_bar").over(by().rowsBetween(-(IMMEDIATE - 1), 0))))
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    number = lambda n: no_number if n in TEXT_FACTS else F.col(n).cast("double") if n in WHOLE_FACTS else two(n)
    kept = lambda n: F.col("_n") >= BACKGROUND if n in BACKGROUND_FACTS else F.lit(True)
    each = [F.struct(F.lit(k).alias("key"), F.lit(w).alias("window"), number(n).alias("value"), (F.col(n) if n in TEXT_FACTS else no_text).alias("text"), kept(n).alias("kept")) for k, w, n in FACTS]
    few = F.array(F.struct(F.lit("insufficient").alias("key"), F.lit("background").alias("window"), F.col("_n").cast("double").alias("value"), no_text.alias("text"), F.lit(True).alias("kept")))
    x = x.select("ticker", "date", F.posexplode(F.when(F.col("_n") < LEAST_BARS, few).otherwise(F.filter(F.array(*each), lambda f: f["kept"]))).alias("_i", "_f"))
    return x.select("ticker", "date", F.concat(F.lit("F"), (F.col("_i") + 1).cast("string")).alias("fact_id"), "_f.key", "_f.window", "_f.value", "_f.text")


# What makes a trend bar and a spike.
TREND_BODY, SPIKE_OVERLAP, AFTER = 0.5, 0.30, 10


def spikes(bars: DataFrame, keys: list[str], order: str, after: int = AFTER) -> DataFrame:
    """Runs of two trend bars or more one way whose bodies hardly overlap, and what came within `after` bars: reversal, trading_range or channel.

    outcome is null where fewer bars follow.
    """
    w = W.partitionBy(*keys).orderBy(order)
    o, cl = F.col("open"), F.col("close")
    x = bars.withColumn("_way", F.when(cl > o, 1).when(cl < o, -1).otherwise(0)).withColumn("_trend", F.coalesce((F.col("high") > F.col("low")) & (F.abs(cl - o) / (F.col("high") - F.col("low")) > TREND_BODY), F.lit(False)))
    po, pc = F.lag("open").over(w), F.lag("close").over(w)
    shared = F.greatest(F.lit(0.0), F.least(F.greatest(o, cl), F.greatest(po, pc)) - F.greatest(F.least(o, cl), F.least(po, pc)))
    size = (F.abs(cl - o) + F.abs(pc - po)) / 2
    overlap = F.when(size > 0, shared / size).otherwise(F.lit(1.0))
    linked = F.coalesce(F.col("_trend") & F.lag("_trend").over(w) & (F.col("_way") != 0) & (F.col("_way") == F.lag("_way").over(w)) & (overlap < SPIKE_OVERLAP), F.lit(False))
    x = x.withColumn("_island", F.sum(F.when(linked, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    later = w.rowsBetween(1, after)
    x = x.withColumn("_n", F.count("*").over(later)).withColumn("_hi", F.max("high").over(later)).withColumn("_lo", F.min("low").over(later)).withColumn("_then", F.last("close").over(later))
    place = F.struct(order)
    y = x.groupBy(*keys, "_island").agg(F.count("*").alias("length"), F.max(order).alias("ends"), F.first("_way").alias("way"), F.min_by("open", place).alias("_open"), *[F.max_by(n, place).alias(n) for n in ("close", "_n", "_hi", "_lo", "_then")])
    y = y.where("length >= 2")
    move, span = (F.col("_then") - F.col("close")) / F.col("close") * F.col("way"), F.abs(F.col("close") - F.col("_open"))
    outcome = F.when(F.col("_n") < after, None).when((move < 0) & (F.abs(move) * F.col("close") > span * 0.5), "reversal").when((span > 0) & (F.col("_hi") - F.col("_lo") < span * 0.75), "trading_range").otherwise("channel")
    return y.select(*keys, "ends", "length", "way", outcome.alias("outcome"))


def oscillators(bars: DataFrame, n: int = 14, k: int = 9, unit: Column | None = None) -> DataFrame:
    """bars with rsi (Wilder's averages of gains and losses, begun with n plain ones), and the stochastic kdj of k bars.

    K and D each take a third of the new value and begin at 50; J is 3 K - 2 D. Null before n steps and k bars.
    """
    step = F.col("close") - F.lag("close").over(by())
    low, frame = by().rowsBetween(-(k - 1), 0), by().rowsBetween(-(n - 1), 0)
    x = bars.withColumn("_g", F.when(step.isNotNull(), F.greatest(step, F.lit(0.0)))).withColumn("_l", F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0)))).withColumn("_i", F.row_number().over(by()))
    top, bottom = F.max("high").over(low), F.min("low").over(low)
    rsv = F.when(F.count("*").over(low) == k, F.when(top > bottom, (F.col("close") - bottom) / (top - bottom) * 100).otherwise(F.lit(50.0)))
    x = x.withColumn("_rsv", rsv).withColumn("_mg", F.avg("_g").over(frame)).withColumn("_ml", F.avg("_l").over(frame))
    wilder = lambda v, mean: (F.when(F.col("_i") > n + 1, (n - 1) / n).otherwise(0.0), F.when(F.col("_i") > n + 1, F.col(v) / n).when(F.col("_i") == n + 1, F.col(mean)).otherwise(0.0), 0.0)
    third = lambda v: (F.when(F.col("_rsv").isNull(), 1.0).otherwise(2.0 / 3), F.coalesce(F.col(v) / 3, F.lit(0.0)), 50.0)
    x = affine_scan(x, ["ticker"], "date", {"_gain": wilder("_g", "_mg"), "_loss": wilder("_l", "_ml"), "_k": third("_rsv")}, unit, counted=bars)
    x = affine_scan(x.withColumn("_kk", F.when(F.col("_rsv").isNotNull(), F.col("_k"))), ["ticker"], "date", {"_d": third("_kk")}, unit, counted=bars)
    rsi = F.when(F.col("_i") > n, F.when(F.col("_gain") + F.col("_loss") > 0, F.col("_gain") / (F.col("_gain") + F.col("_loss")) * 100).otherwise(F.lit(50.0)))
    d = F.when(F.col("_rsv").isNotNull(), F.col("_d"))
    return x.select(*bars.columns, rsi.alias("rsi"), F.col("_kk").alias("k"), d.alias("d"), (3 * F.col("_kk") - 2 * d).alias("j"))


def wilder_range(bars: DataFrame, n: int, out: str = "atr", unit: Column | None = None) -> DataFrame:
    """bars with Wilder's average of true ranges, begun with the plain average of the first n; null before."""
    before = F.lag("close").over(by())
    span = F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    x = bars.withColumn("_tr", span).withColumn("_i", F.row_number().over(by())).withColumn("_mean", F.avg("_tr").over(by().rowsBetween(-(n - 1), 0)))
    a, b = F.when(F.col("_i") > n, (n - 1) / n).otherwise(0.0), F.when(F.col("_i") > n, F.col("_tr") / n).when(F.col("_i") == n, F.col("_mean")).otherwise(0.0)
    x = affine_scan(x, ["ticker"], "date", {"_atr": (a, b, 0.0)}, unit, counted=bars)
    return x.select(*bars.columns, F.when(F.col("_i") >= n, F.col("_atr")).alias(out))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, unit: Column | None = None) -> DataFrame:
    """bars with macd (the fast less the slow exponential average of closes), its own average macd_signal, and macd_histogram."""
    x = exponential_averages(bars, ["ticker"], "date", {"_fast": ("close", fast), "_slow": ("close", slow)}, unit).withColumn("macd", F.col("_fast") - F.col("_slow"))
    x = exponential_averages(x, ["ticker"], "date", {"macd_signal": ("macd", signal)}, unit, bars)
    return x.select(*bars.columns, "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("macd_histogram"))


def direction_score(structure: str, close: str, mid: str, mid_before: str, signal: str) -> tuple[Column, Column]:
    """(score -5..5, label) from structure 2, place to the middle band 1, its slope 1 and a level event 2."""
    sign = lambda a, b: F.when(F.col(a) > F.col(b), 1).when(F.col(a) < F.col(b), -1).otherwise(0)
    s = F.when(F.col(structure) == "up", 2).when(F.col(structure) == "down", -2).otherwise(0) + sign(close, mid) + sign(mid, mid_before)
    s = F.greatest(F.lit(-5), F.least(F.lit(5), s + F.when(F.col(signal) == "breakout", 2).when(F.col(signal) == "breakdown", -2).otherwise(0)))
    return s, F.when(s >= 3, "bullish").when(s >= 1, "weak_bullish").when(s <= -3, "bearish").when(s <= -1, "weak_bearish").otherwise("neutral")


def volume_state(ratio: Column, strong: float) -> Column:
    return F.when(ratio.isNull(), "unknown").when(ratio >= strong, "strong").when(ratio >= 1, "above_average").otherwise("shrinking")
