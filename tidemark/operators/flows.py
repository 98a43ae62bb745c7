"""Sector heat, investor flows, holders, funds and single-stock studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.daily import by, streak


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "place") -> DataFrame:
    """The n first rows of each key; Spark cuts each partition to n rows a key before it shuffles."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n)


def sector_heat(quotes: DataFrame, companies: DataFrame, unknown: str = "unknown") -> DataFrame:
    """By industry: stocks, volume, turnover, up and down counts. quotes: code, change, volume, turnover."""
    x = quotes.join(companies.select("code", "industry"), "code", "left").withColumn("industry", F.coalesce("industry", F.lit(unknown)))
    return x.groupBy("industry").agg(
        F.count("*").alias("stocks"), F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"), F.count_if(F.col("change") > 0).alias("up"), F.count_if(F.col("change") < 0).alias("down")
    )


# Names of investor classes, in order.
INVESTORS = {"foreign": r"(?i)foreign|外資", "trust": r"(?i)trust|投信", "dealer": r"(?i)dealer|自營"}


def investor_class(name: str = "investor") -> Column:
    """Investor class by pattern, in order; null if none fits."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(INVESTORS.items()):
        out = F.when(F.col(name).rlike(pattern), kind).otherwise(out)
    return out


def sector_flow(flows: DataFrame, prices: DataFrame, companies: DataFrame) -> DataFrame:
    """Net value by industry and investor class; rows without a price are dropped. flows: code, investor, lots."""
    x = flows.join(prices.select("code", "close"), "code").join(companies.select("code", "industry"), "code")
    value = F.col("lots") * F.col("close")
    each = lambda k: F.sum(F.when(F.col("class") == k, F.col("value")).otherwise(0.0)).alias(k)
    return x.withColumn("class", investor_class()).withColumn("value", value).groupBy("industry").agg(*[each(k) for k in ("foreign", "trust", "dealer")], F.sum("value").alias("total"))


def pivot_complete(flows: DataFrame, parties: list[str]) -> DataFrame:
    """Net by date and party as columns; only dates that have all parties."""
    return flows.groupBy("date").pivot("investor", parties).agg(F.sum("net")).na.drop(subset=parties)


def net_of_last_dates(flows: DataFrame, n: int) -> DataFrame:
    """Net by ticker and investor over a ticker's last n dates."""
    rank = F.dense_rank().over(W.partitionBy("ticker").orderBy(F.col("date").desc()))
    return flows.withColumn("_r", rank).where(F.col("_r") <= n).groupBy("ticker", "investor").agg(F.sum("net").alias("net"), F.count_distinct("date").alias("dates"))


def buying_streaks(net: DataFrame) -> DataFrame:
    """Per ticker the latest date's streak of positive days and the longest one."""
    x = streak(net, F.col("net") > 0, "run", ["ticker"], ["date"])
    return x.groupBy("ticker").agg(F.max_by("run", "date").alias("streak_now"), F.max("run").alias("streak_longest"))


def large_holders(levels: DataFrame, least: int) -> DataFrame:
    """Share of holders from `least` lots on by date, and whether it rose strictly. levels: code, date, level text, percent."""
    low = F.regexp_replace(F.regexp_extract("level", r"^\s*([0-9,]+)", 1), ",", "").try_cast("long")
    x = levels.where(low >= least).groupBy("code", "date").agg(F.sum("percent").alias("share"))
    return x.withColumn("rising", F.col("share") > F.lag("share").over(W.partitionBy("code").orderBy("date")))


def forward_returns(bars: DataFrame, n: int) -> DataFrame:
    """Percent from each close to the close n bars on."""
    return bars.withColumn("forward", (F.lead("close", n).over(by()) / F.col("close") - 1) * 100)


def return_summary(df: DataFrame, keys: list[str], value: str = "forward") -> DataFrame:
    x = F.col(value)
    return df.where(x.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), (F.count_if(x > 0) / F.count("*") * 100).alias("win_pct"), F.max(x).alias("best"), F.min(x).alias("worst"))


def false_breakouts(bars: DataFrame, n: int, drop_pct: float = 3.0) -> DataFrame:
    """Buy crossings followed within n bars by a close below the average or drop_pct below theirs; the rate is over all crossings."""
    w = by().rowsBetween(1, n)
    x = bars.withColumn("under", F.max((F.col("close") < F.col("hma")).cast("int")).over(w)).withColumn("lowest", F.min("close").over(w)).withColumn("later", F.count("*").over(w))
    bad = (F.col("later") > 0) & ((F.col("under") == 1) | ((F.col("lowest") - F.col("close")) / F.col("close") <= -drop_pct / 100))
    return x.where("crossed_up").groupBy("ticker").agg(F.count("*").alias("signals"), F.count_if(F.col("later") > 0).alias("checked"), F.count_if(bad).alias("false_ones")).withColumn("false_rate", F.col("false_ones") / F.col("signals") * 100)


def volume_confirmed(bars: DataFrame, n: int, ratio: float = 1.2) -> Column:
    """Whether the volume is `ratio` times the average of up to n bars before, or more; false without any."""
    before = F.avg("volume").over(by().rowsBetween(-n, -1))
    return F.coalesce((before != 0) & (F.col("volume") / before >= ratio), F.lit(False))


#: Least average volume and turnover, and the share of the volume that a position may take.
MIN_VOLUME, MIN_TURNOVER, POSITION_SHARE, LOT = 1_000_000.0, 20_000_000.0, 0.02, 1000


def _liquid(volume: Column, turnover: Column, min_volume: float, min_turnover: float, share: float) -> dict[str, Column]:
    ratio = F.least(volume / min_volume, turnover / min_turnover)
    return {
        "avg_volume": volume, "avg_turnover": turnover, "eligible": ratio >= 1, "status": F.when(ratio >= 1, "liquid").otherwise("thin"),
        "score": F.greatest(F.lit(0), F.least(F.lit(100), F.floor(ratio * 100 + 0.5))), "max_shares": F.floor(volume * share), "max_lots": F.floor(F.floor(volume * share) / LOT),
    }


def liquidity(bars: DataFrame, n: int, min_volume: float = MIN_VOLUME, min_turnover: float = MIN_TURNOVER, share: float = POSITION_SHARE) -> DataFrame:
    """Over a ticker's last n bars: average volume and turnover (volume times close), whether both suffice, score and largest lots."""
    x = top_rows(bars.where("volume IS NOT NULL AND close IS NOT NULL"), ["ticker"], [F.col("date").desc()], n)
    out = x.groupBy("ticker").agg(F.count("*").alias("bars"), F.avg("volume").alias("_v"), F.avg(F.col("volume") * F.col("close")).alias("_t"))
    return out.select("ticker", "bars", *[v.alias(k) for k, v in _liquid(F.col("_v"), F.col("_t"), min_volume, min_turnover, share).items()])


def moving_facts(bars: DataFrame) -> DataFrame:
    """Averages of 5, 10, 20 bars, turnover ratio, 20-bar extremes with their dates, and the retracement."""
    frame = lambda n: by().rowsBetween(-(n - 1), 0)
    full = lambda x, n: F.when(F.count("*").over(frame(n)) == n, x)
    hi, lo = F.max("high").over(frame(20)), F.min("low").over(frame(20))
    x = bars.select(
        "*", *[full(F.avg("close").over(frame(n)), n).alias(f"ma{n}") for n in (5, 10, 20)], full(F.col("turnover") / F.avg("turnover").over(frame(20)), 20).alias("turnover_ratio"),
        full(hi, 20).alias("high20"), full(lo, 20).alias("low20"), full(F.max_by("date", "high").over(frame(20)), 20).alias("high20_date"),
    )
    return x.withColumn("retracement", F.when(F.col("high20") > F.col("low20"), (F.col("high20") - F.col("close")) / (F.col("high20") - F.col("low20")) * 100))


def drawdown_episodes(series: DataFrame, keys: list[str], least_pct: float) -> DataFrame:
    """Falls by at least least_pct from a running high: peak, trough and recovery. series: keys, date, close."""
    w = W.partitionBy(*keys).orderBy("date")
    past = w.rowsBetween(W.unboundedPreceding, 0)
    x = series.withColumn("peak", F.max("close").over(past))
    x = x.withColumn("episode", F.sum(F.when(F.col("close") >= F.col("peak"), 1).otherwise(0)).over(past))
    out = x.groupBy(*keys, "episode").agg(F.first("peak").alias("peak"), F.min("date").alias("peak_date"), F.min("close").alias("trough"), F.min_by("date", F.struct("close", "date")).alias("trough_date"), F.max("date").alias("last_date"))
    out = out.withColumn("recovery_date", F.lead("peak_date").over(W.partitionBy(*keys).orderBy("episode"))).withColumn("drawdown_pct", (F.col("trough") / F.col("peak") - 1) * 100)
    return out.where(F.col("drawdown_pct") <= -least_pct)


def trailing_zscore(df: DataFrame, keys: list[str], order: str, value: str, n: int) -> Column:
    """z of a value against the n before it; 0 where those don't differ, null where there are fewer."""
    frame = W.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    spread = F.stddev_pop(value).over(frame)
    return F.when(F.count(value).over(frame) == n, F.when(spread > 0, (F.col(value) - F.avg(value).over(frame)) / spread).otherwise(F.lit(0.0)))


def non_overlapping(series: DataFrame, keys: list[str], hold: int) -> DataFrame:
    """Every hold-th bar's return to the next such bar, compounded per key, against buying and holding."""
    w = W.partitionBy(*keys).orderBy("date")
    x = series.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") % hold == 0).withColumn("ret", F.lead("close").over(w) / F.col("close") - 1)
    return x.where("ret IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("holds"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("compounded"))


def fund_edges(holdings: DataFrame) -> DataFrame:
    """Latest lots per fund and stock, the change to the holding before, and the net value in 100 millions."""
    w = W.partitionBy("fund", "code").orderBy("date", "lots", "price")
    x = holdings.withColumn("before", F.lag("lots").over(w)).withColumn("_last", F.lead("lots").over(w)).where("_last IS NULL").drop("_last")
    change = F.col("lots") - F.coalesce("before", F.lit(0.0))
    return x.select("fund", "code", "lots", change.alias("change"), (change * F.col("price") * 1000 / 1e8).alias("net_value"))


def holders_of(edges: DataFrame) -> DataFrame:
    """By stock: how many funds hold it, the fund with most lots, and total lots."""
    return edges.groupBy("code").agg(F.count("*").alias("funds"), F.max_by("fund", F.struct("lots", -F.col("fund"))).alias("largest_fund"), F.sum("lots").alias("lots"))


def chip_events(bars: DataFrame, net: DataFrame) -> DataFrame:
    """Each bar with the last known net flow at or before its date and its age in days."""
    from tidemark.operators.micro import asof_backward

    known = net.where("net IS NOT NULL")
    x = asof_backward(bars.select("ticker", "date", "close"), known, ["ticker"], "date", "date", ["net"], unit="month")
    return x.withColumn("age_days", F.datediff("date", "matched_ts"))


def decisions(states: DataFrame, n: int = 20, min_volume: float = MIN_VOLUME, min_turnover: float = MIN_TURNOVER, ratio: float = 1.2) -> DataFrame:
    """A decision for every bar that has an average, as of that bar: liquidity, trend, volume, then the last crossing.

    states: bars from daily.hma_state. Windows take the place of a run per day.
    """
    last = by().rowsBetween(-(n - 1), 0)
    liquid = (F.avg("volume").over(last) >= min_volume) & (F.avg(F.col("volume") * F.col("close")).over(last) >= min_turnover)
    signal = F.last(F.when(F.col("crossed_up"), "buy").when(F.col("crossed_down"), "sell"), ignorenulls=True).over(by().rowsBetween(W.unboundedPreceding, 0))
    x = states.select("*", liquid.alias("liquid"), volume_confirmed(states, n, ratio).alias("confirmed"), signal.alias("last_signal"))
    up, weak, down = F.col("trend").isin("bullish", "bullish_reversal"), F.col("trend") == "weak_bullish", F.col("trend").isin("bearish", "bearish_reversal")
    action = (
        F.when(~F.col("liquid"), "avoid_liquidity")
        .when(up & F.col("confirmed"), F.when(F.col("last_signal") == "buy", "buy_watch").otherwise("hold_or_scale"))
        .when(up | weak, "wait_pullback")
        .when(down, "avoid_trend")
        .otherwise("watch")
    )
    return x.where("hma IS NOT NULL AND close_before IS NOT NULL").withColumn("decision", action)


def signal_score(trend: str, confirmed: str, liquid: str, bought: str, forward: str, false_rate: str) -> Column:
    """Confidence 0..100 of a signal: trend, volume, liquidity, institutions, forward average, false breakouts."""
    t, yes = F.col(trend), lambda x, v: F.when(F.coalesce(F.col(x), F.lit(False)), v).otherwise(0)
    score = F.when(t.isin("bullish", "bullish_reversal"), 35).when(t == "weak_bullish", 20).when(t.isin("bearish", "bearish_reversal"), -20).otherwise(0)
    score = score + yes(confirmed, 25) + F.when(F.col(liquid), 15).when(~F.col(liquid), -30).otherwise(0) + yes(bought, 25)
    score = score + F.when(F.col(forward) > 0, 10).otherwise(0) + F.when(F.col(false_rate) <= 30, 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def signal_advice(trend: str, confirmed: str, liquid: str, bought: str, score: str) -> Column:
    t, ok = F.col(trend), lambda x: F.coalesce(F.col(x), F.lit(False))
    up = t.isin("bullish", "bullish_reversal")
    return (
        F.when(~F.col(liquid), "avoid_or_reduce_size")
        .when(t.isin("bearish", "bearish_reversal"), "avoid_or_reduce")
        .when(up & ok(confirmed) & ok(bought) & (F.col(score) >= 70), "follow_in_steps")
        .when(up | (t == "weak_bullish"), "wait_for_pullback")
        .otherwise("watch")
    )


def chip_performance(events: DataFrame, bars: DataFrame, days: list[int]) -> DataFrame:
    """Forward returns of dates with institutional and holder confirmation, by horizon. events: ticker, date."""
    x = bars
    for n in days:
        x = x.withColumn(f"_f{n}", (F.lead("close", n).over(by()) / F.col("close") - 1) * 100)
    each = events.join(x, ["ticker", "date"]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("days"), F.col(f"_f{n}").alias("forward")) for n in days])).alias("_e"))
    return return_summary(each.select("_e.days", "_e.forward"), ["days"])
