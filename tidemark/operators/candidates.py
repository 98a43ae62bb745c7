"""Daily candidates with the evidence they rest on, positions as published the day before, and bars as stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, half_up
from tidemark.operators.daily import by
from tidemark.operators.flows import trailing_zscore

#: The features of a candidate in their order; those that must be there.
FEATURES = (
    "hma9_slope", "hma9_acceleration", "hma20_slope", "close_to_hma9", "volume_ratio", "volume_acceleration", "avg_turnover", "avg_turnover_log10", "momentum1", "momentum3", "momentum5",
    "breadth", "median_momentum3", "relative_momentum3", "range_pct", "close_position", "foreign_streak", "foreign_intensity", "foreign_percentile",
)
REQUIRED = ("hma9_slope", "hma20_slope", "close_to_hma9", "avg_turnover", "momentum5", "close_position")

#: Bars and flows that a candidate's features reach back to.
MARKET_ROWS, FLOW_ROWS = 24, 20


def latest_evidence(bars: DataFrame, flows: DataFrame, available: str = "available_at") -> DataFrame:
    """(ticker, date, decision_time): when the last evidence of a bar's features came: of its last 24 bars, the flows of its last 20, and its date's market.

    The market of a date rests on each ticker's bar and those 1 and 3 before, where all three and their closes are there.
    """
    x = bars.select("ticker", "date", "close", F.col(available).alias("_at")).join(flows.select("ticker", "date", F.col(available).alias("_flow_at")), ["ticker", "date"], "left")
    own = F.max("_at").over(by().rowsBetween(-(MARKET_ROWS - 1), 0))
    flow = F.max("_flow_at").over(by().rowsBetween(-(FLOW_ROWS - 1), 0))
    seen = F.when((F.lag("close", 1).over(by()) > 0) & (F.lag("close", 3).over(by()) > 0) & F.col("close").isNotNull(), F.greatest("_at", F.lag("_at", 1).over(by()), F.lag("_at", 3).over(by())))
    x = x.select("ticker", "date", F.greatest(own, flow).alias("_own"), seen.alias("_seen"))
    market = x.groupBy("date").agg(F.max("_seen").alias("_market"))
    return x.join(market, "date").select("ticker", "date", F.greatest("_own", "_market").alias("decision_time"))


def candidates(daily: DataFrame, foreign: DataFrame, evidence: DataFrame) -> DataFrame:
    """(ticker, date, decision_time, price, the 19 features): bars with a range, a price and the required features.

    daily: of features() and with_market(); foreign: of foreign_features(); evidence: of latest_evidence(). Values are
    rounded to 8 digits; a missing one that isn't required stays null. Bars without evidence are no candidates.
    """
    x = daily.join(foreign.select("ticker", "date", "foreign_streak", "foreign_intensity", "foreign_percentile"), ["ticker", "date"], "left").join(evidence, ["ticker", "date"])
    x = x.withColumn("avg_turnover_log10", F.when(F.col("avg_turnover") > 0, F.log10("avg_turnover")))
    needed = (F.col("close") > 0) & (F.col("high") > F.col("low")) & F.col("decision_time").isNotNull()
    for n in REQUIRED:
        needed &= F.col(n).isNotNull() & ~F.isnan(F.col(n))
    return x.where(needed).select("ticker", "date", "decision_time", half_up("close", 8).alias("price"), *[half_up(n, 8).alias(n) for n in FEATURES])


def positions_before(published: DataFrame, closes: DataFrame, names: list[str], window: int = 126, date: str = "trading_date", keys: list[str] | None = None) -> DataFrame:
    """Each day's close with the positions published the day before, and each position's z against the `window` joined days before it.

    Published rows are one a day (and key); the row before counts even if its day has no close. A published day
    without a close, or a row before that lacks a position, gives nothing. z is 0 where the window doesn't vary;
    days before a full window are left out.
    """
    by_day = [*(keys or []), date]
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(date)  # one row a day and key
    x = published.select(*by_day, *[F.lag(n).over(w).alias(n) for n in names])
    x = x.dropna(subset=names).join(closes.select(*by_day, "close"), by_day)
    grouping = keys or ["_one"]
    x = x if keys else x.withColumn("_one", F.lit(0))
    scores = {f"{n}_z": trailing_zscore(x, grouping, date, n, window) for n in names}
    return x.select(*by_day, "close", *names, *[z.alias(n) for n, z in scores.items()]).dropna(subset=list(scores))


def stored_bars(bars: DataFrame, alias: str | Column, created_at: str | Column, minutes: int = 15) -> DataFrame:
    """Bars as records of an append-only store: an id by alias, day, session and begin, and the values as `fields`.

    bars: trading_date, session, bar_start, open, high, low, close, volume. created_at is a moment with its zone.
    """
    begin = F.date_format("bar_start", "yyyy-MM-dd'T'HH:mm:ss")
    end = F.date_format(F.col("bar_start") + F.make_dt_interval(mins=F.lit(minutes)), "yyyy-MM-dd'T'HH:mm:ss")
    name = c(alias).cast("string")
    day = F.date_format("trading_date", "yyyy-MM-dd")
    fields = F.struct(begin.alias("bar_start"), end.alias("bar_end"), *[F.col(n.lower()).alias(n) for n in ("Open", "High", "Low", "Close", "Volume")])
    return bars.select(
        F.lit("1.0.0").alias("schema_version"), F.concat_ws("-", F.lit(f"derived-kbar-{minutes}m"), name, day, "session", begin).alias("event_id"), F.col("bar_start").alias("exchange_datetime"), c(created_at).alias("received_at"),
        F.lit("DERIVED_FROM_KBARS_1M").alias("source"), name.alias("alias_code"), day.alias("trading_date"), "session", fields.alias("fields"),
    )


def write_stored_bars(records: DataFrame, path: str) -> None:
    """Appends records in folders of day and session, one shuffle by those, so that a day is read alone."""
    records.repartition("trading_date", "session").write.mode("append").partitionBy("trading_date", "session").parquet(path)
