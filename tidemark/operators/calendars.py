"""Calendars from evidence, contract months, periods, and what collected sessions lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, reasons
from tidemark.operators.micro import seconds_between


#: The latest last print of a half day, which closes at 13:30.
HALF_DAY_LAST = "13:31:00"


def build_calendar(manifests: DataFrame, minute_files: bool = False) -> DataFrame:
    """(trading_date, day_close, is_expiry, night_start, nights) from segments (segment_day, first_ts, last_ts, and alias if there is one).

    A date with a print from 8:00 on is a trading date; it closes at 13:30 if its last print is at
    13:31 or before, else at 13:45; is_expiry on third Wednesdays. A night, named by the day it starts,
    belongs to the first trading date after that. Files of ticks hold a trading date with the night before it.
    minute_files hold a calendar date: a print from 15:00 on begins that date's night, one before 8:00 is the
    tail of the night of the day before, or, where that has no beginning, of the latest beginning before. `nights`
    over 1 is an error of the evidence, as is a night that no trading date follows: it comes back with a
    null trading_date. More than one alias raises.
    """
    if "alias" in manifests.columns:
        names = manifests.agg(F.min("alias").alias("a"), F.max("alias").alias("b")).first()
        if names.a != names.b:
            raise ValueError(f"multiple contract aliases in calendar evidence: {names.a}, {names.b}")
    day_of, clock = (lambda n: F.to_date(n)), (lambda n: F.date_format(n, "HH:mm:ss"))
    m = manifests.withColumn("_hour", F.hour("last_ts"))
    days = m.where((day_of("last_ts") == F.col("segment_day")) & (F.col("_hour") >= 8)).groupBy(F.col("segment_day").alias("trading_date")).agg(F.max("last_ts").alias("_last"))
    half = F.col("_last") <= F.to_timestamp_ntz(F.concat(F.date_format("_last", "yyyy-MM-dd"), F.lit(f" {HALF_DAY_LAST}")), F.lit("yyyy-MM-dd HH:mm:ss"))
    days = days.select("trading_date", F.when(half, "13:30").otherwise("13:45").alias("day_close"))
    if minute_files:
        heads = m.where((day_of("last_ts") == F.col("segment_day")) & (clock("last_ts") >= "15:00:00")).select(F.col("segment_day").alias("_h")).distinct()
        tails = m.where(clock("first_ts") < "08:00:00").select(day_of("first_ts").alias("_f")).distinct()
        # a row a day: the latest head before each tail, by one pass over both
        x = heads.select(F.col("_h").alias("_d"), F.lit(1).alias("_k"), F.col("_h")).unionByName(tails.select(F.col("_f").alias("_d"), F.lit(0).alias("_k"), F.lit(None).cast("date").alias("_h")))
        x = x.withColumn("_head", F.max("_h").over(W.orderBy("_d", "_k").rowsBetween(W.unboundedPreceding, -1))).where("_k = 0")
        tails = x.select(F.when(F.col("_head").isNull(), F.date_sub("_d", 1)).otherwise(F.col("_head")).alias("night_start"))
        nights = heads.select(F.col("_h").alias("night_start")).unionByName(tails).distinct()
    else:
        early = (day_of("first_ts") < F.col("segment_day")) | (F.hour("first_ts") < 8)
        start = F.when(F.hour("first_ts") >= 15, day_of("first_ts")).otherwise(F.date_sub(day_of("first_ts"), 1))
        nights = m.where(early).select(start.alias("night_start")).distinct()
    # the next trading date of a night, by one pass over dates and nights together: a row a day each
    both = nights.select(F.col("night_start").alias("_d"), F.lit(0).alias("_k"), F.lit(None).cast("date").alias("_t")).unionByName(days.select(F.col("trading_date").alias("_d"), F.lit(1).alias("_k"), F.col("trading_date").alias("_t")))
    # a date itself is not after a night that starts on it
    after = F.first("_t", ignorenulls=True).over(W.orderBy("_d", F.col("_k").desc()).rowsBetween(1, W.unboundedFollowing))
    placed = both.withColumn("_next", after).where("_k = 0").groupBy(F.col("_next").alias("trading_date")).agg(F.min("_d").alias("night_start"), F.count("*").alias("nights"))
    expiry = F.col("trading_date") == third_wednesday("trading_date")
    out = days.join(placed, "trading_date", "left").select("trading_date", "day_close", expiry.alias("is_expiry"), "night_start", F.coalesce("nights", F.lit(0)).alias("nights"))
    lost = placed.where("trading_date IS NULL").select("trading_date", F.lit(None).cast("string").alias("day_close"), F.lit(None).cast("boolean").alias("is_expiry"), "night_start", "nights")
    return out.unionByName(lost)


def third_wednesday(date: Column | str) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.trunc(c(date), "MM"), 1), "Wed"), 14)


def near_contract(date: Column | str, category: str) -> tuple[Column, Column]:
    """(code, expiry): this month's contract up to its third Wednesday, then the next one's."""
    now, later = third_wednesday(date), third_wednesday(F.add_months(F.trunc(c(date), "MM"), 1))
    expiry = F.when(c(date) > now, later).otherwise(now)
    return F.concat(F.lit(category), F.date_format(expiry, "yyyyMM")), expiry


def rollovers(resolved: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """Resolutions that differ from the one before in any of the columns, with the old values."""
    w = W.partitionBy(*keys).orderBy(at)
    now, old = F.struct(*columns), F.lag(F.struct(*columns)).over(w)
    x = resolved.withColumn("_old", old).where(F.col("_old").isNotNull() & (F.col("_old") != now))
    return x.select(*keys, F.col(at).alias("effective_from"), *[F.col(f"_old.{n}").alias(f"old_{n}") for n in columns], *[F.col(n).alias(f"new_{n}") for n in columns])


def session_by_hour(ts: Column | str) -> Column:
    h = F.hour(c(ts))
    return F.when((h >= 15) | (h < 6), "NIGHT").when((h >= 8) & (h < 14), "DAY")


#: Ranges of half years that a registered study looks at; anything else is outside.
def half_year(date: Column | str) -> Column:
    return F.concat(F.year(c(date)).cast("string"), F.when(F.month(c(date)) <= 6, "H1").otherwise("H2"))


def in_periods(df: DataFrame, date: str, periods: DataFrame) -> DataFrame:
    """df with the period (name, first, last) of its date; null outside all. Periods are a table of a few rows."""
    return df.join(F.broadcast(periods), (F.col(date) >= F.col("first")) & (F.col(date) <= F.col("last")), "left").drop("first", "last")


def blocks(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """df with `block`, from 0, a new one where over a month of the calendar is missing between rows."""
    w = W.partitionBy(*keys).orderBy(date)
    month = F.year(date) * 12 + F.month(date)
    gap = F.coalesce(month - F.lag(month).over(w) > 1, F.lit(False)).cast("long")
    return df.withColumn("block", F.sum(gap).over(w.rowsBetween(W.unboundedPreceding, 0)))


def evidence_date(local: Column | str, complete_hour: int = 18) -> Column:
    """The last day whose evidence is complete at a local time."""
    return F.when(F.hour(c(local)) < complete_hour, F.date_sub(F.to_date(c(local)), 1)).otherwise(F.to_date(c(local)))


def minute_of_session(ts: Column | str, start: Column | str, bucket: int = 30) -> tuple[Column, Column]:
    minute = F.floor(seconds_between(ts, start) / 60)
    return minute, F.floor(minute / bucket)


def weekday_coverage(sessions: DataFrame, first: Column | str, last: Column | str) -> DataFrame:
    """(date, present): weekdays of first..last with no session, or with one of the two only. sessions: trading_date, session."""
    spark = sessions.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(c(first), c(last))).alias("date")).where("weekday(date) < 5")
    seen = sessions.select(F.col("trading_date").alias("date"), "session").distinct().groupBy("date").agg(F.array_join(F.array_sort(F.collect_set("session")), "/").alias("present"))
    return days.join(seen, "date", "left").where(F.col("present").isNull() | (F.col("present") != "DAY/NIGHT")).select("date", F.coalesce("present", F.lit("")).alias("present"))


def missing_from_calendar(collected: DataFrame, calendar: DataFrame) -> DataFrame:
    return collected.select("trading_date").distinct().join(calendar.select("trading_date"), "trading_date", "left_anti")


def audit_sessions(segments: DataFrame, hole_s: float = 60.0) -> DataFrame:
    """By (trading_date, session) of segments (first_ts, last_ts, record_count): counts, holes and what is wrong."""
    w = W.partitionBy("trading_date", "session").orderBy("first_ts", "last_ts")
    x = segments.withColumn("_hole", (seconds_between(F.lead("first_ts").over(w), "last_ts") > hole_s).cast("long"))
    x = x.groupBy("trading_date", "session").agg(F.sum("record_count").alias("records"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum(F.coalesce("_hole", F.lit(0))).alias("holes"))
    at = lambda name: F.date_format(name, "HH:mm")
    day = F.col("session") == "DAY"
    flags = reasons(("late_start", F.when(day, at("first_ts") > "08:46").otherwise(at("first_ts") > "15:01")), ("early_end", F.when(day, at("last_ts") < "13:44").otherwise(at("last_ts") < "04:59")), ("interrupted", F.col("holes") > 0))
    return x.withColumn("flags", flags)


def session_quality(events: DataFrame, expected_s: Column | str, step_s: int = 1) -> DataFrame:
    """By target, trading_date, session and kind: events, share of distinct seconds, longest gap, and whether all is there.

    events: target, trading_date, session, kind, exchange_ts, reasons array.
    """
    keys = ["target", "trading_date", "session", "kind"]
    x = events.withColumn("_gap", seconds_between("exchange_ts", F.lag("exchange_ts").over(W.partitionBy(*keys).orderBy("exchange_ts"))))
    step = F.floor(F.unix_micros(F.col("exchange_ts").cast("timestamp")) / (1_000_000 * step_s))
    x = x.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.size("reasons")).alias("invalid"), F.count_distinct(step).alias("_steps"), F.coalesce(F.max("_gap"), F.lit(0.0)).alias("longest_gap_s"))
    x = x.withColumn("coverage", F.least(F.lit(1.0), F.col("_steps") / c(expected_s))).drop("_steps")
    return x.withColumn("status", F.when((F.col("invalid") == 0) & (F.col("coverage") == 1), "VALID").otherwise("INVALID"))
