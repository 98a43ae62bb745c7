"""Microstructure: sessions, as-of quotes, step states, session-anchored bars and their features.

A step is one second in production and a parameter here. Everything is keyed by (target,
session_start); windows never leave a session unless they say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, quotient
from tidemark.operators.scans import dominance_join, exponential_averages

KEYS = ["target", "session_start"]


def weekday_calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(trading_date, session, session_start, session_end) of every weekday in first..last.

    The night that joins a date opens on the weekday before it and closes the morning after that.
    """
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS d").where("weekday(d) < 5")
    before = F.expr("date_sub(d, CASE weekday(d) WHEN 0 THEN 3 ELSE 1 END)")
    at = lambda day, time: F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(f" {time}")), F.lit("yyyy-MM-dd HH:mm:ss"))
    day = days.select(F.col("d").alias("trading_date"), F.lit("DAY").alias("session"), at(F.col("d"), "08:45:00").alias("session_start"), at(F.col("d"), "13:45:00").alias("session_end"))
    night = days.select(F.col("d").alias("trading_date"), F.lit("NIGHT").alias("session"), at(before, "15:00:00").alias("session_start"), at(F.date_add(before, 1), "05:00:00").alias("session_end"))
    return day.unionByName(night)


def resolve_sessions(df: DataFrame, calendar: DataFrame, ts: str = "exchange_ts") -> DataFrame:
    """df with trading_date, session (CLOSED outside all), session_start, session_end; start in, end out.

    Sessions are laid out by the hours they touch, so this is a join by hour, not a range join.
    """
    hours = calendar.withColumn("_hour", F.explode(F.sequence(F.date_trunc("hour", "session_start"), F.date_trunc("hour", F.expr("session_end - interval 1 microsecond")), F.expr("interval 1 hour"))))
    on = (F.date_trunc("hour", F.col(ts)) == F.col("_hour")) & (F.col(ts) >= F.col("session_start")) & (F.col(ts) < F.col("session_end"))
    return df.join(hours, on, "left").drop("_hour").withColumn("session", F.coalesce("session", F.lit("CLOSED")))


def seconds_between(late: str | Column, early: str | Column) -> Column:
    return (F.unix_micros(c(late).cast("timestamp")) - F.unix_micros(c(early).cast("timestamp"))) / 1_000_000.0


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a moment."""
    return F.unix_micros(c(ts).cast("timestamp"))


#: Microseconds of one task's share of a key's quotes.
HOUR = 3_600_000_000


def asof_quotes(ticks: DataFrame, quotes: DataFrame, keys: list[str], max_age_s: float) -> DataFrame:
    """Each tick with the latest quote of its keys (target and delivery month) that both clocks allow: exchange_ts

    and received_ts not after the tick's; on equal exchange times the larger event_id. Adds quote_id,
    quote_ts, quote_age_s and status: OK, MISSING, or STALE (which keeps the time). event_ids are distinct.
    """
    clocks = lambda d: d.withColumn("_first", micros("exchange_ts")).withColumn("_second", micros("received_ts"))
    right = clocks(quotes.select(*keys, F.col("event_id").alias("quote_id"), F.col("exchange_ts").alias("quote_ts"), "exchange_ts", "received_ts"))
    left = clocks(ticks.select(*keys, "event_id", "exchange_ts", "received_ts"))
    joined = dominance_join(left, right, keys, ["event_id", "exchange_ts", "received_ts"], "_first", "_second", ["quote_id", "quote_ts"], HOUR, HOUR)
    age = seconds_between("exchange_ts", "quote_ts")
    status = F.when(F.col("quote_id").isNull(), "MISSING").when(age > max_age_s, "STALE").otherwise("OK")
    return joined.select("*", age.alias("quote_age_s"), status.alias("status"))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], strict: bool = False, unit: str = "day") -> DataFrame:
    """left with the values of the last right row at or before (strict: before) it; of equal times the greatest values.

    Rows are sorted by key and `unit` of time, so that no key's history meets in one task; what was
    last before a unit comes from a table of one row a key and unit.
    """
    value = F.struct(right_ts, *values)
    kind = right.select(value).schema[0].dataType
    left_row = F.struct(*left.columns)
    l = left.select(*keys, F.col(left_ts).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_value"), left_row.alias("_left"))  # noqa: E741
    r = right.select(*keys, F.col(right_ts).alias("_at"), F.lit(2 if strict else 0).alias("_kind"), value.alias("_value"), F.lit(None).cast(left.select(left_row).schema[0].dataType).alias("_left"))
    both = l.unionByName(r).withColumn("_unit", F.date_trunc(unit, F.col("_at").cast("timestamp")))
    ends = both.groupBy(*keys, "_unit").agg(F.max("_value").alias("_end"))
    before = F.last("_end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_unit").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*keys, "_unit", before.alias("_before"))
    inside = F.last("_value", ignorenulls=True).over(W.partitionBy(*keys, "_unit").orderBy("_at", "_kind", "_value").rowsBetween(W.unboundedPreceding, 0))
    out = both.withColumn("_value", inside).where("_kind = 1").join(ends, [*keys, "_unit"]).withColumn("_value", F.coalesce("_value", "_before"))
    return out.select("_left.*", F.col(f"_value.{right_ts}").alias("matched_ts"), *[F.col(f"_value.{v}").alias(v) for v in values])


def step_states(ticks: DataFrame, quotes: DataFrame, step_s: int, max_quote_age_s: float) -> DataFrame:
    """One row per step of each observed (target, session), from its first to its last event.

    Steps without trades have null prices and volume 0; only the quote and the ages carry on.
    ticks and quotes carry target, session_start, session_end, exchange_ts.
    """
    at = lambda d: d.withColumn("step", F.floor(seconds_between("exchange_ts", "session_start") / step_s))
    ticks, quotes = at(ticks), at(quotes)
    order = F.struct("exchange_ts", "event_id")
    t = ticks.groupBy(*KEYS, "step").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("trades"),
        *[F.sum(F.when(F.col("side") == s, F.col("volume")).otherwise(0)).alias(f"{s}_volume") for s in ("buy", "sell", "unknown")],
        F.sum(F.col("price") * F.col("volume")).alias("notional"), F.max("exchange_ts").alias("tick_ts"),
    )
    q = quotes.groupBy(*KEYS, "step").agg(*[F.max_by(x, order).alias(x) for x in ("bid", "ask", "depth")], F.max("exchange_ts").alias("quote_ts"))
    span = ticks.select(*KEYS, "step").unionByName(quotes.select(*KEYS, "step")).groupBy(*KEYS).agg(F.min("step").alias("a"), F.max("step").alias("b"))
    grid = span.select(*KEYS, F.explode(F.sequence("a", "b")).alias("step"))
    x = grid.join(t, [*KEYS, "step"], "left").join(q, [*KEYS, "step"], "left")
    past = W.partitionBy(*KEYS).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    for name in ("bid", "ask", "depth", "quote_ts", "tick_ts"):
        x = x.withColumn(name, F.last(name, ignorenulls=True).over(past))
    for name in ("volume", "trades", "buy_volume", "sell_volume", "unknown_volume", "notional"):
        x = x.withColumn(name, F.coalesce(name, F.lit(0)))
    return with_ages(x, step_s, max_quote_age_s)


def with_ages(x: DataFrame, step_s: int, max_quote_age_s: float) -> DataFrame:
    """Steps with the ages of their last tick and quote at the step's end, whether the quote is fresh, and spread and midpoint if it is."""
    age = lambda ts: (F.col("step") + 1) * step_s - seconds_between(ts, "session_start")
    x = x.withColumn("tick_age_s", age("tick_ts")).withColumn("quote_age_s", age("quote_ts"))
    fresh = F.coalesce(F.col("quote_age_s") <= max_quote_age_s, F.lit(False))
    return x.select("*", fresh.alias("quote_fresh"), F.when(fresh, F.col("ask") - F.col("bid")).alias("spread"), F.when(fresh, (F.col("ask") + F.col("bid")) / 2).alias("midpoint"))


def bars(states: DataFrame, n: int, steps_in_session: str | Column) -> DataFrame:
    """Bars of n steps anchored at the session's begin; the last is clipped at its end.

    complete: all n steps are there and the bar is not clipped.
    """
    x = states.withColumn("bar", F.floor(F.col("step") / n)).withColumn("_expected", F.least(F.lit(n), c(steps_in_session) - F.col("bar") * n))
    priced = lambda f: F.when(F.col("trades") > 0, f)
    return x.groupBy(*KEYS, "bar").agg(
        F.min_by("open", priced(F.col("step"))).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", priced(F.col("step"))).alias("close"),
        F.sum("volume").alias("volume"), F.sum("trades").alias("trades"), *[F.sum(f"{s}_volume").alias(f"{s}_volume") for s in ("buy", "sell", "unknown")],
        F.when(F.sum("volume") > 0, F.sum("notional") / F.sum("volume")).alias("vwap"),
        (F.count_if("quote_fresh") / F.max("_expected")).alias("quote_coverage"), (F.count_if(F.col("trades") > 0) / F.max("_expected")).alias("tick_coverage"),
        ((F.count("*") == F.max("_expected")) & (F.max("_expected") == n)).alias("complete"),
    )


def bar_features(b: DataFrame) -> DataFrame:
    """Returns, rising run, body ratio, VWAPs, true range, ATR, realised volatility and expansion, by session."""
    w = W.partitionBy(*KEYS).orderBy("bar")
    past, five = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(-4, 0)
    before = F.lag("close").over(w)
    true_range = F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    x = b.withColumn("true_range", true_range).withColumn("ret1", quotient("close", before) - 1).withColumn("ret5", quotient("close", F.lag("close", 5).over(w)) - 1)
    rising = F.coalesce(F.col("close") > F.col("open"), F.lit(False))
    x = x.withColumn("_island", F.sum(F.when(rising, 0).otherwise(1)).over(past))
    x = x.withColumn("rising_run", F.sum(F.when(rising, 1).otherwise(0)).over(W.partitionBy(*KEYS, "_island").orderBy("bar").rowsBetween(W.unboundedPreceding, 0)))
    value = F.col("vwap") * F.col("volume")
    session_vwap = F.sum(value).over(past) / F.sum(F.when(F.col("vwap").isNotNull(), F.col("volume"))).over(past)
    vwap5 = F.sum(value).over(five) / F.sum(F.when(F.col("vwap").isNotNull(), F.col("volume"))).over(five)
    x = x.withColumn("session_vwap", session_vwap).withColumn("vwap5", vwap5).withColumn("atr5", F.avg("true_range").over(five))
    return x.select(
        *b.columns, "ret1", "ret5", "rising_run", "true_range", "atr5", "session_vwap", "vwap5",
        F.when(F.col("high") > F.col("low"), F.abs(F.col("close") - F.col("open")) / (F.col("high") - F.col("low"))).when(F.col("high").isNotNull(), 0.0).alias("body_ratio"),
        (F.col("session_vwap") - F.lag("session_vwap").over(w)).alias("vwap_slope"),
        F.when(F.col("atr5") > 0, (F.col("close") - F.col("session_vwap")) / F.col("atr5")).alias("vwap_distance_atr"),
        F.sqrt(F.sum(F.col("ret1") * F.col("ret1")).over(five)).alias("realized_vol"),
        F.when(F.avg("true_range").over(w.rowsBetween(-5, -1)) != 0, F.col("true_range") / F.avg("true_range").over(w.rowsBetween(-5, -1))).alias("range_expansion"),
    )


def ema(df: DataFrame, value: str, span: int, keys: list[str], order: str, out: str, unit: Column | None = None) -> DataFrame:
    """Exponential average that starts at the first value; keys are not null. unit: see affine_scan()."""
    return exponential_averages(df, keys, order, {out: (value, span)}, unit)


def order_flow(states: DataFrame, steps: int = 10, large: int = 50) -> DataFrame:
    """Aggressive volumes, their imbalance and the share of large steps over the last steps."""
    w = W.partitionBy(*KEYS).orderBy("step").rowsBetween(-(steps - 1), 0)
    buy, sell, rest = (F.sum(f"{s}_volume").over(w) for s in ("buy", "sell", "unknown"))
    big = F.sum(F.when(F.col("volume") >= large, F.col("volume")).otherwise(0)).over(w)
    return states.select(*KEYS, "step", buy.alias("buy_flow"), sell.alias("sell_flow"), F.when(buy + sell > 0, (buy - sell) / (buy + sell)).alias("flow_imbalance"), F.when(buy + sell + rest > 0, big / (buy + sell + rest)).alias("large_share"))


def basis_features(df: DataFrame, basis: str = "basis", window: int = 300) -> DataFrame:
    """Changes over 10 and 60 known values and the z-score over the last `window`, carried to rows without one."""
    w = W.partitionBy(*KEYS).orderBy("step")
    known = df.where(F.col(basis).isNotNull())
    frame = w.rowsBetween(-(window - 1), 0)
    spread = F.stddev_pop(basis).over(frame)
    z = F.when((F.count(basis).over(frame) > 1) & (spread > 0), (F.col(basis) - F.avg(basis).over(frame)) / spread)
    f = known.select(*KEYS, "step", F.struct(F.col(basis).alias("level"), (F.col(basis) - F.lag(basis, 10).over(w)).alias("change10"), (F.col(basis) - F.lag(basis, 60).over(w)).alias("change60"), z.alias("zscore")).alias("_f"))
    x = df.join(f, [*KEYS, "step"], "left").withColumn("_f", F.last("_f", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.select(*df.columns, "_f.level", "_f.change10", "_f.change60", "_f.zscore")


def session_structure(b: DataFrame) -> DataFrame:
    """Distance of each close to the session before: its high, low and close, in ATR, and the break of its high."""
    order = F.struct("bar")
    s = b.groupBy(*KEYS).agg(F.max("high").alias("hi"), F.min("low").alias("lo"), F.max_by("close", order).alias("cl"))
    w = W.partitionBy("target").orderBy("session_start")
    s = s.select(*KEYS, *[F.lag(x).over(w).alias(f"prev_{x}") for x in ("hi", "lo", "cl")])
    x = b.join(s, KEYS)
    gap = lambda level: F.when(F.col("atr5") != 0, (F.col("close") - F.col(level)) / F.col("atr5"))
    return x.select(*b.columns, gap("prev_hi").alias("to_prev_high"), gap("prev_lo").alias("to_prev_low"), gap("prev_cl").alias("to_prev_close"), (F.col("close") > F.col("prev_hi")).alias("breaks_prev_high"))


def percentile_volume(df: DataFrame, keys: list[str], value: str, share: float = 0.9) -> DataFrame:
    """The value at place max(0, int(share n) - 1) of the sorted ones, from a histogram."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys).orderBy(value)
    counts = counts.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(W.partitionBy(*keys)))
    place = F.greatest(F.lit(0), F.floor(F.col("_all") * share) - 1)
    return counts.where(F.col("_upto") > place).groupBy(*keys).agg(F.min(value).alias("threshold"))


def triple_barrier(entries: DataFrame, b: DataFrame, horizon: int, target_atr: float, minimum_target: float, stop_atr: float | None = None, minimum_stop: float | None = None) -> DataFrame:
    """First barrier touched in the `horizon` bars after the entry bar, within its session.

    entries: target, session_start, bar, bid, ask, atr. Entries without all bars up to the
    touch, or up to the horizon, are left out. Adds label, touch bar, favourable and adverse
    excursion up to the touch. The target is the larger of its multiple of the range and its
    minimum above the ask, the stop likewise below the bid; by default the stop is as wide.
    """
    wide = lambda k, least: F.greatest(F.lit(k) * F.col("atr"), F.lit(least))
    stop = wide(target_atr if stop_atr is None else stop_atr, minimum_target if minimum_stop is None else minimum_stop)
    e = entries.withColumn("upper", F.col("ask") + wide(target_atr, minimum_target)).withColumn("lower", F.col("bid") - stop)
    later = b.where("complete").select(*KEYS, F.col("bar").alias("later"), "high", "low")
    x = e.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("later", F.col("bar") + F.col("k")).join(later, [*KEYS, "later"])
    up, down = F.coalesce(F.col("high") >= F.col("upper"), F.lit(False)), F.coalesce(F.col("low") <= F.col("lower"), F.lit(False))
    x = x.withColumn("touch", F.when(up & down, "AMBIGUOUS").when(up, "LONG").when(down, "SHORT"))
    keys = [*KEYS, "bar"]
    first = F.min(F.when(F.col("touch").isNotNull(), F.col("k"))).over(W.partitionBy(*keys))
    x = x.withColumn("first", first).where(F.col("k") <= F.coalesce("first", F.lit(horizon)))
    out = x.groupBy(*keys).agg(
        F.first("upper").alias("upper"), F.first("lower").alias("lower"), F.max("first").alias("touch_at"), F.count("*").alias("seen"), F.max("touch").alias("touch"),
        F.greatest(F.lit(0.0), F.max(F.col("high") - F.col("ask"))).alias("mfe"), F.greatest(F.lit(0.0), F.max(F.col("bid") - F.col("low"))).alias("mae"),
    )
    out = out.where(F.col("seen") == F.coalesce("touch_at", F.lit(horizon)))
    return out.select(*keys, F.coalesce("touch", F.lit("NO_TRADE")).alias("label"), "touch_at", "upper", "lower", F.coalesce("mfe", F.lit(0.0)).alias("mfe"), F.coalesce("mae", F.lit(0.0)).alias("mae"))
