"""Typed rows from raw records, bars from minutes, in-bar signals, and samples for training."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, finite_or_null, reasons
from tidemark.operators.micro import KEYS, seconds_between

# The fields of tick and quote records and their kinds.
TICK = {"event_id": "text", "received_at": "time", "exchange_datetime": "time", "target_code": "text", "close": "number", "volume": "whole", "simtrade": "flag"}
QUOTE = {"event_id": "text", "received_at": "time", "exchange_datetime": "time", "target_code": "text", "bid_prices": "numbers", "ask_prices": "numbers", "bid_volumes": "wholes", "ask_volumes": "wholes", "simtrade": "flag"}


def _typed(x: Column, kind: str) -> Column:
    if kind == "text":
        return F.when(F.length(F.trim(x)) > 0, x)
    if kind == "time":  # a time without a zone is refused
        return F.when(x.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(x))
    if kind == "number":
        return finite_or_null(x)
    if kind == "whole":
        return F.when(F.trim(x).rlike(r"^[+-]?\d+$"), F.trim(x).try_cast("long"))
    if kind == "flag":
        return F.lower(x).try_cast("boolean")
    parts = F.from_json(x, "array<string>")
    each = F.transform(parts, lambda v: _typed(v, kind[:-1]))
    return F.when(F.forall(each, lambda v: v.isNotNull()), each)


def decode(raw: DataFrame, fields: dict[str, str], column: str = "record") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON records: every field typed and required; a reject keeps its record and names what is wrong."""
    names = list(fields)
    # a generator's output is computed once: filters on it do not parse or type a record again
    once = lambda x, name: F.explode(F.array(x)).alias(name)
    parsed = raw.select(F.col(column), once(F.from_json(F.col(column), ", ".join(f"{n} string" for n in names)), "_f"))
    typed = parsed.select(F.col(column), once(F.struct(*[_typed(F.col(f"_f.{n}"), k).alias(n) for n, k in fields.items()]), "_t"))
    missing = [F.col(f"_t.{n}").isNull() for n in names]
    anything = reduce(lambda a, b: a | b, missing)
    good = typed.where(~anything).select(*[F.col(f"_t.{n}").alias(n) for n in names])
    return good, typed.where(anything).select(F.col(column), F.array_join(reasons(*zip(names, missing, strict=True)), ",").alias("wrong"))


def event_reasons() -> Column:
    """What speaks against an event of typed records with a session: seven reasons in order.

    Columns: simtrade, session, trading_date, target_code, code, price, volume, bids, asks (arrays
    of prices, null for trades).
    """
    quote = F.col("bids").isNotNull() | F.col("asks").isNotNull()
    depth = lambda a: F.coalesce(F.size(a) > 0, F.lit(False)) & F.coalesce(F.forall(a, lambda v: v > 0), F.lit(False))
    best = lambda a: F.get(F.col(a), F.lit(0))
    return reasons(
        ("SIMTRADE", F.col("simtrade")), ("OUT_OF_SESSION", (F.col("session") == "CLOSED") | F.col("trading_date").isNull()), ("TARGET_MISMATCH", ~F.coalesce(F.col("target_code") == F.col("code"), F.lit(False))),
        ("INVALID_PRICE", ~quote & ~F.coalesce(F.col("price") > 0, F.lit(False))), ("NEGATIVE_VOLUME", ~quote & (F.col("volume") < 0)),
        ("INVALID_DEPTH", quote & ~(depth("bids") & depth("asks"))), ("CROSSED_BOOK", quote & (best("bids") >= best("asks"))),
    )


def opening_book_is_empty(bids: str, asks: str) -> Column:
    """A book of zeros only, as sent before the open: dropped, not rejected."""
    return ~F.exists(F.concat(bids, asks), lambda v: v != 0)


def snapshots(rows: DataFrame) -> DataFrame:
    """Provider snapshots: numbers under either name, limit state, and whether orders are locked at a limit without a book."""
    there = set(rows.columns)
    pick = lambda *names: F.coalesce(*[finite_or_null(n) for n in names if n in there], F.lit(None).cast("double"))
    kind = F.coalesce(*[F.col(n).cast("string") for n in ("change_type", "changeType", "chg_type") if n in there], F.lit(None).cast("string"))
    up, down = F.coalesce(kind.isin("LimitUp", "1"), F.lit(False)), F.coalesce(kind.isin("LimitDown", "5"), F.lit(False))
    x = rows.select("code", pick("close", "lastPrice").alias("last"), pick("buy_price", "bid_price").alias("bid"), pick("sell_price", "ask_price").alias("ask"), pick("total_volume", "totalVolume").alias("volume"), up.alias("limit_up"), down.alias("limit_down"))
    return x.withColumn("locked", (F.col("limit_up") | F.col("limit_down")) & F.coalesce((F.col("bid") == 0) & (F.col("ask") == 0), F.lit(False)))


def level_book(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Parallel arrays of a provider's book to bids and asks, array<struct<price, volume, diff>>; missing differences are null."""
    side = lambda s: F.transform(F.arrays_zip(F.col(f"{s}_price").alias("price"), F.col(f"{s}_volume").alias("volume"), F.col(f"diff_{s}_vol").alias("diff")), lambda v: F.struct(v["price"].cast("double").alias("price"), v["volume"].cast("double").alias("volume"), v["diff"].cast("double").alias("diff")))
    return rows.select(*keys, side("bid").alias("bids"), side("ask").alias("asks"))


def minute_rows(payloads: DataFrame, keys: list[str], columns: list[str], ts: str = "ts") -> DataFrame:
    """Column arrays of one-minute bars to rows: the label is the closing minute, so `minute` is one before; a stamp that repeats adds its place to the id."""
    size = [F.size(n) for n in (ts, *columns)]
    same = F.greatest(*size) == F.least(*size)
    x = payloads.where(same).select(*keys, F.posexplode(F.arrays_zip(ts, *columns)).alias("_place", "_z")).select(*keys, "_place", *[F.col(f"_z.{n}").alias(n) for n in (ts, *columns)])
    again = F.count("*").over(W.partitionBy(*keys, ts)) > 1
    row_id = F.concat_ws("-", F.lit("kbar"), *[F.col(k).cast("string") for k in keys], F.unix_seconds(F.col(ts).cast("timestamp")).cast("string"))
    return x.select(*keys, F.when(again, F.concat(row_id, F.lit("-"), F.col("_place").cast("string"))).otherwise(row_id).alias("row_id"), (F.col(ts) - F.expr("interval 1 minute")).alias("minute"), *columns)


def bars_of_minutes(minutes: DataFrame, widths: list[int]) -> DataFrame:
    """Bars of several widths from the minutes there are; a bucket that the session's end clips is dropped.

    minutes: KEYS, session_end, minute, open, high, low, close, volume. Equal repeats of a minute
    are one; `conflict` says that a bucket holds a minute with two contents.
    """
    rows = minutes.select(*KEYS, "session_end", "minute", "open", "high", "low", "close", "volume").distinct()
    rows = rows.withColumn("_twice", F.count("*").over(W.partitionBy(*KEYS, "minute")) > 1)
    x = rows.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths]))).withColumn("bucket", F.floor(seconds_between("minute", "session_start") / 60 / F.col("width")))
    x = x.where(seconds_between("session_end", "session_start") / 60 >= (F.col("bucket") + 1) * F.col("width"))
    return x.groupBy(*KEYS, "width", "bucket").agg(
        F.min_by("open", "minute").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "minute").alias("close"), F.sum("volume").alias("volume"), F.count_distinct("minute").alias("minutes"), F.bool_or("_twice").alias("conflict"),
    )


def daily_bars(ticks: DataFrame, key: str = "target") -> DataFrame:
    """Bars of a day's positive prices in order of time, whatever order they were stored in."""
    order = F.struct("exchange_ts", "event_id")
    return ticks.where("price > 0").groupBy(key, F.to_date("exchange_ts").alias("date")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("ticks"))


def near_month(rows: DataFrame, date: str, expiry: str, regular: Column) -> DataFrame:
    """Of each date the regular session's bar of the smallest expiry code with valid prices."""
    ok = regular
    for n in ("open", "high", "low", "close"):
        ok = ok & (F.col(n) > 0)
    w = W.partitionBy(date).orderBy(F.trim(expiry))
    return rows.where(ok).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def basis_with_carry(states: DataFrame, underlying: str = "underlying") -> DataFrame:
    """states with `basis`: close less underlying where a step traded, else the one before; on the first step the midpoint's."""
    w = W.partitionBy(*KEYS).orderBy("step")
    first = F.row_number().over(w) == 1
    seed = F.when((F.col("trades") > 0) & F.col(underlying).isNotNull(), F.col("close") - F.col(underlying)).when(first, F.col("midpoint") - F.col(underlying))
    return states.withColumn("_seed", seed).withColumn("basis", F.last("_seed", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_seed")


def quotes_from_ticks(ticks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The quotes that trades carry (bid, bid_volume, ask, ask_volume), where they are sound and differ from the last sound one."""
    level = F.struct("bid", "bid_volume", "ask", "ask_volume")
    sound = ticks.where("bid > 0 AND ask > 0 AND ask >= bid AND bid_volume >= 0 AND ask_volume >= 0")
    return sound.withColumn("_before", F.lag(level).over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_before").isNull() | (F.col("_before") != level)).drop("_before")


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str) -> DataFrame:
    """left with the value of the first right row strictly after it; rows are ordered within a key, such as a session."""
    l = left.select("*", F.col(left_ts).alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(*keys, F.col(right_ts).alias("_at"), F.lit(0).alias("_k"), F.col(value).alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    # backwards in time: a frame that grows takes a step a row, one that shrinks is read anew for each
    back = W.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_k"), F.desc("_v"))
    nxt = F.last("_v", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(f"next_{value}", nxt).where("_k = 1").select(*left.columns, f"next_{value}")


def inbar_signals(ticks: DataFrame, contexts: DataFrame, keys: list[str], interval_s: int, ratio: float) -> DataFrame:
    """Crossings of the levels of the bar before, at the tick where the pace of volume already suffices: once a bar and way.

    ticks: keys, bar_start, ts, event_id, price, volume; contexts: keys, bar_start, res, sup, mid, volume_avg, prev_close.
    """
    w = W.partitionBy(*keys, "bar_start").orderBy("ts", "event_id")
    x = ticks.join(contexts.where("mid IS NOT NULL AND volume_avg > 0 AND prev_close IS NOT NULL"), [*keys, "bar_start"])
    x = x.withColumn("_sum", F.sum("volume").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_last", F.coalesce(F.lag("price").over(w), "prev_close"))
    pace = F.col("_sum") / (F.greatest(seconds_between("ts", "bar_start"), F.lit(1.0)) / interval_s)
    strong = pace >= ratio * F.col("volume_avg")
    up = (F.col("prev_close") <= F.col("res")) & (F.col("_last") <= F.col("res")) & (F.col("price") > F.col("res")) & strong & (F.col("price") > F.col("mid"))
    down = (F.col("prev_close") >= F.col("sup")) & (F.col("_last") >= F.col("sup")) & (F.col("price") < F.col("sup")) & strong & (F.col("price") < F.col("mid"))
    hit = x.withColumn("_s", F.when(up, F.struct(F.lit("breakout").alias("signal"), F.col("res").alias("level"))).when(down, F.struct(F.lit("breakdown").alias("signal"), F.col("sup").alias("level")))).where("_s IS NOT NULL")
    hit = hit.select(*keys, "bar_start", "ts", "event_id", "_s.signal", "_s.level")
    return hit.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "bar_start", "signal").orderBy("ts", "event_id"))).where("_n = 1").drop("_n")


def zone_entries(ticks: DataFrame, contexts: DataFrame, keys: list[str], zone_pct: float) -> DataFrame:
    """First entries into the zone of a level of the bar before, towards it: once a level and key, such as a session."""
    z = zone_pct / 100
    w = W.partitionBy(*keys, "bar_start").orderBy("ts", "event_id")
    x = ticks.join(contexts.where("prev_close IS NOT NULL"), [*keys, "bar_start"]).withColumn("_last", F.coalesce(F.lag("price").over(w), "prev_close"))
    low, high = F.col("sup") * (1 + z), F.col("res") * (1 - z)
    found = F.array(
        F.when((F.col("_last") > low) & (F.col("price") <= low), F.struct(F.lit("bounce").alias("signal"), F.col("sup").alias("level"))),
        F.when((F.col("_last") < high) & (F.col("price") >= high), F.struct(F.lit("rejection").alias("signal"), F.col("res").alias("level"))),
    )
    hit = x.select(*keys, "bar_start", "ts", "event_id", F.explode(F.filter(found, lambda s: s.isNotNull())).alias("_s")).select(*keys, "bar_start", "ts", "event_id", "_s.signal", "_s.level")
    return hit.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "signal", "level").orderBy("ts", "event_id"))).where("_n = 1").drop("_n")


def time_features(df: DataFrame, at: str, expiry: str) -> DataFrame:
    """Session flags, minutes from the open and to the close, days to expiry, and whether it is the rollover day."""
    return df.select(
        "*", (F.col("session") == "DAY").cast("double").alias("session_day"), (F.col("session") == "NIGHT").cast("double").alias("session_night"), (seconds_between(at, "session_start") / 60).alias("minutes_from_open"),
        (seconds_between("session_end", at) / 60).alias("minutes_to_close"), F.datediff(expiry, "trading_date").cast("double").alias("days_to_expiry"), (F.col(expiry) == F.col("trading_date")).cast("double").alias("is_rollover_day"),
    )


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[F.col(n).isNull().cast("double").alias(f"{n}_missing") for n in columns])


def decision_candidates(bars: DataFrame, horizons: list[int], bar_end: str = "bar_end") -> DataFrame:
    """A candidate for each complete bar and horizon, with a hash of target, time and horizon as its id."""
    x = bars.where("complete AND target IS NOT NULL").select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    name = F.concat_ws("|", F.col("target").cast("string"), F.date_format(bar_end, "yyyy-MM-dd'T'HH:mm:ss"), F.col("horizon").cast("string"))
    return x.withColumn("candidate_id", F.sha2(name, 256)).dropDuplicates(["target", bar_end, "horizon"])


def momentum_grid(bars: DataFrame, keys: list[str], date: str, lookbacks: list[int], holds: list[int]) -> DataFrame:
    """(lookback, hold, before, after): past and future returns of every pair inside a block of keys."""
    w = W.partitionBy(*keys).orderBy(date)
    pairs = [(b, h) for b in lookbacks for h in holds]
    past = {b: F.when(F.lag("close", b).over(w) > 0, F.col("close") / F.lag("close", b).over(w) - 1) for b in lookbacks}
    future = {h: F.when(F.col("close") > 0, F.lead("close", h).over(w) / F.col("close") - 1) for h in holds}
    x = bars.select(*keys, date, *[v.alias(f"_p{b}") for b, v in past.items()], *[v.alias(f"_f{h}") for h, v in future.items()])
    each = F.array(*[F.struct(F.lit(b).alias("lookback"), F.lit(h).alias("hold"), F.col(f"_p{b}").alias("before"), F.col(f"_f{h}").alias("after")) for b, h in pairs])
    return x.select(F.explode(each).alias("_e")).select("_e.*").where("before IS NOT NULL AND after IS NOT NULL")
