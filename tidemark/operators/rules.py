"""Predicates, gates and rules of screening and trading, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, clamp, finite_or_null, first_reason, half_up, reasons
from tidemark.operators.scans import dominance_join


def of_ticker(df: DataFrame, ticker: Column | str, names: list[str]) -> DataFrame:
    """Rows that name the ticker in any of the columns they have of `names`, as text."""
    there = [F.coalesce(F.col(n).cast("string") == c(ticker).cast("string"), F.lit(False)) for n in names if n in df.columns]
    found = F.lit(False)
    for t in there:
        found = found | t
    return df.where(found)


def between_dates(df: DataFrame, date: str, first: str | None, last: str | None) -> DataFrame:
    """Rows of first..last, both included; a bound that is None is open. Pushed down to the scan."""
    out = df if first is None else df.where(F.col(date) >= F.lit(first).cast("date"))
    return out if last is None else out.where(F.col(date) <= F.lit(last).cast("date"))


def shaped(df: DataFrame, fields: list[str] | None, rows: int | None) -> DataFrame:
    """Chosen fields, those that exist, and at most `rows` rows."""
    out = df.select(*[f for f in fields if f in df.columns]) if fields else df
    return out if rows is None else out.limit(rows)


def is_ordinary_equity(exchange: Column | str, code: Column | str, unit: Column | str, name: Column | str) -> Column:
    return F.coalesce(c(exchange).isin("TSE", "OTC") & c(code).rlike(r"^[1-9]\d{3}$") & (c(unit).cast("double") == 1000) & ~c(name).rlike("(?i)ETF|ETN|指數|特別股"), F.lit(False))


def latest_as_of(df: DataFrame, time: str, as_of: Column | str | None = None, window: bool = False) -> DataFrame:
    """Rows decided at or before as_of; of those only the latest date, unless a window is asked for."""
    out = df if as_of is None else df.where(F.col(time) <= c(as_of))
    if window:
        return out
    last = out.agg(F.max(F.to_date(time)).alias("_last"))  # one row
    return out.join(F.broadcast(last), F.to_date(time) == F.col("_last")).drop("_last")


# Limits of the hot-stock gate and the industry it leaves out.
HOT = {"volume_ratio": 1.9, "turnover_ratio": 1.7, "day_return": 1.8, "close_position": 0.7, "amount": 30_000_000.0, "atr_pct": 6.5}
EXCLUDED_INDUSTRIES, PROTECTED_INDUSTRIES = ("17",), ("28",)


def industry_code(x: Column | str) -> Column:
    """Two digits at least, filled with zeros; longer codes stay."""
    text = F.coalesce(c(x).cast("string"), F.lit(""))
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def _or(name: str, value: float = 0.0) -> Column:
    """The number, or `value` where it is null or not finite."""
    return F.coalesce(finite_or_null(name), F.lit(value))


def hot_score() -> Column:
    """From volume_ratio, turnover_ratio, day_return, close_position, amount, atr_pct: capped terms less a penalty for wide ranges."""
    s = F.least(_or("volume_ratio"), F.lit(5.0)) * 42 + F.least(_or("turnover_ratio"), F.lit(5.0)) * 46 + clamp(_or("day_return"), 0, 8) * 16 + clamp(_or("close_position"), 0, 1) * 42
    return half_up(s + F.least(_or("amount") / 1_000_000, F.lit(600.0)) / 10 - F.greatest(F.lit(0.0), _or("atr_pct") - 3.5) * 8, 2)


def hot_gate(industry: str = "industry", limits: dict[str, float] | None = None, excluded: tuple[str, ...] = EXCLUDED_INDUSTRIES) -> Column:
    """hot, insufficient-heat or excluded-industry."""
    if set(excluded) & set(PROTECTED_INDUSTRIES):
        raise ValueError("a protected industry must not be excluded")
    g = HOT | (limits or {})
    enough = F.lit(True)
    for name in ("volume_ratio", "turnover_ratio", "day_return", "close_position", "amount"):
        enough = enough & (_or(name) >= g[name])
    enough = enough & (_or("atr_pct", float("inf")) <= g["atr_pct"])
    return F.when(industry_code(industry).isin(*excluded), "excluded-industry").when(enough, "hot").otherwise("insufficient-heat")


# Fee and tax of a round trip, and how many times its cost the edge must be.
FEE, TAX, COST_MULTIPLE = 0.001425, 0.003, 3.0


def edge_pct(score: str = "hot_score", study: str = "study_score") -> Column:
    """Expected edge of a short trade in percent."""
    rise = lambda n: clamp(_or(n) - 1, 0, 3)
    bonus = lambda n, base: clamp(_or(n) - base, 0, 260) / 260
    e = clamp(_or("day_return"), 0, 6) * 0.28 + rise("volume_ratio") * 0.52 + rise("turnover_ratio") * 0.42 + clamp(_or("close_position"), 0, 1) * 0.72
    return half_up(e + bonus(score, 220) * 0.75 + bonus(study, 300) * 0.45 - F.greatest(F.lit(0.0), _or("atr_pct") - 4.2) * 0.28, 3)


def cost_gate(df: DataFrame, fee: float = FEE, tax: float = TAX, multiple: float = COST_MULTIPLE) -> DataFrame:
    """df with edge_pct, cost_pct, required_pct, cushion_pct, whether the edge pays, and the size multiplier."""
    cost = half_up(F.lit((fee * 2 + tax) * 100), 3)
    x = df.withColumn("edge_pct", edge_pct()).withColumn("cost_pct", cost).withColumn("required_pct", half_up(F.col("cost_pct") * multiple, 3))
    x = x.withColumn("cushion_pct", half_up(F.col("edge_pct") - F.col("cost_pct"), 3)).withColumn("pays", F.col("edge_pct") >= F.col("required_pct"))
    big, some = (F.col("hot_score") >= 390) & (F.col("cushion_pct") >= 2.2), (F.col("hot_score") >= 250) & (F.col("cushion_pct") >= 1)
    return x.withColumn("size_multiplier", F.when(big, 1.0).when(some, 0.72).otherwise(0.5))


def slot_budget(cash: Column | str, capital: Column | str, slots: Column | str, taken: Column | str, multiplier: Column | str) -> Column:
    """Whole currency for the next position: cash, its share of the free slots, or its share of the capital, times the multiplier."""
    free = F.greatest(F.lit(1), c(slots) - c(taken))
    return F.greatest(F.lit(0), F.floor(F.least(c(cash), c(cash) / free, c(capital) / F.greatest(F.lit(1), c(slots))) * c(multiplier)))


def entry_reasons(age_limit_ms: float, spread_limit: float) -> Column:
    """Why an entry is refused, in fixed order; none permits. Columns as named below."""
    quote = F.col("quote_age_ms").isNotNull()
    return reasons(
        ("BIDASK_MISSING", ~quote), ("BIDASK_STALE", quote & (F.col("quote_age_ms") > age_limit_ms)), ("SPREAD_LIMIT_EXCEEDED", quote & (F.col("spread") > spread_limit)), ("DATA_QUALITY_INVALID", ~F.col("quality_ok")),
        ("MODEL_INCOMPATIBLE", ~F.col("model_ok")), ("FEATURES_MISSING", ~F.col("features_ok")), ("POSITION_ALREADY_OPEN", F.col("position_open")), ("ROLLOVER_IN_PROGRESS", F.col("rollover")),
        ("SESSION_ENDED", F.col("session_ending")), ("COST_CONFIG_INCOMPLETE", ~F.col("costs_ok")),
    )


def health_failure(expected: Column | str, tick_limit_ms: float, quote_limit_ms: float) -> Column:
    """The first of six failures, null if all is well."""
    return first_reason(
        ("CONNECTION_INVALID", ~F.col("connected")), ("TARGET_CODE_MISMATCH", ~F.col("target").eqNullSafe(c(expected))), ("ROLLOVER_UNCONFIRMED", F.col("rollover")),
        ("TICK_STALE", F.col("tick_age_ms") > tick_limit_ms), ("BIDASK_STALE", F.col("quote_age_ms") > quote_limit_ms), ("DATA_QUALITY_INVALID", ~F.col("quality_ok")),
    )


def position_exit(age_limit_ms: float) -> Column:
    """Why a position leaves on a bar, or null: stop, target, deadline, session end, stale data, rollover.

    Where the bar touches both barriers, the first price of `ticks` that touches one decides, and
    without one it is the stop. Columns: direction, stop, target, high, low, ticks array<double>,
    at, deadline, session_end, quote_age_ms, rollover.
    """
    long = F.col("direction") == "LONG"
    stops = lambda low, high: F.when(long, low <= F.col("stop")).otherwise(high >= F.col("stop"))
    hits = lambda low, high: F.when(long, high >= F.col("target")).otherwise(low <= F.col("target"))
    stop, target = stops(F.col("low"), F.col("high")), hits(F.col("low"), F.col("high"))
    touch = F.get(F.filter("ticks", lambda p: stops(p, p) | hits(p, p)), F.lit(0))
    both = F.when(touch.isNotNull() & hits(touch, touch) & ~stops(touch, touch), "PROFIT_TARGET").otherwise("STOP_LOSS")
    return (
        F.when(stop & target, both).when(stop, "STOP_LOSS").when(target, "PROFIT_TARGET").when(F.col("at") >= F.col("deadline"), "VERTICAL_BARRIER").when(F.col("at") >= F.col("session_end"), "SESSION_END")
        .when(F.col("quote_age_ms").isNull() | (F.col("quote_age_ms") > age_limit_ms), "DATA_STALE").when(F.col("rollover"), "ROLLOVER")
    )


POINT_VALUE = 10.0


def settle(trades: DataFrame, costs: list[str], point_value: float = POINT_VALUE) -> DataFrame:
    """trades (direction, entry, exit and cost columns) with gross points and currency, and net where all costs are known."""
    gross = F.when(F.col("direction") == "LONG", F.col("exit") - F.col("entry")).otherwise(F.col("entry") - F.col("exit"))
    complete = F.lit(True)
    total = F.lit(0.0)
    for k in costs:
        complete, total = complete & F.col(k).isNotNull(), total + F.col(k)
    x = trades.withColumn("gross_points", gross).withColumn("gross_value", gross * point_value).withColumn("cost_complete", complete)
    return x.withColumn("net_value", F.when(complete, F.col("gross_value") - total))


def executable(bid: Column | str, ask: Column | str, entry_slip: float, exit_slip: float) -> dict[str, Column]:
    """Prices of either direction at a quote: a buyer pays the ask and slippage; null where the quote is crossed or missing."""
    ok = c(ask) >= c(bid)
    sides = {"long_entry": c(ask) + entry_slip, "long_exit": c(bid) - exit_slip, "short_entry": c(bid) - entry_slip, "short_exit": c(ask) + exit_slip}
    return {k: F.when(ok, v) for k, v in sides.items()}


def net_outcomes(df: DataFrame, cost: Column | str) -> DataFrame:
    """df (entry_bid, entry_ask, exit_bid, exit_ask, label) with gross and net points of both directions, and the net of the label."""
    x = df.withColumn("long_gross", F.col("exit_bid") - F.col("entry_ask")).withColumn("short_gross", F.col("entry_bid") - F.col("exit_ask"))
    x = x.withColumn("long_net", F.col("long_gross") - c(cost)).withColumn("short_net", F.col("short_gross") - c(cost))
    return x.withColumn("net", F.when(F.col("label") == "LONG", F.col("long_net")).when(F.col("label") == "SHORT", F.col("short_net")).otherwise(F.lit(0.0)))


def regime_tags(session: str, volatility: str, move: str, expiry_days: str, from_open: str, to_close: str) -> Column:
    """Session, volatility, structure, expiry week and part of the day, as an array."""
    vol, m = F.col(volatility), F.abs(F.col(move))
    return F.array(
        F.col(session), F.when(vol > 0.002, "HIGH_VOLATILITY").when(vol > 0.0005, "MEDIUM_VOLATILITY").otherwise("LOW_VOLATILITY"), F.when(m > 0.001, "TRENDING").otherwise("RANGING"),
        F.when(F.col(expiry_days) <= 7, "EXPIRY_WEEK").otherwise("NON_EXPIRY_WEEK"), F.when(F.col(from_open) <= 30, "OPENING_30M").when(F.col(to_close) <= 30, "CLOSING_30M").otherwise("INTRADAY"),
    )


def market_label(change: Column | str) -> Column:
    x = c(change)
    return F.when(x.isNull() | F.isnan(x), "artifact-only").when(x <= -2, "risk-off").when(x >= 1, "risk-on").otherwise("rotation")


def numbered(df: DataFrame, order: list[Column], keys: list[str], out: str = "place", most: int | None = None) -> DataFrame:
    """df with its place in an order within keys, and of each key the first `most`."""
    x = df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return x if most is None else x.where(F.col(out) <= most)


def screen_difference(before: DataFrame, after: DataFrame, keys: list[str], contexts: list[str]) -> DataFrame:
    """(keys, change): candidates added and removed, and changes of eligibility, score and contexts of rows in both.

    Both have eligible, score and the contexts. A score counts as changed, and a context is
    compared, only where both screens have a score.
    """
    side = lambda d, p: d.select(*keys, *[F.col(n).alias(f"_{p}_{n}") for n in ("eligible", "score", *contexts)], F.lit(True).alias(f"_{p}"))
    x = side(before, "b").join(side(after, "a"), keys, "full_outer")
    was, is_ = F.coalesce("_b_eligible", F.lit(False)), F.coalesce("_a_eligible", F.lit(False))
    both = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    scored = both & F.col("_b_score").isNotNull() & F.col("_a_score").isNotNull()
    found = reasons(
        ("added", is_ & ~was), ("removed", was & ~is_), ("eligibility", both & (was != is_)), ("score", scored & (F.col("_b_score") != F.col("_a_score"))),
        *[(n, scored & ~F.col(f"_b_{n}").eqNullSafe(F.col(f"_a_{n}"))) for n in contexts],
    )
    return x.select(*keys, F.explode(found).alias("change"))


def lineage(df: DataFrame, keys: list[str], order: str, source_hash: str, available: str, rows: int = 24) -> DataFrame:
    """df with the hashes of the last `rows` records up to each, how many, and the latest availability among them."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("lineage", F.array_sort(F.array_distinct(F.collect_list(source_hash).over(w)))).withColumn("lineage_available", F.max(available).over(w)).withColumn("lineage_rows", F.count("*").over(w))


def audit_samples(df: DataFrame, key: str, row_id: str, seed: str) -> DataFrame:
    """One row of each key: that of the smallest seeded hash."""
    draw = F.sha2(F.concat_ws(":", F.lit(seed), F.col(row_id).cast("string")), 256)
    return df.groupBy(key).agg(F.min_by(F.struct(*[n for n in df.columns if n != key]), F.struct(draw, row_id)).alias("_row")).select(key, "_row.*")


def dataset_metrics(df: DataFrame, features: str, available: str, decided: str) -> DataFrame:
    """One row: candidates, the share that is complete and in time, and those with evidence after their decision."""
    in_time = F.coalesce((F.size(available) > 0) & F.forall(available, lambda t: F.coalesce(t <= F.col(decided), F.lit(False))), F.lit(False))
    whole = F.coalesce((F.size(features) > 0) & F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
    n = F.count("*")
    return df.agg(n.alias("candidates"), F.when(n > 0, F.count_if(whole & in_time) / n * 100).otherwise(0.0).alias("coverage_pct"), F.count_if(~in_time).alias("violations"), ((n > 0) & (F.count_if(~in_time) == 0)).alias("passed"))


def frozen_universe(contracts: DataFrame) -> DataFrame:
    """By exchange the ordinary equities: how many, and a hash over their ordered codes."""
    x = contracts.where(is_ordinary_equity("exchange", "code", "unit", "name"))
    return x.groupBy("exchange").agg(F.count_distinct("code").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_set("code")), "\n"), 256).alias("universe_hash"))


def evidence_availability(wanted: DataFrame, landed: DataFrame, key: str, sources: list[str]) -> DataFrame:
    """By key the requested sources that landed and those that didn't. landed: key, source."""
    asked = wanted.select(key).distinct().withColumn("source", F.explode(F.array(*[F.lit(s) for s in sources])))
    got = landed.select(key, "source").distinct().withColumn("_there", F.lit(True))
    x = asked.join(got, [key, "source"], "left")
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("source"))))
    return x.groupBy(key).agg(F.count("*").alias("requested"), names(F.col("_there")).alias("available"), names(F.col("_there").isNull()).alias("unavailable"))


def episode_research(episodes: DataFrame, items: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """Each official episode (number) with the newest research item not after it nor after as_of: ready, stale or transcript_missing.

    items: keys, item_number, item_date. A dominance join by number and day; keys and number tell episodes apart.
    """
    left = episodes.select(*keys, F.col("number").cast("long").alias("_number"), F.unix_date(as_of).cast("long").alias("_day"))
    right = items.select(*keys, F.col("item_number").cast("long").alias("_number"), F.unix_date("item_date").cast("long").alias("_day"), "item_number")
    met = dominance_join(left, right, keys, ["_number", "_day"], "_number", "_day", ["item_number"], 1000, 1000).distinct()
    x = episodes.withColumn("_number", F.col("number").cast("long")).withColumn("_day", F.unix_date(as_of).cast("long")).join(met, [*keys, "_number", "_day"], "left")
    number = F.col("item_number")
    return x.select(*episodes.columns, "item_number", F.when(number == F.col("number"), "ready").when(number.isNotNull(), "stale").otherwise("transcript_missing").alias("status"))


# What a judgement may say.
REGIMES = ("spike", "tight_channel", "normal_channel", "trading_range", "insufficient_data")
DIRECTIONS, GATE_RESULTS, STANCES, NODES = ("bullish", "bearish", "neutral"), ("proceed", "wait"), ("enter", "wait", "avoid"), ("D1", "D2", "D3", "D4")
PRICES = ("active_entry", "patient_entry", "take_profit", "stop_loss")
FACT_TOLERANCE, ANCHOR_TOLERANCE = 0.005, 0.03


def judgement_errors(judgements: DataFrame, cited: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """(key, code): what is wrong with structured judgements, one row a finding.

    judgements: diagnosed and decided (whether the parts are there), regime, alternative_regime, direction,
    gate_result, confidence, trace (array of node, branch and the fact ids it cites), stance and the four
    prices; cited: key, fact_id, value (restated facts); facts: key, fact_id, fact. Without a
    diagnosis that is the only finding. Facts of a judgement are few, so theta joins are equi-joins by key.
    """
    j = judgements.where("diagnosed")
    priced = F.when(F.col("decided"), F.filter(F.array(*[F.col(p) for p in PRICES]), lambda v: v.isNotNull())).otherwise(F.array().cast("array<double>"))
    some, wait = F.size(priced) > 0, F.coalesce(F.col("gate_result") == "wait", F.lit(False))
    proceed, enter = F.coalesce(F.col("gate_result") == "proceed", F.lit(False)), F.col("decided") & F.coalesce(F.col("stance") == "enter", F.lit(False))
    long = ~F.coalesce(F.col("direction") == "bearish", F.lit(False))
    entry, stop, target = F.col("active_entry"), F.col("stop_loss"), F.col("take_profit")
    plan = enter & (F.size(priced) >= 3) & entry.isNotNull() & stop.isNotNull() & target.isNotNull()
    ordered = F.when(long, (stop < entry) & (entry < target)).otherwise((target < entry) & (entry < stop))
    outside = lambda col, allowed: ~F.coalesce(F.col(col).isin(*allowed), F.lit(False))
    walked = F.transform("trace", lambda t: t["node"])
    branch = lambda node: F.get(F.filter("trace", lambda t: t["node"] == node), F.lit(0))  # noqa: E731  the first such node
    strays = lambda node, allowed: branch(node).isNotNull() & ~F.coalesce(F.reduce(F.array(*[F.col(a).eqNullSafe(branch(node)["branch"]) for a in allowed]), F.lit(False), lambda x, y: x | y), F.lit(False))
    own = reasons(
        ("BAD_ENUM", outside("regime", REGIMES)), ("BAD_ENUM", outside("direction", DIRECTIONS)), ("BAD_ENUM", outside("gate_result", GATE_RESULTS)),
        ("BAD_ENUM", F.col("alternative_regime").isNotNull() & outside("alternative_regime", REGIMES)), ("BAD_ENUM", F.col("decided") & outside("stance", STANCES)),
        ("BAD_TYPE", F.coalesce(F.col("confidence") != F.floor("confidence"), F.lit(True))),
        ("BAD_SHAPE", F.coalesce(F.size("trace") <= 0, F.lit(True))),
        *[("MISSING_NODE", proceed & ~F.coalesce(F.array_contains(walked, n), F.lit(False))) for n in NODES],
        ("TRACE_CONFLICT", strays("D2", ("regime", "alternative_regime"))), ("TRACE_CONFLICT", strays("D3", ("direction",))),
        ("GATE_VIOLATION", some & wait), ("GATE_VIOLATION", some & ~proceed), ("GATE_VIOLATION", enter & wait),
        ("PRICE_ORDER", plan & ~ordered), ("RR_TOO_LOW", plan & ordered & (F.abs(target - entry) < F.abs(entry - stop))),
    )
    out = j.select(key, F.explode(own).alias("code")).unionByName(judgements.where("NOT diagnosed").select(key, F.lit("BAD_SHAPE").alias("code")))
    node = j.select(key, F.explode("trace").alias("_t")).select(key, F.coalesce("_t.facts", F.array().cast("array<string>")).alias("_ids"))
    out = out.unionByName(node.where(F.size("_ids") == 0).select(key, F.lit("NO_EVIDENCE").alias("code")))
    near = lambda a, b, tolerance: F.abs(a - b) <= tolerance * F.abs(b)
    x = cited.join(j.select(key), key, "left_semi").join(facts, [key, "fact_id"], "left")
    wrong = F.when(F.col("fact").isNull(), "UNKNOWN_FACT").when(~F.coalesce(near(F.col("value"), F.col("fact"), FACT_TOLERANCE), F.lit(False)), "FACT_VALUE_MISMATCH")
    out = out.unionByName(x.select(key, wrong.alias("code")).where("code IS NOT NULL"))
    # facts come to a judgement as one array, before its nodes and prices are laid out
    known = facts.groupBy(key).agg(F.collect_list(F.struct("fact_id", "fact")).alias("_known"))
    held = j.select(key, "trace", "decided", *PRICES).join(known, key, "left").withColumn("_known", F.coalesce("_known", F.array().cast(known.schema["_known"].dataType)))
    of_id = lambda i: F.filter("_known", lambda f: f["fact_id"] == i)
    unknown = lambda i: F.when(F.size(of_id(i)) == 0, F.array(F.lit("UNKNOWN_FACT"))).otherwise(F.transform(F.filter(of_id(i), lambda f: f["fact"].isNull()), lambda _: F.lit("UNKNOWN_FACT")))
    leaned = F.transform(F.flatten(F.transform("trace", lambda t: F.coalesce(t["facts"], F.array().cast("array<string>")))), unknown)
    anchored = lambda price: F.coalesce(F.exists("_known", lambda f: near(price, f["fact"], ANCHOR_TOLERANCE)), F.lit(False))
    loose = F.array_compact(F.array(*[F.when(F.col("decided") & F.col(p).isNotNull() & ~anchored(F.col(p)), F.lit("UNANCHORED_PRICE")) for p in PRICES]))
    codes = F.concat(F.coalesce(F.flatten(leaned), F.array().cast("array<string>")), loose)
    return out.unionByName(held.select(key, F.explode(codes).alias("code")))


# The kinds of findings; what is not named is of the schema.
CATEGORIES = {
    "schema": ("BAD_ENUM", "BAD_TYPE", "BAD_SHAPE"),
    "missing": ("MISSING_NODE", "NO_EVIDENCE"),
    "inconsistency": ("TRACE_CONFLICT", "GATE_VIOLATION", "RR_TOO_LOW", "PRICE_ORDER", "FORBIDDEN_CONTENT"),
    "untraceable": ("UNKNOWN_FACT", "FACT_VALUE_MISMATCH", "UNANCHORED_PRICE", "UNTRACEABLE_NUMBER"),
}


def counts_by_category(errors: DataFrame, code: str = "code") -> DataFrame:
    category = F.lit("schema")
    for name, codes in CATEGORIES.items():
        category = F.when(F.col(code).isin(*codes), name).otherwise(category)
    return errors.groupBy(category.alias("category")).agg(F.count("*").alias("n"))
