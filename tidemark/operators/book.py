"""Order-book confidence, pre-open judgements and text checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import c, clamp, first_reason, half_up, number_of, reasons

# Weights of the levels, and what a confidence is called and adds from a score on.
WEIGHTS = (5, 4, 3, 2, 1)
LABELS = ((70, "strong_buy_pressure", 8), (58, "buy_pressure", 4))
LOWER_LABELS = ((30, "strong_sell_pressure", -5), (42, "sell_pressure", -2))
PERSISTENT, ENTER_ON_ASK = 0.05, 70


def _bad_level(levels: str) -> Column:
    ok = lambda v: (v["price"] > 0) & (v["volume"] >= 0)
    return ~F.forall(F.slice(levels, 1, len(WEIGHTS)), lambda v: F.coalesce(ok(v), F.lit(False)))


def check_snapshots(books: DataFrame) -> DataFrame:
    """books (bids, asks: array<struct<price, volume, diff>>, suspend) with `problem` (null if sound) and levels of volume only."""
    first = lambda a: F.filter(F.slice(a, 1, len(WEIGHTS)), lambda v: v["volume"] > 0)
    x = books.withColumn("_b", first("bids")).withColumn("_a", first("asks"))
    none = lambda a: F.coalesce(F.size(a) <= 0, F.lit(True))
    problem = first_reason(
        ("suspended", F.coalesce("suspend", F.lit(False))), ("missing_ask_depth", none("asks")), ("missing_bid_depth", none("bids")), ("invalid_bid_level", _bad_level("bids")), ("invalid_ask_level", _bad_level("asks")),
        ("missing_positive_bid_depth", none("_b")), ("missing_positive_ask_depth", none("_a")), ("crossed_or_locked_book", F.get("_b", F.lit(0))["price"] >= F.get("_a", F.lit(0))["price"]),
    )
    return x.select(*[n for n in books.columns if n not in ("bids", "asks")], problem.alias("problem"), F.col("_b").alias("bids"), F.col("_a").alias("asks"))


def _weighted(levels: str, what: str) -> Column:
    pairs = F.zip_with(levels, F.slice(F.array(*[F.lit(float(w)) for w in WEIGHTS]), 1, F.size(levels)), lambda v, w: F.coalesce(v[what].cast("double"), F.lit(0.0)) * w)
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def pressures(checked: DataFrame) -> DataFrame:
    """Depth imbalance, change pressure and pressure (0.8 and 0.2 of them, in -1..1) of sound snapshots, 4 digits."""
    x = checked.where("problem IS NULL").withColumn("_b", _weighted("bids", "volume")).withColumn("_a", _weighted("asks", "volume")).withColumn("_db", _weighted("bids", "diff")).withColumn("_da", _weighted("asks", "diff"))
    depth = F.when(F.col("_b") + F.col("_a") == 0, 0.0).otherwise((F.col("_b") - F.col("_a")) / (F.col("_b") + F.col("_a")))
    change = F.when(F.abs("_db") + F.abs("_da") == 0, 0.0).otherwise((F.col("_db") - F.col("_da")) / (F.abs("_db") + F.abs("_da")))
    x = x.withColumn("depth_imbalance", depth).withColumn("change_pressure", change)
    x = x.withColumn("pressure", half_up(clamp(0.8 * F.col("depth_imbalance") + 0.2 * F.col("change_pressure"), -1, 1)))
    return x.withColumn("depth_imbalance", half_up("depth_imbalance")).withColumn("change_pressure", half_up("change_pressure")).drop("_b", "_a", "_db", "_da")


def confidence(pressured: DataFrame, keys: list[str]) -> DataFrame:
    """Over a key's samples: mean pressure, persistence, a whole score around 50, its label, adjustment and reliability.

    Persistence is 1 or -1 where two samples or more all lean one way by over PERSISTENT.
    """
    p = F.col("pressure")
    x = pressured.groupBy(*keys).agg(F.count("*").alias("samples"), F.avg(p).alias("mean_pressure"), F.every(p > PERSISTENT).alias("_up"), F.every(p < -PERSISTENT).alias("_down"))
    several = F.col("samples") >= 2
    x = x.withColumn("persistence", F.when(several & F.col("_up"), 1).when(several & F.col("_down"), -1).otherwise(0)).drop("_up", "_down")
    x = x.withColumn("score", clamp(half_up(50 + 40 * F.col("mean_pressure") + 10 * F.col("persistence"), 0), 0, 100))
    s, n = F.col("score"), F.col("samples")
    label, adjust = F.lit("balanced"), F.lit(0)
    for edge, name, value in LABELS[::-1]:
        label, adjust = F.when(s >= edge, name).otherwise(label), F.when(s >= edge, value).otherwise(adjust)
    for edge, name, value in LOWER_LABELS[::-1]:
        label, adjust = F.when(s <= edge, name).otherwise(label), F.when(s <= edge, value).otherwise(adjust)
    return x.select("*", label.alias("label"), adjust.alias("adjustment"), F.when(n >= 3, "high").when(n == 2, "medium").otherwise("low").alias("reliability"))


def interpretation(score: Column | str) -> Column:
    s = c(score)
    return F.when(s.isNull(), "unavailable").when(s >= ENTER_ON_ASK, "active_entry_supported").when(s >= 58, "patient_entry_preferred").when(s > 42, "wait_near_support").otherwise("selling_pressure_wait")


def confidence_risks(samples: Column | str, requested: int, stop_reliability: Column | str) -> Column:
    """What speaks against relying on the confidence, in order."""
    n = c(samples)
    return reasons(
        ("visible_depth_can_change_before_manual_entry", F.lit(True)), ("reference_prices_are_not_guaranteed_fills", F.lit(True)), ("partial_sample_coverage", n < requested),
        ("no_valid_dom_sample", n == 0), ("stop_uses_lowest_visible_bid", c(stop_reliability) == "low"),
    )


def reference_prices(checked: DataFrame, scored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Five prices from the walls of the latest sound snapshot and the score of its key.

    A wall is the level of the largest volume times level weight, the better price on ties.
    Active entry is the best ask from ENTER_ON_ASK on, else the best bid; patient entry the bid
    wall; the target one level before the ask wall; the stop one level below the bid wall, or
    the lowest bid, which is of low reliability.
    """
    last = checked.where("problem IS NULL").groupBy(*keys).agg(F.max_by(F.struct("bids", "asks"), order).alias("_s"))
    x = last.select(*keys, F.col("_s.bids").alias("_b"), F.col("_s.asks").alias("_a")).join(scored.select(*keys, "score"), keys)
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    heavy = lambda a: F.zip_with(a, F.slice(weights, F.lit(1), F.size(a)), lambda v, w: v["volume"] * w)
    wall = lambda a: F.array_position(heavy(a), F.array_max(heavy(a))).cast("int")
    x = x.withColumn("_bw", wall(F.col("_b"))).withColumn("_aw", wall(F.col("_a")))
    price = lambda a, at: F.element_at(a, at)["price"]
    lower = F.col("_bw") < F.size("_b")
    return x.select(
        *keys, "score",
        F.when(F.col("score") >= ENTER_ON_ASK, price("_a", F.lit(1))).otherwise(price("_b", F.lit(1))).alias("active_entry"),
        price("_b", F.col("_bw")).alias("patient_entry"),
        price("_a", F.greatest(F.lit(1), F.col("_aw") - 1)).alias("take_profit"),
        price("_b", F.least(F.col("_bw") + 1, F.size("_b"))).alias("stop_loss"),
        F.when(lower, "normal").otherwise("low").alias("stop_reliability"),
    )


def guidance(candidates: DataFrame, priced: DataFrame, key: str, at: str, fresh_s: float) -> DataFrame:
    """Candidates with the reference prices of the latest snapshot at or before them, and the first reason against attaching it.

    priced: key, snapshot_ts, best_bid, best_ask and the columns of reference_prices.
    """
    from tidemark.operators.micro import asof_backward, seconds_between

    prices = ["best_bid", "best_ask", "active_entry", "patient_entry", "take_profit", "stop_loss"]
    x = asof_backward(candidates, priced, [key], at, "snapshot_ts", prices)
    ordered = (F.col("stop_loss") <= F.col("patient_entry")) & (F.col("patient_entry") <= F.col("active_entry")) & (F.col("active_entry") <= F.col("take_profit"))
    why = first_reason(
        ("missing_snapshot", F.col("matched_ts").isNull()), ("stale_snapshot", seconds_between(at, "matched_ts") > fresh_s),
        ("invalid_spread", F.coalesce(F.col("best_ask") <= F.col("best_bid"), F.lit(True))), ("price_order", ~F.coalesce(ordered, F.lit(False))),
    )
    return x.withColumn("problem", why)


def currency_view(change: Column | str) -> Column:
    """A currency that rises by 0.1 or more speaks for shares, one that falls as much against them."""
    x = c(change)
    return F.when(x.isNull(), "missing").when(x <= -0.1, "bullish").when(x >= 0.1, "bearish").otherwise("neutral")


def basis_view(basis: Column | str, month: Column | str) -> Column:
    """Futures over or under the spot by more than 100; in the dividend months down to -300 says nothing."""
    b = c(basis)
    season = c(month).isin(6, 7, 8) & (b >= -300)
    return F.when(b.isNull(), "missing").when(b > 100, "bullish").when((b < -100) & ~season, "bearish").otherwise("neutral")


def relative_strength(moves: Column | str, basis: Column | str) -> Column:
    """Against a map of the moves abroad in percent: weaker where those rise and the basis doesn't, resilient where they fall."""
    values = F.filter(F.map_values(c(moves)), lambda v: v.isNotNull())
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)
    return (
        F.when((F.coalesce(F.size(values), F.lit(0)) <= 0) | (c(basis) == "missing"), "missing")
        .when((F.array_max(values) >= 1) & (c(basis) != "bullish"), "taiwan_weaker_than_us")
        .when((mean <= -1) & (c(basis) != "bearish"), "taiwan_resilient")
        .otherwise("aligned")
    )


def moves_of(text: Column | str) -> Column:
    """"a=1.2, b=-3" as a map of names to numbers; parts without a name are left out."""
    parts = F.filter(F.transform(F.split(c(text), ","), lambda p: F.transform(F.split(p, "=", 2), lambda y: F.trim(y))), lambda kv: F.get(kv, F.lit(0)) != "")
    return F.map_from_entries(F.transform(parts, lambda kv: F.struct(F.get(kv, F.lit(0)).alias("key"), number_of(F.get(kv, F.lit(1))).alias("value"))))


def preopen_environment(fx: Column | str, basis: Column | str, relative: Column | str, pulled_up: Column | str, excluded: Column | str, complete: Column | str) -> Column:
    """The combined view: insufficient unless complete; two like judgements lead; contradictions conflict."""
    fx, basis = c(fx), c(basis)
    both = lambda v: (fx == v) & (basis == v)
    against = (c(relative) == "taiwan_weaker_than_us") | c(pulled_up) | c(excluded)
    mixed = fx.isin("bullish", "bearish") & basis.isin("bullish", "bearish") & (fx != basis)
    return F.when(~c(complete), "insufficient").when(mixed | against, "conflict").when(both("bearish"), "bearish").when(both("bullish"), "bullish").otherwise("neutral")


def branch_pattern(rows: DataFrame, keys: list[str], order: list[str], net: str = "net") -> DataFrame:
    """The last five days of each branch: rising buying to observe, a turn or selling to exclude."""
    w = W.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    five = rows.withColumn("_r", F.row_number().over(w)).where("_r <= 5").withColumn("_before", F.lead(net).over(w))
    n, r = F.col(net), F.col("_r")
    x = five.groupBy(*keys).agg(
        F.count("*").alias("days"), F.sum(net).alias("total"), F.every(n > 0).alias("buying"), F.every(n < 0).alias("selling"), F.every(F.coalesce(n > F.col("_before"), F.lit(True)) | (r == 5)).alias("increasing"),
        (F.coalesce(F.bool_or((r <= 2) & (n < 0)), F.lit(False)) & F.coalesce(F.bool_or((r >= 3) & (n > 0)), F.lit(False))).alias("turned"), F.min_by(n, r).alias("latest"),
    )
    action = F.when(F.col("days") < 5, "insufficient").when(F.col("buying") & F.col("increasing") & ~F.col("turned"), "observe").when(F.col("turned") | F.col("selling") | (F.col("latest") < 0), "exclude").otherwise("insufficient")
    return x.withColumn("action", action)


def auction_state(before: Column | str, last: Column | str, open_: Column | str, big_pct: float = 1.0) -> Column:
    """The last minute's move of the opening auction, and whether the open held a fall."""
    known = c(before).isNotNull() & c(last).isNotNull() & c(open_).isNotNull()
    move = F.when(c(before) != 0, (c(last) - c(before)) / c(before) * 100)
    fall = F.when(c(open_) >= c(last), "last_minute_press_down_held").otherwise("last_minute_press_down_failed")
    return F.when(~known, "insufficient").when(move >= big_pct, "last_minute_pull_up").when(move <= -big_pct, fall).otherwise("stable")


# How numbers and dates are written.
NUMBERS = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
DATES = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"


def numbers_in(texts: DataFrame, id_col: str, text_col: str, least: float = 1000.0) -> DataFrame:
    """(id, value): the distinct numbers of a text from `least` on, dates and years aside."""
    plain = F.regexp_replace(text_col, DATES, " ")
    found = F.explode(F.regexp_extract_all(plain, F.lit(NUMBERS), F.lit(0)))
    x = texts.select(id_col, found.alias("_raw")).select(id_col, F.regexp_replace("_raw", ",", "").try_cast("double").alias("value"))
    year = (F.col("value") == F.floor("value")) & F.col("value").between(1900, 2100)
    return x.where((F.col("value") >= least) & ~year).distinct()


def untraceable(numbers: DataFrame, facts: DataFrame, id_col: str, tolerance: float = 0.005) -> DataFrame:
    """Numbers that no fact of their id is within tolerance of. Joined by id and a logarithmic cell, with its neighbours."""
    width = 2 * tolerance
    cell = lambda v: F.floor(F.log(v) / width)
    near = facts.where("fact > 0").select(F.col(id_col).alias("_id"), "fact", F.explode(F.array(cell(F.col("fact")) - 1, cell(F.col("fact")), cell(F.col("fact")) + 1)).alias("_cell"))
    on = (F.col(id_col) == F.col("_id")) & (cell(F.col("value")) == F.col("_cell")) & (F.abs(F.col("value") - F.col("fact")) <= tolerance * F.abs(F.col("fact")))
    return numbers.join(near, on, "left_anti")


#: Named patterns of what a note must not hold.
FLAGS = {"position_size": r"\d+\s*%\s*(of )?(capital|position|funds)", "promise": r"(?i)\b(guaranteed|sure win|cannot lose)\b", "all_in": r"(?i)\ball[- ]?in\b", "secret": r"(?i)(api[_-]?key|password|token)\s*[:=]\s*\S+", "identifier": r"\b[A-Z][12]\d{8}\b", "address": r"[\w.+-]+@[\w-]+\.[\w.]+"}


def flags(text_col: str, patterns: dict[str, str] | None = None) -> Column:
    """Names of the patterns a text matches, in order."""
    return F.filter(F.array(*[F.when(F.col(text_col).rlike(p), F.lit(n)) for n, p in (patterns or FLAGS).items()]), lambda x: x.isNotNull())


def memory_tier(age_days: Column | str, place: Column | str, hot_cap: int = 50) -> Column:
    """Age tiers; beyond the cap, young notes are warm."""
    return F.when((c(age_days) <= 7) & (c(place) <= hot_cap), "hot").when(c(age_days) <= 30, "warm").otherwise("archive")


def page_links(pages: DataFrame, pattern: str = r'<a href="(/[^"]*)">([^<]*)</a>') -> DataFrame:
    """(page_id, href, label): distinct links of each page."""
    href, label = F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), F.regexp_extract_all("html", F.lit(pattern), F.lit(2))
    return pages.select("page_id", F.explode(F.arrays_zip(href.alias("href"), label.alias("label"))).alias("_l")).select("page_id", "_l.href", "_l.label").distinct()


def page_text(html: str = "html") -> tuple[Column, Column]:
    """Title and text without tags, scripts and styles, white space collapsed."""
    title = F.regexp_extract(html, r"<title>([^<]*)</title>", 1)
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>", " ")
    return F.trim(title), F.trim(F.regexp_replace(bare, r"\s+", " "))
