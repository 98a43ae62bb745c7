"""Band, pivot and level signals over bars, their outcomes, and rules that depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import c
from tidemark.operators.scans import queue_pairs, unblocked


def bands(bars: DataFrame, keys: list[str], order: str, n: int = 20, width: float = 2.0) -> DataFrame:
    """mid, upper and lower: average and population deviations of the last n closes; null before."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    full = lambda x: F.when(F.count("close").over(w) == n, x)
    mid, dev = F.avg("close").over(w), F.stddev_pop("close").over(w)
    return bars.select("*", full(mid).alias("mid"), full(mid + width * dev).alias("upper"), full(mid - width * dev).alias("lower"))


def pivots(bars: DataFrame, keys: list[str], order: str, left: int, right: int) -> DataFrame:
    """pivot_high and pivot_low, confirmed `right` bars late, and resistance and support carried from them.

    A pivot is strictly beyond all `left` bars before and `right` bars after it.
    """
    w = W.partitionBy(*keys).orderBy(order)
    around = lambda f, x: (f(x).over(w.rowsBetween(-left, -1)), f(x).over(w.rowsBetween(1, right)))
    whole = F.count("*").over(w.rowsBetween(-left, right)) == left + right + 1
    (hb, ha), (lb, la) = around(F.max, "high"), around(F.min, "low")
    x = bars.withColumn("_ph", F.when(whole & (F.col("high") > hb) & (F.col("high") > ha), F.col("high"))).withColumn("_pl", F.when(whole & (F.col("low") < lb) & (F.col("low") < la), F.col("low")))
    x = x.withColumn("pivot_high", F.lag("_ph", right).over(w)).withColumn("pivot_low", F.lag("_pl", right).over(w)).drop("_ph", "_pl")
    past = w.rowsBetween(W.unboundedPreceding, 0)
    return x.withColumn("resistance", F.last("pivot_high", ignorenulls=True).over(past)).withColumn("support", F.last("pivot_low", ignorenulls=True).over(past))


def level_signals(bars: DataFrame, keys: list[str], order: str, zone_pct: float, volume_n: int, volume_ratio: float, strong: Column | None = None) -> DataFrame:
    """Rows (bar, signal, direction, level) of the four level signals; levels are those of the bar before.

    strong: whether a bar's volume is strong; by default, more than the ratio times the average of the last bars.
    """
    w = W.partitionBy(*keys).orderBy(order)
    x = bars.withColumn("_res", F.lag("resistance").over(w)).withColumn("_sup", F.lag("support").over(w)).withColumn("_close", F.lag("close").over(w))
    x = x.withColumn("_strong", F.col("volume") > volume_ratio * F.avg("volume").over(w.rowsBetween(-(volume_n - 1), 0)) if strong is None else strong)
    z = zone_pct / 100
    o, h, lo, cl, res, sup = (F.col(n) for n in ("open", "high", "low", "close", "_res", "_sup"))
    found = {
        ("breakout", 1, "_res"): (cl > res) & (F.col("_close") <= res) & F.col("_strong") & (cl > F.col("mid")),
        ("breakdown", -1, "_sup"): (cl < sup) & (F.col("_close") >= sup) & F.col("_strong") & (cl < F.col("mid")),
        ("bounce", 1, "_sup"): (lo <= sup * (1 + z)) & (h >= sup * (1 - z)) & (lo <= F.col("lower")) & (cl >= sup) & (cl > o),
        ("rejection", -1, "_res"): (h >= res * (1 - z)) & (lo <= res * (1 + z)) & (h >= F.col("upper")) & (cl <= res) & (cl < o),
    }
    each = [F.when(F.col("mid").isNotNull() & cond, F.struct(F.lit(n).alias("signal"), F.lit(d).alias("direction"), F.col(lv).alias("level"))) for (n, d, lv), cond in found.items()]
    x = x.withColumn("_s", F.explode(F.filter(F.array(*each), lambda s: s.isNotNull())))
    return x.select(*keys, order, "close", "_s.signal", "_s.direction", "_s.level")


# By minutes of a bar, the bars on either side of a pivot, the zone in percent, and the bars and ratio of strong volume.
PRESETS = {60: (3, 0.30, 10, 1.5), 15: (4, 0.20, 20, 1.6), 5: (5, 0.10, 20, 1.8)}


def with_presets(bars: DataFrame, keys: list[str], order: str, width: str = "width", presets: dict[int, tuple[int, float, int, float]] | None = None) -> DataFrame:
    """Bars of a width that has a preset, with pivot_bars, zone_pct, volume_n, volume_ratio, volume_avg and strong.

    volume_avg is of the last volume_n bars, this one included, and null until they are there; strong is false then.
    """
    found, w = presets or PRESETS, W.partitionBy(*keys, width).orderBy(order)
    table = F.create_map(*[v for k, p in found.items() for v in (F.lit(k), F.struct(F.lit(p[0]).alias("pivot_bars"), F.lit(float(p[1])).alias("zone_pct"), F.lit(p[2]).alias("volume_n"), F.lit(float(p[3])).alias("volume_ratio")))])
    x = bars.where(F.col(width).isin(*found)).withColumn("_p", table[F.col(width)]).select(*bars.columns, "_p.*")
    average = F.lit(None).cast("double")
    for n in sorted({p[2] for p in found.values()}):
        frame = w.rowsBetween(-(n - 1), 0)
        average = F.when((F.col("volume_n") == n) & (F.count("volume").over(frame) == n), F.avg("volume").over(frame)).otherwise(average)
    x = x.withColumn("volume_avg", average)
    return x.withColumn("strong", F.coalesce((F.col("volume_avg") > 0) & (F.col("volume") >= F.col("volume_ratio") * F.col("volume_avg")), F.lit(False)))


def preset_signals(bars: DataFrame, keys: list[str], order: str, width: str = "width", presets: dict[int, tuple[int, float, int, float]] | None = None) -> DataFrame:
    """Level signals of each width under its preset; bars without a price are left out."""
    found, out = presets or PRESETS, None
    priced = bars.where("open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL")
    for minutes, (side, zone, n, ratio) in found.items():
        x = with_presets(priced.where(F.col(width) == minutes), keys, order, width, {minutes: (side, zone, n, ratio)})
        x = pivots(bands(x, [*keys, width], order), [*keys, width], order, side, side)
        x = level_signals(x, [*keys, width], order, zone, n, ratio, F.col("strong"))
        out = x if out is None else out.unionByName(x)
    return out


def outcomes(signals: DataFrame, bars: DataFrame, keys: list[str], order: str, horizons: list[int], cost: float) -> DataFrame:
    """Each signal with its net move over each horizon in bars, clipped at the key's last bar."""
    w = W.partitionBy(*keys).orderBy(order)
    future = w.rowsBetween(0, W.unboundedFollowing)
    moves = bars.select(*keys, order, *[F.coalesce(F.lead("close", h).over(w), F.last("close").over(future)).alias(f"_c{h}") for h in horizons])
    x = signals.join(moves, [*keys, order])
    x = x.withColumn("_h", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_c{h}").alias("exit")) for h in horizons])))
    return x.select(*signals.columns, "_h.horizon", (F.col("direction") * (F.col("_h.exit") - F.col("close")) - cost).alias("net"))


def signal_cells(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("n"), (F.count_if(F.col("net") > 0) / F.count("*")).alias("win_rate"), F.avg("net").alias("mean"), F.percentile("net", F.lit(0.5)).alias("median"))


def structure_state(bars: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Up, down or range from the last two pivots of either side."""
    past = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    x = bars
    for p in ("pivot_high", "pivot_low"):
        known = bars.where(F.col(p).isNotNull()).select(*keys, order, (F.col(p) - F.lag(p).over(W.partitionBy(*keys).orderBy(order))).alias(f"_d{p}"))
        x = x.join(known, [*keys, order], "left").withColumn(f"_d{p}", F.last(f"_d{p}", ignorenulls=True).over(past))
    h, lo = F.col("_dpivot_high"), F.col("_dpivot_low")
    return x.withColumn("structure", F.when((h > 0) & (lo > 0), "up").when((h < 0) & (lo < 0), "down").otherwise("range")).drop("_dpivot_high", "_dpivot_low")


def one_position(signals: DataFrame, keys: list[str], order: str, hold: int | str | Column) -> DataFrame:
    """Signals taken when only one position per key is held: those while it is blocked are skipped.

    order is a number (bar or second), hold its span. Of signals of one order one is taken.
    """
    span = F.lit(hold) if isinstance(hold, int) else c(hold)
    return unblocked(signals.withColumn("_until", F.col(order) + span), keys, order, "_until").select(*signals.columns)


def strategy_trades(
    bars: DataFrame, signals: DataFrame, keys: list[str], hold: int, stop_atr: float | None = None, target_atr: float | None = None
) -> DataFrame:
    """Trades of one position a key: entered the bar after the signal, left after `hold` bars, at a cutoff, at a stop or a target.

    bars: keys, bar (1, 2, ... in order), open, high, low, close, atr, cutoff (the session is about to end).
    signals: keys, bar, direction (1 or -1), one a bar. A signal counts while nothing is held at its bar's
    close. Entry at the next open. At the close of each bar since, a hold of `hold` bars or a cutoff sends
    the position out at the next open; stop and target stand those multiples of that bar's atr from the
    entry, for the bar after: at its open if it lies beyond, else at their price, first the one on the side
    of the bar's extreme nearer to its open. A trade without an exit in the bars is open: nulls, and nothing
    is taken after it. Returns keys, bar (of the signal), direction, entry_bar, entry, exit_bar, exit, reason, points.
    """
    ends = F.min(F.when(F.col("cutoff"), F.col("bar"))).over(W.partitionBy(*keys).orderBy(F.col("bar").desc()).rowsBetween(W.unboundedPreceding, 0))
    b = bars.select(*keys, "bar", "open", "high", "low", "atr", ends.alias("_cut"))
    entries = b.select(*keys, (F.col("bar") - 1).alias("bar"), F.col("bar").alias("entry_bar"), F.col("open").alias("entry"), "_cut")
    x = signals.select(*keys, "bar", "direction").join(entries, [*keys, "bar"])
    x = x.withColumn("_last", F.least(F.col("entry_bar") + hold, F.col("_cut")) + 1).withColumn("_why", F.when(F.col("_last") == F.col("entry_bar") + hold + 1, "hold").otherwise("session"))
    at = [*keys, "bar"]
    out = b.select(*keys, F.col("bar").alias("_last"), F.col("open").alias("_out"))
    x = x.join(out, [*keys, "_last"], "left")
    if stop_atr is not None or target_atr is not None:
        # bars after the entry bar and before the timed exit, with the range at the close before each
        past = b.select(*keys, F.col("bar").alias("_k"), F.col("open").alias("_o"), F.col("high").alias("_h"), F.col("low").alias("_l"), F.lag("atr").over(W.partitionBy(*keys).orderBy("bar")).alias("_atr"))
        y = x.withColumn("_k", F.explode(F.expr(f"filter(sequence(1, {hold + 1}), k -> entry_bar + k < _last)"))).withColumn("_k", F.col("entry_bar") + F.col("_k")).join(past, [*keys, "_k"])
        side = F.col("direction")
        level = lambda k, sign: F.lit(None).cast("double") if k is None else F.col("entry") + F.lit(sign * k) * side * F.col("_atr")
        y = y.withColumn("_stop", level(stop_atr, -1)).withColumn("_target", level(target_atr, 1))
        reached = lambda a, b: F.coalesce(a * side >= b * side, F.lit(False))
        far, near = F.when(side > 0, F.col("_h")).otherwise(F.col("_l")), F.when(side > 0, F.col("_l")).otherwise(F.col("_h"))
        stopped, won = reached(F.col("_stop"), near), reached(far, F.col("_target"))
        gap_stop, gap_won = reached(F.col("_stop"), F.col("_o")), reached(F.col("_o"), F.col("_target"))
        far_first = F.abs(far - F.col("_o")) < F.abs(F.col("_o") - near)
        hit = (
            F.when(gap_stop, F.struct(F.lit("stop").alias("why"), F.col("_o").alias("price")))
            .when(gap_won, F.struct(F.lit("target").alias("why"), F.col("_o").alias("price")))
            .when(won & (far_first | ~stopped), F.struct(F.lit("target").alias("why"), F.col("_target").alias("price")))
            .when(stopped, F.struct(F.lit("stop").alias("why"), F.col("_stop").alias("price")))
        )
        first = y.withColumn("_hit", hit).where(F.col("_hit").isNotNull()).groupBy(*at).agg(F.min(F.struct("_k", "_hit")).alias("_f"))
        x = x.join(first.select(*[F.col(n).alias(n) for n in at], F.col("_f._k").alias("_k"), "_f._hit"), at, "left")
        x = x.withColumn("_last", F.coalesce("_k", "_last")).withColumn("_out", F.coalesce("_hit.price", "_out")).withColumn("_why", F.coalesce("_hit.why", "_why"))
    done = F.col("_out").isNotNull()
    trades = x.select(
        *at, "direction", "entry_bar", "entry", F.when(done, F.col("_last")).alias("exit_bar"), F.when(done, F.col("_out")).alias("exit"),
        F.when(done, F.col("_why")).alias("reason"), (F.col("direction") * (F.col("_out") - F.col("entry"))).alias("points"),
    )
    return unblocked(trades, keys, "bar", "exit_bar")


def pair_leads(early: DataFrame, originals: DataFrame, keys: list[str], order: str, level: str) -> DataFrame:
    """Each early event with the lead to the first unused original of its key and level at or after it; null if none.

    Levels are equal when they agree to a millionth.
    """
    near = lambda d: d.select(*keys, order, level, F.round(F.col(level) * 1_000_000).cast("long").alias("_level"))
    x = queue_pairs(near(early), near(originals), [*keys, "_level"], order)
    return x.select(*keys, order, level, (F.col("matched") - F.col(order)).cast("double").alias("lead"))


def with_pullbacks(df: DataFrame, closes: str, least_pct: float = 0.5) -> DataFrame:
    """df with, of an array of closes in order, the counter legs in percent of the dominant leg before them: pullbacks and pullback_pct.

    Legs turn where the close moves least_pct from the extreme. The dominant way is that from the
    first close to the last. pullback_pct is the median of the last three; null with under three
    closes or no leg, 0 without a counter leg.
    """
    first = F.element_at(closes, 1)
    state = lambda way, top, pivots: F.struct(way.alias("way"), top.alias("top"), pivots.alias("pivots"))
    start = state(F.lit(0), first, F.array(first))

    def step(s: Column, x: Column) -> Column:
        far = F.abs(x - s["top"]) / s["top"] * 100 >= least_pct
        way = F.when(x > s["top"], F.lit(1)).otherwise(F.lit(-1))
        begun = F.when(far, state(way, x, s["pivots"])).otherwise(s)
        turned = state(-s["way"], x, F.concat(s["pivots"], F.array(s["top"])))
        goes_on = ((s["way"] > 0) & (x > s["top"])) | ((s["way"] < 0) & (x < s["top"]))
        return F.when(s["way"] == 0, begun).when(goes_on, state(s["way"], x, s["pivots"])).when(far, turned).otherwise(s)

    x = df.withColumn("_z", F.aggregate(F.slice(closes, F.lit(2), F.greatest(F.size(closes), F.lit(1))), start, step)).withColumn("_p", F.concat("_z.pivots", F.array(F.col("_z.top"))))
    moves = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda i: F.element_at("_p", i + 1) - F.element_at("_p", i))
    x = x.withColumn("_legs", F.filter(moves, lambda v: v != 0)).withColumn("_up", F.element_at(closes, -1) >= F.element_at(closes, 1))
    against = lambda v: F.when(F.col("_up"), v < 0).otherwise(v > 0)
    places = F.when(F.size("_legs") > 1, F.sequence(F.lit(2), F.size("_legs"))).otherwise(F.array().cast("array<int>"))
    at = F.filter(places, lambda i: against(F.element_at("_legs", i)) & ~against(F.element_at("_legs", i - 1)))
    x = x.withColumn("_d", F.transform(at, lambda i: F.abs(F.element_at("_legs", i)) / F.abs(F.element_at("_legs", i - 1)) * 100))
    last = F.array_sort(F.slice("_d", F.greatest(F.size("_d") - 2, F.lit(1)), F.lit(3)))
    depth = F.when(F.size("_d") > 0, F.element_at(last, (F.floor(F.size(last) / 2) + 1).cast("int"))).otherwise(F.lit(0.0))
    known = (F.size(closes) >= 3) & (F.size("_legs") >= 1)
    return x.select(*df.columns, F.size("_d").alias("pullbacks"), F.when(known, depth).alias("pullback_pct"))


def swing_depth(bars: DataFrame, keys: list[str], order: str, n: int = 20, least_pct: float = 0.5) -> DataFrame:
    """The pullbacks of the last n closes of each key."""
    w = W.partitionBy(*keys).orderBy(F.col(order).desc())
    rows = bars.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "close"))), lambda r: r["close"]).alias("closes"))
    return with_pullbacks(rows, "closes", least_pct).drop("closes")


def multiset_agreement(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """How many rows two lists share, counting repeats, and what only one has."""
    a, b = left.groupBy(*by).agg(F.count("*").alias("_l")), right.groupBy(*by).agg(F.count("*").alias("_r"))
    x = a.join(b, by, "full_outer").select(F.coalesce("_l", F.lit(0)).alias("l"), F.coalesce("_r", F.lit(0)).alias("r"))
    m = F.sum(F.least("l", "r"))
    return x.agg(m.alias("matched"), (F.sum("l") - m).alias("left_only"), (F.sum("r") - m).alias("right_only"), (m / F.sum("l") * 100).alias("left_pct"))


def first_divergence(left: DataFrame, right: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Per key the first place where two sequences differ, null-safe; none if they agree."""
    number = lambda d, p: d.select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy(order)).alias("place"), F.struct(*columns).alias(p))
    x = number(left, "l").join(number(right, "r"), [*keys, "place"], "full_outer")
    return x.where(~F.col("l").eqNullSafe(F.col("r"))).groupBy(*keys).agg(F.min("place").alias("first_place"))


def drawdown_rule(bars: DataFrame, keys: list[str], order: str, n: int = 252, steps: tuple[float, ...] = (20.0, 25.0, 30.0), reset: float = 5.0, stop: float = 15.0) -> DataFrame:
    """Tranches bought the bar after the close first stands each of `steps` percent below its n-bar high; per key the trades.

    All tranches leave together where the close falls `stop` percent from the highest close since
    the first one. Within `reset` percent of the high the event ends; only then may it begin again.
    A series is walked in a fold, as each step depends on the one before; it is one key's bars.
    """
    w = W.partitionBy(*keys).orderBy(order)
    x = bars.withColumn("_hi", F.max("close").over(w.rowsBetween(-(n - 1), 0)))
    rows = x.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "close", "_hi"))).alias("_rows"))
    names = ("level", "waiting", "units", "cost", "top", "rets")
    state = lambda *v: F.struct(*[c(x).alias(k) for k, x in zip(names, v, strict=True)])
    start = state(F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0), F.array().cast("array<double>"))

    def step(s: Column, r: Column) -> Column:
        close, high = r["close"], r["_hi"]
        units, cost = s["units"] + s["waiting"], s["cost"] + s["waiting"] * close
        top = F.when(s["units"] > 0, F.greatest(s["top"], close)).otherwise(close)
        out = (units > 0) & (close <= top * (1 - stop / 100))
        reached = F.lit(0)
        for edge in steps:
            reached = reached + (close <= high * (1 - edge / 100)).cast("int")
        level = F.when(out, len(steps)).otherwise(F.greatest(s["level"], reached))
        waiting = F.when(out, 0).otherwise(F.greatest(F.lit(0), reached - s["level"]))
        level = F.when(close >= high * (1 - reset / 100), 0).otherwise(level)
        left = F.concat(s["rets"], F.array(units * close / cost - 1))
        return F.when(out, state(level, waiting, F.lit(0), F.lit(0.0), F.lit(0.0), left)).otherwise(state(level, waiting, units, cost, top, s["rets"]))

    out = rows.select(*keys, F.aggregate("_rows", start, step).alias("_s"))
    return out.select(*keys, F.size("_s.rets").alias("trades"), F.size(F.filter("_s.rets", lambda v: v > 0)).alias("wins"), F.aggregate("_s.rets", F.lit(0.0), lambda a, v: a + v).alias("sum_return"), F.col("_s.units").alias("open_units"))


def exit_reason(open_return: Column | str, hold_days: Column | str, close: Column | str, high: Column | str, previous_close: Column | str, top_close: Column | str, breakout_high: Column | str, stop: float = -0.055, target: float = 0.13, fall: float = 0.035) -> Column:
    """Why a position leaves: the buy day is day 1; from day 3 stop, target, day 7, or no continuation; null holds on.

    A continuation closes no lower than before or reaches the reference high, stays within
    `fall` of the highest close, and is in profit.
    """
    day, r = c(hold_days) + 1, c(open_return)
    reference = F.coalesce(c(breakout_high), c(top_close))
    goes_on = (F.coalesce(c(close) >= c(previous_close), F.lit(False)) | F.coalesce(c(high) >= reference, F.lit(False))) & F.coalesce(c(close) >= c(top_close) * (1 - fall), F.lit(False)) & (r > 0)
    return F.when(day < 3, None).when(r <= stop, "stop").when(r >= target, "target").when(day >= 7, "time").when(~goes_on, "no_continuation")
