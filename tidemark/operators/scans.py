"""Computations along an order, in many tasks a key: dominance joins, recurrences, blocking rules, queues.

A key's rows are sorted by units of the order, so no key meets in one task; what holds before a unit
comes from a table of one row a key and unit. Keys are not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import c
from tidemark.sources.storage import forget, kept


def best_so_far(rows: DataFrame, parts: list[str], at: str, last: str, value: str, unit: int, tasks: int | None = None) -> DataFrame:
    """rows with _best: the greatest `value` (not null) of their parts up to their place, by (at, last). at is a whole number.

    tasks: how many share the rows; Spark decides if it is not given.
    """
    rows = rows.withColumn("_unit", F.floor(F.col(at) / F.lit(unit)))
    rows = rows.repartition(tasks, *parts, "_unit") if tasks else rows
    inside = F.max(value).over(W.partitionBy(*parts, "_unit").orderBy(at, last).rowsBetween(W.unboundedPreceding, 0))
    ends = rows.groupBy(*parts, "_unit").agg(F.max(value).alias("_end"))
    before = F.max("_end").over(W.partitionBy(*parts).orderBy("_unit").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*[F.col(n).alias(n) for n in (*parts, "_unit")], before.alias("_before"))
    best = F.when(F.col("_inside").isNull() | (F.col("_before") > F.col("_inside")), F.col("_before")).otherwise(F.col("_inside"))
    return rows.withColumn("_inside", inside).join(ends, [*parts, "_unit"]).withColumn("_best", best).drop("_unit", "_inside", "_before")


#: Raises unit numbers above zero, whose bits then order them.
_LIFT = 1 << 40

#: Rows of one task of a dominance join, about, before they are copied for each bit; a unit of a key stays in one task.
TASK_ROWS = 50_000


def dominance_join(left: DataFrame, right: DataFrame, keys: list[str], row: list[str], first: str, second: str, values: list[str], first_unit: int, second_unit: int) -> DataFrame:
    """Each left row with the right row of the greatest `first` among those of its keys with both `first` and `second` not above its own.

    Of equal `first` the greatest `values`. first and second are whole numbers; `row` tells the left rows
    apart. Gives keys, row, values (null if there is none). Offline divide and conquer, in three steps:

    1. within a unit of `first`, where the places of all rows are numbered: two places differ first at one
       bit, so a right row with 0 there is offered, in order of `second`, to left rows with 1 (a copy a bit);
    2. for left rows without one, the latest unit before whose least `second` is not above: the same by the
       bits of unit numbers, over one row a unit;
    3. in the unit found every `first` is below: the best by `second` alone.

    Copies are made and sorted in the task that reads the rows, so rows are counted first and dealt to as
    many tasks as that takes: what a task holds does not grow with the tables, unless a unit does.
    """
    given = F.struct(F.col(first).alias("_first"), *values)
    kind = right.select(given.alias("v")).schema[0].dataType
    of_right = [F.lit(None).cast(left.schema[n].dataType).alias(n) for n in row]
    clocks = [F.col(first).cast("long").alias("_e"), F.col(second).cast("long").alias("_r")]
    asked = left.select(*keys, *row, *clocks, F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_v")).withColumn("_u", F.floor(F.col("_e") / F.lit(first_unit)) + _LIFT)
    offered = right.select(*keys, *of_right, *clocks, F.lit(0).alias("_kind"), given.alias("_v")).withColumn("_u", F.floor(F.col("_e") / F.lit(first_unit)) + _LIFT)
    mine = [*keys, *row, "_e", "_r", "_u"]

    in_unit = W.partitionBy(*keys, "_u")
    x = asked.unionByName(offered)
    tasks = max(x.sparkSession.sparkContext.defaultParallelism, -(-x.count() // TASK_ROWS))
    x = x.repartition(tasks, *keys, "_u").withColumn("_p", F.dense_rank().over(in_unit.orderBy("_e")) * 2 + F.col("_kind"))
    x = x.withColumn("_top", F.max("_p").over(in_unit)).withColumn("_l", F.explode(F.expr("filter(sequence(0, 30), l -> (shiftright(_p, l) & 1) = _kind AND shiftleft(1, l) <= _top)")))
    x = x.withColumn("_b", F.expr("shiftright(_p, _l + 1)"))
    x = x.withColumn("_best", F.max("_v").over(W.partitionBy(*keys, "_u", "_l", "_b").orderBy("_r", "_kind").rowsBetween(W.unboundedPreceding, 0)))
    # three branches below read it, and each would make the copies anew
    near = kept(x.where("_kind = 1").groupBy(*mine).agg(F.max("_best").alias("_best")), "near")

    bit = lambda want: F.explode(F.expr(f"filter(sequence(0, 41), l -> (shiftright(_u, l) & 1L) = {want})"))
    rest = near.where(F.col("_best").isNull()).drop("_best").withColumn("_kind", F.lit(1))
    units = offered.groupBy(*keys, "_u").agg(F.min("_r").alias("_r")).select(*keys, *of_right, F.lit(None).cast("long").alias("_e"), "_r", "_u", F.lit(0).alias("_kind"))
    y = rest.withColumn("_l", bit(1)).withColumn("_v", F.lit(None).cast("long")).unionByName(units.withColumn("_l", bit(0)).withColumn("_v", F.col("_u")))
    y = best_so_far(y.withColumn("_b", F.expr("shiftright(_u, _l + 1)")), [*keys, "_l", "_b"], "_r", "_kind", "_v", second_unit, tasks)
    found = y.where("_kind = 1").groupBy(*keys, *row, "_e", "_r").agg(F.max("_best").alias("_u")).where(F.col("_u").isNotNull())

    z = found.withColumn("_kind", F.lit(1)).withColumn("_v", F.lit(None).cast(kind)).unionByName(offered.select(*keys, *row, "_e", "_r", "_u", "_kind", "_v"))
    far = best_so_far(z, [*keys, "_u"], "_r", "_kind", "_v", second_unit, tasks).where("_kind = 1").select(*[F.col(n).alias(n) for n in (*keys, *row)], F.col("_best").alias("_far"))
    on = [near[n].eqNullSafe(far[n]) for n in (*keys, *row)]
    both = near.join(far, on, "left").select(*[near[n] for n in (*keys, *row)], F.coalesce("_best", "_far").alias("_v"))
    return both.select(*keys, *row, *[F.col(f"_v.{n}").alias(n if n not in row and n not in keys else f"right_{n}") for n in values])


def affine_scan(df: DataFrame, keys: list[str], order: str, maps: dict[str, tuple[Column, Column, Column | float]], unit: Column | None = None, block: int = 256, counted: DataFrame | None = None) -> DataFrame:
    """df with y = a x + b along the order of each key, x the y of the row before: for each name its (a, b, x before the first row).

    Each row is such a map, and maps compose: within blocks of rows by doubling distances, then over the
    blocks, then every row's map takes what its block begins with. unit: what rises with the order and
    bounds a task's rows (a month, a session); without it a key's rows are numbered in one. Orders are
    distinct within a key; a and b are not null. Rows a unit are counted first, on `counted` if given: a
    table of the same keys and units whose plan is shorter.
    """
    names = list(maps)
    x = df.withColumn("_unit", unit if unit is not None else F.lit(0))
    x = x.withColumn("_sub", F.floor((F.row_number().over(W.partitionBy(*keys, "_unit").orderBy(order)) - 1) / block))
    for i, n in enumerate(names):
        x = x.withColumn(f"_a{i}", c(maps[n][0]).cast("double")).withColumn(f"_b{i}", c(maps[n][1]).cast("double")).withColumn(f"_x{i}", c(maps[n][2]).cast("double"))
    sizes = (df if counted is None else counted).select(*keys, (unit if unit is not None else F.lit(0)).alias("_unit")).groupBy(*keys, "_unit").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.ceil(F.col("n") / block)).alias("blocks")).agg(F.max("n"), F.max("blocks")).first()
    rounds = lambda rows: max(0, int(rows or 1) - 1).bit_length()

    def doubled(t: DataFrame, w: W, k: int) -> DataFrame:
        out = []
        for i in range(len(names)):
            a, b = F.lag(f"_a{i}", 1 << k).over(w), F.lag(f"_b{i}", 1 << k).over(w)
            out += [(F.col(f"_a{i}") * F.coalesce(a, F.lit(1.0))).alias(f"_a{i}"), (F.col(f"_a{i}") * F.coalesce(b, F.lit(0.0)) + F.col(f"_b{i}")).alias(f"_b{i}")]
        return t.select(*[n for n in t.columns if n[:2] not in ("_a", "_b")], *out)

    in_block = W.partitionBy(*keys, "_unit", "_sub").orderBy(order)
    for k in range(rounds(min(block, int(sizes[0] or 1)))):
        x = doubled(x, in_block, k)
    whole = F.struct(*[f"_{p}{i}" for i in range(len(names)) for p in "ab"])
    ends = x.groupBy(*keys, "_unit", "_sub").agg(F.max_by(whole, order).alias("_m"), F.max(order).alias("_to")).select(*keys, "_unit", "_sub", "_to", "_m.*")
    over = W.partitionBy(*keys).orderBy("_to")
    for k in range(rounds(sizes[1])):
        ends = doubled(ends, over, k)
    before = [F.lag(f"_{p}{i}").over(over).alias(f"_{p}{p}{i}") for i in range(len(names)) for p in "ab"]
    ends = ends.select(*[F.col(n).alias(n) for n in (*keys, "_unit", "_sub")], *before)
    y = x.join(ends, [*keys, "_unit", "_sub"])
    begun = lambda i: F.coalesce(F.col(f"_aa{i}") * F.col(f"_x{i}") + F.col(f"_bb{i}"), F.col(f"_x{i}"))
    return y.select(*df.columns, *[(F.col(f"_a{i}") * begun(i) + F.col(f"_b{i}")).alias(n) for i, n in enumerate(names)])


def with_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with _first: whether a row is the first of its key."""
    least = df.groupBy(*keys).agg(F.min(order).alias("_least")).select(*[F.col(n).alias(n) for n in keys], "_least")
    return df.join(least, keys).withColumn("_first", F.col(order) == F.col("_least")).drop("_least")


def exponential_averages(df: DataFrame, keys: list[str], order: str, spans: dict[str, tuple[str, int]], unit: Column | None = None, counted: DataFrame | None = None) -> DataFrame:
    """df with exponential averages that start at the first value: name -> (value, span)."""
    maps = {}
    for name, (value, span) in spans.items():
        a = 2.0 / (span + 1)
        maps[name] = (F.when(F.col("_first"), 0.0).otherwise(1 - a), F.when(F.col("_first"), F.col(value)).otherwise(F.col(value) * a), 0.0)
    return affine_scan(with_first(df, keys, order), keys, order, maps, unit, counted=df if counted is None else counted).drop("_first")


def unblocked(signals: DataFrame, keys: list[str], order: str, until: str, unit: int = 1 << 20) -> DataFrame:
    """The signals taken when one position a key is held: each blocks those before its `until`; a null until blocks for ever.

    order and until are whole numbers, until above order; of signals of one order the least of its other
    columns counts. Each signal points to the next that is free after it, by a join along the order;
    pointers are doubled (2, 4, 8 ... signals on), and from the first signal of each key the longest
    jumps are taken first, then the shorter ones, which meets every signal taken. All steps are
    equi-joins, written so that a plan never holds the steps before.
    """
    rest = [n for n in signals.columns if n not in (*keys, order)]
    if rest:
        first = signals.groupBy(*keys, order).agg(F.min(F.struct(*rest)).alias("_s"))
        signals = first.select(*keys, order, *[F.col(f"_s.{n}").alias(n) for n in rest])
    made = [signals := kept(signals, "signals")]
    node = signals.select(*keys, F.col(order).cast("long").alias("_at"), F.col(until).cast("long").alias("_until"))
    asks = node.where(F.col("_until").isNotNull()).select(*keys, "_at", (-F.col("_until")).alias("_o"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_v"))
    offers = node.select(*keys, "_at", (-F.col("_at")).alias("_o"), F.lit(0).alias("_kind"), (-F.col("_at")).alias("_v"))
    jump = best_so_far(asks.unionByName(offers), keys, "_o", "_kind", "_v", unit).where("_kind = 1 AND _best IS NOT NULL").select(*keys, "_at", (-F.col("_best")).alias("_to"))
    jumps = [kept(jump, "jumps")]
    while not jumps[-1].isEmpty():
        a, b = jumps[-1], jumps[-1].select(*keys, F.col("_at").alias("_to"), F.col("_to").alias("_on"))
        jumps.append(kept(a.join(b, [*keys, "_to"]).select(*keys, "_at", F.col("_on").alias("_to")), "jumps"))
    taken = node.groupBy(*keys).agg(F.min("_at").alias("_at"))
    for jump in reversed(jumps[:-1]):
        taken = taken.join(jump, [*keys, "_at"], "left").select(*keys, F.explode(F.filter(F.array("_at", "_to"), lambda v: v.isNotNull())).alias("_at"))
    out = kept(signals.join(taken.select(*keys, F.col("_at").alias(order)), [*keys, order], "left_semi").select(*signals.columns), "taken")
    forget(*made, *jumps)
    return out


def queue_pairs(asks: DataFrame, offers: DataFrame, keys: list[str], order: str) -> DataFrame:
    """asks with `matched`: the order of the first offer of its keys at or after it that no ask before it took; null if none.

    Asks wait in a queue, an offer serves the one that waits longest, or goes unused if none does. So the m-th
    offer has served or gone unused; unused so far are max(j - asks up to the j-th offer) over j <= m, and
    an offer that isn't unused serves ask m - unused: counts and one running maximum, then an equi-join of ranks.
    A group is one of `keys`: make it narrow (a session's signals of one level).
    """
    w = W.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    a = asks.select(*keys, F.col(order).alias("_at"), F.lit(0).alias("_kind"))
    b = offers.select(*keys, F.col(order).alias("_at"), F.lit(1).alias("_kind"))
    x = a.unionByName(b).withColumn("_asks", F.sum(1 - F.col("_kind")).over(w)).withColumn("_m", F.sum("_kind").over(w)).where("_kind = 1")
    order_of = W.partitionBy(*keys).orderBy("_m")
    x = x.withColumn("_lost", F.greatest(F.lit(0), F.max(F.col("_m") - F.col("_asks")).over(order_of.rowsBetween(W.unboundedPreceding, 0))))
    x = x.withColumn("_before", F.coalesce(F.lag("_lost").over(order_of), F.lit(0))).where("_lost = _before")
    served = x.select(*[F.col(n).alias(n) for n in keys], (F.col("_m") - F.col("_lost")).alias("_rank"), F.col("_at").alias("matched"))
    ranked = asks.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    return ranked.join(served, [*keys, "_rank"], "left").drop("_rank").select(*asks.columns, "matched")
