"""One-pass resamples and the pre-declared verdict by hand."""

import random

from pyspark.sql import functions as F

from tidemark.operators import evaluation as E
from tidemark.operators import validation as V

KIND = "id long, w int, b int, net double"


def test_resamples_are_poisson_and_agree_on_any_partitioning(spark):
    rows = spark.createDataFrame([(i, 0, 0, float(i)) for i in range(400)], KIND)
    sums = V.resample_sums(rows, [], "net", ["id"], 203, "s")
    got = sorted(map(tuple, sums.collect()))
    assert [g[0] for g in got] == list(range(203))
    weights = [g[1] for g in got]
    mean = sum(weights) / 203
    spread = sum((x - mean) ** 2 for x in weights) / 203
    assert abs(mean - 400) < 5 and 250 < spread < 600  # mean and variance of 400 weights of mean and variance 1
    again = V.resample_sums(rows.repartition(7), [], "net", ["id"], 203, "s")
    assert [(a, b, round(c, 6)) for a, b, c in sorted(map(tuple, again.collect()))] == [(a, b, round(c, 6)) for a, b, c in got]
    assert V.POISSON[:3] == [24109, 48218, 60273]


def test_places_of_the_interval(spark):
    values = spark.createDataFrame([(float(i),) for i in range(1000)], "v double")
    assert tuple(V.order_interval(values, [], "v").first()) == (1000, 25.0, 975.0)
    assert tuple(V.order_interval(values.where("v < 1"), [], "v").first()) == (1, 0.0, 0.0)


def verdict(spark, signal, control):
    """signal, control: (period, bucket) -> values."""
    rows = lambda d: spark.createDataFrame([(hash((w, b)) % 1000 * 1000 + i, w, b, float(v)) for (w, b), vs in d.items() for i, v in enumerate(vs)], KIND)
    return E.period_verdict(rows(signal), rows(control), "w", ["b"], "net", ["id"], F.col("w") == 9, 3, 10, 3, 200, "t").first()


def spread(mean, n=30, seed=0):
    rng = random.Random(seed)
    return [mean + rng.uniform(-1, 1) for _ in range(n)]


def test_all_four_parts_decide(spark):
    good = {(w, 0): spread(5, seed=w) for w in range(4)}
    low = {(w, 0): spread(-5, seed=w) for w in range(4)}
    r = verdict(spark, good, low)
    assert (r.p1, r.p2, r.p2_calm, r.p3, r.p4, r.passes, r.label) == (4, True, True, 4, 4, True, "PASS")
    assert r.plain_low > 9 and r.plain_high < 11
    # as good, but within chance: P1, P3 and P4 hold and P2 doesn't
    noisy = lambda k: {(w, 0): [k + x for x in (-60, 61.0, -55, 57.0, 0.0, 1.0, -40, 42.0, 30.0, -28.0)] for w in range(4)}
    r = verdict(spark, noisy(0.3), noisy(0.0))
    assert (r.p1, r.p3, r.p4, r.p2, r.passes, r.label) == (4, 4, 4, False, False, "FAIL")


def test_a_pass_that_hangs_on_the_crash(spark):
    signal = {(w, 0): [0.1 + x for x in (-9, 9.2, -8, 8.1, 0.0, 1.0, -4, 4.2, 3.0, -2.8)] for w in range(4)} | {(9, 0): spread(50, 40)}
    control = {(w, 0): [x for x in (-9, 9.2, -8, 8.1, 0.0, 1.0, -4, 4.2, 3.0, -2.8)] for w in range(4)} | {(9, 0): spread(-50, 40)}
    r = verdict(spark, signal, control)
    assert (r.p2, r.p2_calm, r.label) == (True, False, "PASS (crash-dependent)")


def test_signals_without_controls_in_their_bucket_are_left_out_of_the_match(spark):
    signal = {(w, b): spread(5, seed=w) for w in range(4) for b in (0, 1)}
    r = verdict(spark, signal, {(w, 0): spread(-5, seed=w) for w in range(4)})
    assert abs((r.matched_low + r.matched_high) / 2 - 10) < 0.5 and r.passes
    r = verdict(spark, signal, {(w, 7): spread(-5, seed=w) for w in range(4)})
    assert r.matched_low is None and not r.p2 and not r.passes
