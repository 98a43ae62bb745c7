"""Scans along an order against plain loops, with units and blocks small enough to be crossed."""

import random

import pytest

from tidemark.operators import scans


@pytest.mark.parametrize("seed", range(3))
def test_dominance_join(spark, seed):
    rng = random.Random(seed)
    place = lambda: rng.randint(-30, 40)
    ticks = [(k, i, place(), place()) for k in "ab" for i in range(60)] + [("c", 0, 1, 1)]
    quotes = [(k, i, place(), place()) for k in "ab" for i in range(25)] + [("d", 0, 1, 1)]
    got = scans.dominance_join(spark.createDataFrame(ticks, "k string, id long, e long, r long"), spark.createDataFrame(quotes, "k string, q long, e long, r long"), ["k"], ["id"], "e", "r", ["q"], 7, 5)
    want = {}
    for k, i, e, r in ticks:
        fit = [(qe, q) for qk, q, qe, qr in quotes if qk == k and qe <= e and qr <= r]
        want[k, i] = max(fit)[1] if fit else None
    assert {(x.k, x.id): x.q for x in got.collect()} == want


def test_dominance_join_of_nothing(spark):
    ticks = spark.createDataFrame([("a", 1, 5, 5)], "k string, id long, e long, r long")
    none = spark.createDataFrame([], "k string, q long, e long, r long")
    assert [tuple(r) for r in scans.dominance_join(ticks, none, ["k"], ["id"], "e", "r", ["q"], 7, 5).collect()] == [("a", 1, None)]
    assert scans.dominance_join(ticks.limit(0), none, ["k"], ["id"], "e", "r", ["q"], 7, 5).collect() == []


def test_dominance_join_takes_more_tasks_for_more_rows(spark, monkeypatch):
    tasks, kept = [], scans.kept
    monkeypatch.setattr(scans, "TASK_ROWS", 10)
    monkeypatch.setattr(scans, "kept", lambda df, name: tasks.append(df.rdd.getNumPartitions()) or kept(df, name))
    for n in (100, 200):
        ticks = spark.createDataFrame([("a", i, i, i) for i in range(n)], "k string, id long, e long, r long")
        quotes = spark.createDataFrame([("a", i, i, i + 3) for i in range(n)], "k string, q long, e long, r long")
        got = scans.dominance_join(ticks, quotes, ["k"], ["id"], "e", "r", ["q"], 7, 5).collect()
        assert {r.id: r.q for r in got} == {i: i - 3 if i > 2 else None for i in range(n)}
    assert tasks == [20, 40]


@pytest.mark.parametrize("block", [1, 3, 256])
def test_affine_scan(spark, block):
    from pyspark.sql import functions as F

    rng = random.Random(block)
    rows = [(k, i, rng.uniform(-1, 1), rng.uniform(-5, 5)) for k in range(3) for i in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "k int, i int, a double, b double")
    got = scans.affine_scan(df, ["k"], "i", {"y": (F.col("a"), F.col("b"), 50.0), "z": (F.lit(0.5), F.col("b"), 0.0)}, F.floor(F.col("i") / 10), block)
    want, y, z, last = {}, 0.0, 0.0, None
    for k, i, a, b in rows:
        y, z = (50.0, 0.0) if k != last else (y, z)
        y, z, last = a * y + b, 0.5 * z + b, k
        want[k, i] = (y, z)
    found = {(r.k, r.i): (r.y, r.z) for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(p - q) < 1e-9 for key in want for p, q in zip(found[key], want[key], strict=True))


def test_unblocked(spark):
    rng = random.Random(4)
    rows = [(k, at, (at + rng.choice([1, 3, 10, 40])) if rng.random() > 0.03 else None, rng.choice("xy")) for k in range(4) for at in rng.sample(range(300), 80)]
    rows += [(0, rows[0][1], rows[0][1] + 2, "z"), (9, 5, None, "x")]
    got = scans.unblocked(spark.createDataFrame(rows, "k int, at int, until int, s string"), ["k"], "at", "until", 16)
    want, free = [], {}
    for k, at, until, s in sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3])):
        if at >= free.get(k, -1):
            want.append((k, at, until, s))
            free[k] = until if until is not None else 10**9
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert scans.unblocked(spark.createDataFrame([], "k int, at int, until int, s string"), ["k"], "at", "until").collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_queue_pairs(spark, seed):
    rng = random.Random(seed)
    asks, offers = ([(k, rng.randint(0, 40)) for k in range(3) for _ in range(20)] for _ in range(2))
    got = scans.queue_pairs(spark.createDataFrame(asks, "k int, t int"), spark.createDataFrame(offers, "k int, t int"), ["k"], "t")
    free, want = sorted(offers), []
    for k, t in sorted(asks):
        hit = next((o for o in free if o[0] == k and o[1] >= t), None)
        if hit:
            free.remove(hit)
        want.append((k, t, hit and hit[1]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def trades(spark, ohlc, found, hold, stop, target, cutoffs=()):
    from tidemark.operators import signals

    bars = spark.createDataFrame([("a", i, *map(float, p), 1.0, i in cutoffs) for i, p in enumerate(ohlc, 1)], "k string, bar int, open double, high double, low double, close double, atr double, cutoff boolean")
    sig = spark.createDataFrame([("a", i, d) for i, d in found], "k string, bar int, direction int")
    got = signals.strategy_trades(bars, sig, ["k"], hold, stop, target)
    return [(r.bar, r.entry_bar, r.entry, r.exit_bar, r.exit, r.reason, r.points) for r in got.orderBy("bar").collect()]


def test_a_position_is_held_entered_late_and_blocks(spark):
    flat = [(10, 11, 9, 10)] * 4 + [(12, 13, 11, 12)] * 4
    # the signal of bar 3 comes while one is held, that of bar 5 at the close of the bar it left in
    assert trades(spark, flat, [(1, 1), (3, -1), (5, -1)], 2, None, None) == [(1, 2, 10.0, 5, 12.0, "hold", 2.0), (5, 6, 12.0, None, None, None, None)]
    assert trades(spark, flat, [(1, -1)], 6, None, None, {3}) == [(1, 2, 10.0, 4, 10.0, "session", 0.0)]


def test_stops_and_targets(spark):
    calm = (10, 10.5, 9.5, 10)
    # the bar of the entry is not watched: orders stand from its close on
    deep = [calm, (10, 12, 7, 10), calm, calm, calm, calm]
    assert trades(spark, deep, [(1, 1)], 2, 2.0, 1.5)[0][3:6] == (5, 10.0, "hold")
    gap = [calm, calm, (7, 8, 6, 7), calm, calm, calm]
    assert trades(spark, gap, [(1, 1)], 2, 2.0, 1.5)[0][3:6] == (3, 7.0, "stop")
    assert trades(spark, gap, [(1, -1)], 2, 2.0, 1.5)[0][3:] == (3, 7.0, "target", 3.0)
    wide = lambda o: [calm, calm, (o, 12, 7, 10), calm, calm, calm]
    assert trades(spark, wide(11), [(1, 1)], 2, 2.0, 1.5)[0][3:6] == (3, 11.5, "target")
    assert trades(spark, wide(9), [(1, 1)], 2, 2.0, 1.5)[0][3:6] == (3, 8.0, "stop")


def test_wilder_range_and_oscillators_by_hand(spark):
    import datetime as dt

    from tidemark.operators import facts

    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    closes = [10.0, 11.0, 10.5, 12.0, 11.0, 13.0]
    b = spark.createDataFrame([(1, day(i), x, x + 1, x - 1, x) for i, x in enumerate(closes)], "ticker int, date date, open double, high double, low double, close double")
    got = [r.atr for r in facts.wilder_range(b, 2).orderBy("date").collect()]
    spans = [2.0, 2.0, 2.0, 2.5, 2.0, 3.0]
    want = [None, (spans[0] + spans[1]) / 2]
    for s in spans[2:]:
        want.append((want[-1] + s) / 2)
    assert got[0] is None and all(abs(x - y) < 1e-12 for x, y in zip(got[1:], want[1:], strict=True))
    rows = facts.oscillators(b, 2, 2).orderBy("date").collect()
    gain, loss = (1.0 + 0.0) / 2, 0.5 / 2
    assert [r.rsi for r in rows[:2]] == [None, None] and abs(rows[2].rsi - gain / (gain + loss) * 100) < 1e-9
    gain, loss = (gain + 1.5) / 2, loss / 2
    assert abs(rows[3].rsi - gain / (gain + loss) * 100) < 1e-9
    k = 50.0 * 2 / 3 + (11.0 - 9.0) / (12.0 - 9.0) * 100 / 3
    d = 50.0 * 2 / 3 + k / 3
    assert rows[0].k is None and abs(rows[1].k - k) < 1e-9 and abs(rows[1].d - d) < 1e-9 and abs(rows[1].j - (3 * k - 2 * d)) < 1e-9
