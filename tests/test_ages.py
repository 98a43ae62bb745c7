"""Ages of ticks and quotes at the ends of steps, to the microsecond."""

import datetime as dt

from tidemark.functions.scalars import settled
from tidemark.operators import micro


def test_halves_of_a_millisecond_go_up(spark):
    start = dt.datetime(2024, 1, 5, 15)
    rows = [(0, start, 31, 0.0, 1.0, start + dt.timedelta(seconds=32 * 600, microseconds=-(46_000_500 + 1000 * k))) for k in range(300)]
    x = spark.createDataFrame([(*r, r[-1]) for r in rows], "target long, session_start timestamp_ntz, step long, bid double, ask double, quote_ts timestamp_ntz, tick_ts timestamp_ntz")
    got = micro.with_ages(x, 600, 3600.0).select(settled("tick_age_s", 3).alias("t"), settled("quote_age_s", 3).alias("q")).collect()
    assert sorted(round(r.t * 1000) for r in got) == sorted(round(r.q * 1000) for r in got) == [46_001 + k for k in range(300)]
