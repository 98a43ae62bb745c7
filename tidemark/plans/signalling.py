"""Queries of band and level signals, of order books built from quotes, and of text checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.scalars import settled, settled_sql
from tidemark.operators import book as B
from tidemark.operators import facts as A
from tidemark.operators import signals as G
from tidemark.operators.daily import by
from tidemark.registry import query
from tidemark.sources.views import table, v_daily, v_flow, v_quotes, with_views

_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"
_BANDS = {"bands": "SELECT *, CASE WHEN count(close) OVER b = 20 THEN avg(close) OVER b END AS mid, CASE WHEN count(close) OVER b = 20 THEN avg(close) OVER b + 2 * stddev_pop(close) OVER b END AS upper, CASE WHEN count(close) OVER b = 20 THEN avg(close) OVER b - 2 * stddev_pop(close) OVER b END AS lower FROM v_daily WINDOW b AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)"}
_PIVOTS = {
    **_BANDS,
    "p0": """SELECT *, CASE WHEN count(*) OVER a = 5 AND high > max(high) OVER l AND high > max(high) OVER r THEN high END AS ph, CASE WHEN count(*) OVER a = 5 AND low < min(low) OVER l AND low < min(low) OVER r THEN low END AS pl FROM bands
        WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), l AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)""",
    "p1": f"SELECT *, lag(ph, 2) OVER w AS pivot_high, lag(pl, 2) OVER w AS pivot_low FROM p0 {_W}",
    "p2": f"SELECT *, last_value(pivot_high IGNORE NULLS) OVER w AS resistance, last_value(pivot_low IGNORE NULLS) OVER w AS support FROM p1 {_W}",
    "p3": f"SELECT *, lag(resistance) OVER w AS res, lag(support) OVER w AS sup, lag(close) OVER w AS pc, volume > 1.05 * avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING) AS strong FROM p2 {_W}",
    "sig": """SELECT ticker, date, close, 'breakout' AS signal, 1 AS direction, res AS level FROM p3 WHERE mid IS NOT NULL AND close > res AND pc <= res AND strong AND close > mid
        UNION ALL SELECT ticker, date, close, 'breakdown', -1, sup FROM p3 WHERE mid IS NOT NULL AND close < sup AND pc >= sup AND strong AND close < mid
        UNION ALL SELECT ticker, date, close, 'bounce', 1, sup FROM p3 WHERE mid IS NOT NULL AND low <= sup * 1.3 AND high >= sup * 0.7 AND low <= lower AND close >= sup AND close > open
        UNION ALL SELECT ticker, date, close, 'rejection', -1, res FROM p3 WHERE mid IS NOT NULL AND high >= res * 0.7 AND low <= res * 1.3 AND high >= upper AND close <= res AND close < open""",
}


def _pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pivots(G.bands(v_daily(spark, sf_dir), ["ticker"], "date"), ["ticker"], "date", 2, 2)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.level_signals(_pivots(spark, sf_dir), ["ticker"], "date", 30.0, 5, 1.05)


@query(with_views(f"SELECT ticker, date, {settled_sql('mid', 4)} AS mid, {settled_sql('upper', 3)} AS upper, {settled_sql('lower', 3)} AS lower FROM bands", "v_daily", **_BANDS))
def bollinger_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bands(v_daily(spark, sf_dir), ["ticker"], "date").select("ticker", "date", settled("mid", 4).alias("mid"), settled("upper", 3).alias("upper"), settled("lower", 3).alias("lower"))


@query(with_views("SELECT ticker, date, pivot_high, pivot_low, resistance, support FROM p2", "v_daily", **_PIVOTS))
def pivot_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pivots(spark, sf_dir).select("ticker", "date", "pivot_high", "pivot_low", "resistance", "support")


@query(with_views("SELECT ticker, date, signal, direction, level FROM sig", "v_daily", **_PIVOTS))
def level_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("ticker", "date", "signal", "direction", "level")


_OUT = {**_PIVOTS, "mv": f"SELECT ticker, date, coalesce(lead(close, 1) OVER w, last_value(close) OVER f) AS c1, coalesce(lead(close, 4) OVER w, last_value(close) OVER f) AS c4 FROM v_daily WINDOW w AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "res": "SELECT sig.*, 1 AS horizon, direction * (c1 - close) - 3 AS net FROM sig JOIN mv USING (ticker, date) UNION ALL SELECT sig.*, 4, direction * (c4 - close) - 3 FROM sig JOIN mv USING (ticker, date)"}


@query(with_views(f"SELECT signal, horizon, count(*) AS n, {settled_sql('count(*) FILTER (net > 0) / count(*)')} AS win_rate, {settled_sql('avg(net)', 3)} AS mean, {settled_sql('quantile_cont(net, 0.5)', 3)} AS median FROM res GROUP BY ALL", "v_daily", **_OUT))
def signal_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.outcomes(_signals(spark, sf_dir), v_daily(spark, sf_dir), ["ticker"], "date", [1, 4], 3.0)
    y = G.signal_cells(x, ["signal", "horizon"])
    return y.select("signal", "horizon", "n", settled("win_rate").alias("win_rate"), settled("mean", 3).alias("mean"), settled("median", 3).alias("median"))


@query(with_views("""SELECT structure, count(*) AS n FROM (SELECT CASE WHEN last_value(dh IGNORE NULLS) OVER w > 0 AND last_value(dl IGNORE NULLS) OVER w > 0 THEN 'up' WHEN last_value(dh IGNORE NULLS) OVER w < 0 AND last_value(dl IGNORE NULLS) OVER w < 0 THEN 'down' ELSE 'range' END AS structure
    FROM p2 LEFT JOIN (SELECT ticker, date, pivot_high - lag(pivot_high) OVER w AS dh FROM p2 WHERE pivot_high IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date)) USING (ticker, date)
    LEFT JOIN (SELECT ticker, date, pivot_low - lag(pivot_low) OVER w AS dl FROM p2 WHERE pivot_low IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date)) USING (ticker, date) WINDOW w AS (PARTITION BY ticker ORDER BY date)) GROUP BY 1""", "v_daily", **_PIVOTS))  # fmt: skip
def market_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.structure_state(_pivots(spark, sf_dir), ["ticker"], "date").groupBy("structure").agg(F.count("*").alias("n"))


@query(with_views("""SELECT ticker, day, signal FROM walk WHERE taken""", "v_daily", **_PIVOTS,
    num="SELECT *, date_diff('day', DATE '1970-01-01', date) AS day, row_number() OVER (PARTITION BY ticker ORDER BY date, signal) AS i FROM sig",
    walk_r="SELECT NULL", walk="""SELECT ticker, day, signal, taken FROM (WITH RECURSIVE r AS (SELECT ticker, i, day, signal, day AS blocked, true AS taken FROM num WHERE i = 1
        UNION ALL SELECT n.ticker, n.i, n.day, n.signal, CASE WHEN n.day >= r.blocked + 28 THEN n.day ELSE r.blocked END, n.day >= r.blocked + 28 FROM r JOIN num n ON n.ticker = r.ticker AND n.i = r.i + 1) SELECT * FROM r)"""))  # fmt: skip
def one_position_per_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals taken when one position of four weeks blocks the next."""
    x = _signals(spark, sf_dir).select("ticker", F.unix_date("date").cast("long").alias("day"), "signal")
    return G.one_position(x, ["ticker"], "day", 28)


_LEADS = {
    **_PIVOTS,
    "ea": "SELECT *, row_number() OVER (PARTITION BY ticker, lv ORDER BY day) AS i FROM (SELECT ticker, date_diff('day', DATE '1970-01-01', date) AS day, level, CAST(round(level * 1000000) AS BIGINT) AS lv FROM sig WHERE signal IN ('bounce', 'rejection'))",
    "og": "SELECT *, row_number() OVER (PARTITION BY ticker, lv ORDER BY day) AS j FROM (SELECT ticker, date_diff('day', DATE '1970-01-01', date) AS day, CAST(round(level * 1000000) AS BIGINT) AS lv FROM sig WHERE signal IN ('breakout', 'breakdown'))",
    "led": """SELECT * FROM (WITH RECURSIVE r AS (SELECT DISTINCT ticker, lv, 0::BIGINT AS i, 0::BIGINT AS used, NULL::BIGINT AS hit FROM ea
        UNION ALL SELECT r.ticker, r.lv, r.i + 1, coalesce(min(o.j), r.used), min(o.j) FROM r JOIN ea e ON e.ticker = r.ticker AND e.lv = r.lv AND e.i = r.i + 1
            LEFT JOIN og o ON o.ticker = r.ticker AND o.lv = r.lv AND o.j > r.used AND o.day >= e.day GROUP BY r.ticker, r.lv, r.i, r.used) SELECT * FROM r)""",
}


@query(with_views("SELECT e.ticker, e.day, e.level, CAST(o.day - e.day AS DOUBLE) AS lead FROM ea e JOIN led r ON r.ticker = e.ticker AND r.lv = e.lv AND r.i = e.i LEFT JOIN og o ON o.ticker = r.ticker AND o.lv = r.lv AND o.j = r.hit", "v_daily", **_LEADS))
def lead_time_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone touches as early events against later signals of the same level."""
    x = _signals(spark, sf_dir).withColumn("day", F.unix_date("date").cast("long"))
    early = x.where("signal IN ('bounce', 'rejection')").select("ticker", "day", "level")
    late = x.where("signal IN ('breakout', 'breakdown')").select("ticker", "day", "level")
    return G.pair_leads(early, late, ["ticker"], "day", "level")


_HOLD, _STOP, _TARGET = 6, 1.0, 1.5
_TRADES = {
    **_PIVOTS,
    "t0": f"SELECT *, row_number() OVER w AS bar, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM v_daily {_W}",
    "t1": "SELECT *, list(tr) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS trs FROM t0",
    "tb": "SELECT ticker, date, bar, open, high, low, day(date) >= 23 AS cutoff, CASE WHEN bar >= 14 THEN list_reduce(list_concat([list_sum(trs[1:14]) / 14], trs[15:]), lambda a, v: (a * 13 + v) / 14) END AS atr FROM t1",
    "en": f"""SELECT b.ticker, b.bar, s.direction, e.bar AS entry_bar, e.open AS entry, least(e.bar + {_HOLD}, (SELECT min(k.bar) FROM tb k WHERE k.ticker = e.ticker AND k.bar >= e.bar AND k.cutoff)) + 1 AS last
        FROM (SELECT ticker, date, min(direction) AS direction FROM sig GROUP BY ALL) s JOIN tb b USING (ticker, date) JOIN tb e ON e.ticker = b.ticker AND e.bar = b.bar + 1""",
    "lv": f"SELECT n.*, k.bar AS kb, k.open AS o, CASE direction WHEN 1 THEN k.high ELSE k.low END AS far, CASE direction WHEN 1 THEN k.low ELSE k.high END AS near, entry - {_STOP} * direction * p.atr AS stop, entry + {_TARGET} * direction * p.atr AS target FROM en n JOIN tb k ON k.ticker = n.ticker AND k.bar > n.entry_bar AND k.bar < n.last JOIN tb p ON p.ticker = k.ticker AND p.bar = k.bar - 1",
    "hi": """SELECT *, CASE WHEN stop * direction >= o * direction THEN 'stop' WHEN o * direction >= target * direction THEN 'target' WHEN far * direction >= target * direction AND (abs(far - o) < abs(o - near) OR NOT stop * direction >= near * direction) THEN 'target' WHEN stop * direction >= near * direction THEN 'stop' END AS why,
        CASE WHEN stop * direction >= o * direction OR o * direction >= target * direction THEN o WHEN far * direction >= target * direction AND (abs(far - o) < abs(o - near) OR NOT stop * direction >= near * direction) THEN target ELSE stop END AS price FROM lv""",
    "fi": "SELECT ticker, bar, min(kb) AS kb, arg_min(why, kb) AS why, arg_min(price, kb) AS price FROM hi WHERE why IS NOT NULL GROUP BY 1, 2",
    "al": f"""SELECT n.ticker, n.bar, n.direction, n.entry_bar, n.entry, CASE WHEN coalesce(f.price, x.open) IS NOT NULL THEN coalesce(f.kb, n.last) END AS exit_bar, coalesce(f.price, x.open) AS exit,
        CASE WHEN coalesce(f.price, x.open) IS NOT NULL THEN coalesce(f.why, CASE WHEN n.last = n.entry_bar + {_HOLD} + 1 THEN 'hold' ELSE 'session' END) END AS reason
        FROM en n LEFT JOIN fi f USING (ticker, bar) LEFT JOIN tb x ON x.ticker = n.ticker AND x.bar = n.last""",
    "tk": """SELECT * FROM (WITH RECURSIVE r AS (SELECT ticker, min(bar) AS bar FROM al GROUP BY 1
        UNION ALL SELECT r.ticker, min(n.bar) FROM r JOIN al c ON c.ticker = r.ticker AND c.bar = r.bar JOIN al n ON n.ticker = r.ticker AND n.bar >= c.exit_bar GROUP BY r.ticker) SELECT * FROM r)""",
}


@query(with_views(f"SELECT al.ticker, al.bar, direction, entry_bar, entry, exit_bar, {settled_sql('exit', 4)} AS exit, reason, {settled_sql('direction * (exit - entry)', 4)} AS points FROM al JOIN tk USING (ticker, bar)", "v_daily", **_TRADES))
def strategy_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All level signals share one slot a ticker; on weekly bars the cutoff is the month's last week."""
    bars = A.wilder_range(v_daily(spark, sf_dir), 14, unit=F.year("date")).withColumn("bar", F.row_number().over(by())).withColumn("cutoff", F.dayofmonth("date") >= 23)
    signals = _signals(spark, sf_dir).groupBy("ticker", "date").agg(F.min("direction").alias("direction")).join(bars.select("ticker", "date", "bar"), ["ticker", "date"])
    x = G.strategy_trades(bars, signals, ["ticker"], _HOLD, _STOP, _TARGET)
    return x.select("ticker", "bar", "direction", "entry_bar", "entry", "exit_bar", settled("exit", 4).alias("exit"), "reason", settled("points", 4).alias("points"))


@query()
def swing_pullbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.swing_depth(v_daily(spark, sf_dir), ["ticker"], "date")


@query(with_views(f"SELECT ticker, len(rets) AS trades, len(list_filter(rets, lambda v: v > 0)) AS wins, {settled_sql('coalesce(list_sum(rets), 0)', 5)} AS sum_return, units AS open_units FROM walk", "v_daily",
    dd="SELECT ticker, date, close, max(close) OVER (PARTITION BY ticker ORDER BY date ROWS 51 PRECEDING) AS hi, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM v_daily",
    want="SELECT *, (close <= hi * (1 - 20.0::DOUBLE / 100))::INT + (close <= hi * (1 - 25.0::DOUBLE / 100))::INT + (close <= hi * (1 - 30.0::DOUBLE / 100))::INT AS reached FROM dd",
    walk="""SELECT ticker, rets, units FROM (WITH RECURSIVE r AS (SELECT ticker, 0::BIGINT AS i, 0 AS level, 0 AS waiting, 0 AS units, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS top, []::DOUBLE[] AS rets FROM (SELECT DISTINCT ticker FROM dd)
        UNION ALL SELECT ticker, i, CASE WHEN close >= hi * (1 - 5.0::DOUBLE / 100) THEN 0 WHEN gone THEN 3 ELSE greatest(level, reached) END, CASE WHEN gone THEN 0 ELSE greatest(0, reached - level) END, CASE WHEN gone THEN 0 ELSE u END, CASE WHEN gone THEN 0 ELSE k END, CASE WHEN gone THEN 0 ELSE t END,
            CASE WHEN gone THEN list_append(rets, u * close / k - 1) ELSE rets END
            FROM (SELECT w.ticker, w.i, w.close, w.hi, w.reached, r.level, r.rets, r.units + r.waiting AS u, r.cost + r.waiting * w.close AS k, CASE WHEN r.units > 0 THEN greatest(r.top, w.close) ELSE w.close END AS t,
                r.units + r.waiting > 0 AND w.close <= (CASE WHEN r.units > 0 THEN greatest(r.top, w.close) ELSE w.close END) * 0.85 AS gone FROM r JOIN want w ON w.ticker = r.ticker AND w.i = r.i + 1)) SELECT r.* FROM r JOIN (SELECT DISTINCT ticker, n FROM dd) e ON e.ticker = r.ticker AND e.n = r.i)"""))  # fmt: skip
def drawdown_entry_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On weekly bars: the high of 52 of them."""
    return G.drawdown_rule(v_daily(spark, sf_dir), ["ticker"], "date", 52).withColumn("sum_return", settled("sum_return", 5))


@query(with_views(f"SELECT CAST(sum(least(l, r)) AS BIGINT) AS matched, CAST(sum(l) - sum(least(l, r)) AS BIGINT) AS left_only, CAST(sum(r) - sum(least(l, r)) AS BIGINT) AS right_only, {settled_sql('sum(least(l, r)) / sum(l) * 100')} AS left_pct FROM (SELECT coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM (SELECT k, hour(ts) AS h, count(*) AS l FROM (SELECT regexp_extract(props, '[0-9]+') AS k, ts, user_id FROM events) WHERE user_id % 2 = 0 GROUP BY 1, 2) a FULL JOIN (SELECT k, hour(ts) AS h, count(*) AS r FROM (SELECT regexp_extract(props, '[0-9]+') AS k, ts, user_id FROM events) WHERE user_id % 2 = 1 GROUP BY 1, 2) b USING (k, h))"))
def multiset_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("user_id", F.regexp_extract("props", "[0-9]+", 0).alias("k"), F.hour("ts").alias("h"))
    y = G.multiset_agreement(x.where("user_id % 2 = 0"), x.where("user_id % 2 = 1"), ["k", "h"])
    return y.withColumn("left_pct", settled("left_pct"))


@query(with_views("SELECT ticker, CAST(min(p) AS INTEGER) AS first_place FROM (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.p, b.p) AS p, a.h IS NOT DISTINCT FROM b.h AS same FROM (SELECT ticker, row_number() OVER w AS p, high AS h FROM v_daily WINDOW w AS (PARTITION BY ticker ORDER BY date)) a FULL JOIN (SELECT ticker, row_number() OVER w AS p, high AS h FROM v_daily WHERE date <> DATE '1998-06-01' WINDOW w AS (PARTITION BY ticker ORDER BY date)) b ON a.ticker = b.ticker AND a.p = b.p) WHERE NOT same GROUP BY 1", "v_daily"))
def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = v_daily(spark, sf_dir)
    return G.first_divergence(x, x.where("date <> DATE'1998-06-01'"), ["ticker"], "date", ["high"])


_BOOK = "SELECT event_id, target, exchange_ts, event_id % 13 = 0 AS suspend, list_transform(range(5), lambda i: {'price': bid - i * 0.1, 'volume': CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE CAST((depth * (i + 3)) % 23 AS DOUBLE) END, 'diff': CAST((depth + i) % 7 AS DOUBLE) - 3}) AS bids, list_transform(range(5), lambda i: {'price': ask + i * 0.1 - CASE WHEN event_id % 19 = 0 THEN 2.0 ELSE 0 END, 'volume': CAST((depth * (i + 5)) % 29 AS DOUBLE), 'diff': CAST((depth + 2 * i) % 5 AS DOUBLE) - 2}) AS asks FROM v_quotes"
_KEEP = "list_filter({a}, lambda v: v.volume > 0)"
_CHECK = {
    "book": _BOOK,
    "chk": f"""SELECT event_id, target, exchange_ts, b, a, CASE WHEN suspend THEN 'suspended' WHEN len(list_filter(bids, lambda v: NOT (v.price > 0 AND v.volume >= 0))) > 0 THEN 'invalid_bid_level' WHEN len(list_filter(asks, lambda v: NOT (v.price > 0 AND v.volume >= 0))) > 0 THEN 'invalid_ask_level'
        WHEN len(b) = 0 THEN 'missing_positive_bid_depth' WHEN len(a) = 0 THEN 'missing_positive_ask_depth' WHEN b[1].price >= a[1].price THEN 'crossed_or_locked_book' END AS problem FROM (SELECT *, {_KEEP.format(a='bids')} AS b, {_KEEP.format(a='asks')} AS a FROM book)""",
    "wd": "SELECT event_id, target, exchange_ts, list_sum(list_transform(b, lambda v, i: v.volume * (6 - i))) AS wb, list_sum(list_transform(a, lambda v, i: v.volume * (6 - i))) AS wa, list_sum(list_transform(b, lambda v, i: v.diff * (6 - i))) AS db, list_sum(list_transform(a, lambda v, i: v.diff * (6 - i))) AS da FROM chk WHERE problem IS NULL",
    "pr": "SELECT event_id, target, exchange_ts, floor(least(1, greatest(-1, 0.8 * CASE WHEN wb + wa = 0 THEN 0 ELSE (wb - wa) / (wb + wa) END + 0.2 * CASE WHEN abs(db) + abs(da) = 0 THEN 0 ELSE (db - da) / (abs(db) + abs(da)) END)) * 1e4 + 0.5) / 1e4 AS pressure FROM wd",
}


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda price, volume, diff: f"named_struct('price', {price}, 'volume', {volume}, 'diff', {diff})"
    bids = level("bid - i * 0.1D", "CASE WHEN event_id % 17 = 0 THEN 0.0D ELSE CAST((depth * (i + 3)) % 23 AS DOUBLE) END", "CAST((depth + i) % 7 AS DOUBLE) - 3")
    asks = level("ask + i * 0.1D - CASE WHEN event_id % 19 = 0 THEN 2.0D ELSE 0D END", "CAST((depth * (i + 5)) % 29 AS DOUBLE)", "CAST((depth + 2 * i) % 5 AS DOUBLE) - 2")
    return v_quotes(spark, sf_dir).selectExpr("event_id", "target", "exchange_ts", "event_id % 13 = 0 AS suspend", f"transform(sequence(0, 4), i -> {bids}) AS bids", f"transform(sequence(0, 4), i -> {asks}) AS asks")


@query(with_views("SELECT coalesce(problem, 'sound') AS problem, count(*) AS n FROM chk GROUP BY 1", "v_quotes", **_CHECK))
def book_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.check_snapshots(_book(spark, sf_dir)).groupBy(F.coalesce("problem", F.lit("sound")).alias("problem")).agg(F.count("*").alias("n"))


@query(with_views("SELECT event_id, pressure FROM pr", "v_quotes", **_CHECK))
def book_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pressures(B.check_snapshots(_book(spark, sf_dir))).select("event_id", "pressure")


_CONF = {
    **_CHECK,
    "conf0": "SELECT target, CAST(exchange_ts AS DATE) AS day, count(*) AS samples, avg(pressure) AS m, CASE WHEN count(*) >= 2 AND bool_and(pressure > 0.05) THEN 1 WHEN count(*) >= 2 AND bool_and(pressure < -0.05) THEN -1 ELSE 0 END AS persistence FROM pr GROUP BY ALL",
    "conf": "SELECT *, greatest(0, least(100, floor(50 + 40 * m + 10 * persistence + 0.5))) AS score FROM conf0",
}


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    checked = B.check_snapshots(_book(spark, sf_dir)).withColumn("day", F.to_date("exchange_ts"))
    return checked, B.confidence(B.pressures(checked), ["target", "day"])


@query(with_views("""SELECT target, day, samples, persistence, score, CASE WHEN score >= 70 THEN 'strong_buy_pressure' WHEN score >= 58 THEN 'buy_pressure' WHEN score > 42 THEN 'balanced' WHEN score > 30 THEN 'sell_pressure' ELSE 'strong_sell_pressure' END AS label,
    CASE WHEN score >= 70 THEN 8 WHEN score >= 58 THEN 4 WHEN score > 42 THEN 0 WHEN score > 30 THEN -2 ELSE -5 END AS adjustment, CASE WHEN samples >= 3 THEN 'high' WHEN samples = 2 THEN 'medium' ELSE 'low' END AS reliability,
    CASE WHEN score >= 70 THEN 'active_entry_supported' WHEN score >= 58 THEN 'patient_entry_preferred' WHEN score > 42 THEN 'wait_near_support' ELSE 'selling_pressure_wait' END AS interpretation FROM conf""", "v_quotes", **_CONF))  # fmt: skip
def book_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[1].select("target", "day", "samples", "persistence", "score", "label", "adjustment", "reliability", B.interpretation("score").alias("interpretation"))


_WALLED = {
    **_CONF,
    "lastb": "SELECT target, CAST(exchange_ts AS DATE) AS day, arg_max(b, exchange_ts) AS b, arg_max(a, exchange_ts) AS a FROM chk WHERE problem IS NULL GROUP BY ALL",
    "hv": "SELECT *, list_transform(b, lambda v, i: v.volume * (6 - i)) AS hb, list_transform(a, lambda v, i: v.volume * (6 - i)) AS ha FROM lastb",
    "wl": "SELECT *, list_position(hb, list_max(hb)) AS bw, list_position(ha, list_max(ha)) AS aw FROM hv",
}


@query(with_views("""SELECT target, day, score, CASE WHEN score >= 70 THEN a[1].price ELSE b[1].price END AS active_entry, b[bw].price AS patient_entry, a[greatest(1, aw - 1)].price AS take_profit, b[least(bw + 1, len(b))].price AS stop_loss,
    CASE WHEN bw < len(b) THEN 'normal' ELSE 'low' END AS stop_reliability FROM wl JOIN conf USING (target, day)""", "v_quotes", **_WALLED))  # fmt: skip
def book_reference_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.reference_prices(*_scored(spark, sf_dir), ["target", "day"], "exchange_ts")


@query(with_views("""SELECT n AS risks, count(*) AS keys FROM (SELECT 2 + (samples < 3)::INT + (samples = 0)::INT + (bw >= len(b))::INT AS n FROM wl JOIN conf USING (target, day)) GROUP BY 1""", "v_quotes", **_WALLED))
def book_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys have how many risks, of three requested samples."""
    checked, scored = _scored(spark, sf_dir)
    x = B.reference_prices(checked, scored, ["target", "day"], "exchange_ts").join(scored.select("target", "day", "samples"), ["target", "day"])
    return x.select(F.size(B.confidence_risks("samples", 3, "stop_reliability")).alias("risks")).groupBy("risks").agg(F.count("*").alias("keys"))


@query(with_views("""SELECT ticker, investor, days, CASE WHEN days < 5 THEN 'insufficient' WHEN buying AND increasing AND NOT turned THEN 'observe' WHEN turned OR selling OR latest < 0 THEN 'exclude' ELSE 'insufficient' END AS action FROM (
    SELECT ticker, investor, count(*) AS days, bool_and(net > 0) AS buying, bool_and(net < 0) AS selling, bool_and(coalesce(net > before, true) OR r = 5) AS increasing, coalesce(bool_or(r <= 2 AND net < 0), false) AND coalesce(bool_or(r >= 3 AND net > 0), false) AS turned, arg_min(net, r) AS latest
    FROM (SELECT *, lead(net) OVER w AS before FROM (SELECT *, row_number() OVER w AS r FROM d WINDOW w AS (PARTITION BY ticker, investor ORDER BY date DESC)) WHERE r <= 5 WINDOW w AS (PARTITION BY ticker, investor ORDER BY date DESC)) GROUP BY 1, 2)""", "v_flow", d="SELECT ticker, investor, date, sum(net) AS net FROM v_flow WHERE net IS NOT NULL GROUP BY ALL"))  # fmt: skip
def branch_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = v_flow(spark, sf_dir).where("net IS NOT NULL").groupBy("ticker", "investor", "date").agg(F.sum("net").alias("net"))
    return B.branch_pattern(x, ["ticker", "investor"], ["date"]).select("ticker", "investor", "days", "action")


@query(with_views("SELECT view_fx, view_basis, count(*) AS n FROM (SELECT CASE WHEN x IS NULL THEN 'missing' WHEN x <= -0.1 THEN 'bullish' WHEN x >= 0.1 THEN 'bearish' ELSE 'neutral' END AS view_fx, CASE WHEN y IS NULL THEN 'missing' WHEN y > 100 THEN 'bullish' WHEN y < -100 AND NOT (m IN (6, 7, 8) AND y >= -300) THEN 'bearish' ELSE 'neutral' END AS view_basis FROM (SELECT lead(l_discount) OVER w - l_discount AS x, (lead(l_extendedprice) OVER w - l_extendedprice) / 100 AS y, month(l_shipdate) AS m FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount))) GROUP BY ALL"))
def preopen_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount")
    x = table(spark, sf_dir, "lineitem").select((F.lead("l_discount").over(w) - F.col("l_discount")).alias("x"), ((F.lead("l_extendedprice").over(w) - F.col("l_extendedprice")) / 100).alias("y"), F.month("l_shipdate").alias("m"))
    return x.groupBy(B.currency_view("x").alias("view_fx"), B.basis_view("y", "m").alias("view_basis")).agg(F.count("*").alias("n"))


@query("SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in B.FLAGS.items()) + "], lambda x: x IS NOT NULL)) AS flag FROM documents) GROUP BY ALL")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents match each forbidden pattern."""
    x = table(spark, sf_dir, "documents").select(F.explode(B.flags("text")).alias("flag"))
    return x.groupBy("flag").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, value FROM (SELECT DISTINCT doc_id, CAST(replace(raw, ',', '') AS DOUBLE) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '{B.DATES}', ' ', 'g'), '{B.NUMBERS}')) AS raw FROM documents)) n
    WHERE value >= 1000 AND NOT (value = floor(value) AND value BETWEEN 1900 AND 2100) AND NOT abs(value - (1000 + n.doc_id)) <= 0.005 * (1000 + n.doc_id)""")  # fmt: skip
def untraceable_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents that their one fact, 1000 + id, doesn't account for."""
    docs = table(spark, sf_dir, "documents")
    facts = docs.select("doc_id", (F.col("doc_id") + 1000).cast("double").alias("fact"))
    return B.untraceable(B.numbers_in(docs, "doc_id", "text"), facts, "doc_id")


@query("""SELECT page_id, count(*) AS links, count(DISTINCT label) AS labels FROM (SELECT DISTINCT page_id, l.href, l.label FROM (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 1), regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 2))) AS z FROM pages), (SELECT z[1] AS href, z[2] AS label) l) GROUP BY 1""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.page_links(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("label").alias("labels"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS n_chars FROM pages")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, text = B.page_text()
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.char_length(text).cast("long").alias("n_chars"))


_AGE = "CAST(DATE '2024-02-01' - CAST(ts AS DATE) AS INTEGER)"


@query(f"SELECT tier, count(*) AS n FROM (SELECT CASE WHEN age <= 7 AND place <= 50 THEN 'hot' WHEN age <= 30 THEN 'warm' ELSE 'archive' END AS tier FROM (SELECT {_AGE} AS age, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS place FROM (SELECT user_id, event_type, regexp_extract(props, '[0-9]+') AS k, max(ts) AS ts FROM events GROUP BY ALL))) GROUP BY 1")
def note_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated notes by age, the newest of each user hot up to a cap."""
    from pyspark.sql import Window as W

    x = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.regexp_extract("props", "[0-9]+", 0).alias("k")).agg(F.max("ts").alias("ts"))
    x = x.select(F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts")).alias("age"), F.row_number().over(W.partitionBy("user_id").orderBy(F.col("ts").desc())).alias("place"))
    return x.groupBy(B.memory_tier("age", "place").alias("tier")).agg(F.count("*").alias("n"))


@query(f"SELECT event_id, {settled_sql('1 / (1 + exp(-value / 10))')} AS sig, {settled_sql('greatest(10, least(30, value))')} AS clamped, floor(value * 10 + 0.5) / 10 AS half_up, {settled_sql('(value + 1) / (value + 2)')} AS micro, sha256(concat_ws('|', CAST(event_id AS VARCHAR), event_type)) AS id_hash FROM events")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events")
    micro = S.microprice(F.lit(0.0), F.col("value") + 1, F.lit(1.0), F.lit(1.0))
    return x.select("event_id", settled(S.sigmoid(F.col("value") / 10)).alias("sig"), settled(S.clamp("value", 10, 30)).alias("clamped"), S.half_up("value", 1).alias("half_up"), settled(micro).alias("micro"), S.joined_hash("|", "event_id", "event_type").alias("id_hash"))
