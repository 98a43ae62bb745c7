"""Queries of predicates, gates, trading rules, screen differences and structured checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import settled, settled_sql
from tidemark.operators import book as B
from tidemark.operators import rules as R
from tidemark.operators import signals as G
from tidemark.plans.screening import _ALL, _screened
from tidemark.registry import query
from tidemark.sources.views import table, v_company, v_daily, with_views

_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date), b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_HEAT = {
    "heat": f"""SELECT ticker, date, turnover * 100 AS amount, {settled_sql('volume / avg(volume) OVER b')} AS volume_ratio, {settled_sql('turnover / avg(turnover) OVER b')} AS turnover_ratio, {settled_sql('(close / lag(close) OVER w - 1) * 100')} AS day_return,
        {settled_sql('(close - low) / (high - low)')} AS close_position, {settled_sql('(high - low) / close * 10')} AS atr_pct, ticker + 10 AS industry, 290.0 + ticker * 20 AS study_score FROM v_daily {_W}""",
    "hots": """SELECT *, floor((least(coalesce(volume_ratio, 0), 5) * 42 + least(coalesce(turnover_ratio, 0), 5) * 46 + greatest(0, least(8, coalesce(day_return, 0))) * 16 + greatest(0, least(1, coalesce(close_position, 0))) * 42
        + least(coalesce(amount, 0) / 1000000, 600) / 10 - greatest(0, coalesce(atr_pct, 0) - 3.5) * 8) * 100 + 0.5) / 100 AS hot_score,
        CASE WHEN industry = 17 THEN 'excluded-industry' WHEN coalesce(volume_ratio, 0) >= 1.2 AND coalesce(turnover_ratio, 0) >= 1.2 AND coalesce(day_return, 0) >= 1.8 AND coalesce(close_position, 0) >= 0.5 AND coalesce(amount, 0) >= 30000000 AND atr_pct <= 30 THEN 'hot' ELSE 'insufficient-heat' END AS gate FROM heat""",
    "edge": """SELECT *, floor((greatest(0, least(6, coalesce(day_return, 0))) * 0.28 + greatest(0, least(3, coalesce(volume_ratio, 0) - 1)) * 0.52 + greatest(0, least(3, coalesce(turnover_ratio, 0) - 1)) * 0.42 + greatest(0, least(1, coalesce(close_position, 0))) * 0.72
        + greatest(0, least(260, hot_score - 220)) / 260 * 0.75 + greatest(0, least(260, study_score - 300)) / 260 * 0.45 - greatest(0, coalesce(atr_pct, 0) - 4.2) * 0.28) * 1000 + 0.5) / 1000 AS edge_pct FROM hots""",
}


def _heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, b = W.partitionBy("ticker").orderBy("date"), W.partitionBy("ticker").orderBy("date").rowsBetween(-20, -1)
    return v_daily(spark, sf_dir).select(
        "ticker", "date", (F.col("turnover") * 100).alias("amount"), settled(F.col("volume") / F.avg("volume").over(b)).alias("volume_ratio"), settled(F.col("turnover") / F.avg("turnover").over(b)).alias("turnover_ratio"),
        settled((F.col("close") / F.lag("close").over(w) - 1) * 100).alias("day_return"), settled((F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))).alias("close_position"), settled((F.col("high") - F.col("low")) / F.col("close") * 10).alias("atr_pct"),
        (F.col("ticker") + 10).alias("industry"), (F.lit(290.0) + F.col("ticker") * 20).alias("study_score"),
    )


#: The gate at the size of the test tables.
FIXTURE_HEAT = {"volume_ratio": 1.2, "turnover_ratio": 1.2, "close_position": 0.5, "atr_pct": 30.0}


@query(with_views(f"SELECT ticker, date, gate, {settled_sql('hot_score', 1)} AS hot_score FROM hots", "v_daily", **_HEAT))
def hot_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _heat(spark, sf_dir).withColumn("gate", R.hot_gate(limits=FIXTURE_HEAT))
    return x.select("ticker", "date", "gate", settled(R.hot_score(), 1).alias("hot_score"))


@query(with_views(f"""SELECT ticker, date, {settled_sql('edge_pct', 2)} AS edge_pct, edge_pct >= 1.755 AS pays, CASE WHEN hot_score >= 390 AND edge_pct - 0.585 >= 2.2 THEN 1e0 WHEN hot_score >= 250 AND edge_pct - 0.585 >= 1 THEN 72e-2 ELSE 5e-1 END AS size_multiplier,
    CAST(greatest(0, floor(least(amount, amount / 2, amount * 2 / 3) * CASE WHEN edge_pct >= 1.755 THEN 1.0 ELSE 0.5 END)) AS BIGINT) AS budget FROM edge""", "v_daily", **_HEAT))  # fmt: skip
def cost_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.cost_gate(_heat(spark, sf_dir).withColumn("hot_score", R.hot_score()))
    budget = R.slot_budget("amount", F.col("amount") * 2, F.lit(3), F.lit(1), F.when(F.col("pays"), 1.0).otherwise(0.5))
    return x.select("ticker", "date", settled("edge_pct", 2).alias("edge_pct"), "pays", "size_multiplier", budget.alias("budget"))


_HOLD = """SELECT ticker, date, close, high, lag(close) OVER w AS pc, max(close) OVER p AS tc, lag(close, (k + 1)::INT) OVER w AS entry, k, CASE WHEN ticker % 2 = 0 THEN max(high) OVER q END AS bh FROM (SELECT *, (row_number() OVER (PARTITION BY ticker ORDER BY date) - 1) % 8 AS k FROM v_daily)
    WINDOW w AS (PARTITION BY ticker ORDER BY date), p AS (PARTITION BY ticker ORDER BY date ROWS 5 PRECEDING), q AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""


@query(with_views("""SELECT coalesce(reason, 'hold') AS reason, count(*) AS n FROM (SELECT CASE WHEN k + 1 < 3 THEN NULL WHEN r <= -0.055 THEN 'stop' WHEN r >= 0.13 THEN 'target' WHEN k + 1 >= 7 THEN 'time'
    WHEN NOT ((coalesce(close >= pc, false) OR coalesce(high >= coalesce(bh, tc), false)) AND coalesce(close >= tc * (1 - 0.035), false) AND r > 0) THEN 'no_continuation' END AS reason FROM (SELECT *, close / entry - 1 AS r FROM h) WHERE entry IS NOT NULL) GROUP BY 1""", "v_daily", h=_HOLD))  # fmt: skip
def holding_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("ticker").orderBy("date")
    x = v_daily(spark, sf_dir).withColumn("k", (F.row_number().over(w) - 1) % 8)
    past = [F.lag("close", n).over(w) for n in range(1, 9)]
    x = x.withColumn("entry", F.element_at(F.array(*past), F.col("k") + 1)).withColumn("pc", F.lag("close").over(w)).withColumn("tc", F.max("close").over(w.rowsBetween(-5, 0)))
    x = x.withColumn("bh", F.when(F.col("ticker") % 2 == 0, F.max("high").over(w.rowsBetween(-5, -1)))).where("entry IS NOT NULL").withColumn("r", F.col("close") / F.col("entry") - 1)
    reason = F.coalesce(G.exit_reason("r", "k", "close", "high", "pc", "tc", "bh"), F.lit("hold"))
    return x.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_EV = "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(value * 100 AS DOUBLE) END AS qa, value / 10 AS spread, event_type = 'error' AS err, user_id % 5 AS target, hour(ts) AS h FROM events"


@query(f"""SELECT event_id, array_to_string(list_filter([CASE WHEN qa IS NULL THEN 'BIDASK_MISSING' END, CASE WHEN qa > 5000 THEN 'BIDASK_STALE' END, CASE WHEN qa IS NOT NULL AND spread > 3 THEN 'SPREAD_LIMIT_EXCEEDED' END, CASE WHEN err THEN 'DATA_QUALITY_INVALID' END, CASE WHEN target = 4 THEN 'FEATURES_MISSING' END,
    CASE WHEN target = 3 AND h > 12 THEN 'POSITION_ALREADY_OPEN' END, CASE WHEN h = 23 THEN 'SESSION_ENDED' END], lambda x: x IS NOT NULL), ',') AS entry_reasons,
    CASE WHEN err THEN 'CONNECTION_INVALID' WHEN target <> 2 THEN 'TARGET_CODE_MISMATCH' WHEN h = 5 THEN 'ROLLOVER_UNCONFIRMED' WHEN spread * 1000 > 2500 THEN 'TICK_STALE' WHEN qa > 2000 THEN 'BIDASK_STALE' END AS health FROM ({_EV})""")
def entry_and_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an entry at each event would be refused, and the first failure of the feed."""
    x = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value * 100 END AS quote_age_ms", "value / 10 AS spread", "event_type <> 'error' AS quality_ok", "true AS model_ok", "user_id % 5 <> 4 AS features_ok",
        "user_id % 5 = 3 AND hour(ts) > 12 AS position_open", "hour(ts) = 23 AS session_ending", "true AS costs_ok", "user_id % 5 AS target", "hour(ts) AS h",
    )
    first = R.health_failure(F.lit(2), 2500.0, 2000.0)
    x = x.withColumn("rollover", F.lit(False)).withColumn("entry", F.array_join(R.entry_reasons(5000.0, 3.0), ","))
    x = x.withColumn("rollover", F.col("h") == 5).withColumn("connected", F.col("quality_ok")).withColumn("tick_age_ms", F.col("spread") * 1000).withColumn("quality_ok", F.lit(True))
    return x.select("event_id", F.col("entry").alias("entry_reasons"), first.alias("health"))


_POS = """SELECT *, CASE WHEN direction = 'LONG' THEN nl <= stop ELSE nh >= stop END AS st, CASE WHEN direction = 'LONG' THEN nh >= target ELSE nl <= target END AS tt FROM (SELECT ticker, date, close, CASE WHEN ticker % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, CASE WHEN ticker % 2 = 0 THEN close - 30000 ELSE close + 30000 END AS stop, CASE WHEN ticker % 2 = 0 THEN close + 30000 ELSE close - 30000 END AS target,
    lead(high) OVER w AS nh, lead(low) OVER w AS nl, [lead(open) OVER w, lead(low) OVER w, lead(high) OVER w] AS ticks, day(date) AS d, CASE WHEN ticker = 9 THEN NULL ELSE volume * 10 END AS qa FROM v_daily WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE nh IS NOT NULL"""


@query(with_views("""SELECT coalesce(reason, 'NONE') AS reason, direction, count(*) AS n FROM (SELECT direction, CASE WHEN st AND tt THEN CASE WHEN CASE WHEN direction = 'LONG' THEN t >= target ELSE t <= target END THEN 'PROFIT_TARGET' ELSE 'STOP_LOSS' END WHEN st THEN 'STOP_LOSS' WHEN tt THEN 'PROFIT_TARGET' WHEN d >= 25 THEN 'VERTICAL_BARRIER' WHEN d >= 20 THEN 'SESSION_END' WHEN qa IS NULL OR qa > 8000 THEN 'DATA_STALE' WHEN d < 5 THEN 'ROLLOVER' END AS reason
    FROM (SELECT *, list_filter(ticks, lambda p: (direction = 'LONG' AND (p <= stop OR p >= target)) OR (direction = 'SHORT' AND (p >= stop OR p <= target)))[1] AS t FROM pos)) GROUP BY ALL""", "v_daily", pos=_POS))  # fmt: skip
def position_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("ticker").orderBy("date")
    side = F.when(F.col("ticker") % 2 == 0, 1).otherwise(-1)
    x = v_daily(spark, sf_dir).select(
        F.when(side > 0, "LONG").otherwise("SHORT").alias("direction"), (F.col("close") - side * 30000).alias("stop"), (F.col("close") + side * 30000).alias("target"), F.lead("high").over(w).alias("high"), F.lead("low").over(w).alias("low"),
        F.array(F.lead("open").over(w), F.lead("low").over(w), F.lead("high").over(w)).alias("ticks"), F.dayofmonth("date").alias("at"), F.lit(25).alias("deadline"), F.lit(20).alias("session_end"), F.when(F.col("ticker") != 9, F.col("volume") * 10).alias("quote_age_ms"), (F.dayofmonth("date") < 5).alias("rollover"),
    ).where("high IS NOT NULL")
    return x.groupBy(F.coalesce(R.position_exit(8000.0), F.lit("NONE")).alias("reason"), "direction").agg(F.count("*").alias("n"))


@query(f"""SELECT l_orderkey, l_linenumber, {settled_sql('g', 3)} AS gross_points, {settled_sql('g * 10', 2)} AS gross_value, tax IS NOT NULL AS cost_complete, {settled_sql('g * 10 - (l_discount * 100 + tax * 50)', 2)} AS net_value
    FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN l_extendedprice / 100 - l_quantity ELSE l_quantity - l_extendedprice / 100 END AS g, CASE WHEN l_tax > 0.01 THEN l_tax END AS tax FROM lineitem)""")
def settled_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_returnflag = 'A' THEN 'LONG' ELSE 'SHORT' END AS direction", "l_quantity AS entry", "l_extendedprice / 100 AS exit", "l_discount * 100 AS fee", "CASE WHEN l_tax > 0.01 THEN l_tax * 50 END AS tax")
    x = R.settle(x, ["fee", "tax"])
    return x.select("l_orderkey", "l_linenumber", settled("gross_points", 3).alias("gross_points"), settled("gross_value", 2).alias("gross_value"), "cost_complete", settled("net_value", 2).alias("net_value"))


@query("SELECT code, name, equity, CASE WHEN length(ind) < 2 THEN lpad(ind, 2, '0') ELSE ind END AS industry FROM (SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_size IS NOT NULL AND p_partkey % 3 < 2 AND regexp_matches(CAST(p_partkey AS VARCHAR), '^[1-9][0-9]{3}$') AND p_size <> 25 AND NOT regexp_matches(p_name, '(?i)ETF|ETN|指數|特別股') AS equity, CAST(p_size AS VARCHAR) AS ind FROM part)")
def ordinary_equities(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"), "p_size", F.element_at(F.array(F.lit("TSE"), F.lit("OTC"), F.lit("OES")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("exchange"))
    return x.select("code", "name", R.is_ordinary_equity("exchange", "code", F.when(F.col("p_size") == 25, 1).when(F.col("p_size").isNotNull(), 1000), "name").alias("equity"), R.industry_code("p_size").alias("industry"))


_EXCHANGE = "CASE p_partkey % 3 WHEN 0 THEN 'TSE' WHEN 1 THEN 'OTC' ELSE 'OES' END"


@query(f"SELECT exchange, count(DISTINCT code) AS n, sha256(array_to_string(list_sort(list(DISTINCT code)), chr(10))) AS universe_hash FROM (SELECT lpad(CAST(p_partkey AS VARCHAR), 4, '1') AS code, {_EXCHANGE} AS exchange FROM part) WHERE exchange <> 'OES' AND code[1] <> '0' GROUP BY 1")
def frozen_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").selectExpr("lpad(CAST(p_partkey AS STRING), 4, '1') AS code", f"{_EXCHANGE} AS exchange", "1000 AS unit", "p_name AS name")
    return R.frozen_universe(x)


_SCREENS = {
    "scr": "SELECT ticker, date, close_pos <= 0.72 AS eligible, round(close) AS score, ticker % 4 AS market, volume >= 1000 AS big FROM (SELECT *, (close - low) / (high - low) AS close_pos FROM v_daily)",
    "scr2": "SELECT ticker, date, close_pos <= 0.5 AS eligible, CASE WHEN month(date) = 3 THEN score + 1 WHEN ticker = 5 THEN NULL ELSE score END AS score, CASE WHEN month(date) = 6 THEN NULL ELSE market END AS market, big FROM (SELECT s.*, (close - low) / (high - low) AS close_pos FROM scr s JOIN v_daily USING (ticker, date)) WHERE month(date) <> 12",
    "dif": "SELECT coalesce(b.ticker, a.ticker) AS ticker, coalesce(b.date, a.date) AS date, coalesce(b.eligible, false) AS was, coalesce(a.eligible, false) AS now, b.ticker IS NOT NULL AND a.ticker IS NOT NULL AS twice, b.score AS s0, a.score AS s1, b.market AS m0, a.market AS m1, b.big AS g0, a.big AS g1 FROM scr b FULL JOIN scr2 a ON a.ticker = b.ticker AND a.date = b.date",
}


@query(with_views("""SELECT ticker, date, unnest(list_filter([CASE WHEN now AND NOT was THEN 'added' END, CASE WHEN was AND NOT now THEN 'removed' END, CASE WHEN twice AND was <> now THEN 'eligibility' END, CASE WHEN twice AND s0 <> s1 THEN 'score' END,
    CASE WHEN twice AND s0 IS NOT NULL AND s1 IS NOT NULL AND m0 IS DISTINCT FROM m1 THEN 'market' END, CASE WHEN twice AND s0 IS NOT NULL AND s1 IS NOT NULL AND g0 IS DISTINCT FROM g1 THEN 'big' END], lambda x: x IS NOT NULL)) AS change FROM dif""", "v_daily", **_SCREENS))  # fmt: skip
def screen_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two screens of the same bars, the later one stricter and restated in some months."""
    bars = v_daily(spark, sf_dir).withColumn("p", (F.col("close") - F.col("low")) / (F.col("high") - F.col("low")))
    one = bars.select("ticker", "date", (F.col("p") <= 0.72).alias("eligible"), F.round("close").alias("score"), (F.col("ticker") % 4).alias("market"), (F.col("volume") >= 1000).alias("big"))
    month = F.month("date")
    two = bars.where(month != 12).select("ticker", "date", (F.col("p") <= 0.5).alias("eligible"), F.when(month == 3, F.round("close") + 1).when(F.col("ticker") == 5, None).otherwise(F.round("close")).alias("score"), F.when(month != 6, F.col("ticker") % 4).alias("market"), (F.col("volume") >= 1000).alias("big"))
    return R.screen_difference(one, two, ["ticker", "date"], ["market", "big"])


@query(with_views("SELECT ticker, date, array_to_string(list_sort(list_distinct(list(h) OVER f)), ',') AS lineage, max(date) OVER f AS lineage_available, count(*) OVER f AS lineage_rows FROM (SELECT *, substr(md5(CAST(CAST(volume AS BIGINT) % 97 AS VARCHAR)), 1, 6) AS h FROM v_daily) WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS 23 PRECEDING)", "v_daily"))
def candidate_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = v_daily(spark, sf_dir).withColumn("h", F.substring(F.md5((F.col("volume").cast("long") % 97).cast("string")), 1, 6))
    return R.lineage(x, ["ticker"], "date", "h", "date").select("ticker", "date", F.array_join("lineage", ",").alias("lineage"), "lineage_available", "lineage_rows")


@query("SELECT event_type, arg_min(event_id, sha256('3005:' || event_id)) AS event_id FROM events GROUP BY 1")
def source_audit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.audit_samples(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", "3005")


@query(with_views("SELECT count(*) AS candidates, " + settled_sql("count(*) FILTER (c AND t) / count(*) * 100") + " AS coverage_pct, count(*) FILTER (NOT t) AS violations, count(*) FILTER (NOT t) = 0 AS passed FROM (SELECT m IS NOT NULL AS c, pd IS NOT NULL AND date + CASE WHEN ticker = 3 THEN 1 ELSE 0 END <= date AS t FROM (SELECT *, lag(close, 3) OVER w AS m, lag(date) OVER w AS pd FROM v_daily WINDOW w AS (PARTITION BY ticker ORDER BY date)))", "v_daily"))
def dataset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("ticker").orderBy("date")
    late = F.date_add("date", F.when(F.col("ticker") == 3, 1).otherwise(0))
    x = v_daily(spark, sf_dir).select("date", F.array("close", F.lag("close", 3).over(w)).alias("features"), F.when(F.lag("date").over(w).isNotNull(), F.array(late)).otherwise(F.array().cast("array<date>")).alias("available"))
    return R.dataset_metrics(x, "features", "available", "date").withColumn("coverage_pct", settled("coverage_pct"))


@query("SELECT user_id, 5 AS requested, array_to_string(list_sort(list(DISTINCT event_type) FILTER (value > 10 AND event_type IN ('click', 'view', 'signup', 'error', 'purchase'))), ',') AS available, 5 - count(DISTINCT event_type) FILTER (value > 10 AND event_type IN ('click', 'view', 'signup', 'error', 'purchase')) AS missing FROM events GROUP BY 1")
def evidence_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By user the kinds of events that it has with a value over 10."""
    x = table(spark, sf_dir, "events").select("user_id", "value", F.col("event_type").alias("source"))
    y = R.evidence_availability(x, x.where("value > 10"), "user_id", ["click", "view", "signup", "error", "purchase"])
    return y.select("user_id", F.col("requested").cast("int").alias("requested"), F.when(F.size("available") > 0, F.array_join("available", ",")).alias("available"), F.size("unavailable").cast("long").alias("missing"))


_EPI = {"epi": "SELECT ticker AS series, row_number() OVER (PARTITION BY ticker ORDER BY date) AS number, date FROM v_daily", "itm": "SELECT series AS s, number AS item_number, date + CAST(number % 3 * 3 AS INTEGER) AS item_date FROM epi WHERE dayofyear(date) % 4 <> 1"}


@query(with_views("SELECT series, number, m.item_number, CASE WHEN m.item_number = number THEN 'ready' WHEN m.item_number IS NOT NULL THEN 'stale' ELSE 'transcript_missing' END AS status FROM (SELECT e.series, e.number, max(item_number) AS item_number FROM epi e LEFT JOIN itm ON s = series AND itm.item_number <= e.number AND item_date <= e.date + 3 GROUP BY ALL) m", "v_daily", **_EPI))
def episode_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as episodes of a show; research on them comes up to six days later, and not on all."""
    e = v_daily(spark, sf_dir).select(F.col("ticker").alias("series"), F.row_number().over(W.partitionBy("ticker").orderBy("date")).alias("number"), "date", F.date_add("date", 3).alias("as_of"))
    items = e.where("dayofyear(date) % 4 <> 1").select("series", F.col("number").alias("item_number"), F.date_add("date", (F.col("number") % 3 * 3).cast("int")).alias("item_date"))
    return R.episode_research(e, items, ["series"], "as_of").select("series", "number", "item_number", "status")


_JUDGE = {
    "jd": """SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'spike' WHEN 1 THEN 'tight_channel' WHEN 2 THEN 'normal_channel' WHEN 3 THEN 'trading_range' WHEN 4 THEN 'insufficient_data' ELSE 'other' END AS regime, CASE user_id % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS direction,
        CASE user_id % 4 WHEN 0 THEN 'bad' WHEN 1 THEN 'spike' END AS alt, CASE WHEN event_id % 4 < 3 THEN 'proceed' ELSE 'wait' END AS gate, CASE event_id % 5 WHEN 0 THEN 'wait' WHEN 1 THEN 'avoid' ELSE 'enter' END AS stance, CASE WHEN event_id % 7 = 0 THEN value ELSE floor(value) END AS confidence,
        event_id % 19 <> 0 AS decided, CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 9 = 0 THEN 3 ELSE 4 END AS walked,
        CASE WHEN event_id % 2 = 0 THEN value + 100 END AS entry, CASE WHEN event_id % 2 = 0 THEN 100 - value / 10 END AS stop, CASE WHEN event_id % 2 = 0 THEN value + 100 + user_id % 60 END AS target, value + 100 AS fact FROM events WHERE event_id % 23 <> 0""",
    "tr": "SELECT jd.*, k, CASE k WHEN 1 THEN 'ok' WHEN 2 THEN CASE WHEN event_id % 5 = 0 THEN 'spike' ELSE regime END WHEN 3 THEN CASE WHEN event_id % 10 = 1 THEN 'neutral' ELSE direction END ELSE 'ok' END AS branch, (event_id + k) % 6 <> 0 AS known, k = 1 AND event_id % 17 = 0 AS unknown FROM jd, (SELECT unnest(generate_series(1, 4)) AS k) WHERE k <= walked",
    "plan": "SELECT *, decided AND stance = 'enter' AND entry IS NOT NULL AS planned, CASE WHEN direction <> 'bearish' THEN stop < entry AND entry < target ELSE target < entry AND entry < stop END AS ordered FROM jd",
    "errs": """SELECT event_id, 'BAD_SHAPE' AS code FROM events WHERE event_id % 23 = 0 UNION ALL SELECT event_id, 'BAD_ENUM' FROM jd WHERE regime = 'other' UNION ALL SELECT event_id, 'BAD_ENUM' FROM jd WHERE alt = 'bad' UNION ALL SELECT event_id, 'BAD_TYPE' FROM jd WHERE confidence <> floor(confidence) UNION ALL SELECT event_id, 'BAD_SHAPE' FROM jd WHERE walked = 0
        UNION ALL SELECT event_id, 'MISSING_NODE' FROM jd, range(1, 5) k(i) WHERE gate = 'proceed' AND i > walked UNION ALL SELECT event_id, 'NO_EVIDENCE' FROM tr WHERE NOT known AND NOT unknown UNION ALL SELECT event_id, 'UNKNOWN_FACT' FROM tr WHERE unknown
        UNION ALL SELECT event_id, 'TRACE_CONFLICT' FROM tr WHERE k = 2 AND branch <> regime AND branch IS DISTINCT FROM alt UNION ALL SELECT event_id, 'TRACE_CONFLICT' FROM tr WHERE k = 3 AND branch <> direction
        UNION ALL SELECT event_id, 'GATE_VIOLATION' FROM jd, range(2) WHERE decided AND gate = 'wait' AND entry IS NOT NULL UNION ALL SELECT event_id, 'GATE_VIOLATION' FROM jd WHERE decided AND gate = 'wait' AND stance = 'enter'
        UNION ALL SELECT event_id, 'PRICE_ORDER' FROM plan WHERE planned AND NOT ordered UNION ALL SELECT event_id, 'RR_TOO_LOW' FROM plan WHERE planned AND ordered AND abs(target - entry) < abs(entry - stop)
        UNION ALL SELECT event_id, 'UNKNOWN_FACT' FROM jd WHERE event_id % 13 = 0 UNION ALL SELECT event_id, 'FACT_VALUE_MISMATCH' FROM jd WHERE event_id % 13 <> 0 AND NOT abs(fact + event_id % 3 - fact) <= 0.005 * fact
        UNION ALL SELECT event_id, 'UNANCHORED_PRICE' FROM jd, (VALUES (0), (1), (2)) k(i) WHERE decided AND entry IS NOT NULL AND NOT abs(CASE i WHEN 0 THEN entry WHEN 1 THEN stop ELSE target END - fact) <= 0.03 * fact""",
}


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events")
    even = lambda v: f"CASE WHEN event_id % 2 = 0 THEN {v} END"
    y = x.selectExpr(
        "event_id", "event_id % 23 <> 0 AS diagnosed", "event_id % 19 <> 0 AS decided", "CASE user_id % 4 WHEN 0 THEN 'bad' WHEN 1 THEN 'spike' END AS alternative_regime",
        "element_at(array('spike', 'tight_channel', 'normal_channel', 'trading_range', 'insufficient_data', 'other'), CAST(user_id % 6 AS INT) + 1) AS regime", "element_at(array('bullish', 'bearish', 'neutral'), CAST(user_id % 3 AS INT) + 1) AS direction",
        "CASE WHEN event_id % 4 < 3 THEN 'proceed' ELSE 'wait' END AS gate_result", "CASE event_id % 5 WHEN 0 THEN 'wait' WHEN 1 THEN 'avoid' ELSE 'enter' END AS stance", "CASE WHEN event_id % 7 = 0 THEN value ELSE CAST(floor(value) AS DOUBLE) END AS confidence",
        f"{even('value + 100')} AS active_entry", "CAST(NULL AS DOUBLE) AS patient_entry", f"{even('value + 100 + user_id % 60')} AS take_profit", f"{even('100 - value / 10')} AS stop_loss",
    )
    branches = F.expr("array('ok', CASE WHEN event_id % 5 = 0 THEN 'spike' ELSE regime END, CASE WHEN event_id % 10 = 1 THEN 'neutral' ELSE direction END, 'ok')")
    ids = lambda k: F.when((k == 1) & (F.col("event_id") % 17 == 0), F.when((F.col("event_id") + k) % 6 != 0, F.array(F.lit("F1"), F.lit("F9"))).otherwise(F.array(F.lit("F9")))).when((F.col("event_id") + k) % 6 != 0, F.array(F.lit("F1")))
    node = lambda k: F.struct(F.concat(F.lit("D"), k.cast("string")).alias("node"), F.element_at("_branches", k).alias("branch"), ids(k).alias("facts"))
    walked = F.expr("CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 9 = 0 THEN 3 ELSE 4 END")
    j = y.withColumn("_branches", branches).withColumn("trace", F.slice(F.transform(F.sequence(F.lit(1), F.lit(4)), node), F.lit(1), walked)).drop("_branches")
    facts = x.selectExpr("event_id", "'F1' AS fact_id", "value + 100 AS fact")
    cited = x.selectExpr("event_id", "CASE WHEN event_id % 13 = 0 THEN 'F9' ELSE 'F1' END AS fact_id", "value + 100 + event_id % 3 AS value")
    return R.judgement_errors(j, cited, facts, "event_id")


@query(with_views("SELECT event_id, code, count(*) AS n FROM errs GROUP BY ALL", **_JUDGE))
def judgement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("event_id", "code").agg(F.count("*").alias("n"))


@query(with_views("SELECT CASE WHEN code IN ('MISSING_NODE', 'NO_EVIDENCE') THEN 'missing' WHEN code IN ('TRACE_CONFLICT', 'GATE_VIOLATION', 'RR_TOO_LOW', 'PRICE_ORDER') THEN 'inconsistency' WHEN code IN ('UNKNOWN_FACT', 'FACT_VALUE_MISMATCH', 'UNANCHORED_PRICE') THEN 'untraceable' ELSE 'schema' END AS category, count(*) AS n FROM errs GROUP BY 1", **_JUDGE))
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by_category(_judged(spark, sf_dir))


_PRE = {
    "pre0": "SELECT ticker, date, lag(close) OVER w AS before, close, lead(open) OVER w AS opened, (close / lag(close) OVER w - 1) * 3 AS fx, (close - lag(close) OVER w) / 20 AS bs, month(date) AS m, CASE WHEN ticker = 7 THEN '' ELSE 'dow=' || CAST(round((high / close - 1) * 3, 4) AS VARCHAR) || ', sox = ' || CAST(round((low / close - 1) * 3, 4) AS VARCHAR) END AS moves, (high / close - 1) * 3 AS mx, (low / close - 1) * 3 AS mn FROM v_daily WINDOW w AS (PARTITION BY ticker ORDER BY date)",
    "pre1": "SELECT *, CASE WHEN fx IS NULL THEN 'missing' WHEN fx <= -0.1 THEN 'bullish' WHEN fx >= 0.1 THEN 'bearish' ELSE 'neutral' END AS vf, CASE WHEN bs IS NULL THEN 'missing' WHEN bs > 100 THEN 'bullish' WHEN bs < -100 AND NOT (m IN (6, 7, 8) AND bs >= -300) THEN 'bearish' ELSE 'neutral' END AS vb, CASE WHEN before IS NULL OR opened IS NULL THEN 'insufficient' WHEN (close - before) / before * 100 >= 5 THEN 'last_minute_pull_up' WHEN (close - before) / before * 100 <= -5 THEN CASE WHEN opened >= close THEN 'last_minute_press_down_held' ELSE 'last_minute_press_down_failed' END ELSE 'stable' END AS auction FROM pre0",
    "pre2": "SELECT *, CASE WHEN ticker = 7 OR vb = 'missing' THEN 'missing' WHEN round(greatest(mx, mn), 4) >= 1 AND vb <> 'bullish' THEN 'taiwan_weaker_than_us' WHEN (round(mx, 4) + round(mn, 4)) / 2 <= -1 AND vb <> 'bearish' THEN 'taiwan_resilient' ELSE 'aligned' END AS rel FROM pre1",
}


@query(with_views("""SELECT vf AS fx, vb AS basis, rel AS relative, auction, CASE WHEN NOT (vf <> 'missing' AND vb <> 'missing' AND auction <> 'insufficient') THEN 'insufficient' WHEN (vf IN ('bullish', 'bearish') AND vb IN ('bullish', 'bearish') AND vf <> vb) OR rel = 'taiwan_weaker_than_us' OR auction = 'last_minute_pull_up' OR ticker = 2 THEN 'conflict'
    WHEN vf = 'bearish' AND vb = 'bearish' THEN 'bearish' WHEN vf = 'bullish' AND vb = 'bullish' THEN 'bullish' ELSE 'neutral' END AS environment, count(*) AS n FROM pre2 GROUP BY ALL""", "v_daily", **_PRE))  # fmt: skip
def preopen_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as mornings: currency, basis, moves abroad as text, auction and excluded branches."""
    w = W.partitionBy("ticker").orderBy("date")
    change = F.col("close") / F.lag("close").over(w) - 1
    text = lambda x: F.round((F.col(x) / F.col("close") - 1) * 3, 4).cast("string")
    x = v_daily(spark, sf_dir).select("ticker", F.lag("close").over(w).alias("before"), "close", F.lead("open").over(w).alias("opened"), (change * 3).alias("f"), ((F.col("close") - F.lag("close").over(w)) / 20).alias("b"), F.month("date").alias("m"), F.when(F.col("ticker") == 7, "").otherwise(F.concat(F.lit("dow="), text("high"), F.lit(", sox = "), text("low"))).alias("moves"))
    x = x.withColumn("fx", B.currency_view("f")).withColumn("basis", B.basis_view("b", "m")).withColumn("auction", B.auction_state("before", "close", "opened", 5.0)).withColumn("relative", B.relative_strength(B.moves_of("moves"), "basis"))
    complete = (F.col("fx") != "missing") & (F.col("basis") != "missing") & (F.col("auction") != "insufficient")
    env = B.preopen_environment("fx", "basis", "relative", F.col("auction") == "last_minute_pull_up", F.col("ticker") == 2, complete)
    return x.groupBy("fx", "basis", "relative", "auction", env.alias("environment")).agg(F.count("*").alias("n"))


@query(with_views("SELECT ticker, date, close FROM v_daily WHERE date = (SELECT max(date) FROM v_daily WHERE date <= DATE '1996-06-30')", "v_daily"))
def latest_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last bars known at the middle of 1996."""
    return R.latest_as_of(v_daily(spark, sf_dir), "date", F.lit("1996-06-30").cast("date")).select("ticker", "date", "close")


@query(with_views("SELECT ticker, date, close FROM v_daily WHERE ticker = 4 AND date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'", "v_daily"))
def ticker_in_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.between_dates(R.of_ticker(v_daily(spark, sf_dir), F.lit("4"), ["code", "ticker", "stock_id"]), "date", "1994-01-01", "1995-12-31")
    return R.shaped(x, ["ticker", "date", "nothing", "close"], None)


@query(with_views("SELECT CAST(row_number() OVER (ORDER BY abs(net) DESC, industry) AS INTEGER) AS place, industry, " + settled_sql("net", 2) + " AS net FROM (SELECT industry, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END) AS net FROM orders JOIN v_company ON code = o_custkey GROUP BY 1)", "v_company"))
def sector_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries by the size of their net flow, whatever its sign."""
    x = table(spark, sf_dir, "orders").join(v_company(spark, sf_dir), F.col("o_custkey") == F.col("code"))
    x = x.groupBy("industry").agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))).alias("net"))
    return R.numbered(x, [F.abs("net").desc(), F.col("industry")], []).select("place", "industry", settled("net", 2).alias("net"))


@query(with_views("SELECT market, change_label, ticker, date FROM (SELECT *, row_number() OVER (PARTITION BY change_label ORDER BY date DESC, ticker) AS place FROM (SELECT ticker, date, 'all' AS market, CASE WHEN r IS NULL THEN 'artifact-only' WHEN r <= -2 THEN 'risk-off' WHEN r >= 1 THEN 'risk-on' ELSE 'rotation' END AS change_label FROM (SELECT *, (close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1) * 100 AS r FROM v_daily))) WHERE place <= 5", "v_daily"))
def newest_by_market_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market labels of changes, and of each label the five newest records."""
    r = (F.col("close") / F.lag("close").over(W.partitionBy("ticker").orderBy("date")) - 1) * 100
    x = v_daily(spark, sf_dir).select("ticker", "date", F.lit("all").alias("market"), R.market_label(r).alias("change_label"))
    return R.numbered(x, [F.col("date").desc(), F.col("ticker")], ["change_label"], most=5).select("market", "change_label", "ticker", "date")


@query(with_views("SELECT ticker, date, n, CAST(place AS INTEGER) AS place FROM (SELECT ticker, date, len(reasons) AS n, row_number() OVER (PARTITION BY ticker ORDER BY len(reasons), date DESC) AS place FROM screened WHERE len(reasons) > 0)", "v_daily", "v_flow", **_ALL))
def rejected_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected bars of each ticker, the nearest misses and newest first."""
    x = _screened(spark, sf_dir).where("NOT eligible").select("ticker", "date", F.size("reasons").alias("n"))
    return R.numbered(x, [F.col("n"), F.col("date").desc()], ["ticker"]).select("ticker", "date", F.col("n").cast("long").alias("n"), "place")


@query("SELECT user_id, array_to_string(list_sort(list_filter(list(DISTINCT event_type), lambda t: t NOT IN ('view', 'error'))), ',') AS topics, len(list_distinct(list_concat(list(DISTINCT event_type) FILTER (value > 40), list(DISTINCT event_type) FILTER (value < 1)))) AS watched FROM events GROUP BY 1")
def topics_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a user but for generic ones, and the union of two lists."""
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"), F.collect_set(F.when(F.col("value") > 40, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") < 1, F.col("event_type"))).alias("b"))
    return x.select("user_id", F.array_join(F.array_sort(F.array_except("t", F.array(F.lit("view"), F.lit("error")))), ",").alias("topics"), F.size(F.array_union("a", "b")).cast("long").alias("watched"))
