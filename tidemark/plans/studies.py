"""Queries of sectors, flows, funds and studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import settled, settled_sql
from tidemark.operators import daily as D
from tidemark.operators import flows as L
from tidemark.plans.screening import _STATE
from tidemark.registry import query
from tidemark.sources.views import table, v_company, v_daily, v_flow, v_holdings, with_views

_QUOTES = "SELECT l_suppkey AS code, sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) - arg_min(l_extendedprice, l_orderkey * 10 + l_linenumber) AS change FROM lineitem GROUP BY 1"
_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume, turnover and change by supplier, between lines with prices; of those with one number the one that is stored first counts, on any partitioning."""
    seq, price = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_extendedprice")
    at = lambda order: F.when(price.isNotNull() & seq.isNotNull(), F.struct(order, F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    first, last = F.min_by(price, at(seq)), F.min_by(price, at(-seq))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover"), (last - first).alias("change"))


_HEAT = "SELECT coalesce(industry, 'unknown') AS industry, count(*) AS stocks, sum(volume) AS volume, {t} AS turnover, count(*) FILTER (change > 0) AS up, count(*) FILTER (change < 0) AS down FROM quotes LEFT JOIN v_company USING (code) GROUP BY 1"


@query(with_views(_HEAT.format(t=settled_sql("sum(turnover)", 2)), "v_company", quotes=_QUOTES))
def sector_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sector_heat(_quotes(spark, sf_dir), v_company(spark, sf_dir)).withColumn("turnover", settled("turnover", 2))


@query(with_views("SELECT industry, code, volume, CAST(place AS INTEGER) AS place FROM (SELECT industry, code, volume, row_number() OVER (PARTITION BY industry ORDER BY volume DESC, code) AS place FROM quotes JOIN v_company USING (code)) WHERE place <= 3", "v_company", quotes=_QUOTES))
def sector_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most traded stocks of each industry."""
    x = _quotes(spark, sf_dir).join(v_company(spark, sf_dir), "code")
    return L.top_rows(x, ["industry"], [F.col("volume").desc(), F.col("code")], 3).select("industry", "code", "volume", "place")


_CLASS = "CASE WHEN regexp_matches(investor, '(?i)foreign|外資') THEN 'foreign' WHEN regexp_matches(investor, '(?i)trust|投信') THEN 'trust' WHEN regexp_matches(investor, '(?i)dealer|自營') THEN 'dealer' END"
#: What the test tables' customer segments stand for.
_SEGMENTS = "CASE c_mktsegment WHEN 'MACHINERY' THEN 'Foreign_Investor' WHEN 'AUTOMOBILE' THEN '投信' WHEN 'BUILDING' THEN 'Dealer_self' WHEN 'FURNITURE' THEN 'Dealer_Hedging' ELSE 'other' END"
_STOCK_FLOW = f"SELECT o_custkey AS code, {_SEGMENTS} AS investor, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE -1.0 END AS lots FROM orders JOIN customer ON o_custkey = c_custkey"
_PRICES = "SELECT l_suppkey AS code, max(l_extendedprice) AS close FROM lineitem GROUP BY 1"


@query(with_views(f"SELECT industry, {', '.join(settled_sql(f'sum(CASE WHEN class = {k!r} THEN lots * close ELSE 0 END)', 2) + f' AS {k}' for k in ('foreign', 'trust', 'dealer'))}, {settled_sql('sum(lots * close)', 2)} AS total FROM (SELECT *, {_CLASS} AS class FROM sflow) JOIN prices USING (code) JOIN v_company USING (code) GROUP BY 1", "v_company", sflow=_STOCK_FLOW, prices=_PRICES))
def sector_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_custkey AS code", f"{_SEGMENTS} AS investor", "CASE WHEN o_orderstatus = 'F' THEN 1.0D ELSE -1.0D END AS lots")
    prices = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(F.max("l_extendedprice").alias("close"))
    x = L.sector_flow(flows, prices, v_company(spark, sf_dir))
    return x.select("industry", *[settled(k, 2).alias(k) for k in ("foreign", "trust", "dealer", "total")])


@query(with_views(f"SELECT date, {settled_sql('m', 2)} AS machinery, {settled_sql('b', 2)} AS building FROM (SELECT date, sum(net) FILTER (investor = 'MACHINERY') AS m, sum(net) FILTER (investor = 'BUILDING') AS b FROM v_flow GROUP BY 1) WHERE m IS NOT NULL AND b IS NOT NULL", "v_flow"))
def institutional_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = L.pivot_complete(v_flow(spark, sf_dir), ["MACHINERY", "BUILDING"])
    return x.select("date", settled("MACHINERY", 2).alias("machinery"), settled("BUILDING", 2).alias("building"))


@query(with_views(f"SELECT ticker, investor, {settled_sql('sum(net)', 2)} AS net, count(DISTINCT date) AS dates FROM (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM v_flow) WHERE r <= 5 GROUP BY ALL", "v_flow"))
def flow_of_last_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.net_of_last_dates(v_flow(spark, sf_dir), 5).withColumn("net", settled("net", 2))


@query(with_views("SELECT ticker, CAST(arg_max(run, date) AS BIGINT) AS streak_now, CAST(max(run) AS BIGINT) AS streak_longest FROM run GROUP BY 1", "v_flow",
    net="SELECT ticker, date, CASE WHEN count(*) FILTER (net IS NULL) = 0 THEN sum(net) END AS net FROM v_flow GROUP BY 1, 2",
    br="SELECT *, sum(CASE WHEN net > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS island FROM net",
    run="SELECT *, sum(CASE WHEN net > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, island ORDER BY date) AS run FROM br"))
def buying_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.buying_streaks(D.daily_net(v_flow(spark, sf_dir), ["ticker", "date"]))


@query(with_views(f"SELECT code, date, {settled_sql('share')} AS share, share > lag(share) OVER (PARTITION BY code ORDER BY date) AS rising FROM (SELECT fund AS code, date, sum(price) AS share FROM v_holdings WHERE lots >= 30 GROUP BY 1, 2)", "v_holdings"))
def large_holder_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = v_holdings(spark, sf_dir).select(F.col("fund").alias("code"), "date", F.concat(F.col("lots").cast("long").cast("string"), F.lit("-1,000,000 lots")).alias("level"), F.col("price").alias("percent"))
    return L.large_holders(levels, 30).withColumn("share", settled("share"))


@query(with_views(f"SELECT trend, count(*) AS n, {settled_sql('avg(forward)', 4)} AS mean, {settled_sql('count(*) FILTER (forward > 0) / count(*) * 100', 4)} AS win_pct, {settled_sql('max(forward)', 4)} AS best, {settled_sql('min(forward)', 4)} AS worst FROM (SELECT trend, (lead(close, 5) OVER w / close - 1) * 100 AS forward FROM state {_W}) WHERE forward IS NOT NULL GROUP BY 1", "v_daily", **_STATE))
def forward_return_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = L.return_summary(L.forward_returns(D.hma_state(v_daily(spark, sf_dir)), 5), ["trend"])
    return x.select("trend", "n", *[settled(k, 4).alias(k) for k in ("mean", "win_pct", "best", "worst")])


@query(with_views(f"""SELECT ticker, count(*) AS signals, count(*) FILTER (later > 0) AS checked, count(*) FILTER (later > 0 AND (under OR (lowest - close) / close <= -0.03)) AS false_ones, {settled_sql('count(*) FILTER (later > 0 AND (under OR (lowest - close) / close <= -0.03)) / count(*) * 100', 4)} AS false_rate
    FROM (SELECT *, bool_or(close < hma) OVER n AS under, min(close) OVER n AS lowest, count(*) OVER n AS later FROM state WINDOW n AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) WHERE close_before <= hma_before AND close > hma GROUP BY 1""", "v_daily", **_STATE))  # fmt: skip
def false_breakout_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.false_breakouts(D.hma_state(v_daily(spark, sf_dir)), 3).withColumn("false_rate", settled("false_rate", 4))


@query(with_views("SELECT ticker, count(*) FILTER (ok) AS confirmed, count(*) AS bars FROM (SELECT ticker, volume / avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) >= 1.2 AS ok FROM v_daily) GROUP BY 1", "v_daily"))
def volume_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = v_daily(spark, sf_dir)
    return x.withColumn("ok", L.volume_confirmed(x, 5)).groupBy("ticker").agg(F.count_if("ok").alias("confirmed"), F.count("*").alias("bars"))


_LIQ = "SELECT ticker, count(*) AS bars, avg(volume) AS v, avg(volume * close) AS t, least(avg(volume) / 500, avg(volume * close) / 2e7) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM v_daily) WHERE r <= 20 GROUP BY 1"


@query(with_views(f"SELECT ticker, bars, {settled_sql('v', 4)} AS avg_volume, {settled_sql('t', 2)} AS avg_turnover, ratio >= 1 AS eligible, CASE WHEN ratio >= 1 THEN 'liquid' ELSE 'thin' END AS status, CAST(greatest(0, least(100, floor(ratio * 100 + 0.5))) AS BIGINT) AS score, CAST(floor(v * 0.02) AS BIGINT) AS max_shares, CAST(floor(floor(v * 0.02) / 1000) AS BIGINT) AS max_lots FROM liq", "v_daily", liq=_LIQ))
def liquidity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = L.liquidity(v_daily(spark, sf_dir), 20, min_volume=500.0)
    return x.select("ticker", "bars", settled("avg_volume", 4).alias("avg_volume"), settled("avg_turnover", 2).alias("avg_turnover"), "eligible", "status", "score", "max_shares", "max_lots")


def _fr(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"


@query(with_views(f"SELECT ticker, date, {', '.join(settled_sql(f'CASE WHEN count(*) {_fr(n)} = {n} THEN avg(close) {_fr(n)} END', 4) + f' AS ma{n}' for n in (5, 10, 20))}, {settled_sql(f'CASE WHEN count(*) {_fr(20)} = 20 THEN turnover / avg(turnover) {_fr(20)} END')} AS turnover_ratio, CASE WHEN count(*) {_fr(20)} = 20 THEN max(high) {_fr(20)} END AS high20, CASE WHEN count(*) {_fr(20)} = 20 THEN min(low) {_fr(20)} END AS low20, {settled_sql(f'CASE WHEN count(*) {_fr(20)} = 20 AND max(high) {_fr(20)} > min(low) {_fr(20)} THEN (max(high) {_fr(20)} - close) / (max(high) {_fr(20)} - min(low) {_fr(20)}) * 100 END', 4)} AS retracement FROM v_daily", "v_daily"))
def moving_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = L.moving_facts(v_daily(spark, sf_dir))
    return x.select("ticker", "date", *[settled(f"ma{n}", 4).alias(f"ma{n}") for n in (5, 10, 20)], settled("turnover_ratio").alias("turnover_ratio"), "high20", "low20", settled("retracement", 4).alias("retracement"))


@query(with_views(f"""SELECT ticker, {settled_sql('peak', 4)} AS peak, peak_date, {settled_sql('trough', 4)} AS trough, trough_date, recovery_date, {settled_sql('dd', 4)} AS drawdown_pct FROM (SELECT *, lead(peak_date) OVER (PARTITION BY ticker ORDER BY ep) AS recovery_date, (trough / peak - 1) * 100 AS dd FROM eps) WHERE dd <= -40""", "v_daily",
    run="SELECT *, max(close) OVER (PARTITION BY ticker ORDER BY date) AS peak FROM v_daily",
    isl="SELECT *, sum(CASE WHEN close >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date) AS ep FROM run",
    eps="SELECT ticker, ep, first(peak) AS peak, min(date) AS peak_date, min(close) AS trough, arg_min(date, close) AS trough_date FROM isl GROUP BY 1, 2"))
def drawdown_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = L.drawdown_episodes(v_daily(spark, sf_dir), ["ticker"], 40.0)
    return x.select("ticker", settled("peak", 4).alias("peak"), "peak_date", settled("trough", 4).alias("trough"), "trough_date", "recovery_date", settled("drawdown_pct", 4).alias("drawdown_pct"))


@query(with_views(f"SELECT ticker, date, {settled_sql('CASE WHEN count(close) OVER f = 26 THEN CASE WHEN stddev_pop(close) OVER f > 0 THEN (close - avg(close) OVER f) / stddev_pop(close) OVER f ELSE 0 END END', 4)} AS z FROM v_daily WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)", "v_daily"))
def trailing_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = v_daily(spark, sf_dir)
    return x.select("ticker", "date", settled(L.trailing_zscore(x, ["ticker"], "date", "close", 26), 4).alias("z"))


@query(with_views(f"SELECT ticker, count(*) AS holds, {settled_sql('exp(sum(ln(1 + ret))) - 1')} AS compounded FROM (SELECT ticker, lead(close) OVER w / close - 1 AS ret FROM (SELECT *, row_number() OVER w - 1 AS i FROM v_daily {_W}) WHERE i % 4 = 0 {_W}) WHERE ret IS NOT NULL GROUP BY 1", "v_daily"))
def non_overlapping_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.non_overlapping(v_daily(spark, sf_dir), ["ticker"], 4).withColumn("compounded", settled("compounded"))


_EDGES = "SELECT fund, code, lots, lots - coalesce(before, 0) AS change, (lots - coalesce(before, 0)) * price * 1000 / 1e8 AS net_value FROM (SELECT *, lag(lots) OVER w AS before, lead(lots) OVER w AS nxt FROM v_holdings WINDOW w AS (PARTITION BY fund, code ORDER BY date, lots, price)) WHERE nxt IS NULL"


@query(with_views(f"SELECT fund, count(*) AS stocks, sum(lots) AS lots, {settled_sql('sum(net_value)', 5)} AS net_value FROM edges GROUP BY 1", "v_holdings", edges=_EDGES))
def fund_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fund_edges(v_holdings(spark, sf_dir)).groupBy("fund").agg(F.count("*").alias("stocks"), F.sum("lots").alias("lots"), settled(F.sum("net_value"), 5).alias("net_value"))


@query(with_views("SELECT code, count(*) AS funds, arg_max(fund, lots * 1000 - fund) AS largest_fund, sum(lots) AS lots FROM edges GROUP BY 1", "v_holdings", edges=_EDGES))
def stock_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.holders_of(L.fund_edges(v_holdings(spark, sf_dir)))


@query(with_views(f"SELECT fund, code, {settled_sql('net_value', 5)} AS net_value, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY fund ORDER BY abs(net_value) DESC, code) AS place FROM edges) WHERE place <= 5", "v_holdings", edges=_EDGES))
def fund_largest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = L.top_rows(L.fund_edges(v_holdings(spark, sf_dir)), ["fund"], [F.abs("net_value").desc(), F.col("code")], 5)
    return x.select("fund", "code", settled("net_value", 5).alias("net_value"), "place")


@query(with_views(f"SELECT d.ticker, d.date, n.date AS matched_ts, {settled_sql('n.net', 2)} AS net, CAST(d.date - n.date AS INTEGER) AS age_days FROM v_daily d ASOF LEFT JOIN net n ON d.ticker = n.ticker AND d.date >= n.date", "v_daily", "v_flow",
    net="SELECT * FROM (SELECT ticker, date, CASE WHEN count(*) FILTER (net IS NULL) = 0 THEN sum(net) END AS net FROM v_flow GROUP BY 1, 2) WHERE net IS NOT NULL"))
def chip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = L.chip_events(v_daily(spark, sf_dir), D.daily_net(v_flow(spark, sf_dir), ["ticker", "date"]))
    return x.select("ticker", "date", "matched_ts", settled("net", 2).alias("net"), "age_days")


_DECIDED = {
    **_STATE,
    "dec0": """SELECT *, close_before <= hma_before AND close > hma AS cu, close_before >= hma_before AND close < hma AS cd,
        avg(volume) OVER l >= 500 AND avg(volume * close) OVER l >= 2e7 AS liquid, coalesce(volume / avg(volume) OVER b >= 1.2, false) AS confirmed FROM state
        WINDOW l AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "dec1": f"SELECT *, last_value(CASE WHEN cu THEN 'buy' WHEN cd THEN 'sell' END IGNORE NULLS) OVER w AS sg FROM dec0 {_W}",
    "decided": """SELECT *, CASE WHEN NOT liquid THEN 'avoid_liquidity' WHEN trend IN ('bullish', 'bullish_reversal') AND confirmed THEN CASE WHEN sg = 'buy' THEN 'buy_watch' ELSE 'hold_or_scale' END
        WHEN trend IN ('bullish', 'bullish_reversal', 'weak_bullish') THEN 'wait_pullback' WHEN trend IN ('bearish', 'bearish_reversal') THEN 'avoid_trend' ELSE 'watch' END AS decision
        FROM dec1 WHERE hma IS NOT NULL AND close_before IS NOT NULL""",
}


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.decisions(D.hma_state(v_daily(spark, sf_dir)), 20, min_volume=500.0)


@query(with_views("SELECT ticker, date, trend, liquid, confirmed, sg AS last_signal, decision FROM decided", "v_daily", **_DECIDED))
def daily_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("ticker", "date", "trend", "liquid", "confirmed", "last_signal", "decision")


_SCORE = "greatest(0, least(100, CASE WHEN trend IN ('bullish', 'bullish_reversal') THEN 35 WHEN trend = 'weak_bullish' THEN 20 WHEN trend IN ('bearish', 'bearish_reversal') THEN -20 ELSE 0 END + CASE WHEN confirmed THEN 25 ELSE 0 END + CASE WHEN liquid THEN 15 ELSE -30 END + CASE WHEN bought THEN 25 ELSE 0 END + CASE WHEN fwd > 0 THEN 10 ELSE 0 END + CASE WHEN fr <= 30 THEN 5 ELSE 0 END))"


@query(with_views(f"""SELECT ticker, date, CAST(score AS INTEGER) AS score, CASE WHEN NOT liquid THEN 'avoid_or_reduce_size' WHEN trend IN ('bearish', 'bearish_reversal') THEN 'avoid_or_reduce' WHEN trend IN ('bullish', 'bullish_reversal') AND confirmed AND bought AND score >= 70 THEN 'follow_in_steps'
    WHEN trend IN ('bullish', 'bullish_reversal', 'weak_bullish') THEN 'wait_for_pullback' ELSE 'watch' END AS advice FROM (SELECT *, {_SCORE} AS score FROM ctx)""", "v_daily", "v_flow", **_DECIDED,
    nets="SELECT ticker, date, sum(net) AS net FROM v_flow GROUP BY 1, 2",
    ctx="SELECT d.*, coalesce(n.net > 0, false) AS bought, (close / lag(close, 3) OVER (PARTITION BY d.ticker ORDER BY d.date) - 1) * 100 AS fwd, 25.0 + d.ticker AS fr FROM decided d LEFT JOIN nets n ON n.ticker = d.ticker AND n.date = d.date"))
def signal_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and advice of each bar; institutions bought where the week's net flow is positive."""
    nets = v_flow(spark, sf_dir).groupBy("ticker", "date").agg(F.sum("net").alias("net"))
    x = _decided(spark, sf_dir).join(nets, ["ticker", "date"], "left").withColumn("bought", F.coalesce(F.col("net") > 0, F.lit(False)))
    x = x.withColumn("fwd", D.lag_pct("close", 3)).withColumn("fr", F.lit(25.0) + F.col("ticker"))
    x = x.withColumn("score", L.signal_score("trend", "confirmed", "liquid", "bought", "fwd", "fr").cast("int"))
    return x.select("ticker", "date", "score", L.signal_advice("trend", "confirmed", "liquid", "bought", "score").alias("advice"))


@query(with_views(f"SELECT days, count(*) AS n, {settled_sql('avg(f)', 4)} AS mean, {settled_sql('count(*) FILTER (f > 0) / count(*) * 100', 4)} AS win_pct, {settled_sql('max(f)', 4)} AS best, {settled_sql('min(f)', 4)} AS worst FROM fw WHERE f IS NOT NULL GROUP BY 1", "v_daily", "v_flow",
    ev="SELECT ticker, date FROM (SELECT ticker, date, sum(net) AS net FROM v_flow GROUP BY 1, 2) WHERE net > 0",
    led=f"SELECT ticker, date, (lead(close, 3) OVER w / close - 1) * 100 AS f3, (lead(close, 10) OVER w / close - 1) * 100 AS f10 FROM v_daily {_W}",
    fw="SELECT 3 AS days, f3 AS f FROM ev JOIN led USING (ticker, date) UNION ALL SELECT 10, f10 FROM ev JOIN led USING (ticker, date)"))
def chip_event_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward returns of weeks that institutions bought in."""
    events = v_flow(spark, sf_dir).groupBy("ticker", "date").agg(F.sum("net").alias("net")).where("net > 0").select("ticker", "date")
    x = L.chip_performance(events, v_daily(spark, sf_dir), [3, 10])
    return x.select("days", "n", *[settled(k, 4).alias(k) for k in ("mean", "win_pct", "best", "worst")])
