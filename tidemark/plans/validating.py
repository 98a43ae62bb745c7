"""Queries of folds, metrics, controls and models, on samples drawn from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import settled, settled_sql
from tidemark.operators import daily as D
from tidemark.operators import validation as V
from tidemark.registry import query
from tidemark.sources.views import table, v_daily, with_views

_S = "SELECT event_id, ts, ts + INTERVAL 3 HOUR AS outcome, CAST(ts AS DATE) AS d, user_id % 5 AS g, event_type = 'click' AS label, least(0.999, value / 100) AS p, value - 25 AS net, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS f1, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS f2 FROM events"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "ts + interval 3 hours AS outcome", "CAST(ts AS DATE) AS d", "user_id % 5 AS g", "event_type = 'click' AS label", "least(0.999D, value / 100) AS p", "value - 25 AS net",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS f1", "CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS f2",
    )


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = V.number_by_time(_samples(spark, sf_dir), "ts", "event_id")
    n = table(spark, sf_dir, "events").count()
    return V.assign_folds(x, V.fold_ranges(spark, n, 3, n // 10, n // 10, n // 5))


_FOLDS = {
    "s": _S,
    "n": "SELECT count(*) AS n FROM s",
    "numbered": "SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM s",
    "ends": "SELECT k AS fold, n - (2 - k) * (n // 5) AS e, n // 5 AS t, n // 10 AS v FROM n, (VALUES (0), (1), (2)) f(k)",
    "ranges": "SELECT fold, 'test' AS role, e - t AS low, e AS high FROM ends UNION ALL SELECT fold, 'validate', e - t - v, e - t FROM ends UNION ALL SELECT fold, 'train', 0, e - t - v FROM ends",
    "assigned": "SELECT * FROM numbered JOIN ranges ON place >= low AND place < high",
}
_PURGED = {
    **_FOLDS,
    "starts": "SELECT fold, min(ts) FILTER (role = 'validate') AS v, min(ts) FILTER (role = 'test') AS t FROM assigned GROUP BY 1",
    "purged": "SELECT * FROM (SELECT a.*, CASE role WHEN 'train' THEN s.v WHEN 'validate' THEN s.t END AS edge FROM assigned a JOIN starts s USING (fold)) WHERE edge IS NULL OR (outcome < edge AND ts < edge - INTERVAL 6 HOUR)",
}


@query(with_views("SELECT fold, role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM assigned GROUP BY ALL", **_FOLDS))
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(with_views("SELECT fold, role, count(*) AS n, max(outcome) AS last_outcome FROM purged GROUP BY ALL", **_PURGED))
def purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = V.purge(_assigned(spark, sf_dir), "ts", "outcome", "6 hours")
    return x.groupBy("fold", "role").agg(F.count("*").alias("n"), F.max("outcome").alias("last_outcome"))


@query(with_views("""SELECT locked, count(*) AS n, count(DISTINCT d) AS dates, min(d) AS first_d FROM (SELECT s.*, place >= least(total - CAST(ceil(total * 0.15) AS BIGINT), coalesce((SELECT min(place) FROM num WHERE dr <= 5), 0)) AS locked FROM num s) GROUP BY 1""", s=_S,
    num="SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS place, count(*) OVER () AS total, dense_rank() OVER (ORDER BY d DESC) AS dr FROM s"))
def locked_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = V.number_by_time(_samples(spark, sf_dir), "ts", "event_id")
    return V.locked_suffix(x, "d", 0.15, 5).groupBy("locked").agg(F.count("*").alias("n"), F.count_distinct("d").alias("dates"), F.min("d").alias("first_d"))


@query(with_views(f"SELECT event_id, {settled_sql('coalesce(f1, m)')} AS f1, f1 IS NULL AS f1_missing FROM s, (SELECT quantile_cont(f1, 0.5) AS m FROM s)", s=_S))
def median_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _samples(spark, sf_dir).select("event_id", "f1")
    return V.impute(x, V.medians(x, ["f1"]), ["f1"]).select("event_id", settled("f1").alias("f1"), "f1_missing")


@query(with_views(f"SELECT event_id, {settled_sql('(least(greatest(f2, lo), hi) - m) / sd')} AS f2 FROM s, lim, (SELECT avg(least(greatest(f2, lo), hi)) AS m, stddev_pop(least(greatest(f2, lo), hi)) AS sd FROM s, lim)", s=_S, lim="SELECT quantile_cont(f2, 0.01) AS lo, quantile_cont(f2, 0.99) AS hi FROM s"))
def clipped_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _samples(spark, sf_dir).select("event_id", "f2")
    return V.scale(x, V.scaling(x, ["f2"]), ["f2"]).select("event_id", settled("f2").alias("f2"))


_Q = "least(greatest(p, 1e-15), 1 - 1e-15)"


@query(with_views(f"SELECT g, CAST(sum(n) AS BIGINT) AS n, {settled_sql('sum(b) / sum(n)')} AS brier, {settled_sql('sum(l) / sum(n)')} AS log_loss, {settled_sql('sum(a) / sum(n)')} AS accuracy, {settled_sql('sum(abs(pp - y)) / sum(n)')} AS ece, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, {settled_sql('coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0)')} AS precision, {settled_sql('coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0)')} AS f1 FROM per GROUP BY 1", s=_S,
    per=f"SELECT g, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p) AS pp, sum(label::INT) AS y, sum((p - label::INT) ** 2) AS b, sum(-(label::INT * ln({_Q}) + (1 - label::INT) * ln(1 - {_Q}))) AS l, sum(((p >= 0.5) = label)::INT) AS a, count(*) FILTER (p >= 0.5 AND label) AS tp, count(*) FILTER (p >= 0.5 AND NOT label) AS fp, count(*) FILTER (p < 0.5 AND label) AS fn FROM s GROUP BY 1, 2"))
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = V.classification(_samples(spark, sf_dir), ["g"], "p", "label")
    return x.select("g", "n", "tp", "fp", "fn", *[settled(k).alias(k) for k in ("brier", "log_loss", "accuracy", "ece", "precision", "f1")])


@query(with_views(f"SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, {settled_sql('avg(p)')} AS mean_p, {settled_sql('avg(label::INT)')} AS share FROM s GROUP BY 1", s=_S))
def reliability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reliability(_samples(spark, sf_dir), "p", "label").select("bin", "n", settled("mean_p").alias("mean_p"), settled("share").alias("share"))


_RANK = "rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0"


@query(with_views(f"SELECT g, {settled_sql('(sum(r) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2.0) / (count(*) FILTER (label) * count(*) FILTER (NOT label))')} AS auc FROM (SELECT *, {_RANK.format(k='g', x='p')} AS r FROM s) GROUP BY 1", s=_S))
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.auc(_samples(spark, sf_dir), ["g"], "p", "label").withColumn("auc", settled("auc"))


@query(with_views(f"SELECT d, feature, count(*) AS n, {settled_sql('corr(ra, rb)', 5)} AS ic FROM (SELECT d, feature, {_RANK.format(k='d, feature', x='value')} AS ra, {_RANK.format(k='d, feature', x='net')} AS rb FROM l) GROUP BY ALL", s=_S,
    l="SELECT d, 'f1' AS feature, f1 AS value, net FROM s WHERE f1 IS NOT NULL UNION ALL SELECT d, 'f2', f2, net FROM s WHERE f2 IS NOT NULL"))
def feature_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.information_table(_samples(spark, sf_dir), ["d"], ["f1", "f2"], "net").select("d", "feature", "n", settled("ic", 5).alias("ic"))


@query(with_views(f"SELECT g, count(*) AS trades, {settled_sql('count(*) FILTER (net > 0) / count(*)')} AS win_rate, {settled_sql('avg(net)')} AS ev, {settled_sql('sum(net)', 3)} AS total, {settled_sql('avg(net) FILTER (net > 0)')} AS avg_win, {settled_sql('avg(net) FILTER (net < 0)')} AS avg_loss, {settled_sql('sum(greatest(net, 0)) / -sum(least(net, 0))')} AS profit_factor FROM s GROUP BY 1", s=_S))
def trading_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = V.trading_metrics(_samples(spark, sf_dir), ["g"])
    return x.select("g", "trades", *[settled(k, 3 if k == "total" else 6).alias(k) for k in ("win_rate", "ev", "total", "avg_win", "avg_loss", "profit_factor")])


@query(with_views(f"SELECT g, {settled_sql('max(top - e)', 3)} AS max_drawdown, CAST(max(run) AS BIGINT) AS losing_streak FROM (SELECT *, greatest(0, max(e) OVER (PARTITION BY g ORDER BY event_id)) AS top, sum(CASE WHEN net < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g, i ORDER BY event_id) AS run FROM (SELECT g, event_id, net, sum(net) OVER w AS e, sum(CASE WHEN net < 0 THEN 0 ELSE 1 END) OVER w AS i FROM s WINDOW w AS (PARTITION BY g ORDER BY event_id))) GROUP BY 1", s=_S))
def equity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.equity_metrics(_samples(spark, sf_dir), ["g"], ["event_id"]).withColumn("max_drawdown", settled("max_drawdown", 3))


@query(with_views(f"SELECT 'd' AS dimension, d::VARCHAR AS member, {settled_sql('sum(net)', 3)} AS net, count(*) AS n FROM s GROUP BY d UNION ALL SELECT 'g', g::VARCHAR, {settled_sql('sum(net)', 3)}, count(*) FROM s GROUP BY g UNION ALL SELECT 'all', 'all', {settled_sql('sum(net)', 3)}, count(*) FROM s", s=_S))
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.contributions(_samples(spark, sf_dir), ["d", "g"]).withColumn("net", settled("net", 3))


@query(with_views(f"SELECT g, {settled_sql('CASE WHEN sum(net) > 0 THEN max(greatest(0, net)) / sum(net) END')} AS concentration FROM (SELECT g, d, sum(net) AS net FROM s GROUP BY 1, 2) GROUP BY 1", s=_S))
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _samples(spark, sf_dir).groupBy("g", "d").agg(F.sum("net").alias("net"))
    return V.concentration(parts, ["g"]).withColumn("concentration", settled("concentration"))


@query(with_views(f"SELECT g, {settled_sql('avg(net)')} AS mean, {settled_sql('quantile_cont(net, 0.5)')} AS median, {settled_sql('min(net)')} AS worst, {settled_sql('max(net)')} AS best, {settled_sql('stddev_pop(net)')} AS deviation, {settled_sql('quantile_cont(net, 0.75) - quantile_cont(net, 0.25)')} AS iqr FROM s GROUP BY 1", s=_S))
def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = V.distribution(_samples(spark, sf_dir), ["g"], "net")
    return x.select("g", *[settled(k).alias(k) for k in ("mean", "median", "worst", "best", "deviation", "iqr")])


_TRADES = "SELECT *, CASE WHEN event_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, CASE WHEN hour(ts) BETWEEN 8 AND 13 THEN 'DAY' ELSE 'NIGHT' END AS regime FROM s"
_FOLD_EVIDENCE = """SELECT hour(ts) // 3 AS fold, count(*) >= 20 AS sufficient, avg(net) AS test_ev, avg(CASE WHEN label THEN net ELSE 0 END) AS baseline_ev, avg((p - label::INT) ** 2) AS test_brier, avg((0.5 - label::INT) ** 2) AS baseline_brier,
    avg(abs(p - label::INT)) AS test_log_loss, avg(abs(0.4 - label::INT)) AS baseline_log_loss, sum(net) AS net, true AS cost_complete FROM tr GROUP BY 1"""


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).selectExpr("*", "CASE WHEN event_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction", "CASE WHEN hour(ts) BETWEEN 8 AND 13 THEN 'DAY' ELSE 'NIGHT' END AS regime")


def _fold_evidence(trades: DataFrame) -> DataFrame:
    y = F.col("label").cast("int")
    return trades.groupBy(F.expr("hour(ts) div 3").alias("fold")).agg(
        (F.count("*") >= 20).alias("sufficient"), F.avg("net").alias("test_ev"), F.avg(F.when(F.col("label"), F.col("net")).otherwise(0.0)).alias("baseline_ev"), F.avg((F.col("p") - y) ** 2).alias("test_brier"), F.avg((0.5 - y) ** 2).alias("baseline_brier"),
        F.avg(F.abs(F.col("p") - y)).alias("test_log_loss"), F.avg(F.abs(0.4 - y)).alias("baseline_log_loss"), F.sum("net").alias("net"), F.lit(True).alias("cost_complete"),
    )


@query(with_views(f"""SELECT valid, {settled_sql('positive')} AS positive, {settled_sql('baseline')} AS baseline, {settled_sql('CASE WHEN total > 0 THEN ftop / total END')} AS fold_concentration, {settled_sql('CASE WHEN total > 0 THEN mtop / total END')} AS month_concentration,
    array_to_string(list_filter([CASE WHEN total <= 0 THEN 'NON_POSITIVE_TOTAL_OUTER_NET_PNL' END, CASE WHEN positive < 0.7 THEN 'NON_NEGATIVE_FOLD_RATIO_BELOW_70_PERCENT' END, CASE WHEN baseline < 0.7 THEN 'BASELINE_OUTPERFORMANCE_BELOW_70_PERCENT' END, CASE WHEN brier <= 0.5 THEN 'BRIER_NOT_NONINFERIOR_IN_STRICT_MAJORITY' END, CASE WHEN ll <= 0.5 THEN 'LOG_LOSS_NOT_NONINFERIOR_IN_STRICT_MAJORITY' END,
        CASE WHEN total <= 0 OR ftop / total > 0.4 THEN 'FOLD_CONCENTRATION_ABOVE_40_PERCENT' END, CASE WHEN total <= 0 OR mtop / total > 0.3 THEN 'MONTH_CONCENTRATION_ABOVE_30_PERCENT' END, CASE WHEN total <= 0 OR dtop / total > 0.85 THEN 'DIRECTION_CONCENTRATION_ABOVE_85_PERCENT' END, CASE WHEN total <= 0 OR etop / total > 0.4 THEN 'EVENT_CONCENTRATION_ABOVE_40_PERCENT' END,
        CASE WHEN rbad THEN 'NEGATIVE_REGIME_CONTRIBUTION' END, CASE WHEN tbad THEN 'NEGATIVE_TARGET_CODE_CONTRIBUTION' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM (SELECT count(*) AS valid, sum(net) AS total, count(*) FILTER (test_ev >= 0) / count(*) AS positive, count(*) FILTER (test_ev > baseline_ev) / count(*) AS baseline, count(*) FILTER (test_brier <= baseline_brier) / count(*) AS brier, count(*) FILTER (test_log_loss <= baseline_log_loss) / count(*) AS ll, max(greatest(0, net)) AS ftop FROM fe WHERE sufficient),
        (SELECT max(greatest(0, net)) AS mtop FROM (SELECT sum(net) AS net FROM tr GROUP BY month(ts))), (SELECT max(greatest(0, net)) AS dtop FROM (SELECT sum(net) AS net FROM tr GROUP BY direction)), (SELECT max(greatest(0, net)) AS etop FROM (SELECT sum(net) AS net FROM tr GROUP BY d)),
        (SELECT bool_or(net < 0) AS rbad FROM (SELECT sum(net) AS net FROM tr GROUP BY regime)), (SELECT bool_or(net < 0) AS tbad FROM (SELECT sum(net) AS net FROM tr GROUP BY g))""", s=_S, tr=_TRADES, fe=_FOLD_EVIDENCE))  # fmt: skip
def stability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = _trades(spark, sf_dir).withColumn("month", F.month("ts")).withColumn("event", F.col("d").cast("string")).withColumn("target", F.col("g"))
    parts = V.contributions(trades, ["month", "direction", "event", "regime", "target"])
    x = V.stability_gate(_fold_evidence(trades), parts)
    return x.select("valid", settled("positive").alias("positive"), settled("baseline").alias("baseline"), settled("fold_concentration").alias("fold_concentration"), settled("month_concentration").alias("month_concentration"), F.array_join("reasons", ",").alias("reasons"))


@query(with_views(f"SELECT CAST(sum(w) AS BIGINT) AS signals, {settled_sql('sum(sm) / sum(w)')} AS signal_mean, {settled_sql('sum(w * m) / sum(w)')} AS control_mean FROM (SELECT g, hour(ts) // 6 AS b, count(*) AS w, sum(net) AS sm FROM s WHERE label GROUP BY 1, 2) JOIN (SELECT g, hour(ts) // 6 AS b, avg(net) AS m FROM s WHERE NOT label GROUP BY 1, 2) USING (g, b)", s=_S))
def matched_control_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _samples(spark, sf_dir).withColumn("b", F.floor(F.hour("ts") / 6))
    y = V.matched_control(x.where("label"), x.where("NOT label"), ["g", "b"], "net")
    return y.select("signals", settled("signal_mean").alias("signal_mean"), settled("control_mean").alias("control_mean"))


_DRAW = "('0x' || substr(md5('{seed}:' || {x}), 1, 15))::BIGINT"


@query(with_views(f"SELECT d, event_id FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY {_DRAW.format(seed='controls', x='event_id')}, event_id) AS r FROM s) WHERE r <= 20", s=_S))
def random_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty random moments of each day, the same in any engine."""
    return V.sample_controls(_samples(spark, sf_dir), ["d"], "event_id", 20, "controls").select("d", "event_id")


@query(with_views(f"SELECT count(m) AS resamples, {settled_sql('list_sort(list(m))[CAST(floor(count(m) * 0.025) AS INT) + 1]', 5)} AS low, {settled_sql('list_sort(list(m))[CAST(floor(count(m) * 0.975) AS INT) + 1]', 5)} AS high FROM rs", s=_S,
    num="SELECT d, avg(net) AS v FROM s GROUP BY 1", rs=f"""SELECT i, sum(w * v) / nullif(sum(w), 0) AS m FROM (SELECT i, v, {' + '.join(f'(u >= {t})::INT' for t in V.POISSON)} AS w FROM (SELECT i, v, ('0x' || substr(md5('boot:' || d || ':' || (i // 8)), 4 * (i % 8) + 1, 4))::BIGINT AS u
        FROM num, (SELECT unnest(generate_series(0, 999)) AS i))) GROUP BY i"""))  # fmt: skip
def bootstrap_daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _samples(spark, sf_dir).groupBy("d").agg(F.avg("net").alias("v"))
    x = V.bootstrap_mean(days, "v", ["d"], 1000, "boot")
    return x.select(F.col("resamples").cast("long").alias("resamples"), settled("low", 5).alias("low"), settled("high", 5).alias("high"))


@query(with_views(f"SELECT 'momentum1' AS a, 'range_pct' AS b, {settled_sql('corr(m, r)', 5)} AS corr FROM (SELECT (close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1) * 100 AS m, (high - low) / close * 100 AS r FROM v_daily)", "v_daily"))
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.correlation_groups(D.features(v_daily(spark, sf_dir)), ["momentum1", "range_pct"]).withColumn("corr", settled("corr", 5))


@query()
def two_stage_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade probability and side of each sample by two logistic fits on the earlier 70 percent of the days."""
    x = V.impute(_samples(spark, sf_dir), V.medians(_samples(spark, sf_dir), ["f1"]), ["f1"]).withColumn("trade", (F.abs("net") > 10).cast("double")).withColumn("up", (F.col("net") > 0).cast("double"))
    cut = x.agg(F.percentile(F.unix_date("d"), F.lit(0.7)).alias("c")).first()["c"]
    train = x.where(F.unix_date("d") < cut)
    scored = V.score_logistic(V.fit_logistic(train, ["f1", "f2"], "trade", 1.0), x, "p_trade", ["f1", "f2"])
    scored = V.score_logistic(V.fit_logistic(train.where("trade = 1"), ["f1", "f2"], "up", 1.0), scored, "p_long", ["f1", "f2"])
    return scored.select("event_id", "p_trade", "p_long", (F.col("p_trade") * F.col("p_long")).alias("p_up"), V.model_thresholds(scored, "p_trade", "p_long", 0.5, 0.05).alias("signal"))


@query()
def isotonic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores through isotonic steps: the value of the first bound not below the score."""
    x = _samples(spark, sf_dir).withColumn("y", (F.col("net") > 0).cast("double")).select("event_id", "p", "y")
    return V.read_steps(x, V.fit_steps(x, "p", "y"), "p", "calibrated")
