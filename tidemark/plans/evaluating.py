"""Queries of calibrators, baselines, stability, ablations, verdicts and reports, on samples drawn from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import settled, settled_sql
from tidemark.operators import daily as D
from tidemark.operators import evaluation as E
from tidemark.operators import validation as V
from tidemark.plans.screening import _FEATURES
from tidemark.plans.validating import _S, _TRADES, _samples, _trades
from tidemark.registry import query
from tidemark.sources.views import table, v_daily, with_views

_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


@query(with_views("SELECT folds, test, greatest(1, test // 2) AS validation, n - folds * test AS training FROM (SELECT f.folds, n, greatest(1, n // (f.folds + 3)) AS test FROM (SELECT count(*) AS n FROM s), (VALUES (3), (5), (8)) f(folds))", s=_S))
def fold_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").count()
    return spark.createDataFrame([(k, *E.fold_sizes(n, k)) for k in (3, 5, 8)], "folds int, test long, validation long, training long")


@query()
def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as they are, by Platt scaling and by isotonic steps, and which of them is chosen; tests check the metrics."""
    x = _samples(spark, sf_dir).withColumn("y", (F.col("net") > 0).cast("double"))
    x = x.withColumn("p_platt", E.platt("p", E.fit_platt(x, "p", "y")))
    x = V.read_steps(x, V.fit_steps(x, "p", "y"), "p", "p_isotonic")
    return E.choose_calibrator(x, {"UNCALIBRATED": "p", "PLATT": "p_platt", "ISOTONIC": "p_isotonic"}, "y", "net")


_BASE = {"bs": f"SELECT ticker, date, close, lag(close) OVER w AS pc, sum(turnover) OVER w / sum(volume) OVER w AS vw, avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING) - avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS sl, 1 / (1 + exp(-(close / lag(close, 3) OVER w - 1))) AS pr FROM v_daily {_W}"}


def _side(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 'LONG' WHEN {x} < 0 THEN 'SHORT' ELSE 'NO_TRADE' END"


@query(with_views(f"SELECT 'NO_TRADE' AS a, {_side('close - pc')} AS b, {_side('close - vw')} AS c, {_side('sl')} AS d, {_side('CASE WHEN abs(pr - 0.5) > 1e-15 THEN pr - 0.5 ELSE 0 END')} AS e, count(*) AS n FROM bs GROUP BY ALL", "v_daily", **_BASE))
def baseline_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five baselines on bars: none, last move, side of the running average price, slope, and a function of returns."""
    w = W.partitionBy("ticker").orderBy("date")
    past = w.rowsBetween(W.unboundedPreceding, 0)
    x = v_daily(spark, sf_dir).select(F.col("close").alias("price"), F.lag("close").over(w).alias("previous_price"), (F.sum("turnover").over(past) / F.sum("volume").over(past)).alias("vwap"), (F.avg("close").over(w.rowsBetween(-4, 0)) - F.avg("close").over(w.rowsBetween(-5, -1))).alias("ema_slope"), (1 / (1 + F.exp(-(F.col("close") / F.lag("close", 3).over(w) - 1)))).alias("p_return"))
    y = E.signals_of_baselines(x)
    return y.groupBy(*[F.col(f"baseline_{k}").alias(v) for k, v in (("none", "a"), ("last_move", "b"), ("vwap_side", "c"), ("ema_slope", "d"), ("return_model", "e"))]).agg(F.count("*").alias("n"))


_FM = {
    "fm0": "SELECT *, hour(ts) // 4 AS fold, CASE WHEN value > 20 THEN net END AS tnet FROM (SELECT s.*, e.value FROM s JOIN events e USING (event_id))",
    "fm": "SELECT fold, coalesce(avg(tnet), 0) AS ev, CASE WHEN sum(greatest(tnet, 0)) > 0 THEN sum(greatest(tnet, 0)) / greatest(-sum(least(tnet, 0)), 1e-12) ELSE 0 END AS profit_factor, count(tnet) / count(*) AS frequency, avg((p - label::INT) ** 2) AS brier, avg(((p >= 0.5) = label)::INT) AS accuracy FROM fm0 GROUP BY 1",
}


def _fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).withColumn("fold", F.expr("hour(ts) div 4")).withColumn("tnet", F.when(F.col("net") > -5, F.col("net")))


@query(with_views(f"SELECT fold, {', '.join(f'{settled_sql(x)} AS {x}' for x in ('ev', 'profit_factor', 'frequency', 'brier', 'accuracy'))} FROM fm", s=_S, **_FM))
def fold_metric_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.fold_metrics(_fold_rows(spark, sf_dir), "fold", "p", "label", "tnet")
    return m.select("fold", *[settled(k).alias(k) for k in ("ev", "profit_factor", "frequency", "brier", "accuracy")])


@query(with_views(f"SELECT metric, {', '.join(f'{settled_sql(e)} AS {n}' for n, e in (('mean', 'avg(v)'), ('median', 'quantile_cont(v, 0.5)'), ('worst', 'min(v)'), ('best', 'max(v)'), ('deviation', 'stddev_pop(v)'), ('iqr', 'quantile_cont(v, 0.75) - quantile_cont(v, 0.25)')))} FROM (SELECT 'ev' AS metric, ev AS v FROM fm UNION ALL SELECT 'brier', brier FROM fm UNION ALL SELECT 'frequency', frequency FROM fm) GROUP BY 1", s=_S, **_FM))
def fold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.fold_report(E.fold_metrics(_fold_rows(spark, sf_dir), "fold", "p", "label", "tnet"), "fold", ["ev", "brier", "frequency"])
    return x.select("metric", *[settled(k).alias(k) for k in ("mean", "median", "worst", "best", "deviation", "iqr")])


_GAP = {
    **_FM,
    "gp": "SELECT a.fold, a.ev AS te, b.ev AS se, a.profit_factor AS tp, b.profit_factor AS sp, a.brier AS tb, b.brier AS sb, a.frequency AS tf, b.frequency AS sf, a.accuracy AS ta, b.accuracy AS sa FROM fm a JOIN fm b ON b.fold = a.fold + 1",
}


@query(with_views(f"""SELECT fold, {settled_sql('sb - tb')} AS brier_gap, {settled_sql('se - te')} AS ev_gap, array_to_string(list_filter([CASE WHEN te > 0 AND se < 0 THEN 'TRAIN_POSITIVE_TEST_NEGATIVE_EV' END, CASE WHEN tp > greatest(1, sp * 1.5) THEN 'PROFIT_FACTOR_GAP' END, CASE WHEN tb + 0.05 < sb THEN 'CALIBRATION_GAP' END, CASE WHEN tf > greatest(0.01, sf * 2) THEN 'TRADE_FREQUENCY_GAP' END,
    CASE WHEN ta > sa AND se < te THEN 'ACCURACY_UP_NET_EV_DOWN' END], lambda x: x IS NOT NULL), ',') AS reasons FROM gp""", s=_S, **_GAP))  # fmt: skip
def generalisation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold as training of the next."""
    m = E.fold_metrics(_fold_rows(spark, sf_dir), "fold", "p", "label", "tnet")
    names = ("ev", "profit_factor", "brier", "frequency", "accuracy")
    train, test = m.select("fold", *[F.col(n).alias(f"train_{n}") for n in names]), m.select((F.col("fold") - 1).alias("fold"), *[F.col(n).alias(f"test_{n}") for n in names])
    x = E.generalisation_gaps(train.join(test, "fold"))
    return x.select("fold", settled("brier_gap").alias("brier_gap"), settled("ev_gap").alias("ev_gap"), F.array_join("reasons", ",").alias("reasons"))


_ABL = {
    "ab": "SELECT hour(ts) // 4 AS fold, user_id % 4 AS grp, avg(value) AS ev, avg(value * value) / 1000 AS log_loss, avg(value) / 100 AS brier FROM events GROUP BY 1, 2",
}


@query(with_views(f"SELECT grp AS removed, {settled_sql('count(*) FILTER (fe >= ev AND fl <= log_loss AND fb <= brier) / count(*)')} AS gain_ratio, {settled_sql('greatest(0, least(1, 1 - (max(fe - ev) - min(fe - ev)) / (1 + max(abs(fe)))))')} AS fold_stability, count(*) FILTER (fe >= ev AND fl <= log_loss AND fb <= brier) / count(*) > 0.5 AS supported FROM ab JOIN (SELECT fold, ev AS fe, log_loss AS fl, brier AS fb FROM ab WHERE grp = 0) f USING (fold) WHERE grp > 0 GROUP BY 1", **_ABL))
def ablation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by group as models: the first is the full one."""
    g = F.col("user_id") % 4
    x = table(spark, sf_dir, "events").groupBy(F.expr("hour(ts) div 4").alias("fold"), F.when(g > 0, g).alias("removed")).agg(F.avg("value").alias("ev"), (F.avg(F.col("value") * F.col("value")) / 1000).alias("log_loss"), (F.avg("value") / 100).alias("brier"))
    return E.ablations(x).select("removed", settled("gain_ratio").alias("gain_ratio"), settled("fold_stability").alias("fold_stability"), "supported")


_COEF = {
    "co": "SELECT event_type AS feature, hour(ts) // 6 AS fold, avg(value) - 25 AS c FROM events GROUP BY 1, 2",
    "rk": "SELECT *, row_number() OVER (PARTITION BY fold ORDER BY abs(c) DESC, feature) AS r FROM co",
}


@query(with_views(f"SELECT feature, {settled_sql('quantile_cont(c, 0.5)')} AS median, {settled_sql('greatest(count(*) FILTER (c > 0), count(*) FILTER (c < 0)) / count(*)')} AS dominant_sign, {settled_sql('CASE WHEN count(*) > 1 THEN 1 / (1 + stddev_pop(r)) ELSE 1 END')} AS rank_stability, {settled_sql('count(*) FILTER (c >= 0) / count(*)')} AS removal_support, bool_or(r <= 2) AND (greatest(count(*) FILTER (c > 0), count(*) FILTER (c < 0)) / count(*) < 0.7 OR abs(quantile_cont(c, 0.5)) <= 1e-12 OR count(*) FILTER (c >= 0) / count(*) <= 0.5) AS unstable FROM rk GROUP BY 1", **_COEF))
def coefficient_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as features: their mean, less 25, by part of the day as coefficients."""
    x = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("feature"), F.expr("hour(ts) div 6").alias("fold")).agg((F.avg("value") - 25).alias("coefficient"))
    x = x.withColumn("rank", F.row_number().over(W.partitionBy("fold").orderBy(F.abs("coefficient").desc(), "feature"))).withColumn("important", F.col("rank") <= 2)
    removals = x.select("feature", "fold", F.col("coefficient").alias("full_ev"), F.lit(0.0).alias("removed_ev"))
    y = E.coefficient_stability(x, removals)
    return y.select("feature", *[settled(k).alias(k) for k in ("median", "dominant_sign", "rank_stability", "removal_support")], "unstable")


_RED = ("momentum1", "momentum3", "momentum5", "close_to_hma9", "range_pct", "close_position")
_PAIRS = [(a, b) for i, a in enumerate(_RED) for b in _RED[i + 1 :]]


@query(with_views("SELECT f.feature, string_agg(m.feature, ',' ORDER BY m.feature) AS members, f.feature = min(m.feature) AS kept FROM lab f JOIN lab m ON m.root = f.root GROUP BY 1, f.root", "v_daily", **_FEATURES,
    cr=" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM feats" for a, b in _PAIRS), ed="SELECT a, b FROM cr WHERE abs(r) > 0.7 UNION ALL SELECT b, a FROM cr WHERE abs(r) > 0.7",
    nm="SELECT unnest(" + str(list(_RED)) + ") AS feature", lab="SELECT feature, root FROM (WITH RECURSIVE t AS (SELECT feature, feature AS other FROM nm UNION SELECT t.feature, ed.b FROM t JOIN ed ON ed.a = t.other) SELECT feature, min(other) AS root FROM t GROUP BY 1)"))
def redundant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily features connected by a correlation above 0.7; alike profiles, so the first name of a group stays."""
    x = D.features(v_daily(spark, sf_dir)).select(*_RED)
    profiles = spark.createDataFrame([(n, 1.0, 1, 1.0) for n in _RED], "feature string, completeness double, simplicity int, stability double")
    return E.redundancy_groups(V.correlation_groups(x, list(_RED)), profiles, 0.7)


@query("SELECT " + settled_sql("max(v) FILTER (l2 = 1 AND t = 0.5 AND k = 1)") + " AS value, max(v) FILTER (l2 = 1 AND t = 0.5 AND k = 1) > 0 AND coalesce(max(v) FILTER (NOT (l2 = 1 AND t = 0.5 AND k = 1)) <= 0, false) AS fragile FROM (SELECT l2, t, k, avg(value) - 25 + CASE WHEN l2 = 1 AND t = 0.5 AND k = 1 THEN 5 ELSE 0 END AS v FROM (SELECT value, CASE event_id % 7 WHEN 1 THEN 0.5 WHEN 2 THEN 2.0 ELSE 1.0 END AS l2, CASE event_id % 7 WHEN 3 THEN 0.45 WHEN 4 THEN 0.55 ELSE 0.5 END AS t, CASE event_id % 7 WHEN 5 THEN 0.75 WHEN 6 THEN 1.25 ELSE 1.0 END AS k FROM events) GROUP BY l2, t, k)")
def parameter_fragility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point and its six neighbours, each with a seventh of the events."""
    pick = lambda a, x, b, y, rest: F.when(F.col("event_id") % 7 == a, x).when(F.col("event_id") % 7 == b, y).otherwise(rest)
    x = table(spark, sf_dir, "events").groupBy(pick(1, 0.5, 2, 2.0, 1.0).alias("l2"), pick(3, 0.45, 4, 0.55, 0.5).alias("threshold"), pick(5, 0.75, 6, 1.25, 1.0).alias("atr")).agg(F.avg("value").alias("v"))
    chosen = (F.col("l2") == 1) & (F.col("threshold") == 0.5) & (F.col("atr") == 1)
    return E.fragile(x.withColumn("value", F.col("v") - 25 + F.when(chosen, 5).otherwise(0)), (1.0, 0.5, 1.0)).withColumn("value", settled("value"))


@query("SELECT fold, CASE WHEN NOT sparse THEN candidate_id END AS candidate_id, CASE WHEN sparse THEN 'INSUFFICIENT_CALIBRATION_EVIDENCE' ELSE 'SELECTED' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY sparse, brier, candidate_id) AS r FROM (SELECT CAST(ts AS DATE) AS fold, user_id % 6 AS candidate_id, round(avg(value), 6) AS brier, min(value) < 0.5 AS sparse FROM events GROUP BY 1, 2)) WHERE r = 1")
def inner_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("fold"), (F.col("user_id") % 6).alias("candidate_id")).agg(F.round(F.avg("value"), 6).alias("brier"), (F.min("value") < 0.5).alias("sparse"))
    return E.select_inner(x, ["fold"], [F.col("brier")])


def resampled_sql(source: str, value: str, row_id: str, seed: str, resamples: int, by: str = "") -> str:
    """Means of the resamples of resample_sums(); row_id is the text of the ids joined by colons."""
    draw = f"('0x' || substr(md5('{seed}:' || {row_id} || ':' || (i // 8)), 4 * (i % 8) + 1, 4))::BIGINT"
    weight = " + ".join(f"(u >= {t})::INT" for t in V.POISSON)
    return f"SELECT {by}i, sum(({weight}) * v) / nullif(sum({weight}), 0) AS m FROM (SELECT {by}i, {value} AS v, {draw} AS u FROM {source}, (SELECT unnest(generate_series(0, {resamples - 1})) AS i) WHERE {value} IS NOT NULL) GROUP BY ALL"


def _interval_sql(values: str) -> tuple[str, str]:
    """Low and high of a list of differences, as order_interval() takes them."""
    at = lambda p: f"list_sort(list({values}))[CAST({p} AS INT) + 1]"
    return at(f"floor(count({values}) * {(1 - 0.95) / 2!r}::DOUBLE)"), at(f"least(count({values}) - 1, floor(count({values}) * {1 - (1 - 0.95) / 2!r}::DOUBLE))")


_LOW, _HIGH = _interval_sql("a.m - b.m")


@query(with_views(f"SELECT {settled_sql('lo', 5)} AS low, {settled_sql('hi', 5)} AS high, lo > 0 OR hi < 0 AS excludes_zero FROM (SELECT {_LOW} AS lo, {_HIGH} AS hi FROM ra a JOIN rb b USING (i))", s=_S,
    na="SELECT d, avg(net) AS v FROM s WHERE label GROUP BY 1", nb="SELECT d, avg(net) AS v FROM s WHERE NOT label GROUP BY 1",
    ra=resampled_sql("na", "v", "'l:' || d", "diff", 500), rb=resampled_sql("nb", "v", "'r:' || d", "diff", 500)))
def bootstrap_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _samples(spark, sf_dir)
    side = lambda cond: x.where(cond).groupBy("d").agg(F.avg("net").alias("v"))
    return E.bootstrap_difference(side("label"), side("NOT label"), "v", ["d"], 500, "diff").select(settled("low", 5).alias("low"), settled("high", 5).alias("high"), "excludes_zero")


_FORMS = ("plain", "matched", "plain_calm", "matched_calm")
_VERDICT = {
    "s": _S,
    "q": "SELECT *, day(ts) // 7 AS w, hour(ts) // 6 AS b, day(ts) // 7 = 2 AS crash FROM s",
    "cm": "SELECT w, b, avg(net) AS m, avg(net) FILTER (NOT crash) AS mc FROM q WHERE NOT label GROUP BY 1, 2",
    "mt": "SELECT q.event_id, q.w, q.net, q.crash, m, mc FROM q JOIN cm USING (w, b) WHERE label",
    "sets": """SELECT 'plain' AS form, 'l' AS side, event_id, net AS x FROM q WHERE label UNION ALL SELECT 'plain', 'r', event_id, net FROM q WHERE NOT label
        UNION ALL SELECT 'matched', 'l', event_id, net FROM mt UNION ALL SELECT 'matched', 'r', event_id, m FROM mt
        UNION ALL SELECT 'plain_calm', 'l', event_id, net FROM q WHERE label AND NOT crash UNION ALL SELECT 'plain_calm', 'r', event_id, net FROM q WHERE NOT label AND NOT crash
        UNION ALL SELECT 'matched_calm', 'l', event_id, net FROM mt WHERE NOT crash AND mc IS NOT NULL UNION ALL SELECT 'matched_calm', 'r', event_id, mc FROM mt WHERE NOT crash""",
    "rs": resampled_sql("sets", "x", "side || ':' || event_id", "verdict", 400, "form, side, "),
    "iv": f"SELECT form, {_LOW} AS lo, {_HIGH} AS hi FROM (SELECT * FROM rs WHERE side = 'l') a JOIN (SELECT * FROM rs WHERE side = 'r') b USING (form, i) GROUP BY form",
    "p2": f"SELECT {', '.join(f'max(lo) FILTER (form = {f!r}) AS {f}_low, max(hi) FILTER (form = {f!r}) AS {f}_high' for f in _FORMS)}, coalesce(bool_and(lo > 0 OR hi < 0) FILTER (form IN ('plain', 'matched')), false) AS p2, coalesce(bool_and(lo > 0 OR hi < 0) FILTER (form IN ('plain_calm', 'matched_calm')), false) AS p2_calm FROM iv",
    "cn": """SELECT count(*) FILTER (m > pl AND m > mm) AS p1, count(*) FILTER (m > 0) AS p3, count(*) FILTER (n >= 10) AS p4 FROM (SELECT w, count(*) AS n, avg(net) AS m FROM q WHERE label GROUP BY 1) LEFT JOIN (SELECT w, avg(net) AS pl FROM q WHERE NOT label GROUP BY 1) USING (w)
        LEFT JOIN (SELECT w, avg(m) AS mm FROM mt GROUP BY 1) USING (w)""",
}
_BOUNDS = [f"{f}_{n}" for f in _FORMS for n in ("low", "high")]


@query(with_views(f"SELECT p1, p3, p4, p2, p2_calm, {', '.join(f'{settled_sql(n, 5)} AS {n}' for n in _BOUNDS)}, p1 >= 3 AND p2 AND p3 >= 3 AND p4 >= 3 AS passes, CASE WHEN NOT (p1 >= 3 AND p2 AND p3 >= 3 AND p4 >= 3) THEN 'FAIL' WHEN p2_calm THEN 'PASS' ELSE 'PASS (crash-dependent)' END AS label FROM cn, p2", **_VERDICT))
def period_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks as periods, the third one as the crash."""
    x = _samples(spark, sf_dir).withColumn("w", F.expr("day(ts) div 7")).withColumn("b", F.expr("hour(ts) div 6"))
    y = E.period_verdict(x.where("label"), x.where("NOT label"), "w", ["b"], "net", ["event_id"], F.col("w") == 2, 3, 10, 3, 400, "verdict")
    return y.select("p1", "p3", "p4", "p2", "p2_calm", *[settled(n, 5).alias(n) for n in _BOUNDS], "passes", "label")


@query(with_views(f"SELECT kind, days, {settled_sql('mean')} AS mean, {settled_sql('w5')} AS worst_5pct, {settled_sql('mean - (SELECT mean FROM st WHERE kind = ' + chr(39) + 'base' + chr(39) + ')')} AS gain FROM st", s=_S,
    dk="SELECT d, 'base' AS kind, net FROM s UNION ALL SELECT d, CASE WHEN f2 > 50 THEN 'eligible' ELSE 'blocked' END, net FROM s", st="SELECT kind, count(*) AS days, avg(m) AS mean, quantile_cont(m, 0.05) AS w5 FROM (SELECT d, kind, avg(net) AS m FROM dk GROUP BY 1, 2) GROUP BY 1"))
def filter_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _samples(spark, sf_dir).select(F.col("d").alias("date"), "net", F.explode(F.array(F.lit("base"), F.when(F.col("f2") > 50, "eligible").otherwise("blocked"))).alias("kind"))
    return E.filter_study(x).select("kind", "days", *[settled(k).alias(k) for k in ("mean", "worst_5pct", "gain")])


@query(with_views(f"""SELECT n, dates, {settled_sql('brier')} AS brier, {settled_sql('log_loss')} AS log_loss, {settled_sql('ece')} AS ece, trades, {settled_sql('conc')} AS event_concentration, array_to_string(list_filter([CASE WHEN n < 40 OR dates < 40 THEN 'INSUFFICIENT_HOLDOUT_SAMPLE' END, CASE WHEN trades < 30 OR longs < 10 OR trades - longs < 10 THEN 'INSUFFICIENT_HOLDOUT_TRADES' END, CASE WHEN brier > 0.25 OR log_loss > ln(2) OR ece > 0.1 THEN 'HOLDOUT_CALIBRATION_FAILED' END,
    CASE WHEN net <= 0 THEN 'HOLDOUT_NET_EV_OR_COST_FAILED' END, CASE WHEN conc > 0.4 THEN 'HOLDOUT_EVENT_CONCENTRATION_FAILED' END, CASE WHEN bad THEN 'HOLDOUT_REGIME_OR_TARGET_STABILITY_FAILED' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (SELECT *, CASE WHEN net > 0 THEN tp / net ELSE 1 END AS conc FROM
    (SELECT count(*) AS n, count(DISTINCT d) AS dates, avg((p - label::INT) ** 2) AS brier, avg(-(label::INT * ln(greatest(p, 1e-15)) + (1 - label::INT) * ln(greatest(1 - p, 1e-15)))) AS log_loss, abs(avg(p) - avg(label::INT)) AS ece FROM s), (SELECT count(*) AS trades, count(*) FILTER (direction = 'LONG') AS longs, sum(net) AS net FROM tr), (SELECT max(greatest(0, v)) AS tp FROM (SELECT sum(net) AS v FROM tr GROUP BY d)),
    (SELECT min(v) < 0 AS bad FROM (SELECT sum(net) AS v FROM tr GROUP BY regime UNION ALL SELECT sum(net) FROM tr GROUP BY g)))""", s=_S, tr=_TRADES))  # fmt: skip
def holdout_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trades(spark, sf_dir)
    x = E.holdout_evaluation(t.select(F.col("d").alias("date"), F.col("p").alias("probability"), F.col("label").alias("outcome")), t.select("direction", F.col("d").alias("event"), F.array("regime").alias("regimes"), F.col("g").alias("target"), "net"))
    return x.select("n", "dates", *[settled(k).alias(k) for k in ("brier", "log_loss", "ece")], "trades", settled("event_concentration").alias("event_concentration"), F.array_join("reasons", ",").alias("reasons"))


@query("SELECT user_id, CASE WHEN n < 5 THEN 'INSUFFICIENT_DATA' WHEN bad > 0 THEN 'REJECTED' ELSE 'COMPLETE' END AS research, CASE WHEN n < 5 THEN 'REJECTED_INSUFFICIENT_DATA' WHEN bad > 0 THEN 'REJECTED_OVERFIT_RISK' WHEN user_id % 5 = 0 THEN 'CANDIDATE' WHEN user_id % 5 = 1 THEN 'LOCKED_TEST_PENDING' ELSE 'APPROVED_FOR_PAPER' END AS model, CAST(bad + CASE WHEN n >= 5 AND bad = 0 AND user_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_reasons FROM (SELECT user_id, count(*) AS n, (min(value) < 0.3)::INT + (max(value) > 49.5)::INT + (user_id % 7 = 0)::INT + (user_id % 11 = 0)::INT AS bad FROM events GROUP BY 1)")
def research_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as experiments: their events as folds, extremes and numbers as what speaks against them."""
    none = F.array().cast("array<string>")
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("valid_folds"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = x.select(
        "user_id", "valid_folds", F.when(F.col("lo") < 0.3, F.array(F.lit("LOW"))).otherwise(none).alias("core_reasons"), F.when(F.col("hi") > 49.5, F.array(F.lit("f1:EV"))).otherwise(none).alias("gap_reasons"), (F.col("user_id") % 7 == 0).alias("sparse"), (F.col("user_id") % 11 == 0).alias("fragile"),
        F.lit(False).alias("unstable"), F.lit(False).alias("unsupported"), (F.col("user_id") % 5 == 0).alias("synthetic"), (F.col("user_id") % 5 > 1).alias("holdout"),
    )
    return E.research_decision(x).select("user_id", "research", "model", F.size("reasons").alias("n_reasons"))


@query("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderpriority <> 'x' AND o_orderkey % 3 = 0 THEN 'dataset_version' END, CASE WHEN o_orderstatus = 'P' THEN 'label_version' END], lambda x: x IS NOT NULL), ',') AS mismatches FROM orders")
def comparable_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderpriority AS dataset_version", "'f' AS fold_plan", "CAST(NULL AS STRING) AS cost_assumption", "o_orderstatus AS label_version", "'all' AS period")
    y = x.withColumn("dataset_version", F.when(F.col("o_orderkey") % 3 == 0, "other").otherwise(F.col("dataset_version"))).withColumn("label_version", F.when(F.col("label_version") == "P", None).otherwise(F.col("label_version")))
    return E.incomparable(x, y, ["o_orderkey"]).select("o_orderkey", F.array_join("mismatches", ",").alias("mismatches"))


_BT = {"bt": "SELECT *, CAST(day(ts) // 10 AS VARCHAR) AS period FROM s", "bo": "SELECT event_id, net, period FROM bt UNION ALL SELECT event_id, net, 'all' FROM bt",
    "eq": "SELECT period, greatest(0, max(e) OVER (PARTITION BY period ORDER BY event_id)) - e AS f FROM (SELECT period, event_id, sum(net) OVER (PARTITION BY period ORDER BY event_id) AS e FROM bo)"}


@query(with_views(f"SELECT period, trades, {settled_sql('net', 3)} AS net, {settled_sql('win_rate')} AS win_rate, {settled_sql('pf', 5)} AS profit_factor, {settled_sql('dd', 3)} AS max_drawdown, best, worst FROM (SELECT period, count(*) AS trades, sum(net) AS net, count(*) FILTER (net > 0) / count(*) AS win_rate, sum(greatest(net, 0)) / -sum(least(net, 0)) AS pf, max(net) AS best, min(net) AS worst FROM bo GROUP BY 1) JOIN (SELECT period, max(f) AS dd FROM eq GROUP BY 1) USING (period)", s=_S, **_BT))
def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.backtest(_samples(spark, sf_dir).withColumn("period", F.expr("CAST(day(ts) div 10 AS STRING)")), "period", ["event_id"])
    return x.select("period", "trades", settled("net", 3).alias("net"), settled("win_rate").alias("win_rate"), settled("profit_factor", 5).alias("profit_factor"), settled("max_drawdown", 3).alias("max_drawdown"), "best", "worst")


@query(with_views(f"SELECT g, count(*) AS trades, count(*) FILTER (direction = 'LONG') AS longs, {settled_sql('sum(net) / count(DISTINCT d)', 4)} AS ev_per_day, {settled_sql('sum(f2) / count(*)')} AS holding, {settled_sql('least(1, sum(f2) / 1e6)')} AS exposure, {settled_sql('count(*) / count(DISTINCT d)')} AS per_day, {settled_sql('count(*) / 5e4')} AS frequency FROM tr GROUP BY 1", s=_S, tr=_TRADES))
def exposure_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _trades(spark, sf_dir).select("g", "direction", F.col("d").alias("date"), "net", F.col("f2").alias("holding_minutes"), F.lit(50_000).alias("c"), F.lit(1e6).alias("m"))
    y = E.exposure_metrics(x, ["g"], "c", "m")
    return y.select("g", "trades", "longs", settled("ev_per_day", 4).alias("ev_per_day"), *[settled(k).alias(k) for k in ("holding", "exposure", "per_day", "frequency")])


@query("SELECT coalesce(problem, 'joined') AS problem, count(*) AS n FROM (SELECT CASE WHEN e.event_id % 8 = 0 THEN 'missing' WHEN e.event_id % 9 = 0 THEN 'hash' END AS problem FROM events e) GROUP BY 1")
def outcomes_of_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("event_id", F.md5("event_type").alias("source_hash"), "value")
    o = x.where("event_id % 8 <> 0").select("event_id", F.when(F.col("event_id") % 9 == 0, "other").otherwise(F.col("source_hash")).alias("source_hash"), F.col("value").alias("outcome"))
    joined, bad = E.outcomes_of_predictions(x, o, "event_id", "source_hash")
    return joined.select(F.lit("joined").alias("problem")).unionByName(bad.select("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query(with_views(f"""SELECT q, width, horizon, n, l AS long, s AS short, {settled_sql('CASE WHEN l + s > 0 THEN (l - s) / (l + s) END')} AS lean, {settled_sql('CASE WHEN l + s > 0 THEN ag / (l + s) END')} AS agreement FROM (SELECT q, width, horizon, count(*) AS n, count(*) FILTER (lb = 'LONG') AS l, count(*) FILTER (lb = 'SHORT') AS s, count(*) FILTER ((lb = 'LONG' AND mv > 0) OR (lb = 'SHORT' AND mv < 0)) AS ag FROM lb2 GROUP BY ALL)""", "v_daily",
    sw="SELECT ticker, date, close, h.h AS horizon, CASE h.h WHEN 1 THEN lead(high) OVER w WHEN 4 THEN max(high) OVER f END AS hi, CASE h.h WHEN 1 THEN lead(low) OVER w WHEN 4 THEN min(low) OVER f END AS lo, CASE h.h WHEN 1 THEN lead(close) OVER w WHEN 4 THEN lead(close, 4) OVER w END - close AS mv FROM v_daily, (VALUES (1), (4)) h(h) WINDOW w AS (PARTITION BY ticker, h.h ORDER BY date), f AS (PARTITION BY ticker, h.h ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)",
    lb2="SELECT CAST(year(date) AS VARCHAR) || 'Q' || CAST(quarter(date) AS VARCHAR) AS q, k.width, horizon, mv, CASE WHEN hi >= close + width AND lo <= close - width THEN 'AMBIGUOUS' WHEN hi >= close + width THEN 'LONG' WHEN lo <= close - width THEN 'SHORT' ELSE 'NO_TRADE' END AS lb FROM sw, (VALUES (20000), (30000), (40000), (50000), (60000)) k(width) WHERE hi IS NOT NULL AND mv IS NOT NULL"))
def label_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by quarter, five widths and two horizons, their lean and agreement with the move."""
    w = W.partitionBy("ticker").orderBy("date")
    f = w.rowsBetween(1, 4)
    x = v_daily(spark, sf_dir).select("date", "close", F.lead("high").over(w).alias("h1"), F.lead("low").over(w).alias("l1"), F.max("high").over(f).alias("h4"), F.min("low").over(f).alias("l4"), (F.lead("close").over(w) - F.col("close")).alias("m1"), (F.lead("close", 4).over(w) - F.col("close")).alias("m4"))
    each = F.array(*[F.struct(F.lit(n).alias("horizon"), F.col(f"h{n}").alias("hi"), F.col(f"l{n}").alias("lo"), F.col(f"m{n}").alias("move")) for n in (1, 4)])
    x = x.select("date", "close", F.explode(each).alias("_e")).select("date", "close", "_e.*").where("hi IS NOT NULL AND move IS NOT NULL").withColumn("width", F.explode(F.array(*[F.lit(v) for v in (20000, 30000, 40000, 50000, 60000)])))
    up, down = F.col("hi") >= F.col("close") + F.col("width"), F.col("lo") <= F.col("close") - F.col("width")
    x = x.withColumn("label", F.when(up & down, "AMBIGUOUS").when(up, "LONG").when(down, "SHORT").otherwise("NO_TRADE")).withColumn("q", F.concat(F.year("date").cast("string"), F.lit("Q"), F.quarter("date").cast("string")))
    return E.label_shares(x, ["q", "width", "horizon"]).withColumn("lean", settled("lean")).withColumn("agreement", settled("agreement"))
