"""Evaluation of models and rules: calibrators, baselines, stability, ablation, verdicts, holdout and reports, as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import logit, reasons
from tidemark.operators import validation as V


def fold_sizes(rows: int, folds: int) -> tuple[int, int, int] | None:
    """(test, validation, training at least) of so many outer folds; None with too few rows."""
    if rows < folds * 3 + 3:
        return None
    test = max(1, rows // (folds + 3))
    return test, max(1, test // 2), rows - folds * test


def with_interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in pairs])


def fit_platt(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    """(intercept, coefficient) of the label on the logit of the score."""
    x = df.select(logit(score, 1e-12).alias("_z"), F.col(label).cast("double").alias("_label"))
    base, by_name = V.coefficients(V.fit_logistic(x, ["_z"], "_label", 1e-6, rows=1), ["_z"])
    return base, by_name["_z"]


def platt(score: str, fitted: tuple[float, float]) -> Column:
    return F.lit(1.0) / (1.0 + F.exp(-(F.lit(fitted[0]) + F.lit(fitted[1]) * logit(score, 1e-12))))


def choose_calibrator(df: DataFrame, scores: dict[str, str], label: str, net: str, bins: int = 10, least: int = 20) -> DataFrame:
    """One row a method: Brier, log loss, calibration error, expected value, whether a bin is sparse, and whether it is chosen.

    The least of (Brier, log loss, error, -value) is chosen; scores: method to column.
    """
    out = None
    for method, name in scores.items():
        m = V.classification(df, [], name, label, bins).select("brier", "log_loss", "ece")
        sparse = df.groupBy(F.least(F.floor(F.col(name) * bins), F.lit(bins - 1))).agg(F.count("*").alias("_n")).agg(F.coalesce(F.bool_or(F.col("_n") < least), F.lit(False)).alias("sparse"))
        row = m.crossJoin(df.agg(F.avg(F.col(name) * F.col(net)).alias("value"))).crossJoin(sparse).select(F.lit(method).alias("method"), "brier", "log_loss", "ece", "value", "sparse")
        out = row if out is None else out.unionByName(row)
    key = F.struct("brier", "log_loss", "ece", (-F.col("value")).alias("v"), "method")
    return out.withColumn("chosen", key == F.min(key).over(W.partitionBy()))


def signals_of_baselines(df: DataFrame) -> DataFrame:
    """df (price, previous_price, vwap, ema_slope, p_return) with the signal of each of five baselines; the last is a model of returns only."""
    way = lambda x: F.when(x > 0, "LONG").when(x < 0, "SHORT").otherwise("NO_TRADE")
    parts = {"none": F.lit("NO_TRADE"), "last_move": way(F.col("price") - F.col("previous_price")), "vwap_side": way(F.col("price") - F.col("vwap")), "ema_slope": way(F.col("ema_slope")), "return_model": way(F.when(F.abs(F.col("p_return") - 0.5) > 1e-15, F.col("p_return") - 0.5).otherwise(0.0))}
    return df.select("*", *[v.alias(f"baseline_{k}") for k, v in parts.items()])


def fold_metrics(df: DataFrame, fold: str, p: str, label: str, net: str) -> DataFrame:
    """By fold: expected value, Brier, log loss, accuracy, profit factor and the share of rows that trade (net not null)."""
    m = V.classification(df, [fold], p, label).select(fold, "brier", "log_loss", "accuracy")
    gains, losses = F.sum(F.greatest(F.col(net), F.lit(0.0))), -F.sum(F.least(F.col(net), F.lit(0.0)))
    t = df.groupBy(fold).agg(F.coalesce(F.avg(net), F.lit(0.0)).alias("ev"), F.when(gains > 0, gains / F.greatest(losses, F.lit(1e-12))).otherwise(0.0).alias("profit_factor"), (F.count(net) / F.count("*")).alias("frequency"))
    return t.join(m, fold)


def generalisation_gaps(folds: DataFrame) -> DataFrame:
    """folds (fold, train_* and test_* of ev, profit_factor, brier, frequency, accuracy) with the gaps and the risk reasons in order."""
    t, s = (lambda n: F.col(f"train_{n}")), (lambda n: F.col(f"test_{n}"))
    why = reasons(
        ("TRAIN_POSITIVE_TEST_NEGATIVE_EV", (t("ev") > 0) & (s("ev") < 0)), ("PROFIT_FACTOR_GAP", t("profit_factor") > F.greatest(F.lit(1.0), s("profit_factor") * 1.5)), ("CALIBRATION_GAP", t("brier") + 0.05 < s("brier")),
        ("TRADE_FREQUENCY_GAP", t("frequency") > F.greatest(F.lit(0.01), s("frequency") * 2)), ("ACCURACY_UP_NET_EV_DOWN", (t("accuracy") > s("accuracy")) & (s("ev") < t("ev"))),
    )
    return folds.select("fold", (s("brier") - t("brier")).alias("brier_gap"), (s("ev") - t("ev")).alias("ev_gap"), (t("profit_factor") - s("profit_factor")).alias("profit_factor_gap"), (t("frequency") - s("frequency")).alias("frequency_gap"), (t("accuracy") - s("accuracy")).alias("accuracy_gap"), why.alias("reasons"))


def ablations(results: DataFrame) -> DataFrame:
    """results (fold, removed, ev, log_loss, brier; removed null for the full model) to one row a removed group.

    gain_ratio: folds where the full model is no worse in all three; fold_stability: 1 less the
    spread of the gains over 1 plus the largest value; supported where over half the folds gain.
    """
    full = results.where("removed IS NULL").select("fold", *[F.col(n).alias(f"_{n}") for n in ("ev", "log_loss", "brier")])
    x = results.where("removed IS NOT NULL").join(full, "fold").withColumn("_gain", F.col("_ev") - F.col("ev"))
    ok = (F.col("_ev") >= F.col("ev")) & (F.col("_log_loss") <= F.col("log_loss")) & (F.col("_brier") <= F.col("brier"))
    stable = 1 - (F.max("_gain") - F.min("_gain")) / (1 + F.max(F.abs("_ev")))
    out = x.groupBy("removed").agg((F.count_if(ok) / F.count("*")).alias("gain_ratio"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), stable)).alias("fold_stability"))
    return out.withColumn("supported", F.col("gain_ratio") > 0.5)


def coefficient_stability(observed: DataFrame, removals: DataFrame) -> DataFrame:
    """By feature over folds: median coefficient, share of the dominant sign, stability of its rank, support by removal, unstable.

    observed: feature, fold, coefficient, rank, important; removals: feature, fold, full_ev, removed_ev.
    """
    up, down = F.count_if(F.col("coefficient") > 0), F.count_if(F.col("coefficient") < 0)
    x = observed.groupBy("feature").agg(
        F.percentile("coefficient", F.lit(0.5)).alias("median"), (F.greatest(up, down) / F.count("*")).alias("dominant_sign"), F.when(F.count("*") > 1, 1 / (1 + F.stddev_pop("rank"))).otherwise(1.0).alias("rank_stability"), F.bool_or("important").alias("important"),
    )
    r = removals.groupBy("feature").agg((F.count_if(F.col("full_ev") >= F.col("removed_ev")) / F.count("*")).alias("removal_support"))
    x = x.join(r, "feature")
    return x.withColumn("unstable", F.col("important") & ((F.col("dominant_sign") < 0.70) | (F.abs("median") <= 1e-12) | (F.col("removal_support") <= 0.5)))


def redundancy_groups(correlations: DataFrame, profiles: DataFrame, threshold: float = 0.90) -> DataFrame:
    """(feature, members, kept): features connected by correlations above the threshold, and which one stays.

    Kept by completeness, then simplicity rank, then stability, then name. Features are tens at
    most, columns of one table, so their pairs come to the driver to be labelled.
    """
    root: dict[str, str] = {}
    for r in correlations.where(F.abs("corr") > threshold).select("a", "b").collect():
        old, new = sorted((root.get(r["a"], r["a"]), root.get(r["b"], r["b"])), reverse=True)
        root |= {r["a"]: new, r["b"]: new} | {k: new for k, v in root.items() if v == old}
    labels = profiles.sparkSession.createDataFrame([*root.items(), ("", "")], "feature string, _root string")
    x = profiles.join(F.broadcast(labels), "feature", "left").withColumn("root", F.coalesce("_root", "feature"))
    order = W.partitionBy("root").orderBy(F.col("completeness").desc(), "simplicity", F.col("stability").desc(), "feature")
    return x.select("feature", F.array_join(F.array_sort(F.collect_list("feature").over(W.partitionBy("root"))), ",").alias("members"), (F.row_number().over(order) == 1).alias("kept"))


def fragile(results: DataFrame, selected: tuple[float, float, float]) -> DataFrame:
    """One row: whether the selected (l2, threshold, atr) gains and none of its six neighbours does. results: l2, threshold, atr, value."""
    l2, t, k = selected
    near = [(0.5 * l2, t, k), (2 * l2, t, k), (l2, round(t - 0.05, 12), k), (l2, round(t + 0.05, 12), k), (l2, t, round(k - 0.25, 12)), (l2, t, round(k + 0.25, 12))]
    is_ = lambda p: (F.col("l2") == p[0]) & (F.col("threshold") == p[1]) & (F.col("atr") == p[2])
    value = lambda p: F.max(F.when(is_(p), F.col("value")))
    lost = F.lit(True)
    for p in near:
        lost = lost & (value(p) <= 0)
    return results.agg(value(selected).alias("value"), ((value(selected) > 0) & lost).alias("fragile"))


def select_inner(candidates: DataFrame, keys: list[str], metrics: list[Column]) -> DataFrame:
    """Of each key's candidates the best by the metrics in order, then id, of those without sparse bins; null where all have some."""
    order = W.partitionBy(*keys).orderBy("sparse", *metrics, "candidate_id")
    x = candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return x.select(*keys, F.when(~F.col("sparse"), F.col("candidate_id")).alias("candidate_id"), F.when(F.col("sparse"), "INSUFFICIENT_CALIBRATION_EVIDENCE").otherwise("SELECTED").alias("status"))


def difference_intervals(rows: DataFrame, by: list[str], side: str, value: str, row_id: list[str], resamples: int, seed: str) -> DataFrame:
    """(by, low, high, excludes_zero): 95 percent intervals of the difference of means, side 'l' less side 'r', each resampled by itself."""
    seeded = V.resample_sums(rows.withColumn("_side", F.col(side)), [*by, "_side"], value, ["_side", *row_id], resamples, seed)
    mean = lambda s: F.max(F.when(F.col("_side") == s, F.col("total") / F.nullif("weight", F.lit(0))))
    x = seeded.groupBy(*by, "i").agg((mean("l") - mean("r")).alias("_d")).where("_d IS NOT NULL")
    return V.order_interval(x, by, "_d").select(*by, "low", "high", ((F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero"))


def bootstrap_difference(left: DataFrame, right: DataFrame, value: str, row_id: list[str], resamples: int, seed: str) -> DataFrame:
    """The interval of the difference of two samples' means, and whether it excludes 0."""
    both = [d.select(value, *row_id, F.lit(s).alias("_s")) for d, s in ((left, "l"), (right, "r"))]
    return difference_intervals(both[0].unionByName(both[1]), [], "_s", value, row_id, resamples, seed)


def period_verdict(signals: DataFrame, controls: DataFrame, period: str, bucket: list[str], value: str, row_id: list[str], crash: Column, needed: int, least: int, sufficient: int, resamples: int, seed: str) -> DataFrame:
    """One row: a pre-declared verdict of signals against controls, by periods.

    p1: periods whose signal mean beats both the plain mean of controls and the matched one (each signal's
    bucket of its period has the mean of its controls; signals without controls are left out). p2: whether the
    intervals of the plain and of the matched difference over all periods exclude zero; p2_calm without the rows of
    `crash`. p3: periods with a positive signal mean. p4: periods of at least `least` signals. passes: p1 and p3 in `needed`
    periods, p4 in `sufficient` ones, and p2; label: FAIL, PASS, or PASS (crash-dependent) where p2_calm fails.
    """
    known = lambda d: d.where(F.col(value).isNotNull()).select(period, *bucket, *row_id, F.col(value).alias("_v"), crash.alias("_crash"))
    s, c_ = known(signals), known(controls)
    means = c_.groupBy(*[F.col(n).alias(f"_{n}") for n in (period, *bucket)]).agg(F.avg("_v").alias("_m"), F.avg(F.when(~F.col("_crash"), F.col("_v"))).alias("_mc"))
    on = [F.col(n) == F.col(f"_{n}") for n in (period, *bucket)]
    matched = s.join(means, on).select(period, *row_id, "_v", "_m", "_mc", "_crash")

    by_period = s.groupBy(period).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    x = by_period.join(c_.groupBy(period).agg(F.avg("_v").alias("plain")), period, "left").join(matched.groupBy(period).agg(F.avg("_m").alias("matched")), period, "left")
    counts = x.agg(F.count_if((F.col("mean") > F.col("plain")) & (F.col("mean") > F.col("matched"))).alias("p1"), F.count_if(F.col("mean") > 0).alias("p3"), F.count_if(F.col("n") >= least).alias("p4"))

    # a row's values in all forms come together, so that they share its hashes
    value_in = lambda form, side, v, cond=None: F.when(F.lit(True) if cond is None else cond, F.struct(F.lit(form).alias("form"), F.lit(side).alias("_s"), F.col(v).alias("_x")))
    each = lambda d, *values: d.select(*row_id, F.explode(F.array_compact(F.array(*values))).alias("_e")).select(*row_id, "_e.*")
    calm, there = ~F.col("_crash"), F.col("_m").isNotNull()
    ours = each(
        s.join(means, on, "left"), value_in("plain", "l", "_v"), value_in("matched", "l", "_v", there), value_in("matched", "r", "_m", there),
        value_in("plain_calm", "l", "_v", calm), value_in("matched_calm", "l", "_v", calm & F.col("_mc").isNotNull()), value_in("matched_calm", "r", "_mc", calm & there),
    )
    every = ours.unionByName(each(c_, value_in("plain", "r", "_v"), value_in("plain_calm", "r", "_v", calm)))
    found = difference_intervals(every, ["form"], "_s", "_x", row_id, resamples, seed)
    of = lambda form, n: F.max(F.when(F.col("form") == form, F.col(n)))
    forms = ("plain", "matched", "plain_calm", "matched_calm")
    both = lambda a, b: F.coalesce(of(a, "excludes_zero") & of(b, "excludes_zero"), F.lit(False))
    intervals = found.agg(*[of(f, n).alias(f"{f}_{n}") for f in forms for n in ("low", "high")], both("plain", "matched").alias("p2"), both("plain_calm", "matched_calm").alias("p2_calm"))
    out = counts.crossJoin(intervals)  # one row each
    passes = (F.col("p1") >= needed) & F.col("p2") & (F.col("p3") >= needed) & (F.col("p4") >= sufficient)
    return out.withColumn("passes", passes).withColumn("label", F.when(passes & F.col("p2_calm"), "PASS").when(passes, "PASS (crash-dependent)").otherwise("FAIL"))


def filter_study(days: DataFrame) -> DataFrame:
    """days (date, kind base, eligible or blocked, net) to each kind's mean of daily means and the eligible ones' gain over the base."""
    d = days.groupBy("date", "kind").agg(F.avg("net").alias("net"))
    x = d.groupBy("kind").agg(F.count("*").alias("days"), F.avg("net").alias("mean"), F.percentile("net", F.lit(0.05)).alias("worst_5pct"))
    base = x.where("kind = 'base'").select(F.col("mean").alias("_b"))
    return x.crossJoin(F.broadcast(base)).select("kind", "days", "mean", "worst_5pct", (F.col("mean") - F.col("_b")).alias("gain"))


def holdout_evaluation(rows: DataFrame, trades: DataFrame) -> DataFrame:
    """One row of what a locked holdout says, with reasons in order.

    rows: date, probability, outcome; trades: direction, event, regimes array, target, net.
    """
    p, y = F.col("probability"), F.col("outcome").cast("double")
    edge = lambda v: F.greatest(v, F.lit(1e-15))
    r = rows.agg(F.count("*").alias("n"), F.count_distinct("date").alias("dates"), F.avg((p - y) ** 2).alias("brier"), F.avg(-(y * F.log(edge(p)) + (1 - y) * F.log(edge(1 - p)))).alias("log_loss"), F.abs(F.avg(p) - F.avg(y)).alias("ece"))
    t = trades.agg(F.count("*").alias("trades"), F.count_if(F.col("direction") == "LONG").alias("longs"), F.coalesce(F.sum("net"), F.lit(0.0)).alias("net"), F.coalesce(F.avg("net"), F.lit(0.0)).alias("ev"))
    top = trades.groupBy("event").agg(F.sum("net").alias("_v")).agg(F.max(F.greatest(F.lit(0.0), F.col("_v"))).alias("_top"))
    member = trades.select(F.explode(F.concat(F.transform("regimes", lambda v: F.concat(F.lit("r:"), v)), F.array(F.concat(F.lit("t:"), F.col("target").cast("string"))))).alias("m"), "net").groupBy("m").agg(F.sum("net").alias("_v")).agg(F.coalesce(F.min("_v") < 0, F.lit(False)).alias("_bad"))
    x = r.crossJoin(t).crossJoin(top).crossJoin(member).withColumn("event_concentration", F.when(F.col("net") > 0, F.coalesce(F.col("_top") / F.col("net"), F.lit(1.0))).otherwise(1.0))
    why = reasons(
        ("INSUFFICIENT_HOLDOUT_SAMPLE", (F.col("n") < 40) | (F.col("dates") < 40)), ("INSUFFICIENT_HOLDOUT_TRADES", (F.col("trades") < 30) | (F.col("longs") < 10) | (F.col("trades") - F.col("longs") < 10)),
        ("HOLDOUT_CALIBRATION_FAILED", (F.col("brier") > 0.25) | (F.col("log_loss") > F.log(F.lit(2.0))) | (F.col("ece") > 0.10)), ("HOLDOUT_NET_EV_OR_COST_FAILED", (F.col("net") <= 0) | (F.col("ev") < 0)),
        ("HOLDOUT_EVENT_CONCENTRATION_FAILED", F.col("event_concentration") > 0.40), ("HOLDOUT_REGIME_OR_TARGET_STABILITY_FAILED", F.col("_bad")),
    )
    return x.withColumn("reasons", why).drop("_top", "_bad")


def research_decision(evidence: DataFrame) -> DataFrame:
    """One row to (research, model, reasons): core reasons array, gap_reasons array, sparse, fragile, unstable, unsupported, synthetic, holdout."""
    why = F.concat("core_reasons", F.transform("gap_reasons", lambda g: F.concat(F.lit("GENERALIZATION_RISK:"), g)), reasons(
        ("CALIBRATION_EVIDENCE_INSUFFICIENT", F.col("sparse")), ("PARAMETER_FRAGILITY", F.col("fragile")), ("COEFFICIENT_OR_REMOVAL_INSTABILITY", F.col("unstable")), ("ABLATION_MAJORITY_SUPPORT_FAILED", F.col("unsupported")),
    ))
    x = evidence.withColumn("_why", why)
    few, some = F.col("valid_folds") < 5, F.size("_why") > 0
    research = F.when(few, "INSUFFICIENT_DATA").when(some, "REJECTED").otherwise("COMPLETE")
    model = F.when(few, "REJECTED_INSUFFICIENT_DATA").when(some, "REJECTED_OVERFIT_RISK").when(F.col("synthetic"), "CANDIDATE").when(~F.col("holdout"), "LOCKED_TEST_PENDING").otherwise("APPROVED_FOR_PAPER")
    extra = F.when(~few & ~some & F.col("synthetic"), F.array(F.lit("SYNTHETIC_TEST_ONLY_CANNOT_APPROVE"))).otherwise(F.array().cast("array<string>"))
    return x.select(*evidence.columns, research.alias("research"), model.alias("model"), F.concat("_why", extra).alias("reasons"))


CONTEXT = ("dataset_version", "fold_plan", "cost_assumption", "label_version", "period")


def incomparable(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, ...] = CONTEXT) -> DataFrame:
    """By key the parts of the context in which two experiments differ; an empty array is comparable."""
    r = right.select(*keys, *[F.col(n).alias(f"_{n}") for n in names])
    return left.join(r, keys).select(*keys, reasons(*[(n, ~F.col(n).eqNullSafe(F.col(f"_{n}"))) for n in names]).alias("mismatches"))


def fold_report(folds: DataFrame, fold: str, metrics: list[str]) -> DataFrame:
    """(metric, mean, median, worst, best, deviation, iqr) over folds."""
    return V.distribution(folds.unpivot([fold], metrics, "metric", "value"), ["metric"], "value")


def backtest(trades: DataFrame, period: str, order: list[str]) -> DataFrame:
    """Per period and in all: trades, net, mean, win rate, profit factor, largest fall of the running total, best and worst."""
    both = trades.withColumn("_p", F.explode(F.array(F.col(period).cast("string"), F.lit("all"))))
    gains, losses = F.sum(F.greatest(F.col("net"), F.lit(0.0))), -F.sum(F.least(F.col("net"), F.lit(0.0)))
    m = both.groupBy("_p").agg(F.count("*").alias("trades"), F.sum("net").alias("net"), F.avg("net").alias("mean"), (F.count_if(F.col("net") > 0) / F.count("*")).alias("win_rate"), F.when(losses > 0, gains / losses).alias("profit_factor"), F.max("net").alias("best"), F.min("net").alias("worst"))
    e = V.equity_metrics(both, ["_p"], order).select("_p", "max_drawdown")
    return m.join(e, "_p").withColumnRenamed("_p", period)


def exposure_metrics(trades: DataFrame, keys: list[str], candidates: str, minutes: str) -> DataFrame:
    """Longs and shorts, value per day, holding, exposure, trades a day and turnover. trades: direction, date, net, holding_minutes."""
    x = trades.groupBy(*keys).agg(F.count("*").alias("trades"), F.count_if(F.col("direction") == "LONG").alias("longs"), F.count_distinct("date").alias("days"), F.sum("net").alias("_net"), F.sum("holding_minutes").alias("_held"), F.max(candidates).alias("_c"), F.max(minutes).alias("_m"))
    return x.select(*keys, "trades", "longs", (F.col("trades") - F.col("longs")).alias("shorts"), (F.col("_net") / F.col("days")).alias("ev_per_day"), (F.col("_held") / F.col("trades")).alias("holding"), F.least(F.lit(1.0), F.col("_held") / F.col("_m")).alias("exposure"), (F.col("trades") / F.col("days")).alias("per_day"), (F.col("trades") / F.col("_c")).alias("frequency"))


def outcomes_of_predictions(predictions: DataFrame, outcomes: DataFrame, row_id: str, source_hash: str) -> tuple[DataFrame, DataFrame]:
    """(joined, disagreements): predictions with the outcome of their row where the hashes agree; others, and rows without one."""
    o = outcomes.withColumnRenamed(source_hash, "_hash")
    x = predictions.join(o, row_id, "left")
    same = F.coalesce(F.col(source_hash) == F.col("_hash"), F.lit(False))
    return x.where(same).drop("_hash"), x.where(~same).select(row_id, F.when(F.col("_hash").isNull(), "missing").otherwise("hash").alias("problem"))


def label_shares(labels: DataFrame, keys: list[str]) -> DataFrame:
    """labels (keys, label, move) to counts of either side, the lean to long, and how often the side agrees with the move."""
    long, short = F.count_if(F.col("label") == "LONG"), F.count_if(F.col("label") == "SHORT")
    agree = F.count_if(((F.col("label") == "LONG") & (F.col("move") > 0)) | ((F.col("label") == "SHORT") & (F.col("move") < 0)))
    return labels.groupBy(*keys).agg(F.count("*").alias("n"), long.alias("long"), short.alias("short"), F.when(long + short > 0, (long - short) / (long + short)).alias("lean"), F.when(long + short > 0, agree / (long + short)).alias("agreement"))


def rank_features(model_coefficients: dict[str, float]) -> list[tuple[str, float, int]]:
    """(feature, coefficient, rank by size) of one fit: a row a feature."""
    order = sorted(model_coefficients, key=lambda n: (-abs(model_coefficients[n]), n))
    return [(n, model_coefficients[n], i + 1) for i, n in enumerate(order)]

