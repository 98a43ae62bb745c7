"""Samples for training, with every candidate that gave none beside them under its reason.

Candidates are all bars of a session. Features are of what was known at the bar's end, entry and exit
are at quotes of states, and evidence is held against the times at which it was valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.micro import KEYS, triple_barrier
from tidemark.operators.rules import executable, net_outcomes

CANDIDATE = [*KEYS, "bar"]

# Features by group, in order.
GROUPS = {
    "price": ["return_1m", "return_5m", "ema_distance_5", "consecutive_up_bars", "body_to_range_ratio"],
    "vwap": ["session_vwap", "rolling_vwap_5m", "price_to_session_vwap_atr", "vwap_slope_5m"],
    "flow": ["aggressive_buy_volume_10s", "aggressive_sell_volume_10s", "trade_imbalance_10s", "large_trade_ratio"],
    "orderbook": ["spread_points", "midpoint", "microprice", "microprice_minus_midpoint", "level1_book_imbalance", "level3_book_imbalance", "level5_book_imbalance"],
    "basis": ["basis_points", "basis_change_10s", "basis_change_1m", "basis_pct", "basis_zscore_5m"],
    "volatility": ["true_range_1m", "atr_5m", "realized_vol_5m", "range_expansion_ratio"],
    "structure": ["distance_previous_day_high_atr", "distance_previous_day_low_atr", "distance_previous_close_atr", "distance_night_high_atr", "break_previous_high"],
    "time": ["session_day", "session_night", "minutes_from_session_open", "minutes_to_session_close", "days_to_expiry", "is_rollover_day"],
}
# Features that are candidates only, those left out of reduced sets, and those that may be missing.
NOT_FORMAL = ["consecutive_up_bars", "midpoint", "level1_book_imbalance", "level3_book_imbalance", "level5_book_imbalance", "basis_change_10s", "distance_previous_close_atr", "distance_night_high_atr", "break_previous_high", "session_night", "is_rollover_day"]
REDUCED_OUT = ["trade_imbalance_10s", "large_trade_ratio"]
MISSING = {"basis_points": "underlying_missing", "basis_zscore_5m": "basis_dispersion_missing", "spread_points": "quote_missing", "atr_5m": "atr_missing", "distance_previous_close_atr": "previous_day_missing", "distance_night_high_atr": "night_range_missing"}
MISSING_REDUCED = {
    "return_1m": "return_1m_missing", "return_5m": "return_5m_missing", "ema_distance_5": "ema_distance_5_missing", "body_to_range_ratio": "body_to_range_ratio_missing", "vwap_slope_5m": "vwap_slope_5m_missing", "price_to_session_vwap_atr": "price_to_session_vwap_atr_missing",
    "realized_vol_5m": "realized_vol_5m_missing", "range_expansion_ratio": "range_expansion_ratio_missing", "distance_previous_day_high_atr": "previous_day_high_missing", "distance_previous_day_low_atr": "previous_day_low_missing",
}
SCHEMAS = ("full", "historical", "historical_reduced")


def feature_schema(kind: str) -> dict[str, object]:
    """Primary and formal features and missing flags of a collection.

    full: live collection; historical: trades with their own quotes, so without an underlying;
    historical_reduced: that without two features that are often null, and with flags for those that sometimes are.
    """
    if kind not in SCHEMAS:
        raise ValueError(f"schema of features must be one of {SCHEMAS}: {kind}")
    gone = set() if kind == "full" else set(GROUPS["basis"])
    primary = [n for names in GROUPS.values() for n in names if n not in gone]
    formal = [n for n in primary if n not in NOT_FORMAL and not (kind == "historical_reduced" and n in REDUCED_OUT)]
    missing = MISSING_REDUCED if kind == "historical_reduced" else {n: flag for n, flag in MISSING.items() if n not in gone}
    return {"primary": primary, "formal": formal, "missing": missing}


def with_schema(df: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """keys, the formal features of a collection, and its flags of missing values; a feature that is not there is an error."""
    schema = feature_schema(kind)
    lacking = [n for n in [*schema["formal"], *schema["missing"]] if n not in df.columns]
    if lacking:
        raise ValueError(f"features of schema {kind} are lacking: {', '.join(lacking)}")
    return df.select(*keys, *[F.col(n).cast("double").alias(n) for n in schema["formal"]], *[F.col(n).isNull().cast("double").alias(flag) for n, flag in schema["missing"].items()])


def prior_sessions(b: DataFrame) -> DataFrame:
    """Of each session the high, low and last close of the target's session before, and when that began; null in the first."""
    s = b.groupBy(*KEYS).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", F.when(F.col("close").isNotNull(), F.col("bar"))).alias("close"))
    w = W.partitionBy("target").orderBy("session_start")  # one row a session
    return s.select(*KEYS, *[F.lag(n).over(w).alias(f"prev_{n}") for n in ("high", "low", "close")], F.lag("session_start").over(w).alias("prev_start"))


def prior_thresholds(states: DataFrame, share: float = 0.9) -> DataFrame:
    """(target, session_start, threshold): the volume at place max(0, int(share n) - 1) of all positive volumes of earlier sessions.

    1 where there is none. Volumes are counted by session and value first. The running counts take a row for a
    session and a value that an earlier session of the target traded, never a row of states: a target trades in
    fewer sizes than a session has steps, so they are fewer than the states. Ties are one value.
    """
    sessions = states.select(*KEYS).distinct()
    counts = states.where("volume > 0").groupBy(*KEYS, "volume").agg(F.count("*").alias("_n"))
    seen = counts.groupBy("target", "volume").agg(F.min("session_start").alias("_from"))
    grid = sessions.join(seen, "target").where("_from < session_start").select(*KEYS, "volume")
    first = seen.select("target", F.col("_from").alias("session_start"), "volume")
    running = W.partitionBy("target", "volume").orderBy("session_start").rowsBetween(W.unboundedPreceding, -1)
    x = grid.unionByName(first).join(counts, [*KEYS, "volume"], "left").withColumn("_before", F.sum("_n").over(running)).where("_before > 0")
    by_size = W.partitionBy(*KEYS).orderBy("volume")
    x = x.withColumn("_upto", F.sum("_before").over(by_size)).withColumn("_all", F.sum("_before").over(W.partitionBy(*KEYS)))
    place = F.greatest(F.lit(0), F.floor(F.col("_all") * share) - 1)
    found = x.where(F.col("_upto") > place).groupBy(*KEYS).agg(F.min("volume").alias("threshold"))
    return sessions.join(found, KEYS, "left").withColumn("threshold", F.coalesce("threshold", F.lit(1)).cast("long"))


def last_states(states: DataFrame, n: int, values: list[str]) -> DataFrame:
    """(target, session_start, bar, last_step, values) of the last state of each bar of n steps."""
    x = states.withColumn("bar", F.floor(F.col("step") / n))
    return x.groupBy(*CANDIDATE).agg(F.max("step").alias("last_step"), F.max_by(F.struct(*values), "step").alias("_v")).select(*CANDIDATE, "last_step", "_v.*")


def validity(events: DataFrame, keys: list[str], feature: str, order: list[str], available: str = "received_ts", id: str = "event_id") -> DataFrame:
    """(keys, feature, evidence_id, valid_from, valid_to): an event is valid from its receipt to the first receipt of a later one.

    keys name a bounded group such as a session; valid_to is null of the last.
    """
    later = W.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order]).rowsBetween(W.unboundedPreceding, -1)
    return events.select(*keys, F.lit(feature).alias("feature"), F.col(id).alias("evidence_id"), F.col(available).alias("valid_from"), F.min(available).over(later).alias("valid_to"))


def used_evidence(events: DataFrame, candidates: DataFrame, feature: str, order: list[str], id: str = "event_id") -> DataFrame:
    """(candidate, decision_at, feature, evidence_id): the last event by the end of each candidate's bar, null if none.

    events carry their bar; candidates carry decision_at.
    """
    last = events.groupBy(*CANDIDATE).agg(F.max(F.struct(*order, F.col(id).alias("_id"))).alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(W.partitionBy(*KEYS).orderBy("bar").rowsBetween(W.unboundedPreceding, 0))
    x = candidates.select(*CANDIDATE, "decision_at").join(last, CANDIDATE, "left").withColumn("_last", carried)
    return x.select(*CANDIDATE, "decision_at", F.lit(feature).alias("feature"), F.col("_last._id").alias("evidence_id"))


def audit_evidence(used: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """used with valid_from, valid_to and finding of the named evidence at the decision.

    ABSENT: none was used; UNKNOWN: what was used isn't there; LATE: not yet received; SUPERSEDED: a later
    one was; else OK. An equi-join on ids, which are distinct within keys and feature.
    """
    named = used.where("evidence_id IS NOT NULL").join(evidence, [*keys, "feature", "evidence_id"], "left")
    finding = F.when(F.col("valid_from").isNull(), "UNKNOWN").when(F.col("valid_from") > F.col("decision_at"), "LATE").when(F.col("valid_to") <= F.col("decision_at"), "SUPERSEDED").otherwise("OK")
    columns = [*used.columns, "valid_from", "valid_to"]
    absent = used.where("evidence_id IS NULL").select("*", *[F.lit(None).cast(evidence.schema[n].dataType).alias(n) for n in ("valid_from", "valid_to")], F.lit("ABSENT").alias("finding"))
    return named.select(*columns, finding.alias("finding")).unionByName(absent)


def audit_failures(audited: DataFrame, refused: tuple[str, ...] = ("LATE", "UNKNOWN")) -> DataFrame:
    """(candidate, failures): features with a refused finding, in order of name, for the candidates that have one."""
    bad = audited.where(F.col("finding").isin(*refused))
    return bad.groupBy(*CANDIDATE).agg(F.array_sort(F.collect_set("feature")).alias("failures"))


def build_samples(b: DataFrame, last: DataFrame, context: DataFrame, failures: DataFrame, horizon: int, multiple: float, minimum: float, cost: float | Column) -> DataFrame:
    """One row a candidate, so samples and rejects together are the candidates; `reason` is null of samples.

    b: bars with features (complete, close, high, low, atr5); last: the last state of each bar (bid, ask,
    quote_fresh); context: one row a session; failures: of audit_failures(). Reasons, the first that holds:
    INCOMPLETE_DECISION_BAR, NO_ENTRY_QUOTE (none, stale or crossed), EVIDENCE (see failures), SHORT_SESSION
    (fewer than `horizon` bars follow), INCOMPLETE_HORIZON (before a barrier is touched), NO_EXIT_QUOTE. Entry is at
    the last state's quote, exit at that of the bar of the outcome. An ambiguous label stays, but doesn't train.
    A range that is null or 0 counts as 1.
    """
    range_ = F.when(F.col("atr5") > 0, F.col("atr5")).otherwise(1.0)
    quoted = F.col("quote_fresh") & executable("bid", "ask", 0.0, 0.0)["long_entry"].isNotNull()
    quotes = last.select(*CANDIDATE, *[F.when(quoted, F.col(n)).alias(n) for n in ("bid", "ask")])
    following = F.max("bar").over(W.partitionBy(*KEYS)) - F.col("bar")
    x = b.withColumn("following", following).join(quotes, CANDIDATE, "left").withColumnsRenamed({"bid": "entry_bid", "ask": "entry_ask"})
    entries = x.where("complete AND entry_ask IS NOT NULL").select(*CANDIDATE, F.col("entry_bid").alias("bid"), F.col("entry_ask").alias("ask"), range_.alias("atr"))
    labels = triple_barrier(entries, b, horizon, multiple, minimum).select(*CANDIDATE, "label", "upper", "lower", "mfe", "mae", F.coalesce("touch_at", F.lit(horizon)).cast("int").alias("outcome_at"))
    exits = quotes.select(*KEYS, F.col("bar").alias("exit_bar"), F.col("bid").alias("exit_bid"), F.col("ask").alias("exit_ask"))
    x = x.join(labels, CANDIDATE, "left").withColumn("exit_bar", F.col("bar") + F.col("outcome_at")).join(exits, [*KEYS, "exit_bar"], "left")
    x = x.join(context, KEYS, "left").join(failures, CANDIDATE, "left")
    reason = (
        F.when(~F.coalesce("complete", F.lit(False)), "INCOMPLETE_DECISION_BAR")
        .when(F.col("entry_ask").isNull(), "NO_ENTRY_QUOTE")
        .when(F.size(F.coalesce("failures", F.array().cast("array<string>"))) > 0, "EVIDENCE")
        .when(F.col("following") < horizon, "SHORT_SESSION")
        .when(F.col("label").isNull(), "INCOMPLETE_HORIZON")
        .when(F.col("exit_ask").isNull(), "NO_EXIT_QUOTE")
    )
    x = net_outcomes(x.withColumn("reason", reason), F.lit(cost) if not isinstance(cost, Column) else cost)
    sample = F.col("reason").isNull()
    x = x.withColumns({n: F.when(sample, F.col(n)) for n in ("label", "outcome_at", "upper", "lower", "mfe", "mae", "exit_bid", "exit_ask", "long_gross", "short_gross", "long_net", "short_net", "net")})
    gap = lambda n: F.when(F.col("atr5") != 0, (F.col("close") - F.col(n)) / F.col("atr5"))
    return x.withColumn("training_eligible", sample & F.coalesce(F.col("label") != "AMBIGUOUS", F.lit(False))).withColumns({f"to_prev_{n}": gap(f"prev_{n}") for n in ("high", "low", "close")})
