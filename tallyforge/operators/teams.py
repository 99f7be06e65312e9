"""Scores of teams by windows of their matches: observed means, shrunk finishing, percentiles, composites, signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import written
from .entity_scores import SHOT_PRIOR, TARGET_PRIOR, points, team_confidence
from .percentile import percentile
from .profiles import TEAM_V1
from .scoring import shrunk_ratio
from .windows import recent_windows

#: Metrics that are given, those that are made, and ratios with their attempts and priors.
GIVEN = ("shots_total_for", "shots_on_target_for", "shots_inside_box_for", "corners_for", "shots_total_against", "shots_on_target_against", "shots_inside_box_against", "possession_pct")
MADE = ("goals_for", "goals_against", "goal_difference_per_match", "points_per_match", "pass_accuracy_pct", "pass_share")
RATIOS = {"goals_per_shot": ("shots_total_for", SHOT_PRIOR), "goals_per_shot_on_target": ("shots_on_target_for", TARGET_PRIOR)}
#: Metrics of which less is better, and those whose observed share is the coverage.
LOWER = ("goals_against", "shots_total_against", "shots_on_target_against", "shots_inside_box_against")
COVERAGE = (*GIVEN, "pass_accuracy_pct", "pass_share")
#: The delta of results and process that is a signal; thresholds of issues.
DELTA, HIGH, LOW, FINISHES = 12.0, 65.0, 35.0, 45.0


def only_scope(rows: DataFrame, scope: Mapping[str, object]) -> DataFrame:
    """rows, if all are of the scope (column: value); else an error. Scopes are never compared with each other."""
    same = F.lit(True)
    for column, value in scope.items():
        same = same & F.col(column).eqNullSafe(F.lit(value))
    if rows.where(~same).head(1):
        raise ValueError(f"rows must belong to one scope: {dict(scope)}")
    return rows


def match_values(rows: DataFrame) -> DataFrame:
    """rows with the metrics that are made of goals and passes; null where an input is, or where there are no passes."""
    passes, accurate, both = F.col("passes_total"), F.col("passes_accurate"), F.col("passes_total") + F.col("opponent_passes_total")
    return rows.withColumns({
        "goal_difference_per_match": F.col("goals_for") - F.col("goals_against"), "points_per_match": points(F.col("goals_for"), F.col("goals_against")),
        "pass_accuracy_pct": F.when(passes > 0, 100.0 * accurate / passes), "pass_share": F.when(both > 0, 100.0 * passes / both)})


def team_windows(rows: DataFrame, scope: Sequence[str], newest: Sequence[Column], team: str = "team") -> DataFrame:
    """scope, team, window_key, matches, weighted means of each metric over the matches that have it, sums of ratios, and how often each was observed.

    rows: scope, team, goals_for, goals_against, passes_total, passes_accurate,
    opponent_passes_total, and GIVEN; metrics that are no columns are unknown.
    """
    metrics = (*MADE, *GIVEN)
    unknown = [c for c in (*GIVEN, "passes_total", "passes_accurate", "opponent_passes_total") if c not in rows.columns]
    valued = match_values(rows.withColumns({c: F.lit(None).cast("double") for c in unknown}))
    # what the windows read is stored once: some take the newest rows, one takes all
    found = recent_windows(written(valued, "matches"), [*scope, team], list(newest))
    w = F.col("weight")
    aggregates = [F.count("*").alias("matches")]
    for m in metrics:
        aggregates += [F.try_divide(F.sum(w * F.col(m)), F.sum(F.when(F.col(m).isNotNull(), w))).alias(m), F.count(m).alias(f"observed_{m}")]
    for name, (attempts, _) in RATIOS.items():
        seen = F.col(attempts).isNotNull()
        aggregates += [F.sum(F.when(seen, w * F.col("goals_for"))).alias(f"top_{name}"), F.sum(w * F.col(attempts)).alias(f"bottom_{name}"), F.count(attempts).alias(f"observed_{name}")]
    return written(found.groupBy(*scope, team, "window_key").agg(*aggregates), "windows")


def team_features(windows: DataFrame, scope: Sequence[str], team: str = "team", digits: int = 9) -> DataFrame:
    """scope, team, window_key, matches, metric, raw_value, adjusted, observed, percentile (more is better), reference_size.

    Ratios of goals are pulled to the window's ratio of sums. Values are ranked
    within scope, window and metric after rounding to `digits`.
    """
    keys = [*scope, team, "window_key", "matches"]
    means = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("raw_value"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("bottom"), F.col(f"observed_{m}").alias("observed")) for m in (*MADE, *GIVEN)))
    ratios = F.array(*(F.struct(F.lit(m).alias("metric"), F.when(F.col(f"bottom_{m}") > 0, F.col(f"top_{m}") / F.col(f"bottom_{m}")).alias("raw_value"), F.col(f"top_{m}").cast("double").alias("top"), F.col(f"bottom_{m}").cast("double").alias("bottom"), F.col(f"observed_{m}").alias("observed")) for m in RATIOS))
    long = windows.select(*keys, F.inline(F.concat(means, ratios))).where("raw_value is not null")
    group = [*scope, "window_key", "metric"]
    mean = long.where("bottom is not null").groupBy(*group).agg((F.sum("top") / F.sum("bottom")).alias("mean"))
    prior = F.lit(None).cast("double")
    for m, (_, p) in RATIOS.items():
        prior = F.when(F.col("metric") == m, p).otherwise(prior)
    joined = long.join(mean, group, "left")
    adjusted = F.when(F.col("bottom").isNull(), F.col("raw_value")).otherwise(shrunk_ratio(F.col("top"), F.col("bottom"), F.col("mean"), prior))
    ranked = percentile(written(joined.withColumn("adjusted", F.round(adjusted, digits)).drop("top", "bottom", "mean"), "features"), group, "adjusted", "mid_rank")
    return ranked.withColumn("percentile", F.when(F.col("metric").isin(*LOWER), 100.0 - F.col("percentile")).otherwise(F.col("percentile")))


def weighted(values: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """The values by weight, over the weights of those that are there."""
    top = bottom = F.lit(0.0)
    for name, w in weights.items():
        top, bottom = top + F.coalesce(values[name] * w, F.lit(0.0)), bottom + F.when(values[name].isNotNull(), F.lit(w)).otherwise(0.0)
    return F.when(bottom > 0, top / bottom)


def process_signal(delta: Column) -> Column:
    return F.when(delta >= DELTA, "results_above_process").when(delta <= -DELTA, "results_below_process").when(delta.isNotNull(), "results_aligned")


def issue_signals(chance: Column, finishing: Column, defense: Column, signal: Column) -> Column:
    """Signals in a fixed order: finishing or else creation, defence, then a process signal that isn't aligned."""
    return F.array_compact(F.array(
        F.when((chance >= HIGH) & (finishing <= LOW), "finishing_issue").when((chance <= LOW) & (finishing >= FINISHES), "creation_issue"),
        F.when(defense <= LOW, "defensive_process_issue"), F.when(signal != "results_aligned", signal)))


def team_scores(features: DataFrame, scope: Sequence[str], team: str = "team", digits: int = 9) -> DataFrame:
    """scope, team, window_key, matches, chance_generation, defense, control, finishing_proxy, process, results, attack, overall, coverage, confidence, results_process_delta, signal, signals.

    Each composite is shared out over what is known. Teams without a process or
    results have no row. Thresholds read deltas and scores of `digits` decimals.
    """
    needed = sorted({m for name in ("chance", "defense", "control", "finishing", "results") for m in TEAM_V1[name]})
    wide = features.groupBy(*scope, team, "window_key", "matches").agg(
        *(F.max(F.when(F.col("metric") == m, F.col("percentile"))).alias(f"_{m}") for m in needed), F.max("reference_size").alias("_population"),
        F.sum(F.when(F.col("metric").isin(*COVERAGE), F.col("observed") / F.col("matches"))).alias("_observed"))
    of = {m: F.col(f"_{m}") for m in needed}
    names = {"chance": "chance_generation", "defense": "defense", "control": "control", "finishing": "finishing_proxy", "results": "results"}
    parts = wide.withColumns({n: F.round(weighted(of, TEAM_V1[key]), digits) for key, n in names.items()})
    made = {key: F.col(n) for key, n in names.items()}
    parts = parts.withColumns({"process": F.round(weighted(made, TEAM_V1["process"]), digits), "attack": F.round(weighted(made, TEAM_V1["attack"]), digits)})
    parts = parts.where("process is not null and results is not null")
    coverage = F.coalesce(F.col("_observed"), F.lit(0.0)) / len(COVERAGE)
    delta = F.round(F.col("results") - F.col("process"), digits)
    found = parts.withColumns({
        "overall": F.round(weighted({"process": F.col("process"), "results": F.col("results")}, TEAM_V1["overall"]), digits), "coverage": coverage,
        "confidence": F.least(F.lit(1.0), team_confidence(F.col("matches"), coverage, F.col("_population"))), "results_process_delta": delta, "signal": process_signal(delta)})
    signals = issue_signals(F.col("chance_generation"), F.col("finishing_proxy"), F.col("defense"), F.col("signal"))
    return found.withColumn("signals", signals).drop(*(f"_{m}" for m in needed), "_population", "_observed")


def issue_rows(scores: DataFrame, keys: Sequence[str], signals: str = "signals") -> DataFrame:
    """A row for each signal of a score, with what supports it."""
    rest = [c for c in scores.columns if c not in (*keys, signals)]
    return scores.select(*keys, F.explode(signals).alias("signal_code"), F.struct(*rest).alias("supporting"))

