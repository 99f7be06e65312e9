"""Findings of players and teams: every rule in one pass, each with its severity and confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import clamp

#: High and low percentiles; of finishing: least expected output, minutes, shots, residual, and a high one; deltas of a risk and its confidence.
HIGH, LOW = 65.0, 35.0
EXPECTED, MINUTES, SHOTS, RESIDUAL, LARGE_RESIDUAL = 5.0, 450, 10, 2.0, 5.0
RISK, LARGE_RISK, RISK_CONFIDENCE, BREAKOUT = 20.0, 30.0, 0.45, 80.0


def severity(size: Column, notable: float, high: float) -> Column:
    return F.when(F.abs(size) >= high, "high").when(F.abs(size) >= notable, "notable").when(size.isNotNull(), "info")


def residual_class(actual: Column, expected: Column, non_penalty: Column | None = None, non_penalty_expected: Column | None = None, threshold: float = RESIDUAL) -> Column:
    """Of output less expected output: results_above_process, results_below_process or aligned; insufficient_data without an expectation. Non-penalty values come first where both are known."""
    if non_penalty is not None and non_penalty_expected is not None:
        both = non_penalty.isNotNull() & non_penalty_expected.isNotNull()
        actual, expected = F.when(both, non_penalty).otherwise(actual), F.when(both, non_penalty_expected).otherwise(expected)
    delta = actual - expected
    return F.when(delta.isNull(), "insufficient_data").when(delta >= threshold, "results_above_process").when(delta <= -threshold, "results_below_process").otherwise("aligned")


def chance_quality_allowed(volume: Column, on_target: Column, xga: Column) -> Column:
    """Of percentiles where more is better (fewer shots allowed): few chances but good ones, many but poor ones, or insufficient_data. xGA tells quality before shots on target do."""
    quality = F.coalesce(xga, on_target)
    return F.when((volume >= HIGH) & (quality <= LOW), "few_but_high_quality_chances_allowed").when((volume <= LOW) & (quality >= HIGH), "high_volume_low_quality_allowed").otherwise("insufficient_data")


def _finding(code: str, when: Column, how: Column, confidence: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), how.alias("severity"), confidence.cast("double").alias("confidence")))


def _rows(df: DataFrame, keys: Sequence[str], rules: list[Column]) -> DataFrame:
    return df.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("f")).select(*keys, "f.*")


def team_findings(teams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, code, severity, confidence: every rule of a team.

    teams: results_process_delta, signals (array, as operators.teams gives
    them), defense, confidence; and the percentiles possession, creation,
    volume_allowed, on_target_allowed, xga_allowed, of which more is better.
    What is null, or isn't a column, fires no rule.
    """
    def of(name: str, kind: str = "double") -> Column:
        return F.col(name) if name in teams.columns else F.lit(None).cast(kind)

    c, delta, defense, gap = of("confidence"), of("results_process_delta"), of("defense"), of("possession") - of("creation")
    signals = of("signals", "array<string>")
    allowed = chance_quality_allowed(of("volume_allowed"), of("on_target_allowed"), of("xga_allowed"))
    return _rows(teams, keys, [
        _finding("results_above_process", delta >= 12, severity(delta, 12, 25), c), _finding("results_below_process", delta <= -12, severity(delta, 12, 25), c),
        _finding("creation_problem", F.array_contains(signals, "creation_issue"), F.lit("notable"), c), _finding("defensive_process_weak", F.array_contains(signals, "defensive_process_issue"), F.lit("notable"), c),
        _finding("defensive_process_strong", defense >= HIGH, severity(defense - HIGH, 0, 20), c),
        _finding("regression_risk", (delta >= RISK) & (c <= RISK_CONFIDENCE), F.when(delta >= LARGE_RISK, "high").otherwise("notable"), c),
        _finding("sterile_possession", (of("possession") >= HIGH) & (of("creation") <= LOW), severity(gap, 40, 60), c),
        *(_finding(code, allowed == code, F.lit("notable"), c) for code in ("few_but_high_quality_chances_allowed", "high_volume_low_quality_allowed")),
    ])


def player_findings(players: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, code, severity, confidence: every rule of a player.

    players: goals, xg, non_penalty_goals, npxg, minutes, shots, confidence,
    volume_pct, accuracy_pct, watchlist_signal, watchlist_score, rating_signal,
    rating_gap. Null minutes or shots pass their gates; what else is null, or
    isn't a column, fires no rule.
    """
    def of(name: str, kind: str = "double") -> Column:
        return F.col(name) if name in players.columns else F.lit(None).cast(kind)

    both = of("non_penalty_goals").isNotNull() & of("npxg").isNotNull()
    known = of("goals").isNotNull() & of("xg").isNotNull()
    actual, expected = F.when(both, of("non_penalty_goals")).otherwise(of("goals")), F.when(both, of("npxg")).otherwise(of("xg"))
    enough = known & (expected >= EXPECTED) & F.coalesce(of("minutes") >= MINUTES, F.lit(True)) & F.coalesce(of("shots") >= SHOTS, F.lit(True))
    delta, c = actual - expected, of("confidence")
    sure = clamp(F.least(c, expected / (expected + EXPECTED), of("minutes") / (of("minutes") + MINUTES)), 0.0, 1.0)  # least() passes nulls over
    gap = of("volume_pct") - of("accuracy_pct")
    rated = of("rating_signal", "string")
    return _rows(players, keys, [
        _finding("finishing_underperformance", enough & (delta <= -RESIDUAL), severity(delta, RESIDUAL, LARGE_RESIDUAL), sure), _finding("finishing_overperformance", enough & (delta >= RESIDUAL), severity(delta, RESIDUAL, LARGE_RESIDUAL), sure),
        _finding("high_volume_low_quality_shooting", (of("volume_pct") >= HIGH) & (of("accuracy_pct") <= LOW), severity(gap, 40, 60), c),
        _finding("breakout_signal", of("watchlist_signal", "string") == "breakout", F.when(of("watchlist_score") >= BREAKOUT, "high").otherwise("notable"), c),
        _finding("underrated", (rated == "underrated") & of("rating_gap").isNotNull(), severity(of("rating_gap"), 12, 25), c), _finding("overrated", (rated == "overrated") & of("rating_gap").isNotNull(), severity(of("rating_gap"), 12, 25), c),
    ])


def v2_inputs(features: DataFrame, scores: DataFrame, creation: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What team_findings() reads, of evidence-gated features (keys, metric, percentile), scores (keys, confidence) and dimensions' evidence (keys, dimension, score).

    Percentiles of what is allowed rank the raw value, so they are turned
    around; possession isn't. Rules on results and process have no input here.
    """
    def percentile(metric: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col("percentile")))

    wide = features.groupBy(*keys).agg(percentile("possession_pct").alias("possession"), *(F.round(100.0 - percentile(m), 2).alias(name) for m, name in (("shots_allowed", "volume_allowed"), ("shots_on_target_allowed", "on_target_allowed"), ("xga", "xga_allowed"))))
    made = creation.where("dimension = 'creation'").select(*keys, F.col("score").alias("creation"))
    return scores.select(*keys, "confidence").join(wide, list(keys), "left").join(made, list(keys), "left")
