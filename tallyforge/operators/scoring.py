"""Weighted scores of percentiles: one kind is shared out over what is there, the other stays null unless all is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The least coverage, by weight, of evidence that counts as partial; the ranking gate.
LEAST_COVERAGE, RANKING_CONFIDENCE = 0.60, 0.40

Profiles = dict[str, Sequence[tuple[str, float, int, bool]]]


def profile_table(spark: SparkSession, profiles: Profiles) -> DataFrame:
    """dimension, metric, weight, direction (1, or -1 where lower is better) and core, as a small table."""
    rows = [(d, m, float(w), int(s), bool(c)) for d, inputs in profiles.items() for m, w, s, c in inputs]
    return spark.createDataFrame(rows, "dimension string, metric string, weight double, direction int, core boolean")


def directed(percentile: Column, direction: Column) -> Column:
    return F.when(direction < 0, F.lit(100.0) - percentile).otherwise(percentile)


def renormalized(scored: DataFrame, keys: Sequence[str], percentile: str = "percentile", weight: str = "weight", direction: str = "direction", default: float | None = None) -> DataFrame:
    """keys and score: directed percentiles by weight, over the weights that are there; `default` where none is."""
    p = directed(F.col(percentile), F.col(direction))
    there = F.when(p.isNotNull(), F.col(weight))
    score = F.try_divide(F.sum(p * F.col(weight)), F.sum(there))
    return scored.groupBy(*keys).agg((score if default is None else F.coalesce(score, F.lit(default))).alias("score"))


def evidence(features: DataFrame, profiles: DataFrame, keys: Sequence[str], metric: str = "metric", percentile: str = "percentile") -> DataFrame:
    """keys, dimension, score, coverage, state and the metrics available and missing.

    A score is there only if every weighted input is; partial evidence is never
    scaled up. State: ready with all of it; insufficient with none, without a core
    metric, or below LEAST_COVERAGE of the weight; else partial.
    """
    entities = features.select(*keys).distinct()
    wanted = entities.join(F.broadcast(profiles), how="cross") if not set(keys) & set(profiles.columns) else entities.join(F.broadcast(profiles), [k for k in keys if k in profiles.columns])
    own = features.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(metric).alias("_m"), F.col(percentile).alias("_p"))
    on = F.col("metric") == F.col("_m")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    p = directed(F.col("_p"), F.col("direction"))
    there = F.col("_p").isNotNull()
    grouped = wanted.join(own, on, "left").groupBy(*keys, "dimension").agg(
        F.sum(p * F.col("weight")).alias("_sum"), F.sum("weight").alias("_all"), F.coalesce(F.sum(F.when(there, F.col("weight"))), F.lit(0.0)).alias("_there"),
        F.count_if(there).alias("_n"), F.count_if(~there & F.col("core")).alias("_no_core"), F.count("*").alias("_wanted"),
        F.array_sort(F.collect_set(F.when(there, F.col("metric")))).alias("available"), F.array_sort(F.collect_set(F.when(~there, F.col("metric")))).alias("missing"))
    coverage = F.round(F.col("_there") / F.col("_all"), 6)
    state = F.when((F.col("_n") == 0) | (F.col("_no_core") > 0) | (coverage < LEAST_COVERAGE), "insufficient_evidence").when(F.col("_n") < F.col("_wanted"), "partial").otherwise("ready")
    return grouped.withColumn("coverage", coverage).withColumn("state", state).select(*keys, "dimension", F.when(state == "ready", F.col("_sum") / F.col("_all")).alias("score"), "coverage", "state", "available", "missing")


def composed(dimensions: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, overall, coverage and state from dimensions (evidence()) by weights (dimension, share [, further keys]).

    overall is there only if every weighted dimension is ready; partial if any evidence is available.
    """
    on = ["dimension", *(k for k in keys if k in weights.columns)]
    joined = dimensions.join(F.broadcast(weights), on)
    ready = F.count_if(F.col("state") == "ready") == F.count("*")
    return joined.groupBy(*keys).agg(
        F.when(ready, F.sum(F.col("share") * F.col("score"))).alias("overall"), F.round(F.sum(F.col("share") * F.col("coverage")), 6).alias("coverage"),
        F.when(ready, "ready").when(F.max("coverage") > 0, "partial").otherwise("insufficient_evidence").alias("state"))


def gated_order(confidence: str = "confidence", score: str = "score", exposure: str = "exposure") -> list[Column]:
    """Order of a ranking: those below the confidence gate last, then by score, confidence and exposure."""
    return [(F.coalesce(F.col(confidence), F.lit(0.0)) < RANKING_CONFIDENCE).asc(), F.col(score).desc_nulls_last(), F.col(confidence).desc_nulls_last(), F.col(exposure).desc_nulls_last()]


def shrunk(value: Column, mean: Column, exposure: Column, prior: float) -> Column:
    """value pulled to mean by exposure / (exposure + prior)."""
    share = exposure / (exposure + F.lit(prior))
    return share * value + (1 - share) * mean


def shrunk_ratio(top: Column, bottom: Column, mean: Column, prior: float | Column) -> Column:
    """(top + prior mean) / (bottom + prior)."""
    prior = prior if isinstance(prior, Column) else F.lit(prior)
    return (top + prior * mean) / (bottom + prior)


def saturation(x: Column, scale: float) -> Column:
    """1 - exp(-x / scale)."""
    return 1 - F.exp(-x / F.lit(scale))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within the bounds; null stays null, which least() and greatest() pass over."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
