"""Scores of entities from their appearances: decayed rates, shrinkage, percentiles, weights, confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import written
from .percentile import percentile
from .scoring import directed, saturation, shrunk, shrunk_ratio
from .windows import recent_windows

#: Exposure of the prior; the confidence's largest population; the cap where few inputs are known.
PRIOR, POPULATION, CAPPED = 450.0, 20, 0.65
#: The priors of finishing ratios, shots and shots on target.
SHOT_PRIOR, TARGET_PRIOR = 20.0, 8.0
#: Exposure from which a window's row counts in percentiles.
LEAST_EXPOSURE = {"last_3": 90, "last_5": 180, "last_10": 270, "season": 450}


def possession_adjusted(count: Column, possession: Column) -> Column:
    """count * 0.5 / the opponent's share of play; unchanged where possession is unknown, out of range or leaves 0.05 or less."""
    share = 1 - possession / 100
    return F.when(possession.between(0, 100) & (share > 0.05), count * 0.5 / share).otherwise(count)


def primary_role(appearances: DataFrame, entity: str, role: str = "role", exposure: str = "exposure", at: str = "at") -> DataFrame:
    """entity, role and role_confidence: the role of most exposure over all rows, ties to the one seen last, then by name.

    Entities without a known role are left out.
    """
    known = appearances.where(F.col(role).isNotNull())
    each = known.groupBy(entity, role).agg(F.sum(exposure).alias("_m"), F.max(at).alias("_at"))
    best = each.groupBy(entity).agg(F.max_by(F.struct(role, "_m"), F.struct("_m", "_at", role)).alias("b"), F.sum("_m").alias("_all"))
    return best.select(entity, F.col(f"b.{role}").alias(role), F.try_divide(F.col("b._m"), F.col("_all")).alias("role_confidence"))


def rates(appearances: DataFrame, entity: str, role: str, metrics: Sequence[str], per: float = 90.0, newest: Sequence[Column] = (), exposure: str = "exposure") -> DataFrame:
    """entity, role, window_key, exposure, appearances, metric, value: per * sum(w count) / sum(w exposure) in each window.

    Counts that are null are 0 for an appearance that took place; appearances without exposure don't count.
    """
    rows = recent_windows(appearances.where(F.col(exposure) > 0), [entity], list(newest))
    w = F.col("weight")
    sums = [F.try_divide(F.lit(per) * F.sum(w * F.greatest(F.coalesce(F.col(m), F.lit(0)), F.lit(0))), F.sum(w * F.col(exposure))).alias(m) for m in metrics]
    wide = rows.groupBy(entity, role, "window_key").agg(F.sum(exposure).alias("exposure"), F.count("*").alias("appearances"), *sums)
    wide = written(wide, "rates")  # a row an entity and window, read by baselines, percentiles and scores
    return wide.unpivot([entity, role, "window_key", "exposure", "appearances"], list(metrics), "metric", "value")


def adjusted(features: DataFrame, role: str, prior: float = PRIOR, digits: int = 9) -> DataFrame:
    """features with adjusted: values pulled to the exposure-weighted mean of window, role and metric, and their mid-rank percentile.

    The mean is aggregated and joined back; values are ranked after rounding to `digits`.
    Means are stored: ranks are counted by value and joined back by it, and a
    sum of doubles depends on the order in which its parts arrive, so that the
    two would now and then differ in the last digit if each took its own.
    """
    group = ["window_key", role, "metric"]
    means = features.groupBy(*group).agg(F.try_divide(F.sum(F.col("value") * F.col("exposure")), F.sum("exposure")).alias("baseline"))
    means = written(means, "baselines")
    joined = features.join(means, group).withColumn("adjusted", F.round(shrunk(F.col("value"), F.col("baseline"), F.col("exposure"), prior), digits))
    return percentile(joined, group, "adjusted", "mid_rank")


def weight_table(spark: SparkSession, weights: dict[str, dict[str, float]], role: str = "role") -> DataFrame:
    """role, metric, weight and direction; a negative weight means that lower is better."""
    return spark.createDataFrame([(r, m, abs(float(w)), 1 if w >= 0 else -1) for r, own in weights.items() for m, w in own.items()], f"{role} string, metric string, weight double, direction int")


def scores(features: DataFrame, weights: DataFrame, entity: str, role: str, capped: Sequence[str] = (), prior: float = PRIOR) -> DataFrame:
    """entity, role, window_key, overall, coverage, confidence, exposure, appearances.

    overall: directed percentiles by weight, over the weights that are there; 50 without any.
    confidence: cap * (1 - exp(-exposure / prior)) * (.75 + .25 role confidence) * (.75 + .25 coverage) * (.75 + .25 min(1, n / 20)), at most 1.
    """
    joined = features.join(weights, [role, "metric"])
    p = directed(F.col("percentile"), F.col("direction"))
    there = F.when(p.isNotNull(), F.col("weight"))
    own = ["role_confidence"] if "role_confidence" in features.columns else []
    found = joined.groupBy(entity, role, "window_key", "exposure", "appearances", *own).agg(F.coalesce(F.try_divide(F.sum(p * F.col("weight")), F.sum(there)), F.lit(50.0)).alias("overall"), F.coalesce(F.sum(there) / F.sum("weight"), F.lit(0.0)).alias("coverage"), F.max("reference_size").alias("population"))
    cap = F.when(F.col(role).isin(*capped), CAPPED).otherwise(1.0) if capped else F.lit(1.0)
    sure = F.coalesce(F.col("role_confidence"), F.lit(0.0)) if own else F.lit(1.0)
    confidence = cap * saturation(F.col("exposure"), prior) * (0.75 + 0.25 * sure) * (0.75 + 0.25 * F.col("coverage")) * (0.75 + 0.25 * F.least(F.lit(1.0), F.col("population") / POPULATION))
    return found.withColumn("confidence", F.least(F.lit(1.0), confidence)).select(entity, role, "window_key", "overall", "coverage", "confidence", "exposure", "appearances")


def dimensions(features: DataFrame, parts: DataFrame, entity: str, role: str) -> DataFrame:
    """entity, role, window_key, dimension, score: unweighted means of directed percentiles. parts: role, dimension, metric, direction."""
    joined = features.join(F.broadcast(parts), [role, "metric"])  # a fixed list of some dozens
    return joined.groupBy(entity, role, "window_key", "dimension").agg(F.avg(directed(F.col("percentile"), F.col("direction"))).alias("score"))


# -- teams -----------------------------------------------------------------------

def points(goals_for: Column, goals_against: Column) -> Column:
    return F.when(goals_for > goals_against, 3).when(goals_for == goals_against, 1).when(goals_for < goals_against, 0)


def window_means(rows: DataFrame, entity: Sequence[str], metrics: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """entity, window_key, matches, and for each metric its weighted mean over the rows that have it, and observed_<metric>."""
    found = recent_windows(rows, entity, list(newest))
    w = F.col("weight")
    means = [x for m in metrics for x in (F.try_divide(F.sum(w * F.col(m)), F.sum(F.when(F.col(m).isNotNull(), w))).alias(m), F.count(m).alias(f"observed_{m}"))]
    return found.groupBy(*entity, "window_key").agg(F.count("*").alias("matches"), *means)


def finishing(rows: DataFrame, entity: Sequence[str], newest: Sequence[Column], goals: str, attempts: str, prior: float) -> DataFrame:
    """entity, window_key, ratio, adjusted: goals per attempt over rows with attempts observed, pulled to the window's ratio of sums."""
    found = recent_windows(rows, entity, list(newest))
    w, seen = F.col("weight"), F.col(attempts).isNotNull()
    sums = found.groupBy(*entity, "window_key").agg(F.sum(F.when(seen, w * F.col(goals))).alias("top"), F.sum(w * F.col(attempts)).alias("bottom"))
    mean = sums.groupBy("window_key").agg(F.try_divide(F.sum("top"), F.sum("bottom")).alias("mean"))
    joined = sums.join(F.broadcast(mean), "window_key")  # one row a window
    return joined.select(*entity, "window_key", F.try_divide(F.col("top"), F.col("bottom")).alias("ratio"), shrunk_ratio(F.col("top"), F.col("bottom"), F.col("mean"), prior).alias("adjusted"))


def team_confidence(matches: Column, coverage: Column, population: Column) -> Column:
    """(1 - exp(-n / 5)) * (.55 + .45 coverage) * (.75 + .25 min(1, N / 12))."""
    return saturation(matches, 5.0) * (0.55 + 0.45 * coverage) * (0.75 + 0.25 * F.least(F.lit(1.0), population / 12))


def evidence_confidence(appearances: Column, reference: Column, coverage: Column) -> Column:
    """min(n / 10, 1) * min(reference / 10, 1) * coverage, 5 decimals."""
    return F.round(F.least(appearances / 10, F.lit(1.0)) * F.least(reference / 10, F.lit(1.0)) * coverage, 5)
