"""The radar: candidates of several feeds, ranked by rates a match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_even
from .percentile import percentile
from .scoring import clamp

#: Weights of the metrics by profile; minutes and appearances of full confidence; what counts as elite.
RADAR = {
    "attacker": {"goals_per90": 0.35, "shots_on_target_per90": 0.20, "assists_per90": 0.20, "key_passes_per90": 0.15, "successful_dribbles_per90": 0.10},
    "midfielder": {"assists_per90": 0.30, "key_passes_per90": 0.25, "goals_per90": 0.20, "successful_dribbles_per90": 0.15, "shots_on_target_per90": 0.10},
}
MINUTES, APPEARANCES, ELITE = 1200, 15, 85.0


def merged_feeds(entries: DataFrame, key: str, order: str, fields: Sequence[str], source: str = "source_list") -> DataFrame:
    """One row a key: the first value that isn't null of each field, in order, and the sorted lists that name it."""
    first = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(order, source))).alias(f) for f in fields]
    return entries.groupBy(key).agg(*first, F.array_sort(F.collect_set(source)).alias("source_lists"))


def profile(position: Column) -> Column:
    """midfielder where the position has "mid" in it, else attacker."""
    return F.when(F.contains(F.lower(position), F.lit("mid")), "midfielder").otherwise("attacker")


def radar(candidates: DataFrame, key: str, counts: Sequence[str], pool: Sequence[str] = ()) -> DataFrame:
    """key, profile, radar_score, raw_score (unrounded), confidence, reasons: percentiles of counts per 90 minutes among all candidates, weights of the profile shared over those that are there.

    candidates: key, position, minutes, appearances, source_lists and counts
    named as RADAR's metrics without _per90. No minutes, no row; no counts, a
    score of 0. `pool` names columns within which candidates compare.
    """
    own = candidates.where("minutes > 0").withColumn("profile", profile(F.col("position")))
    kept = [key, *pool, "profile", "minutes", "appearances", "source_lists"]
    own = own.select(*kept, *(half_even(F.col(c) * (F.lit(90.0) / F.col("minutes")), 4).alias(f"{c}_per90") for c in counts))
    rows = own.unpivot(kept, [f"{c}_per90" for c in counts], "metric", "value")
    ranked = percentile(rows, [*pool, "metric"], "value", "mid_rank_or_50")
    weights = rows.sparkSession.createDataFrame([(p, m, w) for p, metrics in RADAR.items() for m, w in metrics.items()], "profile string, metric string, w double")
    ranked = ranked.join(F.broadcast(weights), ["profile", "metric"])  # ten rows
    there = F.when(F.col("percentile").isNotNull(), F.col("w"))

    def of(metric: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("metric") == metric, F.col("percentile"))), F.lit(0.0))

    found = ranked.groupBy(*kept).agg(F.coalesce(F.try_divide(F.sum(there * F.col("percentile")), F.sum(there)), F.lit(0.0)).alias("raw"), of("goals_per90").alias("g"), of("assists_per90").alias("a"), of("key_passes_per90").alias("k"))
    confidence = clamp(0.5 * F.least(F.lit(1.0), F.col("minutes") / MINUTES) + 0.3 * F.least(F.lit(1.0), F.coalesce("appearances", F.lit(0)) / APPEARANCES) + 0.2 * F.when(F.size("source_lists") >= 2, 1.0).otherwise(0.5), 0.0, 1.0)
    reasons = F.array_compact(F.array(
        F.when(F.array_contains("source_lists", "topscorers"), "top_scorer_feed"), F.when(F.array_contains("source_lists", "topassists"), "top_assist_feed"),
        F.when(F.col("g") >= ELITE, "elite_goals_per90"), F.when(F.greatest("a", "k") >= ELITE, "elite_creation_per90")))
    return found.select(key, *pool, "profile", half_even(clamp(F.col("raw"), 0.0, 100.0), 2).alias("radar_score"), F.col("raw").alias("raw_score"), confidence.alias("confidence"), reasons.alias("reasons"))
