"""Percentiles and ranks that share ties' places, within explicit groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METHODS = ("mid_rank", "mid_rank_or_50", "tie_average")


def _same(groups: Sequence[str], prefix: str) -> Column:
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"{prefix}{g}"))
    return on


def _counts(df: DataFrame, groups: Sequence[str], value: str, buckets: int) -> DataFrame:
    """For each group and value: rows below, rows equal, rows in all.

    Rows are counted by value first, with partial sums, so that what is sorted
    is a group's distinct values and not its rows. With buckets, a group's
    values are cut at approximate quantiles and each bucket is sorted on its
    own; sums over the buckets before make the counts exact wherever the cuts lie.
    """
    each = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_equal"))
    if buckets <= 1:
        upto = W.partitionBy(*groups).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        return each.withColumn("_below", F.coalesce(F.sum("_equal").over(upto), F.lit(0))).withColumn("_all", F.sum("_equal").over(W.partitionBy(*groups)))
    cuts = each.groupBy(*groups).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)]).alias("_cuts")).withColumnsRenamed({g: f"_c_{g}" for g in groups})
    placed = each.join(cuts, _same(groups, "_c_")).withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).select(*each.columns, "_bucket")
    sums = placed.groupBy(*groups, "_bucket").agg(F.sum("_equal").alias("_n"))
    before = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*(F.col(g).alias(f"_b_{g}") for g in groups), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*groups)).alias("_all"))
    within = W.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.withColumn("_within", F.coalesce(F.sum("_equal").over(within), F.lit(0)))
    joined = ranked.join(sums, _same(groups, "_b_") & (F.col("_bucket") == F.col("_b")))
    return joined.select(*each.columns, (F.col("_before") + F.col("_within")).alias("_below"), "_all")


def percentile_of(below: Column, equal: Column, everyone: Column, method: str) -> Column:
    """mid_rank: 100 (below + equal / 2) / n. mid_rank_or_50: the same, 50 if alone. tie_average: 100 times the mean place of the tie over n - 1, 50 if alone."""
    mid = F.lit(100.0) * (below + F.lit(0.5) * equal) / everyone
    if method == "mid_rank":
        return mid
    if method == "mid_rank_or_50":
        return F.when(everyone <= 1, F.lit(50.0)).otherwise(mid)
    if method == "tie_average":
        return F.when(everyone == 1, F.lit(50.0)).otherwise(F.lit(100.0) * (below + (equal - 1) / F.lit(2.0)) / (everyone - 1))
    raise ValueError(f"method is one of {METHODS}")


def percentile(df: DataFrame, groups: Sequence[str], value: str, method: str = "mid_rank", eligible: Column | None = None, name: str = "percentile", size: str = "reference_size", buckets: int = 1) -> DataFrame:
    """df with a percentile of `value` in its group, and the group's size.

    Rows that aren't eligible, or have no value, keep their row, with a null
    percentile; they are in no group's size. `buckets` is for populations too
    large for one task to sort their distinct values.
    """
    fit = F.col(value).isNotNull() & (F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False)))
    marked = df.withColumn("_v", F.when(fit, F.col(value)))
    counts = _counts(marked, groups, "_v", buckets).select(*(F.col(g).alias(f"_g_{g}") for g in groups), F.col("_v").alias("_u"), "_below", "_equal", "_all")
    joined = marked.join(counts, (F.col("_v") == F.col("_u")) & _same(groups, "_g_"), "left")
    out = joined.withColumn(name, percentile_of(F.col("_below"), F.col("_equal"), F.col("_all"), method)).withColumn(size, F.coalesce(F.col("_all"), F.lit(0)).cast("long"))
    return out.select(*df.columns, name, size)


def average_rank(df: DataFrame, groups: Sequence[str], value: str, name: str = "average_rank") -> DataFrame:
    """df with ranks from 1, ties sharing the mean of their places."""
    w = W.partitionBy(*groups).orderBy(value)
    ties = W.partitionBy(*groups, value)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(ties) - 1) / F.lit(2.0))
