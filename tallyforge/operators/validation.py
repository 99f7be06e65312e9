"""Backtests of ratings and the stability of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_even
from .percentile import average_rank

#: Least rows of a backtest and of a stability, bins, the confidence that both windows need.
ROWS, PAIRS, BINS, CONFIDENCE = 50, 20, 5, 0.50


def backtest(pairs: DataFrame, groups: Sequence[str] = (), least: int = ROWS) -> DataFrame:
    """groups, n, status, brier, baseline, skill, ece, mean_expected and mean_actual of (expected, actual); null below `least` rows.

    Brier scores against those of always saying one half. Five equal bins;
    a bin's error counts with 4 decimals. Skill over a perfect baseline is 0.
    status: insufficient_data, pass with some skill, else warn.
    """
    e, a = F.col("expected"), F.col("actual")
    binned = pairs.withColumn("bin", F.least(F.floor(e * BINS), F.lit(BINS - 1))).groupBy(*groups, "bin").agg(F.count("*").alias("n"), F.sum(e).alias("se"), F.sum(a).alias("sa"), F.sum((e - a) * (e - a)).alias("sb"), F.sum((a - 0.5) * (a - 0.5)).alias("s0"))
    n = F.sum("n")
    error = half_even(F.abs(F.col("se") / F.col("n") - F.col("sa") / F.col("n")), 4)
    out = binned.groupBy(*groups).agg(n.alias("n"), (F.sum("sb") / n).alias("brier"), (F.sum("s0") / n).alias("baseline"), F.sum(F.col("n") / F.lit(1.0) * error).alias("_error"), (F.sum("se") / n).alias("mean_expected"), (F.sum("sa") / n).alias("mean_actual"))
    fine = F.col("n") >= least
    skill = F.when(F.col("baseline") > 0, 1 - F.col("brier") / F.col("baseline")).otherwise(0.0)

    def shown(value: Column) -> Column:
        return F.when(fine, half_even(value, 6))

    status = F.when(~fine, "insufficient_data").when(skill > 0, "pass").otherwise("warn")
    return out.select(*groups, "n", status.alias("status"), *(shown(F.col(c)).alias(c) for c in ("brier", "baseline", "mean_expected", "mean_actual")), shown(F.col("_error") / F.col("n")).alias("ece"), shown(skill).alias("skill"))


def stability(scores: DataFrame, entity: str, role: str = "role", confidence: float = CONFIDENCE, least: int = PAIRS, first: str = "season", second: str = "last_10", digits: int = 9) -> DataFrame:
    """role, n, status and spearman: rank correlation of the overall scores of two windows, of entities whose confidence reaches `confidence` in both, by role.

    Values are ranked after rounding to `digits`. Fewer than `least` entities: insufficient_data, and no correlation.
    """
    def of(window: str, column: str) -> Column:
        return F.max(F.when(F.col("window_key") == window, F.col(column)))

    wide = scores.groupBy(entity, role).agg(F.round(of(first, "overall"), digits).alias("a"), F.round(of(second, "overall"), digits).alias("b"), of(first, "confidence").alias("ca"), of(second, "confidence").alias("cb"))
    fit = wide.where((F.col("ca") >= confidence) & (F.col("cb") >= confidence) & F.col("a").isNotNull() & F.col("b").isNotNull())
    ranked = average_rank(average_rank(fit, [role], "a", "x"), [role], "b", "y")
    found = ranked.groupBy(role).agg(F.count("*").alias("n"), F.corr("x", "y").alias("_r"))
    enough = F.col("n") >= least
    return found.select(role, "n", F.when(enough, "measured").otherwise("insufficient_data").alias("status"), F.when(enough, F.col("_r")).alias("spearman"))
