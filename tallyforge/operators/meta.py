"""Signals over seasons: stable level, expectation and surprise, trend, watchlist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import clamp

#: Weights of the present and past periods.
STABLE, EXPECTED = (1.0, 0.6, 0.36, 0.216), (1.0, 0.6, 0.36)
#: Thresholds and least confidences of surprise and trend; pairs of windows and their weights.
SURPRISE, SURPRISE_CONFIDENCE, TREND, TREND_CONFIDENCE = 12.0, 0.35, 8.0, 0.30
PAIRS = (("last_3", "last_10", 0.60), ("last_5", "season", 0.40))
#: The watchlist's weights, and what its signals need.
WATCH_STABLE, WATCH_SURPRISE, WATCH_TREND = 0.45, 0.35, 0.20
BREAKOUT_TREND, LEAST_LEVEL = 6.0, 55.0


def aligned_periods(scores: DataFrame, scopes: Sequence[str], scope: str = "scope_key") -> DataFrame:
    """scores with period, the place of their scope in `scopes` (0: the present one); other scopes are left out."""
    places = scores.sparkSession.createDataFrame([(s, i) for i, s in enumerate(scopes)], "_scope string, period int")
    return scores.join(F.broadcast(places), F.col(scope) == F.col("_scope")).drop("_scope")  # a caller's list


def _period_weight(weights: Sequence[float], first: int) -> Column:
    out = F.lit(None).cast("double")
    for i, w in enumerate(weights):
        out = F.when(F.col("period") == i + first, F.lit(w)).otherwise(out)
    return out


def meta_levels(scores: DataFrame, entity: str, role: str = "role", strict: bool = True) -> DataFrame:
    """entity, role, current, current_confidence, stable, stable_confidence, expected, expected_confidence, surprise, surprise_signal, seasons.

    scores: entity, role, period (0: now), overall, confidence, of season
    windows, one a period. Past periods, 1 to 3, count only in the role that the
    entity has now. A level is weighted by recency and confidence. A level whose
    confidences are all nought is an error, or null if not strict. The scores
    are read once.
    """
    same = scores.where(F.col("period").between(0, len(STABLE) - 1) & F.col(entity).isNotNull() & F.col(role).isNotNull())
    c, now = F.col("confidence"), F.col("period") == 0

    def level(w: Column) -> Column:
        total = F.sum(w * c)
        fault = F.raise_error(F.lit("a level's confidences are all nought")) if strict else F.lit(None)
        return F.when(total > 0, F.sum(w * c * F.col("overall")) / total).when((F.count(w) > 0) & (F.count_if(now) > 0), fault.cast("double"))

    def sure(w: Column) -> Column:
        return clamp(F.sum(w * c) / F.sum(w) * F.least(F.lit(1.0), 0.7 + 0.1 * F.count(w)), 0.0, 1.0)

    s, e = _period_weight(STABLE, 0), _period_weight(EXPECTED, 1)
    current = (F.max(F.when(now, F.col(x))).alias(y) for x, y in (("overall", "current"), ("confidence", "current_confidence")))
    found = same.groupBy(entity, role).agg(*current, level(s).alias("stable"), sure(s).alias("stable_confidence"), level(e).alias("expected"), sure(e).alias("expected_confidence"), F.count(e).alias("seasons"), F.count_if(now).alias("_now"))
    surprise = F.col("current") - F.col("expected")
    low = (F.col("current_confidence") < SURPRISE_CONFIDENCE) | (F.col("expected_confidence") < SURPRISE_CONFIDENCE)
    signal = F.when(F.col("seasons") == 0, "insufficient_history").when(surprise.isNull() | low, "insufficient_evidence").when(surprise >= SURPRISE, "surprise").when(surprise <= -SURPRISE, "disappointment").otherwise("aligned")
    return found.where("_now > 0").drop("_now").withColumn("surprise", surprise).withColumn("surprise_signal", signal)


def trend(windows: DataFrame, entity: str) -> DataFrame:
    """entity, trend, trend_confidence, trend_signal from the four windows' overall and confidence.

    Pairs (last_3 less last_10, .60) and (last_5 less season, .40), each by the
    smaller confidence of the two. Without a pair neither is known.
    """
    wide = windows.groupBy(entity).agg(*(F.max(F.when(F.col("window_key") == w, F.col(v))).alias(f"{v}_{w}") for w in ("last_3", "last_5", "last_10", "season") for v in ("overall", "confidence")))
    top = bottom = share = F.lit(0.0)
    for a, b, w in PAIRS:
        there = F.col(f"overall_{a}").isNotNull() & F.col(f"overall_{b}").isNotNull()
        sure = F.least(f"confidence_{a}", f"confidence_{b}")
        top = top + F.when(there, (F.col(f"overall_{a}") - F.col(f"overall_{b}")) * w * sure).otherwise(0.0)
        bottom, share = bottom + F.when(there, w * sure).otherwise(0.0), share + F.when(there, F.lit(w)).otherwise(0.0)
    value, confidence = F.when(bottom > 0, top / bottom), F.when(share > 0, F.when(bottom > 0, clamp(bottom / share, 0.0, 1.0)).otherwise(0.0))
    signal = F.when(share == 0, "insufficient_data").when(value.isNull() | (confidence < TREND_CONFIDENCE), "insufficient_evidence").when(value >= TREND, "rising").when(value <= -TREND, "falling").otherwise("stable")
    return wide.select(entity, value.alias("trend"), confidence.alias("trend_confidence"), signal.alias("trend_signal"))


def usable_surprise(surprise: Column, signal: Column) -> Column:
    return F.when(signal.isin("surprise", "disappointment", "aligned"), surprise)


def usable_trend(value: Column, signal: Column) -> Column:
    return F.when(signal.isin("rising", "falling", "stable"), value)


def watchlist_score(stable: Column, surprise: Column, trend_value: Column) -> Column:
    """Of a stable level and what is usable of surprise and trend; only rises count."""
    up, rise = (F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0))) for x in (surprise, trend_value))
    return clamp(WATCH_STABLE * stable + WATCH_SURPRISE * clamp(up * 4.0, 0.0, 100.0) + WATCH_TREND * clamp(rise * 5.0, 0.0, 100.0), 0.0, 100.0)


def watchlist_signal(stable: Column, surprise: Column, trend_value: Column, score: Column) -> Column:
    up, rise, high = F.coalesce(surprise, F.lit(0.0)), F.coalesce(trend_value, F.lit(0.0)), stable >= LEAST_LEVEL
    return F.when((up >= SURPRISE) & (rise >= BREAKOUT_TREND) & high, "breakout").when((up >= SURPRISE) & high, "outperforming").when((rise >= TREND) & high, "rising").when((score >= LEAST_LEVEL) & high, "monitor").otherwise("none")


def meta_snapshots(scores: DataFrame, entity: str, role: str = "role", strict: bool = True) -> DataFrame:
    """meta_levels() with form, form_confidence, trend, trend_confidence, trend_signal, watchlist_score and watchlist_signal.

    scores: entity, role, period, window_key, overall, confidence. Only entities
    with a season window now have a row; the other windows count in its role.
    """
    levels = meta_levels(scores.where("window_key = 'season'"), entity, role, strict)
    own = scores.where("period = 0").join(levels.select(entity, role), [entity, role], "left_semi")
    form = own.where("window_key = 'last_5'").select(entity, F.col("overall").alias("form"), F.col("confidence").alias("form_confidence"))
    found = levels.join(trend(own, entity), entity, "left").join(form, entity, "left")
    up, rise = usable_surprise(F.col("surprise"), F.col("surprise_signal")), usable_trend(F.col("trend"), F.col("trend_signal"))
    score = watchlist_score(F.col("stable"), up, rise)
    return found.withColumn("watchlist_score", score).withColumn("watchlist_signal", watchlist_signal(F.col("stable"), up, rise, F.col("watchlist_score")))
