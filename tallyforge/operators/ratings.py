"""Stances of texts, what sources together think, and how it compares with performance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, once
from .scoring import clamp

#: Phrases and what they say.
POSITIVE: dict[str, float] = {
    "earns praise": 1.00, "wins praise": 1.00, "masterclass": 1.00, "world class": 1.00, "outstanding": 1.00, "brilliant": 1.00, "superb": 1.00, "excellent": 0.90,
    "shines": 0.90, "impresses": 0.90, "impressed": 0.80, "dominant": 0.80, "remarkable": 0.80, "hero": 0.80, "inspired": 0.70, "key player": 0.65,
}
NEGATIVE: dict[str, float] = {
    "costly error": -1.00, "under fire": -0.90, "underperforming": -0.90, "underperforms": -0.90, "disappointing": -0.85, "struggles": -0.85, "struggled": -0.85, "blunder": -1.00, "flop": -1.00,
    "awful": -1.00, "criticised": -0.75, "criticized": -0.75, "poor": -0.75, "booed": -0.75, "wasteful": -0.70, "mistake": -0.65, "anonymous": -0.60, "dropped": -0.50,
}
#: Days of evidence and of its half-life; least evidence, scored evidence, sources and confidences; gap, polarization and its part that is mixed; mean of a stance.
EVIDENCE_DAYS, HALF_LIFE = 180, 45.0
EVIDENCE, SCORED, SOURCES, PERCEPTION_CONFIDENCE, RATING_CONFIDENCE = 4, 3, 2, 0.55, 0.50
GAP, POLARIZED, MIXED, LEANING = 12.0, 60.0, 40.0, 0.20


def plain(text: Column) -> Column:
    """Folded text in which hyphens are spaces."""
    return F.trim(F.regexp_replace(F.replace(folded(text), F.lit("-"), F.lit(" ")), r"\s+", " "))


def sentences(text: Column) -> Column:
    """Trimmed sentences: cut after a full stop, a question or an exclamation mark with white space, and at line ends and semicolons."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|[\r\n;]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def focus(text: Column, name: Column) -> Column:
    """The sentences that mention the name, accents and case aside, or the whole text; white space collapsed."""

    def own(x: Column) -> Column:
        found = F.filter(sentences(x["text"]), lambda s: F.contains(plain(s), x["name"]))
        return once(found, lambda f: F.when(F.size(f) > 0, F.array_join(f, " ")).otherwise(x["text"]))

    return F.trim(F.regexp_replace(once(F.struct(text.alias("text"), plain(name).alias("name")), own), r"\s+", " "))


def evidence_text(title: Column, excerpt: Column) -> Column:
    return F.concat_ws(" ", *(F.when(F.trim(x) != "", x) for x in (title, excerpt)))


def stance(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """struct(score, confidence, hits, terms): sum of the phrases said over the sum of their sizes; .5 + .15 a hit, at most 1; 0 and 0 without a hit."""
    def there(own: Column, phrase: str) -> Column:
        """A phrase as whole words; one of letters and spaces is first looked for as it is, without a pattern: most texts have few."""
        whole = own.rlike(rf"(?<!\w){phrase}(?!\w)")
        return F.contains(own, F.lit(phrase)) & whole if re.fullmatch(r"[\w ]+", phrase) else whole

    def said(own: Column) -> Column:
        return F.array_compact(F.array(*(F.when(there(own, phrase), F.struct(F.lit(phrase).alias("term"), F.lit(w).alias("w"))) for phrase, w in (lexicon or POSITIVE | NEGATIVE).items())))

    def summed(hits: Column) -> Column:
        total = F.aggregate(hits, F.lit(0.0), lambda a, x: a + x["w"])
        size = F.aggregate(hits, F.lit(0.0), lambda a, x: a + F.abs(x["w"]))
        n = F.size(hits)
        return F.struct(
            clamp(F.coalesce(F.try_divide(total, size), F.lit(0.0)), -1.0, 1.0).alias("score"), F.when(n > 0, F.least(F.lit(1.0), 0.5 + 0.15 * n)).otherwise(0.0).alias("confidence"),
            n.alias("hits"), F.transform(hits, lambda h: h["term"]).alias("terms"))

    return once(once(plain(text), said), summed)


def recent(evidence: DataFrame, now: Column, days: int = EVIDENCE_DAYS) -> DataFrame:
    """Evidence of the last days with age_days, by published_at or else discovered_at; what is dated later has age 0."""
    at = F.coalesce("published_at", "discovered_at").cast("timestamp")
    age = (now.cast("timestamp").cast("double") - at.cast("double")) / 86400
    return evidence.withColumn("age_days", F.greatest(F.lit(0.0), age)).where(at >= now.cast("timestamp") - F.expr(f"interval {days} days"))


def perception(evidence: DataFrame, entity: str, half_life: float = HALF_LIFE) -> DataFrame:
    """entity, mean, polarization, consensus, score, sources, scored, evidence, confidence, perception_signal.

    evidence: entity, source, score, confidence, age_days. Each source with
    scored evidence (of a confidence) weighs the same: an item has recency *
    confidence over its source's sum of it, over the sources. Sums by source
    come first, so that a loud source is one row each. Without scored evidence
    nothing is known and the confidence is 0.
    """
    e = evidence.withColumn("recency", F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.col("age_days").cast("double")) / F.lit(half_life)))
    w = F.col("recency") * F.col("confidence")
    each = e.groupBy(entity, "source").agg(
        F.sum(w).alias("w"), F.sum(w * F.col("score")).alias("wx"), F.sum(w * F.col("score") * F.col("score")).alias("wxx"), F.sum(w * F.abs("score")).alias("wa"), F.sum(w * F.col("recency")).alias("wr"),
        F.count("*").alias("n"), F.count_if(F.col("confidence") > 0).alias("scored"))
    fine = F.col("w") > 0

    def balanced(column: str) -> Column:
        return F.avg(F.when(fine, F.col(column) / F.col("w")))

    found = each.groupBy(entity).agg(balanced("wx").alias("mean"), balanced("wxx").alias("square"), balanced("wa").alias("size"), balanced("wr").alias("recency"), F.count_if(fine).alias("sources"), F.sum("scored").alias("scored"), F.sum("n").alias("evidence"))
    std = F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))))
    confidence = clamp(0.35 * F.least(F.lit(1.0), F.col("evidence") / 8) + 0.30 * F.least(F.lit(1.0), F.col("sources") / 3) + 0.20 * F.col("scored") / F.col("evidence") + 0.15 * F.col("recency"), 0.0, 1.0)
    signal = F.when(F.col("mean").isNull(), "insufficient_evidence").when(100 * std >= MIXED, "mixed").when(F.col("mean") >= LEANING, "positive").when(F.col("mean") <= -LEANING, "negative").otherwise("neutral")
    return found.select(
        entity, "mean", (100 * std).alias("polarization"), clamp(100 * F.col("size") * (1 - std), 0.0, 100.0).alias("consensus"), clamp(50 + 50 * F.col("mean"), 0.0, 100.0).alias("score"), "sources", "scored", "evidence",
        F.when(F.col("mean").isNull(), 0.0).otherwise(confidence).alias("confidence"), signal.alias("perception_signal"))


def rating_confidence(performance: Column, perceived: Column, polarization: Column) -> Column:
    """The smaller confidence, less up to a half by polarization."""
    return clamp(F.least(performance, perceived) * (1 - 0.5 * F.coalesce(polarization, F.lit(0.0)) / 100), 0.0, 1.0)


def rating_signal(evidence: Column, scored: Column, sources: Column, confidence: Column, polarization: Column, rated: Column, gap: Column) -> Column:
    """Gates of evidence first, then polarization, then the rating's confidence, then the gap of performance over perception."""
    thin = gap.isNull() | (evidence < EVIDENCE) | (scored < SCORED) | (sources < SOURCES) | (confidence < PERCEPTION_CONFIDENCE)
    return F.when(F.coalesce(thin, F.lit(True)), "insufficient_evidence").when(F.coalesce(polarization, F.lit(0.0)) >= POLARIZED, "polarized").when(rated < RATING_CONFIDENCE, "insufficient_evidence").when(gap >= GAP, "underrated").when(gap <= -GAP, "overrated").otherwise("aligned")


def rating_snapshots(performance: DataFrame, perceived: DataFrame, entity: str) -> DataFrame:
    """Each row of performance (entity, stable, stable_confidence) with what is perceived, rating_gap, rating_confidence and rating_signal.

    Entities without evidence have a confidence of 0 and no gap.
    """
    found = performance.join(perceived, entity, "left").withColumns({
        **{c: F.coalesce(F.col(c), F.lit(0)) for c in ("sources", "scored", "evidence")}, "confidence": F.coalesce("confidence", F.lit(0.0)), "perception_signal": F.coalesce("perception_signal", F.lit("insufficient_evidence"))})
    found = found.withColumn("rating_gap", F.col("stable") - F.col("score")).withColumn("rating_confidence", rating_confidence(F.col("stable_confidence"), F.col("confidence"), F.col("polarization")))
    return found.withColumn("rating_signal", rating_signal(*(F.col(c) for c in ("evidence", "scored", "sources", "confidence", "polarization", "rating_confidence", "rating_gap"))))
