"""Formations and styles of teams, and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import mapped
from .scoring import clamp

#: High and low scores, that below which control is modest, the least confidence.
HIGH, LOW, MODEST, MIDDLE, CONFIDENCE, PERMISSIVE = 65.0, 40.0, 50.0, 55.0, 0.35, 35.0
#: What a summary says of a style, a defence, and a formation.
STYLE_TEXT = {
    "control_and_volume": "Combina control alto de balón con volumen ofensivo alto dentro de su liga.",
    "possession_control": "Controla mucho el balón, con un volumen ofensivo más moderado.",
    "volume_without_control": "Genera volumen ofensivo alto con menor control de balón; esto no prueba juego de contra.",
    "low_control_low_volume": "Presenta control y volumen ofensivo bajos en relación con su competición.",
    "balanced": "Muestra un perfil relativamente equilibrado entre control y volumen ofensivo.",
    "insufficient_evidence": "No hay evidencia cuantitativa suficiente para resumir el estilo con confianza.",
}
DEFENCE_TEXT = {
    "restrictive_shot_profile": " Además, su perfil defensivo limita bien el volumen de tiros del rival.",
    "permissive_shot_profile": " Defensivamente concede un volumen alto de tiros en comparación con su liga.",
    "balanced": " El volumen defensivo concedido está cerca de la zona media.",
    "insufficient_evidence": "",
}
NO_FORMATION_TEXT = " No hay formación nominal observada suficiente todavía."
FORMATION_TEXT = " Formación nominal más repetida: %s (%d/%d partidos con formación observada)."


def valid_formation(text: Column) -> Column:
    """3 to 5 parts, all positive whole numbers, ten in all."""
    parts = F.transform(F.split(text, "-"), lambda p: F.when(p.rlike(r"^\d{1,2}$"), p.cast("int")))
    fine = F.size(parts).between(3, 5) & F.forall(parts, lambda p: F.coalesce(p > 0, F.lit(False)))
    return F.coalesce(fine & (F.aggregate(parts, F.lit(0), lambda a, p: a + F.coalesce(p, F.lit(0))) == 10), F.lit(False))


def formation_profile(rows: DataFrame, team: str, formation: str, newest: Sequence[Column], matches: str | None = None) -> DataFrame:
    """team, primary, formation_matches, share, coverage, confidence, label and alternatives (formation, matches, share), four at most, the primary first.

    The mode of valid formations; ties by the one seen last, then by name.
    Coverage is of the team's matches: its rows, or the largest `matches` among them.
    """
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(team).orderBy(*newest)))
    each = ranked.where(valid_formation(F.col(formation))).groupBy(team, formation).agg(F.count("*").alias("n"), F.min("_rn").alias("seen"))
    order = F.struct((-F.col("n")).alias("a"), F.col("seen").alias("b"), F.col(formation).alias("name"), F.col("n").alias("n"))
    tops = each.groupBy(team).agg(F.array_sort(F.collect_list(order)).alias("o"), F.sum("n").alias("valid"))  # a row for each formation
    played = rows.groupBy(team).agg((F.max(matches) if matches else F.count("*")).alias("played"))
    first = F.try_element_at("o", F.lit(1))
    share, coverage = first["n"] / F.col("valid"), F.least(F.lit(1.0), F.coalesce("valid", F.lit(0)) / F.greatest(F.lit(1), F.col("played")))
    joined = played.join(tops, team, "left").withColumn("share", share).withColumn("coverage", coverage)
    label = F.when(F.col("valid").isNull(), "unavailable").when((F.col("valid") < 3) | (F.col("coverage") < 0.30), "limited_evidence").when(F.col("share") >= 0.65, "stable").when((F.col("share") <= 0.50) & (F.size("o") >= 2), "variable").otherwise("mixed")
    return joined.select(
        team, first["name"].alias("primary"), F.coalesce("valid", F.lit(0)).alias("formation_matches"), "share", "coverage", F.coalesce(clamp(F.col("coverage") * (0.5 + 0.5 * F.col("share")), 0.0, 1.0), F.lit(0.0)).alias("confidence"), label.alias("label"),
        F.transform(F.slice("o", 1, 4), lambda x: F.struct(x["name"].alias("formation"), x["n"].alias("matches"), (x["n"] / F.col("valid")).alias("share"))).alias("alternatives"))


def style_signal(control: Column, volume: Column, confidence: Column) -> Column:
    unknown = F.coalesce(confidence < CONFIDENCE, F.lit(True)) | control.isNull() | volume.isNull()
    return F.when(unknown, "insufficient_evidence").when((control >= HIGH) & (volume >= HIGH), "control_and_volume").when((control >= HIGH) & (volume < MIDDLE), "possession_control").when((volume >= HIGH) & (control < MODEST), "volume_without_control").when((control <= LOW) & (volume <= LOW), "low_control_low_volume").otherwise("balanced")


def defensive_signal(defense: Column, confidence: Column) -> Column:
    return F.when(F.coalesce(confidence < CONFIDENCE, F.lit(True)) | defense.isNull(), "insufficient_evidence").when(defense >= HIGH, "restrictive_shot_profile").when(defense <= PERMISSIVE, "permissive_shot_profile").otherwise("balanced")


def tactical_confidence(source: Column, formation: Column, formation_matches: Column) -> Column:
    """The source's confidence, of which 15 % hang on the formation's; 85 % without one."""
    return clamp(source * F.when(formation_matches > 0, 0.85 + 0.15 * formation).otherwise(0.85), 0.0, 1.0)


def summary(style: Column, defence: Column, primary: Column, formation_matches: Column, matches: Column) -> Column:
    named = F.when(primary.isNull(), F.lit(NO_FORMATION_TEXT)).otherwise(F.format_string(FORMATION_TEXT, primary, formation_matches.cast("long"), matches.cast("long")))
    return F.concat(mapped(style, STYLE_TEXT), mapped(defence, DEFENCE_TEXT), named)


def tactical_snapshots(teams: DataFrame, formations: DataFrame, team: str, newest: Sequence[Column], formation: str = "formation") -> DataFrame:
    """team, style_signal, defensive_signal, the formation's profile, tactical_confidence and summary.

    teams: team, matches, control, chance_generation, defense, source_confidence.
    formations: team, formation and what `newest` orders by. A team without any has no primary formation.
    """
    sized = formations.join(teams.select(team, F.col("matches").alias("_matches")), team)
    found = formation_profile(sized, team, formation, newest, "_matches").withColumnRenamed("confidence", "formation_confidence").withColumnRenamed("label", "formation_signal")
    joined = teams.join(found, team, "left").withColumn("formation_signal", F.coalesce("formation_signal", F.lit("unavailable"))).withColumn("formation_matches", F.coalesce("formation_matches", F.lit(0)))
    joined = joined.withColumn("style_signal", style_signal(F.col("control"), F.col("chance_generation"), F.col("source_confidence"))).withColumn("defensive_signal", defensive_signal(F.col("defense"), F.col("source_confidence")))
    sure = tactical_confidence(F.col("source_confidence"), F.coalesce("formation_confidence", F.lit(0.0)), F.col("formation_matches"))
    return joined.select(
        team, "style_signal", "defensive_signal", "primary", "formation_matches", "share", "formation_signal", "alternatives", sure.alias("tactical_confidence"),
        summary(F.col("style_signal"), F.col("defensive_signal"), F.col("primary"), F.col("formation_matches"), F.col("matches")).alias("summary"))
