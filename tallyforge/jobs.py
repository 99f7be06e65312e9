"""Jobs that read tables of a folder and write what an operator makes of them: name, tables, what runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import elo, entity_scores, entity_v2, findings, identity, mesh, meta, radar, ratings, tactics, teams, validation
from .operators.audits import column_coverage, rating_violations, tactical_violations
from .operators.profiles import PLAYER_V1_DIMENSIONS, ROLE_DIMENSIONS, ROLE_WEIGHTS
from .sources import sinks

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Job:
    """tables: the Parquet tables that it reads, by name; run: from them to the result; help: one line."""

    tables: tuple[str, ...]
    run: Callable[[SparkSession, Tables], DataFrame]
    help: str


def _newest():
    return [F.desc("kickoff"), F.desc("match_id")]


def _player_features(spark: SparkSession, t: Tables) -> DataFrame:
    rows = t["appearances"]
    roles = entity_scores.primary_role(rows, "player_id", "role", "minutes", "kickoff")
    metrics = sorted({m for own in ROLE_WEIGHTS.values() for m in own} & set(rows.columns))
    rates = entity_scores.rates(rows.drop("role").join(roles.drop("role_confidence"), "player_id"), "player_id", "role", metrics, newest=_newest(), exposure="minutes")
    return entity_scores.adjusted(rates, "role").join(roles.select("player_id", "role_confidence"), "player_id")


def _player_scores(spark: SparkSession, t: Tables) -> DataFrame:
    return entity_scores.scores(_player_features(spark, t), entity_scores.weight_table(spark, ROLE_WEIGHTS), "player_id", "role", capped=("goalkeeper",))


def _player_dimensions(spark: SparkSession, t: Tables) -> DataFrame:
    parts = [(role, d, m, s) for role, own in ROLE_DIMENSIONS.items() for d in own for m, s in PLAYER_V1_DIMENSIONS[d].items()]
    return entity_scores.dimensions(_player_features(spark, t), spark.createDataFrame(parts, "role string, dimension string, metric string, direction int"), "player_id", "role")


def _team_features(spark: SparkSession, t: Tables) -> DataFrame:
    return teams.team_features(teams.team_windows(t["team_matches"], ["competition", "season"], _newest()), ["competition", "season"])


def _reconciled(spark: SparkSession, t: Tables) -> DataFrame:
    return identity.reconciled(t["observations"], F.col("competition"), t["crosswalk"], mesh.policies(spark))[0]


def _crosswalk(spark: SparkSession, t: Tables) -> DataFrame:
    indexes = identity.local_index(t["observations"], F.col("competition"))
    return mesh.crosswalk(identity.appearances(t["observations"], *map(identity.checked, indexes))[0])


JOBS: dict[str, Job] = {
    "player-features": Job(("appearances",), _player_features, "rates, shrunk values and percentiles of players by role and window"),
    "player-scores": Job(("appearances",), _player_scores, "overall scores of players by role and window"),
    "player-dimensions": Job(("appearances",), _player_dimensions, "dimension scores of players by role and window"),
    "player-features-v2": Job(("observations",), lambda spark, t: entity_v2.player_features(t["observations"]), "catalogued features of players by family and window"),
    "player-scores-v2": Job(("observations",), lambda spark, t: entity_v2.player_scores(entity_v2.player_features(t["observations"]))[1], "evidence-gated scores of players"),
    "team-features": Job(("team_matches",), _team_features, "means, shrunk finishing and percentiles of teams by window"),
    "team-scores": Job(("team_matches",), lambda spark, t: teams.team_scores(_team_features(spark, t), ["competition", "season"]), "composites, confidence and signals of teams"),
    "team-scores-v2": Job(("observations",), lambda spark, t: entity_v2.team_scores(entity_v2.team_features(t["observations"]))[1], "evidence-gated scores of teams"),
    "elo": Job(("matches",), lambda spark, t: elo.elo_history(t["matches"], ["competition", "season"]), "ratings match by match"),
    "elo-backtest": Job(("matches",), lambda spark, t: validation.backtest(elo.elo_history(t["matches"], ["competition", "season"]).where("is_home"), ["competition", "season"]), "how well ratings foretold results"),
    "meta": Job(("scores",), lambda spark, t: meta.meta_snapshots(t["scores"], "player_id"), "levels, surprise, trend and watchlist over seasons"),
    "stability": Job(("scores",), lambda spark, t: validation.stability(t["scores"].where("period = 0"), "player_id"), "rank correlation of season and recent scores"),
    "ratings": Job(("performance", "evidence"), lambda spark, t: ratings.rating_snapshots(t["performance"], ratings.perception(t["evidence"], "player_id"), "player_id"), "what sources think, against performance"),
    "tactics": Job(("teams", "formations"), lambda spark, t: tactics.tactical_snapshots(t["teams"], t["formations"], "team", _newest()), "styles, formations and summaries of teams"),
    "radar": Job(("candidates",), lambda spark, t: radar.radar(t["candidates"], "player_id", [c for c in ("goals", "assists", "shots_on_target", "key_passes", "successful_dribbles") if c in t["candidates"].columns]), "candidates ranked by rates"),
    "team-findings": Job(("teams",), lambda spark, t: findings.team_findings(t["teams"], ["team"]), "findings of teams"),
    "player-findings": Job(("players",), lambda spark, t: findings.player_findings(t["players"], ["player_id"]), "findings of players"),
    "crosswalk": Job(("observations",), _crosswalk, "players whom two providers name alike in the same matches"),
    "reconcile": Job(("observations", "crosswalk"), _reconciled, "facts of several providers, by policy"),
    "coverage": Job(("entries", "wanted"), lambda spark, t: mesh.coverage_fraction(mesh.requirements(t["entries"], t["wanted"])), "requirements that any provider satisfies"),
    "audit-ratings": Job(("ratings",), lambda spark, t: rating_violations(t["ratings"]), "ratings that break the rules that made them"),
    "audit-tactics": Job(("tactics",), lambda spark, t: tactical_violations(t["tactics"]), "tactical rows that break their rules"),
    "column-coverage": Job(("rows",), lambda spark, t: column_coverage(t["rows"], t["rows"].columns), "how full each column is"),
    "runs": Job(("log",), lambda spark, t: sinks.run_summary(t["log"]), "runs, failures and rows of each job"),
    "preflight": Job(("rows",), lambda spark, t: sinks.preflight(dict(t)), "rows of a table"),
}


def run(spark: SparkSession, name: str, folder: str) -> DataFrame:
    job = JOBS[name]
    return job.run(spark, {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in job.tables})
