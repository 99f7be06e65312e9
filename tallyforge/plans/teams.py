"""Queries of teams' scores. A team is a supplier in a season; what it has of a match are the counts of its lines in the order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entity_scores, entity_v2, findings, teams
from ..operators.profiles import TEAM_V1
from ..sources.tables import table
from .domain import _W, newest
from .registry import query
from .relational import DOUBLED, doubled, matches

_COUNTS = {"shots_total": "count(*)", "shots_on_target": "count(*) FILTER (l_discount >= 0.05)", "shots_inside_box": "nullif(count(*) FILTER (l_quantity >= 30), 0)", "passes_total": "sum(l_quantity)", "passes_accurate": "sum(l_quantity) FILTER (l_linestatus = 'O')", "corners": "count(*) FILTER (l_tax >= 0.04)"}


def rows(spark, sf):
    """Each side of a match with its own counts and the other side's; some aren't known."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_linestatus").groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("team")).agg(
        F.count("*").cast("double").alias("shots_total"), F.count_if(F.col("l_discount") >= 0.05).cast("double").alias("shots_on_target"), F.nullif(F.count_if(F.col("l_quantity") >= 30), F.lit(0)).cast("double").alias("shots_inside_box"),
        F.sum("l_quantity").alias("passes_total"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("passes_accurate"), F.count_if(F.col("l_tax") >= 0.04).cast("double").alias("corners"))
    other = lines.select("match_id", F.col("team").alias("opponent"), *(F.col(c).alias(f"{c}_against") for c in ("shots_total", "shots_on_target", "shots_inside_box")), F.col("passes_total").alias("opponent_passes_total"))
    both = doubled(matches(spark, sf)).join(lines, ["match_id", "team"]).join(other, ["match_id", "opponent"])
    possession = 100 * F.col("passes_total") / (F.col("passes_total") + F.col("opponent_passes_total"))
    return both.withColumn("possession_pct", F.when(F.col("match_id") % 5 > 0, possession)).withColumnsRenamed({"shots_total": "shots_total_for", "shots_on_target": "shots_on_target_for", "shots_inside_box": "shots_inside_box_for", "corners": "corners_for"})


def _weighted(weights: dict[str, float], prefix: str = "") -> str:
    top = " + ".join(f"coalesce({w}::DOUBLE * {prefix}{m}, 0::DOUBLE)" for m, w in weights.items())
    bottom = " + ".join(f"CASE WHEN {prefix}{m} IS NULL THEN 0::DOUBLE ELSE {w}::DOUBLE END" for m, w in weights.items())
    return f"round(({top}) / nullif({bottom}, 0), 9)"


_METRICS = (*teams.MADE, *teams.GIVEN)
_NEEDED = sorted({m for k in ("chance", "defense", "control", "finishing", "results") for m in TEAM_V1[k]})
FEATURES = f"""{DOUBLED},
lc AS (SELECT l_orderkey AS match_id, l_suppkey AS team, {", ".join(f"{x}::DOUBLE AS {c}" for c, x in _COUNTS.items())} FROM lineitem GROUP BY 1, 2),
tm AS (
  SELECT t.*, o.shots_total AS shots_total_for, o.shots_on_target AS shots_on_target_for, o.shots_inside_box AS shots_inside_box_for, o.corners AS corners_for, x.shots_total AS shots_total_against, x.shots_on_target AS shots_on_target_against, x.shots_inside_box AS shots_inside_box_against,
         CASE WHEN t.match_id % 5 > 0 THEN 100 * o.passes_total / (o.passes_total + x.passes_total) END AS possession_pct, goals_for - goals_against AS goal_difference_per_match, CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END AS points_per_match,
         100.0 * o.passes_accurate / o.passes_total AS pass_accuracy_pct, 100.0 * o.passes_total / (o.passes_total + x.passes_total) AS pass_share, row_number() OVER (PARTITION BY season, t.team ORDER BY kickoff DESC, t.match_id DESC) AS rn
  FROM team_rows t JOIN lc o ON o.match_id = t.match_id AND o.team = t.team JOIN lc x ON x.match_id = t.match_id AND x.team = t.opponent),
tx AS (SELECT tm.*, window_key, CASE WHEN n IS NULL THEN 1 ELSE pow(0.5, (rn - 1) / 3.0) END AS w FROM tm JOIN {_W} ON n IS NULL OR rn <= n),
tw AS (SELECT season, team, window_key, count(*) AS matches, {", ".join(f"sum(w * {m}) / sum(w) FILTER ({m} IS NOT NULL) AS {m}, count({m}) AS n_{m}" for m in _METRICS)},
  sum(w * goals_for) FILTER (shots_total_for IS NOT NULL) AS t1, sum(w * shots_total_for) AS b1, sum(w * goals_for) FILTER (shots_on_target_for IS NOT NULL) AS t2, sum(w * shots_on_target_for) AS b2, count(shots_total_for) AS n1, count(shots_on_target_for) AS n2 FROM tx GROUP BY 1, 2, 3),
tr AS (SELECT *, t1 / nullif(b1, 0) AS r1, t2 / nullif(b2, 0) AS r2, sum(CASE WHEN b1 > 0 THEN t1 END) OVER p / sum(CASE WHEN b1 > 0 THEN b1 END) OVER p AS m1, sum(CASE WHEN b2 > 0 THEN t2 END) OVER p / sum(CASE WHEN b2 > 0 THEN b2 END) OVER p AS m2 FROM tw WINDOW p AS (PARTITION BY season, window_key)),
tl AS ({" UNION ALL ".join(f"SELECT season, team, window_key, matches, '{m}' AS metric, {m}::DOUBLE AS raw_value, {m}::DOUBLE AS adjusted, n_{m} AS observed FROM tr WHERE {m} IS NOT NULL" for m in _METRICS)}
  UNION ALL SELECT season, team, window_key, matches, 'goals_per_shot', r1, (t1 + 20.0 * m1) / (b1 + 20.0), n1 FROM tr WHERE r1 IS NOT NULL UNION ALL SELECT season, team, window_key, matches, 'goals_per_shot_on_target', r2, (t2 + 8.0 * m2) / (b2 + 8.0), n2 FROM tr WHERE r2 IS NOT NULL),
tv AS (SELECT * REPLACE (round(adjusted, 9) AS adjusted) FROM tl),
tp AS (SELECT *, 100.0 * (rank() OVER (PARTITION BY season, window_key, metric ORDER BY adjusted) - 1 + 0.5 * count(*) OVER (PARTITION BY season, window_key, metric, adjusted)) / count(*) OVER (PARTITION BY season, window_key, metric) AS mid, count(*) OVER (PARTITION BY season, window_key, metric) AS reference_size FROM tv),
tf AS (SELECT *, CASE WHEN metric IN ({", ".join(f"'{m}'" for m in teams.LOWER)}) THEN 100 - mid ELSE mid END AS percentile FROM tp)"""
SCORES = f"""{FEATURES},
sw AS (SELECT season, team, window_key, matches, {", ".join(f"max(percentile) FILTER (metric = '{m}') AS p_{m}" for m in _NEEDED)}, max(reference_size) AS population, coalesce(sum(observed / matches) FILTER (metric IN ({", ".join(f"'{m}'" for m in teams.COVERAGE)})), 0) / 10 AS coverage FROM tf GROUP BY 1, 2, 3, 4),
s1 AS (SELECT *, {", ".join(f"{_weighted(TEAM_V1[k], 'p_')} AS {k}" for k in ("chance", "defense", "control", "finishing", "results"))} FROM sw),
s2 AS (SELECT *, {_weighted(TEAM_V1["process"])} AS process, {_weighted(TEAM_V1["attack"])} AS attack FROM s1),
s3 AS (SELECT *, {_weighted(TEAM_V1["overall"])} AS overall, round(results - process, 9) AS delta, least(1.0, (1 - exp(-matches / 5.0)) * (0.55 + 0.45 * coverage) * (0.75 + 0.25 * least(1.0, population / 12))) AS confidence FROM s2 WHERE process IS NOT NULL AND results IS NOT NULL),
ss AS (SELECT *, CASE WHEN delta >= 12 THEN 'results_above_process' WHEN delta <= -12 THEN 'results_below_process' ELSE 'results_aligned' END AS signal,
  CASE WHEN chance >= 65 AND finishing <= 35 THEN 'finishing_issue' WHEN chance <= 35 AND finishing >= 45 THEN 'creation_issue' END AS first_issue, CASE WHEN defense <= 35 THEN 'defensive_process_issue' END AS second_issue FROM s3)"""


#: Added before rounding: scores are decimals of few digits, whose ties two engines round by the last bit of a double.
_APART = 1.23457e-7


def _sql(column: str, name: str) -> str:
    return f"round({column} + {_APART}::DOUBLE, 6) AS {name}"


def _shown(column, name: str):
    return F.round(F.col(column) + F.lit(_APART), 6).alias(name)


def features(spark, sf):
    return teams.team_features(teams.team_windows(rows(spark, sf), ["season"], newest("kickoff")), ["season"])


def scores(spark, sf):
    return teams.team_scores(features(spark, sf), ["season"])


@query("team_values", f"WITH {FEATURES} SELECT match_id, team, goal_difference_per_match::BIGINT AS goal_difference, points_per_match AS points, round(pass_accuracy_pct, 6) AS pass_accuracy_pct, round(pass_share, 6) AS pass_share FROM tm")
def team_values(spark, sf):
    found = teams.match_values(rows(spark, sf))
    return found.select("match_id", "team", F.col("goal_difference_per_match").cast("long").alias("goal_difference"), F.col("points_per_match").alias("points"), F.round("pass_accuracy_pct", 6).alias("pass_accuracy_pct"), F.round("pass_share", 6).alias("pass_share"))


@query("team_windows", f"WITH {FEATURES} SELECT season, team, window_key, matches, {', '.join(f'round({m}, 6) AS {m}, n_{m} AS observed_{m}' for m in ('points_per_match', 'goal_difference_per_match', 'possession_pct', 'shots_inside_box_for'))} FROM tw")
def team_windows(spark, sf):
    found = teams.team_windows(rows(spark, sf), ["season"], newest("kickoff"))
    return found.select("season", "team", "window_key", "matches", *(c for m in ("points_per_match", "goal_difference_per_match", "possession_pct", "shots_inside_box_for") for c in (F.round(m, 6).alias(m), f"observed_{m}")))


@query("team_features_v1", f"WITH {FEATURES} SELECT season, team, window_key, metric, round(raw_value, 6) AS raw_value, round(adjusted, 6) AS adjusted, observed, round(percentile, 6) AS percentile, reference_size FROM tf")
def team_features_v1(spark, sf):
    return features(spark, sf).select("season", "team", "window_key", "metric", F.round("raw_value", 6).alias("raw_value"), F.round("adjusted", 6).alias("adjusted"), "observed", F.round("percentile", 6).alias("percentile"), "reference_size")


_SHOWN = {"chance_generation": "chance", "defense": "defense", "control": "control", "finishing_proxy": "finishing", "process": "process", "results": "results", "attack": "attack", "overall": "overall", "coverage": "coverage", "confidence": "confidence", "results_process_delta": "delta"}


@query("team_scores", f"WITH {SCORES} SELECT season, team, window_key, matches, {', '.join(_sql(c, n) for n, c in _SHOWN.items())}, signal, concat_ws(',', first_issue, second_issue, nullif(signal, 'results_aligned')) AS signals FROM ss")
def team_scores(spark, sf):
    return scores(spark, sf).select("season", "team", "window_key", "matches", *(_shown(c, c) for c in _SHOWN), "signal", F.array_join("signals", ",").alias("signals"))


@query("team_issue_rows", f"""WITH {SCORES} SELECT season, team, window_key, unnest(list_filter([first_issue, second_issue, nullif(signal, 'results_aligned')], lambda x: x IS NOT NULL)) AS signal_code, {_sql('delta', 'delta')}, {_sql('overall', 'overall')} FROM ss""")
def team_issue_rows(spark, sf):
    found = teams.issue_rows(scores(spark, sf), ["season", "team", "window_key"])
    return found.select("season", "team", "window_key", "signal_code", _shown("supporting.results_process_delta", "delta"), _shown("supporting.overall", "overall"))


_ALLOWED = """CASE WHEN p_volume >= 65 AND quality <= 35 THEN 'few_but_high_quality_chances_allowed' WHEN p_volume <= 35 AND quality >= 65 THEN 'high_volume_low_quality_allowed' END"""


@query("team_findings", f"""WITH {SCORES},
f AS (SELECT s.*, sw.p_possession_pct AS possession, sw.p_shots_total_against AS p_volume, coalesce(CASE WHEN s.team % 2 = 0 THEN sw.p_shots_inside_box_against END, sw.p_shots_on_target_against) AS quality FROM ss s JOIN sw USING (season, team, window_key)),
g AS (SELECT *, {_ALLOWED} AS allowed FROM f)
SELECT season, team, window_key, signal AS code, CASE WHEN abs(delta) >= 25 THEN 'high' ELSE 'notable' END AS severity FROM g WHERE signal <> 'results_aligned'
UNION ALL SELECT season, team, window_key, 'creation_problem', 'notable' FROM g WHERE first_issue = 'creation_issue'
UNION ALL SELECT season, team, window_key, 'defensive_process_weak', 'notable' FROM g WHERE defense <= 35
UNION ALL SELECT season, team, window_key, 'defensive_process_strong', CASE WHEN defense - 65 >= 20 THEN 'high' ELSE 'notable' END FROM g WHERE defense >= 65
UNION ALL SELECT season, team, window_key, 'regression_risk', CASE WHEN delta >= 30 THEN 'high' ELSE 'notable' END FROM g WHERE delta >= 20 AND confidence <= 0.45
UNION ALL SELECT season, team, window_key, 'sterile_possession', CASE WHEN possession - chance >= 60 THEN 'high' WHEN possession - chance >= 40 THEN 'notable' ELSE 'info' END FROM g WHERE possession >= 65 AND chance <= 35
UNION ALL SELECT season, team, window_key, allowed, 'notable' FROM g WHERE allowed IS NOT NULL""")
def team_findings(spark, sf):
    """Every rule; for every other team the shots inside the box stand for expected goals allowed."""
    f, keys = features(spark, sf), ["season", "team", "window_key"]

    def percentile(metric):
        return F.max(F.when(F.col("metric") == metric, F.col("percentile")))

    wide = f.groupBy(*keys).agg(percentile("possession_pct").alias("possession"), percentile("shots_total_against").alias("volume_allowed"), percentile("shots_on_target_against").alias("on_target_allowed"), F.when(F.col("team") % 2 == 0, percentile("shots_inside_box_against")).alias("xga_allowed"))
    inputs = teams.team_scores(f, ["season"]).withColumn("creation", F.col("chance_generation")).join(wide, keys)
    return findings.team_findings(inputs, keys).drop("confidence")


def _observations(spark, sf):
    """A team's matches with what evidence-gated scores read: a map of metrics, each known in every match."""
    r = rows(spark, sf)
    stats = {"xg": F.col("shots_total_for") * 0.4, "xga": F.col("shots_total_against") * 0.3 + F.col("goals_against") * 0.01, "shots_total_against": F.col("shots_total_against"), "shots_on_target_against": F.col("shots_on_target_against"), "possession_pct": F.col("pass_share"), "big_chances": F.col("corners_for"), "box_entries": F.col("goals_for") * 0.1, "deep_completions": F.col("shots_on_target_for")}
    r = teams.match_values(r)
    return r.select(F.concat_ws(":", "season", "team").alias("team_id"), "match_id", "kickoff", "goals_for", "goals_against", F.create_map(*(x for k, v in stats.items() for x in (F.lit(k), v.cast("double")))).alias("stats"))


_V2 = """{features},
vr AS (SELECT season || ':' || team AS team_id, rn, shots_total_for * 0.4 AS xg, shots_total_against * 0.3 + goals_against * 0.01 AS xga, shots_total_against AS shots_allowed, shots_on_target_against AS shots_on_target_allowed, pass_share AS possession_pct, corners_for AS big_chances, goals_for * 0.1 AS box_entries, shots_on_target_for AS deep_completions FROM tm),
vw AS (SELECT team_id, window_key, count(*) AS matches, {sums}, avg(possession_pct) AS possession_pct FROM vr JOIN {w} ON n IS NULL OR rn <= n GROUP BY 1, 2),
vu AS (SELECT team_id, window_key, metric, round(round(raw, 6), 6) AS raw FROM (UNPIVOT (SELECT team_id, window_key, {rates}, round(possession_pct, 6) AS possession_pct FROM vw) ON {names}, possession_pct INTO NAME metric VALUE raw)),
vp AS (SELECT *, CASE WHEN count(*) OVER g = 1 THEN 50 ELSE 100.0 * (rank() OVER (PARTITION BY window_key, metric ORDER BY raw) - 1 + (count(*) OVER (PARTITION BY window_key, metric, raw) - 1) / 2.0) / (count(*) OVER g - 1) END AS pc FROM vu WINDOW g AS (PARTITION BY window_key, metric)),
vi AS (SELECT team_id, window_key, max(pc) FILTER (metric = 'possession_pct') AS possession, round(100 - max(pc) FILTER (metric = 'shots_allowed'), 2) AS p_volume, round(100 - max(pc) FILTER (metric = 'xga'), 2) AS quality,
  0.3 * max(pc) FILTER (metric = 'xg') + 0.25 * max(pc) FILTER (metric = 'big_chances') + 0.25 * max(pc) FILTER (metric = 'box_entries') + 0.2 * max(pc) FILTER (metric = 'deep_completions') AS creation FROM vp GROUP BY 1, 2)"""
_V2_NAMES = ("xg", "xga", "shots_allowed", "shots_on_target_allowed", "big_chances", "box_entries", "deep_completions")
_V2 = _V2.format(features=FEATURES, w=_W, sums=", ".join(f"sum({c})::DOUBLE AS {c}" for c in _V2_NAMES), rates=", ".join(f"round({c} / matches, 6) AS {c}" for c in _V2_NAMES), names=", ".join(_V2_NAMES))


@query("team_bridge_v2", f"""WITH {_V2}, va AS (SELECT *, {_ALLOWED} AS allowed FROM vi)
SELECT team_id, window_key, 'sterile_possession' AS code, CASE WHEN possession - creation >= 60 THEN 'high' WHEN possession - creation >= 40 THEN 'notable' ELSE 'info' END AS severity FROM va WHERE possession >= 65 AND creation <= 35
UNION ALL SELECT team_id, window_key, allowed, 'notable' FROM va WHERE allowed IS NOT NULL""")
def team_bridge_v2(spark, sf):
    """Evidence-gated features as the rules' inputs: what is allowed is turned around, and rules on results have no input."""
    found = entity_v2.team_features(_observations(spark, sf))
    parts, whole = entity_v2.team_scores(found)
    inputs = findings.v2_inputs(found, whole, parts, ["team_id", "window_key"])
    return findings.team_findings(inputs, ["team_id", "window_key"]).drop("confidence")


@query("team_confidence", "SELECT o_orderkey, round((1 - exp(-(o_orderkey % 12) / 5.0)) * (0.55 + 0.45 * (o_orderkey % 11) / 10.0) * (0.75 + 0.25 * least(1.0, (o_orderkey % 20) / 12.0)), 6) AS confidence FROM orders")
def team_confidence(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders", "o_orderkey").select(k, F.round(entity_scores.team_confidence(k % 12, (k % 11) / F.lit(10.0), k % 20), 6).alias("confidence"))
