"""Event feeds: nested events of a match to counts for players, goalkeepers and teams, each in one pass over the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import catalog
from ..functions.text import distance

#: Fixed values of feed A: outcomes and types.
ON_TARGET, OFF_TARGET = ("Goal", "Saved", "Saved Off Target", "Saved to Post"), ("Off T", "Wayward")
SAVES = ("Shot Saved", "Shot Saved Off Target", "Shot Saved to Post", "Penalty Saved", "Penalty Saved to Post")
CONCEDED = ("Goal Conceded", "Penalty Conceded")
#: Fixed values of feed B: tags, and (event, sub-event) that are shots.
TAGS = {"goal": 101, "assist": 301, "key_pass": 302, "head": 403, "won": 703, "through": 901, "interception": 1401, "red": 1701, "yellow": 1702, "second_yellow": 1703, "accurate": 1801, "not_accurate": 1802, "counter_attack": 1901, "blocked": 2101}
SHOTS_B = (("Shot", "Shot"), ("Free Kick", "Free kick shot"), ("Free Kick", "Penalty"))
GROUND_DUELS = ("Ground attacking duel", "Ground defending duel", "Ground loose ball duel")

#: The metrics that feed A, and feed B, may emit, by grain: 110 and 77.
EMITTED_A: dict[str, tuple[str, ...]] = {
    "match": (
        "home_score", "away_score", "status", "kickoff_at", "round_name", "venue_name"
    ),
    "team_match": (
        "home_away", "goals_for", "goals_against", "shots_total", "shots_on_target", "blocked_shots", "shots_allowed", "shots_on_target_allowed", "passes_total", "passes_accurate",
        "pass_accuracy_pct", "corners", "offsides", "fouls", "yellow_cards", "red_cards", "pressures", "recoveries", "counter_attack_shots", "goalkeeper_saves", "formation", "xg", "xga", "npxg",
        "npxga", "xg_per_shot", "xga_per_shot"
    ),
    "player_appearance": (
        "started", "shirt_number", "listed_position"
    ),
    "player_season": (
        "matches", "appearances", "starts", "sub_appearances"
    ),
    "player_match": (
        "touches", "passes_total", "passes_accurate", "pass_completion_pct", "passes_received", "passes_under_pressure", "assists", "key_passes", "chances_created", "through_balls", "crosses",
        "switches", "shots_total", "shots_on_target", "shots_off_target", "blocked_shots", "headed_shots", "shots_on_target_pct", "goals_per_shot", "goals_per_shot_on_target", "goals",
        "non_penalty_goals", "goal_contributions", "penalty_goals", "penalties_attempted", "penalties_missed", "advanced.xg", "npxg", "xg_per_shot", "goals_minus_xg", "non_penalty_goals_minus_npxg",
        "duels_total", "aerial_duels", "tackles", "ground_duels", "interceptions", "clearances", "blocks", "dribbles_attempted", "dribbles_successful", "dribble_success_pct", "take_ons_attempted",
        "take_ons_successful", "take_on_success_pct", "fouls_committed", "fouls_drawn", "dispossessed", "miscontrols", "possession_losses", "turnovers", "recoveries", "pressures", "carries",
        "carry_distance", "yellow_cards", "red_cards", "second_yellow_cards", "saves"
    ),
    "goalkeeper_match": (
        "saves", "goals_conceded", "shots_on_target_faced", "save_pct", "clean_sheets", "claims", "crosses_stopped", "sweeper_actions", "passes", "distribution_accuracy_pct"
    ),
    "goalkeeper_season": (
        "save_pct", "clean_sheets"
    ),
}
EMITTED_B: dict[str, tuple[str, ...]] = {
    "match": (
        "home_score", "away_score", "status", "kickoff_at", "round_name", "venue_name"
    ),
    "team_match": (
        "home_away", "goals_for", "goals_against", "shots_total", "shots_on_target", "blocked_shots", "shots_allowed", "shots_on_target_allowed", "passes_total", "passes_accurate",
        "pass_accuracy_pct", "corners", "offsides", "fouls", "yellow_cards", "red_cards", "goalkeeper_saves", "counter_attack_shots"
    ),
    "player_appearance": (
        "started",
    ),
    "player_season": (
        "matches", "appearances", "starts", "sub_appearances"
    ),
    "player_match": (
        "touches", "passes_total", "passes_accurate", "pass_completion_pct", "assists", "key_passes", "chances_created", "through_balls", "crosses", "shots_total", "shots_on_target",
        "shots_off_target", "blocked_shots", "headed_shots", "shots_on_target_pct", "goals_per_shot", "goals_per_shot_on_target", "goals", "non_penalty_goals", "goal_contributions", "penalty_goals",
        "penalties_attempted", "penalties_missed", "duels_total", "duels_won", "duel_win_pct", "aerial_duels", "aerial_duels_won", "aerial_duel_win_pct", "ground_duels", "ground_duels_won",
        "interceptions", "clearances", "fouls_committed", "yellow_cards", "second_yellow_cards", "red_cards", "saves"
    ),
    "goalkeeper_match": (
        "saves", "passes", "distribution_accuracy_pct", "launches", "shots_on_target_faced", "save_pct", "goals_conceded", "clean_sheets"
    ),
    "goalkeeper_season": (
        "save_pct", "clean_sheets"
    ),
}

_NAMED = "struct<id:bigint,name:string>"
EVENTS_A = f"""match_id bigint, type {_NAMED}, team {_NAMED}, player {_NAMED}, play_pattern {_NAMED}, under_pressure boolean, location array<double>, tactics struct<formation:int>,
  shot struct<outcome:{_NAMED},body_part:{_NAMED},type:{_NAMED},statsbomb_xg:double>, pass struct<outcome:{_NAMED},recipient:{_NAMED},type:{_NAMED},shot_assist:boolean,goal_assist:boolean,through_ball:boolean,cross:boolean,switch:boolean>,
  duel struct<type:{_NAMED}>, dribble struct<outcome:{_NAMED}>, carry struct<end_location:array<double>>, goalkeeper struct<type:{_NAMED},outcome:{_NAMED}>"""
LINEUPS_A = "match_id bigint, team_id bigint, team_name string, lineup array<struct<player_id:bigint,player_name:string,jersey_number:int,cards:array<struct<card_type:string>>,positions:array<struct<position:string,`from`:string,start_reason:string>>>>"
EVENTS_B = "matchId bigint, playerId bigint, teamId bigint, eventName string, subEventName string, tags array<struct<id:int>>"
_ENTRY = "array<struct<playerId:bigint>>"
MATCHES_B = f"wyId bigint, competitionId bigint, seasonId bigint, label string, dateutc string, teamsData map<string,struct<side:string,score:int,formation:struct<lineup:{_ENTRY},bench:{_ENTRY},substitutions:string>>>"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files, one document or list each, with a declared schema."""
    return spark.read.schema(T.StructType.fromDDL(schema)).option("multiLine", True).json(path)


def _n(when: Column) -> Column:
    return F.count_if(F.coalesce(when, F.lit(False)))


def players_a(events: DataFrame) -> DataFrame:
    """match_id, player_id and every counter of feed A. Passes count for who received them too, if accurate."""
    kind, player = F.col("type.name"), F.col("player.id")
    own = events.where(player.isNotNull() & (kind != "Starting XI"))
    shot, passed = (kind == "Shot") & F.col("shot").isNotNull(), (kind == "Pass") & F.col("pass").isNotNull()
    outcome, penalty = F.col("shot.outcome.name"), F.coalesce(F.col("shot.type.name") == "Penalty", F.lit(False))
    accurate, keeper = F.col("pass.outcome").isNull(), (kind == "Goal Keeper") & F.col("goalkeeper").isNotNull()
    xg, gk = F.col("shot.statsbomb_xg"), F.col("goalkeeper.type.name")
    run = distance(F.col("location"), F.col("carry.end_location"))
    counters = {
        "touches": F.lit(True), "shots_total": shot, "shots_on_target": shot & outcome.isin(*ON_TARGET), "shots_off_target": shot & outcome.isin(*OFF_TARGET), "blocked_shots": shot & (outcome == "Blocked"), "headed_shots": shot & (F.col("shot.body_part.name") == "Head"),
        "goals": shot & (outcome == "Goal"), "penalties_attempted": shot & penalty, "penalty_goals": shot & penalty & (outcome == "Goal"),
        "passes_total": passed, "passes_accurate": passed & accurate, "key_passes": passed & F.col("pass.shot_assist"), "assists": passed & F.col("pass.goal_assist"), "through_balls": passed & F.col("pass.through_ball"), "crosses": passed & F.col("pass.cross"), "switches": passed & F.col("pass.switch"), "passes_under_pressure": passed & F.col("under_pressure"),
        "duels_total": (kind == "Duel") & F.col("duel").isNotNull(), "aerial_duels": (kind == "Duel") & (F.col("duel.type.name") == "Aerial Lost"), "tackles": (kind == "Duel") & (F.col("duel.type.name") == "Tackle"),
        "interceptions": kind == "Interception", "clearances": kind == "Clearance", "blocks": kind == "Block", "dribbles_attempted": (kind == "Dribble") & F.col("dribble").isNotNull(), "dribbles_successful": (kind == "Dribble") & (F.col("dribble.outcome.name") == "Complete"),
        "fouls_committed": kind == "Foul Committed", "fouls_drawn": kind == "Foul Won", "dispossessed": kind == "Dispossessed", "miscontrols": kind == "Miscontrol", "recoveries": kind == "Ball Recovery", "pressures": kind == "Pressure", "carries": (kind == "Carry") & F.col("carry").isNotNull(),
        "saves": keeper & gk.isin(*SAVES), "goals_conceded": keeper & gk.isin(*CONCEDED), "sweeper_actions": keeper & (gk == "Keeper Sweeper"), "claims": keeper & (gk == "Keeper Sweeper") & (F.col("goalkeeper.outcome.name") == "Claim"), "crosses_stopped": keeper & (gk == "Punch"),
    }
    sums = {"advanced.xg": F.when(shot, xg), "npxg": F.when(shot & ~penalty, xg), "carry_distance": F.when((kind == "Carry") & (F.size("location") >= 2) & (F.size("carry.end_location") >= 2), run)}
    # who played and who received: one row each, so that both meet in one aggregation
    received = F.when(passed & accurate, F.col("pass.recipient.id"))
    played = own.select("match_id", player.alias("player_id"), *(_flag(v).alias(k) for k, v in counters.items()), *(F.coalesce(v, F.lit(0.0)).alias(k) for k, v in sums.items()), F.lit(0).alias("passes_received"))
    got = own.where(received.isNotNull()).select("match_id", received.alias("player_id"), F.lit(1).alias("passes_received"))
    names = [*counters, *sums, "passes_received"]
    both = played.unionByName(got, allowMissingColumns=True)
    return both.groupBy("match_id", "player_id").agg(*(F.coalesce(F.sum(F.col(f"`{c}`")), F.lit(0)).alias(c) for c in names))


def _flag(when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), 1).otherwise(0)


def derived_a(counts: DataFrame) -> DataFrame:
    """Residuals and shares of feed A's counts, 4 decimals; a share needs something to share."""
    def pct(a, b):
        return F.round(F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)), 4)

    xg = F.col("`advanced.xg`")
    return counts.withColumns({
        "non_penalty_goals": F.col("goals") - F.col("penalty_goals"), "goal_contributions": F.col("goals") + F.col("assists"), "goals_minus_xg": F.round(F.col("goals") - xg, 4), "non_penalty_goals_minus_npxg": F.round(F.col("goals") - F.col("penalty_goals") - F.col("npxg"), 4),
        "penalties_missed": F.col("penalties_attempted") - F.col("penalty_goals"), "shots_on_target_pct": pct("shots_on_target", "shots_total"), "pass_completion_pct": pct("passes_accurate", "passes_total"), "dribble_success_pct": pct("dribbles_successful", "dribbles_attempted"),
        "xg_per_shot": F.round(F.when(F.col("shots_total") > 0, xg / F.col("shots_total")), 4), "possession_losses": F.col("dispossessed") + F.col("miscontrols")})


def roster_a(lineups: DataFrame) -> DataFrame:
    """match_id, team_id, player_id, name, shirt_number, started, participated, yellow_cards, red_cards, second_yellow_cards, goalkeeper."""
    p = lineups.select("match_id", "team_id", F.explode("lineup").alias("p"))
    cards, positions = F.coalesce("p.cards", F.array()), F.coalesce("p.positions", F.array())

    def cards_of(*names):
        return F.size(F.filter(cards, lambda c: c["card_type"].isin(*names)))

    return p.select("match_id", "team_id", F.col("p.player_id").alias("player_id"), F.col("p.player_name").alias("name"), F.col("p.jersey_number").alias("shirt_number"),
                    F.coalesce(F.try_element_at("p.positions", F.lit(1))["start_reason"] == "Starting XI", F.lit(False)).alias("started"), (F.size(positions) > 0).alias("participated"),
                    cards_of("Yellow Card").alias("yellow_cards"), cards_of("Red Card", "Second Yellow").alias("red_cards"), cards_of("Second Yellow").alias("second_yellow_cards"), F.exists(positions, lambda x: x["position"] == "Goalkeeper").alias("goalkeeper"))


def formations_a(events: DataFrame) -> DataFrame:
    """match_id, team_id, formation as dashed digits."""
    opening = events.where((F.col("type.name") == "Starting XI") & F.col("tactics.formation").isNotNull())
    return opening.groupBy("match_id", F.col("team.id").alias("team_id")).agg(F.array_join(F.filter(F.split(F.max("tactics.formation").cast("string"), ""), lambda c: c != ""), "-").alias("formation"))


def zero_filled(roster: DataFrame, counts: DataFrame) -> DataFrame:
    """Participants' counts: nought for those without events; nothing for who didn't take part."""
    names = [c for c in counts.columns if c not in ("match_id", "player_id")]
    joined = roster.where("participated").join(counts, ["match_id", "player_id"], "left")
    return joined.select(*roster.columns, *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in names))


def goalkeepers_a(filled: DataFrame) -> DataFrame:
    """Goalkeepers' counts with shots on target faced (saves and goals conceded) and the share saved."""
    faced = F.col("saves") + F.col("goals_conceded")
    return filled.where("goalkeeper").withColumn("shots_on_target_faced", faced).withColumn("save_pct", F.round(F.when(faced > 0, 100.0 * F.col("saves") / faced), 4))


def with_opponent(teams: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Teams' rows with the other side's counts under new names: a match's sum less one's own, without a self-join."""
    total = teams.groupBy("match_id").agg(*(F.sum(F.col(f"`{c}`")).alias(f"_{c}") for c in pairs), F.count("*").alias("_sides"))
    joined = teams.join(total.where("_sides = 2"), "match_id", "left")
    return joined.select(*(F.col(f"`{c}`") for c in teams.columns), *((F.col(f"`_{c}`") - F.col(f"`{c}`")).alias(n) for c, n in pairs.items()))


def teams_a(events: DataFrame) -> DataFrame:
    """match_id, team_id and feed A's team counters, with what each allowed."""
    kind, outcome = F.col("type.name"), F.col("shot.outcome.name")
    shot, passed = kind == "Shot", kind == "Pass"
    xg = F.when(shot, F.col("shot.statsbomb_xg"))
    found = events.where("team.id is not null").groupBy("match_id", F.col("team.id").alias("team_id")).agg(
        _n(shot).alias("shots_total"), _n(shot & outcome.isin(*ON_TARGET)).alias("shots_on_target"), _n(shot & (outcome == "Blocked")).alias("blocked_shots"), _n(shot & (F.col("play_pattern.name") == "From Counter")).alias("counter_attack_shots"),
        _n(passed).alias("passes_total"), _n(passed & F.col("pass.outcome").isNull()).alias("passes_accurate"), _n(passed & (F.col("pass.type.name") == "Corner")).alias("corners"), _n(kind == "Foul Committed").alias("fouls"), _n(kind == "Offside").alias("offsides"),
        _n(kind == "Pressure").alias("pressures"), _n(kind == "Ball Recovery").alias("recoveries"), F.coalesce(F.sum(xg), F.lit(0.0)).alias("xg"))
    return with_opponent(found, {"shots_total": "shots_allowed", "shots_on_target": "shots_on_target_allowed", "xg": "xga"})


def has(tag: str) -> Column:
    return F.coalesce(F.exists("tags", lambda t: t["id"] == TAGS[tag]), F.lit(False))


def players_b(events: DataFrame) -> DataFrame:
    """match_id, player_id and every counter of feed B. Player 0 stands for nobody."""
    own = events.where("matchId is not null and playerId <> 0")
    event, sub = F.col("eventName"), F.col("subEventName")
    passed, duel, foul = event == "Pass", event == "Duel", event == "Foul"
    shot = F.lit(False)
    for a, b in SHOTS_B:
        shot = shot | ((event == a) & (sub == b))
    penalty, ground = (event == "Free Kick") & (sub == "Penalty"), duel & sub.isin(*GROUND_DUELS)
    return own.groupBy(F.col("matchId").alias("match_id"), F.col("playerId").alias("player_id")).agg(
        F.count("*").alias("touches"), _n(passed).alias("passes_total"), _n(passed & has("accurate")).alias("passes_accurate"), _n(passed & has("assist")).alias("assists"), _n(passed & has("key_pass")).alias("key_passes"), _n(passed & has("through")).alias("through_balls"),
        _n(passed & (sub == "Cross")).alias("crosses"), _n(passed & (sub == "Launch")).alias("launches"), _n(shot).alias("shots_total"), _n(shot & has("accurate")).alias("shots_on_target"), _n(shot & has("not_accurate")).alias("shots_off_target"), _n(shot & has("blocked")).alias("blocked_shots"),
        _n(shot & has("head")).alias("headed_shots"), _n(shot & has("goal")).alias("goals"), _n(penalty).alias("penalties_attempted"), _n(penalty & has("goal")).alias("penalty_goals"), _n(duel).alias("duels_total"), _n(duel & has("won")).alias("duels_won"),
        _n(duel & (sub == "Air duel")).alias("aerial_duels"), _n(duel & (sub == "Air duel") & has("won")).alias("aerial_duels_won"), _n(ground).alias("ground_duels"), _n(ground & has("won")).alias("ground_duels_won"), _n(has("interception")).alias("interceptions"),
        _n((event == "Others on the ball") & (sub == "Clearance")).alias("clearances"), _n(foul).alias("fouls_committed"), _n(foul & has("yellow")).alias("yellow_cards"), _n(foul & has("second_yellow")).alias("second_yellow_cards"), _n(foul & (has("red") | has("second_yellow"))).alias("red_cards"), _n((event == "Save attempt") & has("accurate")).alias("saves"))


def teams_b(events: DataFrame) -> DataFrame:
    """match_id, team_id and feed B's team counters, with what each allowed."""
    event, sub = F.col("eventName"), F.col("subEventName")
    shot = F.lit(False)
    for a, b in SHOTS_B:
        shot = shot | ((event == a) & (sub == b))
    found = events.where("matchId is not null and teamId <> 0").groupBy(F.col("matchId").alias("match_id"), F.col("teamId").alias("team_id")).agg(
        _n(shot).alias("shots_total"), _n(shot & has("accurate")).alias("shots_on_target"), _n(shot & has("counter_attack")).alias("counter_attack_shots"), _n(event == "Pass").alias("passes_total"), _n((event == "Pass") & has("accurate")).alias("passes_accurate"),
        _n((event == "Free Kick") & (sub == "Corner")).alias("corners"), _n(event == "Foul").alias("fouls"), _n(event == "Offside").alias("offsides"))
    return with_opponent(found, {"shots_total": "shots_allowed", "shots_on_target": "shots_on_target_allowed"})


def roster_b(matches: DataFrame) -> DataFrame:
    """match_id, team_id, player_id, started, participated: lineup, or bench and brought on. substitutions may be the text "null"."""
    t = matches.select(F.col("wyId").alias("match_id"), F.explode("teamsData").alias("team", "x")).select("match_id", F.expr("try_cast(team AS bigint)").alias("team_id"), "x.formation").where("team_id is not null")
    subs = F.from_json("formation.substitutions", "array<struct<playerIn:bigint,playerOut:bigint,minute:int>>")
    line, bench = (F.coalesce(F.transform(f"formation.{c}", lambda p: p["playerId"]), F.array().cast("array<bigint>")) for c in ("lineup", "bench"))
    came = F.coalesce(F.transform(subs, lambda s: s["playerIn"]), F.array().cast("array<bigint>"))
    rows = t.select("match_id", "team_id", line.alias("line"), bench.alias("bench"), came.alias("came"))
    rows = rows.select("match_id", "team_id", "line", "came", "bench", F.explode(F.array_distinct(F.concat("line", "bench"))).alias("player_id")).where("player_id <> 0")
    started = F.array_contains("line", F.col("player_id"))
    return rows.select("match_id", "team_id", "player_id", started.alias("started"), (started | (F.array_contains("bench", F.col("player_id")) & F.array_contains("came", F.col("player_id")))).alias("participated"))


def goalkeepers_b(filled: DataFrame, keepers: DataFrame, teams: DataFrame) -> DataFrame:
    """Goalkeepers (keepers: player_id) with their team's shots on target faced, only where one goalkeeper of the team played."""
    own = filled.join(keepers.select("player_id").distinct(), "player_id", "left_semi")
    alone = own.groupBy("match_id", "team_id").agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    faced = teams.select("match_id", "team_id", "shots_on_target_allowed").join(alone, ["match_id", "team_id"])
    joined = own.join(faced, ["match_id", "team_id"], "left").withColumnRenamed("shots_on_target_allowed", "shots_on_target_faced")
    return joined.withColumn("save_pct", F.round(F.when(F.col("shots_on_target_faced") > 0, 100.0 * F.col("saves") / F.col("shots_on_target_faced")), 4))


def season_totals(filled: DataFrame, keys: list[str], additive: list[str]) -> DataFrame:
    """A player's season from matches: appearances, starts, sub_appearances and sums."""
    return filled.groupBy(*keys).agg(F.count("*").alias("appearances"), F.count_if("started").alias("starts"), F.count_if(~F.col("started")).alias("sub_appearances"), *(F.sum(F.col(f"`{c}`")).alias(c) for c in additive))


def outside_scope(matches: DataFrame, competition: str, season: str, want_competition: object, want_season: object) -> DataFrame:
    """Matches of another competition or season; a scope's read must fail if there are any."""
    return matches.where(~(F.col(competition).eqNullSafe(F.lit(want_competition)) & F.col(season).eqNullSafe(F.lit(want_season))))


def identities(emitted: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(metric, granularity) of a feed's list."""
    return [(m, g) for g, metrics in emitted.items() for m in metrics]


def registry(spark: SparkSession, emitted: dict[str, tuple[str, ...]]) -> DataFrame:
    """metric, granularity, unit, derived and safe: each entry of the catalog, and whether the feed may emit it."""
    listed = spark.createDataFrame(identities(emitted), "metric string, granularity string").withColumn("_safe", F.lit(True))
    return catalog(spark).join(F.broadcast(listed), ["metric", "granularity"], "left").select("metric", "granularity", "unit", "derived", F.coalesce("_safe", F.lit(False)).alias("safe"))  # fixed lists


def long_facts(counts: DataFrame, keys: list[str], granularity: str) -> DataFrame:
    """keys, metric, granularity, value: counts as facts; what is null isn't one."""
    names = [c for c in counts.columns if c not in keys and dict(counts.dtypes)[c] in ("int", "bigint", "double", "boolean")]
    rows = counts.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in names))).alias("x"))
    return rows.select(*keys, "x.metric", F.lit(granularity).alias("granularity"), "x.value").where("value is not null")


def match_a(events: DataFrame, lineups: DataFrame, match_id: int) -> dict[str, DataFrame]:
    """players, goalkeepers and teams of one match of feed A: all that a match tells, and nothing of a season."""
    own, roster = events.where(F.col("match_id") == match_id), roster_a(lineups.where(F.col("match_id") == match_id))
    filled = zero_filled(roster, players_a(own))
    return {"players": derived_a(filled), "goalkeepers": goalkeepers_a(filled), "teams": teams_a(own)}


def season_a(matches: DataFrame, events: DataFrame, lineups: DataFrame, competition: int, season: int, complete: int | None = None) -> dict[str, DataFrame]:
    """As match_a() of all matches (match_id, competition_id, season_id), with player_seasons where the scope is complete: has `complete` matches, or any number.

    Matches of another scope are an error.
    """
    if outside_scope(matches, "competition_id", "season_id", competition, season).head(1):
        raise ValueError("matches belong to another competition or season")
    ids = matches.select("match_id").distinct()
    own, roster = events.join(ids, "match_id", "left_semi"), roster_a(lineups.join(ids, "match_id", "left_semi"))
    filled = zero_filled(roster, players_a(own))
    out = {"players": derived_a(filled), "goalkeepers": goalkeepers_a(filled), "teams": teams_a(own)}
    if complete is None or ids.count() == complete:
        out["player_seasons"] = season_totals(filled, ["player_id"], ["goals", "assists", "shots_total"])
    return out


def season_b(matches: DataFrame, events: DataFrame, keepers: DataFrame, competition: int, season: int) -> dict[str, DataFrame]:
    """players, goalkeepers, teams and player_seasons of feed B's season. Matches of another scope are an error."""
    if outside_scope(matches, "competitionId", "seasonId", competition, season).head(1):
        raise ValueError("matches belong to another competition or season")
    own = events.join(matches.select(F.col("wyId").alias("matchId")), "matchId", "left_semi")
    filled, teams = zero_filled(roster_b(matches), players_b(own)), teams_b(own)
    return {"players": filled, "goalkeepers": goalkeepers_b(filled, keepers, teams), "teams": teams, "player_seasons": season_totals(filled, ["player_id"], ["goals", "assists", "shots_total"])}
