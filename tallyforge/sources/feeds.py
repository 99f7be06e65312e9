"""Readers of published files: fixtures, results, leagues, news feeds, spreadsheets. Schemas are declared, values cast or null."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lenient_int, lenient_number, plain_html, utc_timestamp

#: Short codes of a fixture's status.
STATUSES = {
    "FT": "finished", "AET": "finished", "PEN": "finished", "1H": "live", "HT": "live", "2H": "live", "ET": "live", "BT": "live", "P": "live", "SUSP": "live", "INT": "live", "LIVE": "live",
    "PST": "postponed", "CANC": "cancelled", "ABD": "abandoned", "TBD": "scheduled", "NS": "scheduled",
}
#: Codes of an event that is over, and of one that isn't; of others neither is known.
OVER, NOT_OVER = ("FT", "AET", "PEN"), ("NS", "1H", "HT", "2H", "ET", "BT")
#: Names of an event's statistics that are admitted, and their metric.
EVENT_STATS = {"Shots on Goal": "shots_on_target", "Total Shots": "shots_total", "Blocked Shots": "blocked_shots", "Shots insidebox": "shots_inside_box"}
#: The results file's columns of home and away, and their metric.
RESULT_PAIRS = (("HS", "AS", "shots_total"), ("HST", "AST", "shots_on_target"), ("HF", "AF", "fouls"), ("HC", "AC", "corners"), ("HY", "AY", "yellow_cards"), ("HR", "AR", "red_cards"))

_STAT = "array<struct<type:string,value:string>>"
BUNDLE = f"""response array<struct<
  fixture:struct<id:bigint,date:string,venue:struct<name:string>,status:struct<short:string>>, league:struct<id:bigint,name:string,season:int,round:string>,
  teams:struct<home:struct<id:bigint,name:string>,away:struct<id:bigint,name:string>>, goals:struct<home:int,away:int>,
  statistics:array<struct<team:struct<id:bigint>,statistics:{_STAT}>>,
  players:array<struct<team:struct<id:bigint>,players:array<struct<player:struct<id:bigint,name:string>,statistics:array<struct<
     games:struct<minutes:int,position:string,captain:boolean,substitute:boolean,number:int>,goals:struct<total:int,assists:int,saves:int>,shots:struct<total:int,on:int>,passes:struct<total:int,key:int>,
     tackles:struct<total:int,blocks:int,interceptions:int>,dribbles:struct<success:int>,duels:struct<won:int>,fouls:struct<drawn:int,committed:int>,cards:struct<yellow:int,red:int>>>>>>>,
  lineups:array<struct<team:struct<id:bigint>,formation:string>>>>"""


def status(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in STATUSES.items() for x in p)), code), F.lit("unknown"))


def stat_map(stats: Column) -> Column:
    """[{type, value}] as a map; of a type that comes twice the last counts."""
    return F.aggregate(stats, F.expr("map()").cast("map<string,string>"), lambda m, s: F.when(s["type"].isNull(), m).otherwise(F.map_concat(F.map_filter(m, lambda k, _: k != s["type"]), F.create_map(s["type"], s["value"]))))


def fixture_bundles(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """competitions, teams, matches, team_stats, lineups, players, appearances and player_stats of bundles (JSON, one a file)."""
    raw = spark.read.schema(T.StructType.fromDDL(BUNDLE)).option("multiLine", True).json(path).select(F.explode("response").alias("r")).select("r.*")
    match = F.col("fixture.id").alias("match_id")
    teams = raw.select(F.explode(F.array("teams.home", "teams.away")).alias("t")).select(F.col("t.id").alias("team_id"), F.col("t.name").alias("name"))
    stats = raw.select(match, F.explode_outer("statistics").alias("s")).where("s is not null").select("match_id", F.col("s.team.id").alias("team_id"), stat_map(F.col("s.statistics")).alias("m"))
    wanted = {"shots_total": "Total Shots", "shots_on_target": "Shots on Goal", "shots_inside_box": "Shots insidebox", "corners": "Corner Kicks", "fouls": "Fouls", "passes_total": "Total passes", "passes_accurate": "Passes accurate", "saves": "Goalkeeper Saves"}
    team_stats = stats.select("match_id", "team_id", *(lenient_int(F.try_element_at("m", F.lit(v))).alias(k) for k, v in wanted.items()), lenient_number(F.try_element_at("m", F.lit("Ball Possession"))).alias("possession_pct"))
    people = raw.select(match, F.explode_outer("players").alias("p")).where("p is not null").select("match_id", F.col("p.team.id").alias("team_id"), F.explode("p.players").alias("q")).select("match_id", "team_id", F.col("q.player.id").alias("player_id"), F.col("q.player.name").alias("name"), F.try_element_at("q.statistics", F.lit(1)).alias("s"))
    return {
        "competitions": raw.select(F.col("league.id").alias("competition_id"), F.col("league.name").alias("name"), F.col("league.season").alias("season")).distinct(),
        "teams": teams.distinct(),
        "matches": raw.select(match, F.col("league.id").alias("competition_id"), utc_timestamp(F.col("fixture.date")).alias("kickoff_at"), status(F.col("fixture.status.short")).alias("status"), F.col("league.round").alias("round_name"), F.col("fixture.venue.name").alias("venue_name"),
                              F.col("teams.home.id").alias("home_team_id"), F.col("teams.away.id").alias("away_team_id"), F.col("goals.home").alias("home_score"), F.col("goals.away").alias("away_score")),
        "team_stats": team_stats,
        "lineups": raw.select(match, F.explode_outer("lineups").alias("l")).where("l is not null").select("match_id", F.col("l.team.id").alias("team_id"), F.col("l.formation").alias("formation")),
        "players": people.select("player_id", "name").distinct(),
        "appearances": people.where("s.games.minutes > 0").select("match_id", "team_id", "player_id", F.col("s.games.minutes").alias("minutes"), (~F.coalesce("s.games.substitute", F.lit(False))).alias("started"), F.col("s.games.captain").alias("captain"), F.col("s.games.number").alias("shirt_number"), F.col("s.games.position").alias("listed_position")),
        "player_stats": people.where("s.games.minutes > 0").select("match_id", "player_id", *(F.col(f"s.{c}").alias(n) for c, n in (
            ("goals.total", "goals"), ("goals.assists", "assists"), ("shots.total", "shots_total"), ("shots.on", "shots_on_target"), ("passes.total", "passes_total"), ("passes.key", "key_passes"), ("tackles.total", "tackles"), ("tackles.blocks", "blocks"),
            ("tackles.interceptions", "interceptions"), ("dribbles.success", "dribbles_successful"), ("duels.won", "duels_won"), ("fouls.drawn", "fouls_drawn"), ("fouls.committed", "fouls_committed"), ("cards.yellow", "yellow_cards"), ("cards.red", "red_cards"), ("goals.saves", "saves")))),
    }


def observation_rows(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """keys, metric and value (text) of a wide row; what is null isn't there."""
    made = df.select(*keys, *(v.cast("string").alias(k) for k, v in values.items()))
    return made.unpivot(keys, list(values), "metric", "value").where("value is not null")


def results_csv(spark: SparkSession, path: str, division: str, season: str) -> DataFrame:
    """division, season, date, home_team, away_team, side, metric, value of a results file with a header; rows without teams or date go."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)

    def text(c: str) -> Column:
        return F.nullif(F.trim(F.col(c)), F.lit("")) if c in raw.columns else F.lit(None).cast("string")

    day = F.coalesce(F.try_to_timestamp(text("Date"), F.lit("dd/MM/yyyy")), F.try_to_timestamp(text("Date"), F.lit("dd/MM/yy"))).cast("date")
    base = raw.select(F.lit(division).alias("division"), F.lit(season).alias("season"), day.alias("date"), text("HomeTeam").alias("home_team"), text("AwayTeam").alias("away_team"), *(text(c).alias(c) for pair in RESULT_PAIRS for c in pair[:2]), text("FTHG").alias("FTHG"), text("FTAG").alias("FTAG"))
    base = base.where("date is not null and home_team is not null and away_team is not null")
    keys = ["division", "season", "date", "home_team", "away_team"]
    both = lenient_int(F.col("FTHG")).isNotNull() & lenient_int(F.col("FTAG")).isNotNull()
    match = observation_rows(base, keys, {"home_score": F.when(both, lenient_int(F.col("FTHG"))), "away_score": F.when(both, lenient_int(F.col("FTAG"))), "status": F.when(both, F.lit("finished"))}).withColumn("side", F.lit(None).cast("string"))
    sides = [observation_rows(base, keys, {m: lenient_int(F.col(pair[i])) for *pair, m in RESULT_PAIRS}).withColumn("side", F.lit(side)) for i, side in enumerate(("home", "away"))]
    return reduce(DataFrame.unionByName, [match, *sides]).select(*keys, "side", "metric", "value")


def season_json(spark: SparkSession, path: str) -> DataFrame:
    """date, home_team, away_team, round, home_score, away_score of a season's file.

    score is {"ft": [h, a]} or [h, a]; without a full-time score both are null, never nought.
    """
    raw = spark.read.schema("name string, matches array<struct<round:string,date:string,team1:string,team2:string,score:string>>").option("multiLine", True).json(path)
    m = raw.select(F.explode("matches").alias("m")).select("m.*")
    score = F.try_parse_json("score")

    def goals(i: int) -> Column:
        return F.coalesce(F.try_variant_get(score, f"$.ft[{i}]", "int"), F.try_variant_get(score, f"$[{i}]", "int"))

    both = goals(0).isNotNull() & goals(1).isNotNull()
    return m.select(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).cast("date").alias("date"), F.col("team1").alias("home_team"), F.col("team2").alias("away_team"), F.col("round"), F.when(both, goals(0)).alias("home_score"), F.when(both, goals(1)).alias("away_score")).where("home_team is not null and away_team is not null")


def league_json(spark: SparkSession, path: str) -> DataFrame:
    """match_id, kickoff_at, home_team, away_team, finished and the score of the first final result."""
    schema = "matchID bigint, matchDateTimeUTC string, matchIsFinished boolean, team1 struct<teamId:bigint,teamName:string>, team2 struct<teamId:bigint,teamName:string>, matchResults array<struct<resultTypeKind:string,resultName:string,pointsTeam1:int,pointsTeam2:int>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    final = F.try_element_at(F.filter("matchResults", lambda r: F.upper(r["resultTypeKind"]) == "FINAL"), F.lit(1))
    return raw.select(F.col("matchID").alias("match_id"), utc_timestamp(F.col("matchDateTimeUTC")).alias("kickoff_at"), F.col("team1.teamName").alias("home_team"), F.col("team2.teamName").alias("away_team"), F.col("matchIsFinished").alias("finished"), final["pointsTeam1"].alias("home_score"), final["pointsTeam2"].alias("away_score"))


def event_json(spark: SparkSession, path: str) -> DataFrame:
    """match_id, date, home_team, away_team, scores and finished (null where the status says neither) of a list of events."""
    raw = spark.read.schema("events array<struct<idEvent:string,dateEvent:string,strHomeTeam:string,strAwayTeam:string,intHomeScore:string,intAwayScore:string,strStatus:string>>").option("multiLine", True).json(path)
    e = raw.select(F.explode("events").alias("e")).select("e.*")
    code = F.trim("strStatus")
    finished = F.when(code.isin(*OVER), True).when(code.isin(*NOT_OVER), False)
    return e.select(F.col("idEvent").alias("match_id"), F.try_to_timestamp("dateEvent", F.lit("yyyy-MM-dd")).cast("date").alias("date"), F.col("strHomeTeam").alias("home_team"), F.col("strAwayTeam").alias("away_team"), lenient_int(F.col("intHomeScore")).alias("home_score"), lenient_int(F.col("intAwayScore")).alias("away_score"), finished.alias("finished"))


def event_stats_json(spark: SparkSession, path: str) -> DataFrame:
    """match_id, side, metric, value of events' statistics that the list admits; others, and values that are no numbers, go."""
    raw = spark.read.schema("eventstats array<struct<idEvent:string,strStat:string,intHome:string,intAway:string>>").option("multiLine", True).json(path)
    e = raw.select(F.explode("eventstats").alias("e")).select("e.*")
    metric = F.try_element_at(F.create_map(*(F.lit(x) for p in EVENT_STATS.items() for x in p)), F.trim("strStat"))
    rows = e.select(F.col("idEvent").alias("match_id"), metric.alias("metric"), F.inline(F.array(F.struct(F.lit("home").alias("side"), lenient_int(F.col("intHome")).alias("value")), F.struct(F.lit("away").alias("side"), lenient_int(F.col("intAway")).alias("value")))))
    return rows.where("metric is not null and value is not null").select("match_id", "side", "metric", "value")


def lineup_json(spark: SparkSession, path: str) -> DataFrame:
    """match_id, team_id, player_id, name, position, shirt_number and started (null where it isn't said)."""
    raw = spark.read.schema("lineup array<struct<idEvent:string,idTeam:string,idPlayer:string,strPlayer:string,strPosition:string,strSubstitute:string,intSquadNumber:string>>").option("multiLine", True).json(path)
    p = raw.select(F.explode("lineup").alias("p")).select("p.*").where("idPlayer is not null and trim(idPlayer) <> ''")
    substitute = F.lower(F.trim("strSubstitute"))
    return p.select(F.col("idEvent").alias("match_id"), F.col("idTeam").alias("team_id"), F.col("idPlayer").alias("player_id"), F.col("strPlayer").alias("name"), F.nullif(F.trim("strPosition"), F.lit("")).alias("position"), lenient_int(F.col("intSquadNumber")).alias("shirt_number"), F.when(substitute == "no", True).when(substitute == "yes", False).alias("started"))


def match_json(spark: SparkSession, path: str) -> DataFrame:
    """match_id, kickoff_at, home_team, away_team, status and the full-time score (both or neither) of a list of matches."""
    side, score = "struct<id:bigint,name:string>", "struct<fullTime:struct<home:int,away:int>>"
    raw = spark.read.schema(f"matches array<struct<id:bigint,utcDate:string,status:string,homeTeam:{side},awayTeam:{side},score:{score}>>").option("multiLine", True).json(path)
    m = raw.select(F.explode("matches").alias("m")).select("m.*").where("id is not null")
    both = F.col("score.fullTime.home").isNotNull() & F.col("score.fullTime.away").isNotNull()
    return m.select(F.col("id").alias("match_id"), utc_timestamp(F.col("utcDate")).alias("kickoff_at"), F.col("homeTeam.name").alias("home_team"), F.col("awayTeam.name").alias("away_team"), "status", F.when(both, F.col("score.fullTime.home")).alias("home_score"), F.when(both, F.col("score.fullTime.away")).alias("away_score"))


def competition_json(spark: SparkSession, path: str) -> DataFrame:
    """code, name and season of a list of competitions."""
    raw = spark.read.schema("competitions array<struct<code:string,name:string,currentSeason:struct<startDate:string,endDate:string>>>").option("multiLine", True).json(path)
    c = raw.select(F.explode("competitions").alias("c")).select("c.*").where("code is not null")
    return c.select("code", "name", F.concat_ws("-", F.substring("currentSeason.startDate", 1, 4), F.substring("currentSeason.endDate", 1, 4)).alias("season"))


def allowed(rows: DataFrame, names: DataFrame, on: str = "metric") -> DataFrame:
    """Rows whose metric a declared list admits."""
    return rows.join(names.select(on).distinct(), on, "left_semi")


# -- news feeds ---------------------------------------------------------------------

_ITEMS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "guid", "summary", "published")]))


@F.pandas_udf(_ITEMS)
def feed_items(payload: pd.Series) -> pd.Series:
    """Items of an RSS, RDF or Atom document; none of one that isn't well formed, and none of one that declares entities."""
    import xml.etree.ElementTree as ET

    def name(e):
        return e.tag.rpartition("}")[2].lower()

    def child(e, *names):
        for c in e:
            if name(c) in names:
                return c
        return None

    def text(e):
        return None if e is None else "".join(e.itertext()).strip() or None

    def one(x):
        if x is None or "<!ENTITY" in x.upper():
            return []
        try:
            root = ET.fromstring(x.encode())
        except ET.ParseError:
            return []
        out = []
        for e in root.iter():
            if name(e) not in ("item", "entry"):
                continue
            link = child(e, "link")
            links = [c for c in e if name(c) == "link" and c.get("rel", "alternate") == "alternate"]
            href = links[0].get("href") if links and links[0].get("href") else text(link)
            out.append({"title": text(child(e, "title")), "link": href, "guid": text(child(e, "guid", "id")), "summary": text(child(e, "description", "summary", "content")), "published": text(child(e, "pubdate", "published", "updated", "date"))})
        return out

    return payload.map(one)


def news(documents: DataFrame, payload: str = "payload") -> DataFrame:
    """The documents' other columns with title, url, guid, excerpt and published_at of each item that has a title and a link."""
    rows = documents.select("*", F.explode(feed_items(F.col(payload))).alias("i")).drop(payload)
    return rows.select("*", plain_html(F.col("i.title")).alias("title"), F.col("i.link").alias("url"), F.col("i.guid").alias("guid"), F.substring(plain_html(F.col("i.summary")), 1, 400).alias("excerpt"), utc_timestamp(F.col("i.published")).alias("published_at")).drop("i").where("title <> '' and url is not null")


# -- spreadsheets ----------------------------------------------------------------------

def contract(rows: DataFrame, required: list[str], enums: dict[str, list[str]] | None = None, unit: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the contract, the others with their faults): required texts, values of a list, numbers from 0 to 1."""
    faults = [F.when(F.coalesce(F.trim(F.col(c)) == "", F.lit(True)), F.lit(f"{c} is missing")) for c in required]
    faults += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*v), F.lit(f"{c} isn't in the list")) for c, v in (enums or {}).items()]
    number = {c: lenient_number(F.col(c)) for c in unit or []}
    faults += [F.when(F.col(c).isNotNull() & (F.trim(F.col(c)) != "") & ~F.coalesce(n.between(0, 1), F.lit(False)), F.lit(f"{c} isn't between 0 and 1")) for c, n in number.items()]
    marked = rows.withColumn("faults", F.array_compact(F.array(*faults)))
    return marked.where(F.size("faults") == 0).drop("faults"), marked.where(F.size("faults") > 0)


# -- files ---------------------------------------------------------------------------------

def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (path, content) with ok: whether the manifest's sha256 of the path is the content's; null without an entry."""
    own = files.withColumn("sha256", F.sha2("content", 256))
    want = manifest.select(F.col("path").alias("_p"), F.col("sha256").alias("_s"))
    return own.join(want, F.col("path") == F.col("_p"), "left").withColumn("ok", F.col("sha256") == F.col("_s")).drop("_p", "_s")


def manifest(files: DataFrame) -> DataFrame:
    """path, bytes and sha256 of files (path, content)."""
    return files.select("path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
