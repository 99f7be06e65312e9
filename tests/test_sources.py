"""Feeds, counters, text functions, sinks and streams on small files."""

import datetime as dt
import html
import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as X
from tallyforge.sources import event_feeds, feeds, sinks
from tallyforge.sources.tables import table
from tallyforge.streaming import events as streams


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).head()


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_fixture_bundle(spark, tmp_path):
    player = {"player": {"id": 7, "name": "Ann"}, "statistics": [{"games": {"minutes": 90, "position": "F", "captain": True, "substitute": False, "number": 9}, "goals": {"total": 2, "assists": None}, "shots": {"total": 4, "on": 3}}]}
    bench = {"player": {"id": 8, "name": "Bea"}, "statistics": [{"games": {"minutes": None}}]}
    bundle = {"response": [{"fixture": {"id": 1, "date": "2024-08-01T18:00:00+02:00", "venue": {"name": "V"}, "status": {"short": "FT"}}, "league": {"id": 39, "name": "L", "season": 2024, "round": "R1"}, "teams": {"home": {"id": 10, "name": "H"}, "away": {"id": 11, "name": "A"}}, "goals": {"home": 2, "away": 0},
                            "statistics": [{"team": {"id": 10}, "statistics": [{"type": "Ball Possession", "value": "55%"}, {"type": "Total Shots", "value": 9}, {"type": "Total Shots", "value": 12}, {"type": "Fouls", "value": None}]}], "players": [{"team": {"id": 10}, "players": [player, bench]}], "lineups": [{"team": {"id": 10}, "formation": "4-3-3"}]},
                           {"fixture": {"id": 2, "date": "bad", "status": {"short": "??"}}, "league": {"id": 39, "name": "L", "season": 2024}, "teams": {"home": {"id": 11, "name": "A"}, "away": {"id": 10, "name": "H"}}, "goals": {"home": None, "away": None}}]}
    found = feeds.fixture_bundles(spark, put(tmp_path / "b.json", bundle))
    m = {r.match_id: r for r in found["matches"].collect()}
    assert (m[1].status, m[1].kickoff_at, m[1].home_score) == ("finished", dt.datetime(2024, 8, 1, 16), 2) and (m[2].status, m[2].kickoff_at, m[2].home_score) == ("unknown", None, None)
    s = found["team_stats"].head()
    assert (s.shots_total, s.possession_pct, s.fouls) == (12, 55.0, None)
    assert [(r.player_id, r.minutes, r.started, r.captain) for r in found["appearances"].collect()] == [(7, 90, True, True)]
    assert [(r.goals, r.assists, r.shots_on_target) for r in found["player_stats"].collect()] == [(2, None, 3)]
    assert found["teams"].count() == 2 and found["competitions"].count() == 1 and found["lineups"].head().formation == "4-3-3" and found["players"].count() == 2


def test_results_csv(spark, tmp_path):
    path = put(tmp_path / "r.csv", "Date,HomeTeam,AwayTeam,FTHG,FTAG,HS,AS,HY\n17/08/2024,Ars,Wol,2,0,9,,1\n18/08/24,Che,MCI,,,3,4,\n,X,Y,1,1,,,\nbad,X,Y,1,1,,,\n")
    rows = {(r.home_team, r.metric, r.side): r.value for r in feeds.results_csv(spark, path, "E0", "2425").collect()}
    assert rows == {("Ars", "home_score", None): "2", ("Ars", "away_score", None): "0", ("Ars", "status", None): "finished", ("Ars", "shots_total", "home"): "9", ("Ars", "yellow_cards", "home"): "1", ("Che", "shots_total", "home"): "3", ("Che", "shots_total", "away"): "4"}


def test_league_files(spark, tmp_path):
    season = {"name": "L", "matches": [{"round": "1", "date": "2024-08-01", "team1": "A", "team2": "B", "score": {"ft": [2, 1]}}, {"date": "2024-08-02", "team1": "A", "team2": "C", "score": [0, 0]}, {"date": "2024-08-03", "team1": "B", "team2": "C"}, {"date": "2024-08-03", "team1": None, "team2": "C"}]}
    assert [(r.home_score, r.away_score) for r in feeds.season_json(spark, put(tmp_path / "s.json", season)).orderBy("date").collect()] == [(2, 1), (0, 0), (None, None)]
    league = [{"matchID": 5, "matchDateTimeUTC": "2024-08-01T18:30:00Z", "matchIsFinished": True, "team1": {"teamName": "A"}, "team2": {"teamName": "B"}, "matchResults": [{"resultTypeKind": "HALF", "pointsTeam1": 1, "pointsTeam2": 0}, {"resultTypeKind": "Final", "pointsTeam1": 3, "pointsTeam2": 2}]}]
    r = feeds.league_json(spark, put(tmp_path / "l.json", league)).head()
    assert (r.home_score, r.away_score, r.kickoff_at) == (3, 2, dt.datetime(2024, 8, 1, 18, 30))
    events = {"events": [{"idEvent": str(i), "dateEvent": "2024-08-01", "strHomeTeam": "A", "strAwayTeam": "B", "intHomeScore": "2", "intAwayScore": None, "strStatus": s} for i, s in enumerate(("FT", "NS", "??", None))]}
    assert [r.finished for r in feeds.event_json(spark, put(tmp_path / "e.json", events)).orderBy("match_id").collect()] == [True, False, None, None]
    stats = {"eventstats": [{"idEvent": "1", "strStat": "Total Shots", "intHome": "9", "intAway": None}, {"idEvent": "1", "strStat": "Hair", "intHome": "1", "intAway": "1"}]}
    assert [tuple(r) for r in feeds.event_stats_json(spark, put(tmp_path / "st.json", stats)).collect()] == [("1", "home", "shots_total", 9)]
    lineup = {"lineup": [{"idEvent": "1", "idTeam": "2", "idPlayer": str(i), "strPlayer": "N", "strSubstitute": v, "intSquadNumber": "7"} for i, v in enumerate(("No", "Yes", None))] + [{"idPlayer": " "}]}
    assert [(r.started, r.shirt_number) for r in feeds.lineup_json(spark, put(tmp_path / "li.json", lineup)).orderBy("player_id").collect()] == [(True, 7), (False, 7), (None, 7)]
    games = {"matches": [{"id": 1, "utcDate": "2024-08-01T18:00:00Z", "status": "FINISHED", "homeTeam": {"name": "A"}, "awayTeam": {"name": "B"}, "score": {"fullTime": {"home": 1, "away": 0}}}, {"id": 2, "score": {"fullTime": {"home": 1}}}, {}]}
    assert [(r.match_id, r.home_score, r.away_score) for r in feeds.match_json(spark, put(tmp_path / "ma.json", games)).orderBy("match_id").collect()] == [(1, 1, 0), (2, None, None)]
    c = feeds.competition_json(spark, put(tmp_path / "c.json", {"competitions": [{"code": "PL", "name": "P", "currentSeason": {"startDate": "2024-08-01", "endDate": "2025-05-25"}}, {"code": None}]})).collect()
    assert [(r.code, r.season) for r in c] == [("PL", "2024-2025")]


def test_news(spark):
    rss = '<rss><channel><item><title>A &amp; &lt;b&gt;B&lt;/b&gt;</title><link>https://x/1</link><guid>g</guid><description>&lt;p&gt;Hi  there&lt;/p&gt;</description><pubDate>Thu, 01 Aug 2024 18:00:00 GMT</pubDate></item><item><title>no link</title></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>C</title><link rel="self" href="https://x/s"/><link rel="alternate" href="https://x/2"/><id>i</id><summary>s</summary><updated>2024-08-01T18:00:00Z</updated></entry></feed>'
    bomb = '<!DOCTYPE x [<!ENTITY a "b">]><rss><item><title>&a;</title><link>l</link></item></rss>'
    df = spark.createDataFrame([("r", rss), ("a", atom), ("x", "<rss"), ("e", bomb), ("n", None)], "source string, payload string")
    found = {r.source: r for r in feeds.news(df).collect()}
    assert set(found) == {"r", "a"} and found["r"].title == "A & B" and found["r"].excerpt == "Hi there" and found["a"].url == "https://x/2"
    assert found["r"].published_at == found["a"].published_at == dt.datetime(2024, 8, 1, 18)


def test_contract(spark):
    rows = [("a", "media", "0.5"), ("", "media", "0.5"), ("b", "other", None), ("c", None, "1.5"), ("d", "fan", "x")]
    good, bad = feeds.contract(spark.createDataFrame(rows, "id string, kind string, w string"), ["id"], {"kind": ["media", "fan"]}, ["w"])
    assert [r.id for r in good.collect()] == ["a"] and {r.id: len(r.faults) for r in bad.collect()} == {"": 1, "b": 1, "c": 1, "d": 1}


def test_manifest(spark):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("c", bytearray(b"3"))], "path string, content binary")
    listed = feeds.manifest(files.where("path <> 'c'")).withColumn("sha256", F.when(F.col("path") == "b", "0").otherwise(F.col("sha256")))
    assert {r.path: r.ok for r in feeds.verified(files, listed).collect()} == {"a": True, "b": False, "c": None}


def named(name, i=1):
    return {"id": i, "name": name}


def test_feed_a(spark, tmp_path):
    def event(kind, player=1, team=10, **more):
        return {"match_id": 5, "type": named(kind), "team": named("T", team), "player": named("P", player) if player else None} | more

    events = [
        event("Starting XI", None, tactics={"formation": 433}), event("Shot", shot={"outcome": named("Goal"), "body_part": named("Head"), "type": named("Penalty"), "statsbomb_xg": 0.7}), event("Shot", shot={"outcome": named("Off T"), "type": named("Open Play"), "statsbomb_xg": 0.1}, play_pattern=named("From Counter")),
        event("Pass", **{"pass": {"recipient": named("Q", 2), "goal_assist": True}}), event("Pass", under_pressure=True, **{"pass": {"outcome": named("Incomplete"), "recipient": named("Q", 2), "type": named("Corner")}}), event("Carry", location=[0.0, 0.0], carry={"end_location": [3.0, 4.0]}), event("Duel", duel={"type": named("Tackle")}),
        event("Goal Keeper", 3, 11, goalkeeper={"type": named("Shot Saved")}), event("Goal Keeper", 3, 11, goalkeeper={"type": named("Goal Conceded")}), event("Goal Keeper", 3, 11, goalkeeper={"type": named("Keeper Sweeper"), "outcome": named("Claim")}), event("Pressure", 3, 11), event("Offside", None, 11),
    ]
    df = event_feeds.read(spark, put(tmp_path / "e.json", events), event_feeds.EVENTS_A)
    p = {r.player_id: r.asDict() for r in event_feeds.derived_a(event_feeds.players_a(df)).collect()}
    a = p[1]
    assert (a["touches"], a["shots_total"], a["shots_on_target"], a["shots_off_target"], a["goals"], a["penalty_goals"], a["headed_shots"], a["tackles"]) == (6, 2, 1, 1, 1, 1, 1, 1)
    assert (a["advanced.xg"], a["npxg"], a["carry_distance"], a["passes_total"], a["passes_accurate"], a["assists"], a["passes_under_pressure"]) == (pytest.approx(0.8), 0.1, 5.0, 2, 1, 1, 1)
    assert (a["pass_completion_pct"], a["goals_minus_xg"], a["non_penalty_goals"], a["dribble_success_pct"]) == (50.0, 0.2, 0, None) and p[2]["passes_received"] == 1 and p[2]["touches"] == 0
    assert (p[3]["saves"], p[3]["goals_conceded"], p[3]["sweeper_actions"], p[3]["claims"]) == (1, 1, 1, 1)
    t = {r.team_id: r for r in event_feeds.teams_a(df).collect()}
    assert (t[10].shots_total, t[10].corners, t[10].counter_attack_shots, t[10].shots_allowed) == (2, 1, 1, 0) and (t[11].shots_allowed, t[11].offsides, t[11].pressures) == (2, 1, 1) and t[11].xga == pytest.approx(0.8)
    assert [(r.team_id, r.formation) for r in event_feeds.formations_a(df).collect()] == [(10, "4-3-3")]

    def man(i, reason=None, position="Goalkeeper", cards=()):
        return {"player_id": i, "player_name": f"N{i}", "jersey_number": i, "cards": [{"card_type": c} for c in cards], "positions": [{"position": position, "from": "00:00", "start_reason": reason}] if reason else []}

    lineups = [{"match_id": 5, "team_id": 10, "lineup": [man(1, "Starting XI", "Wing", ("Yellow Card", "Second Yellow")), man(4), man(5, "Substitution - On", "Wing")]}, {"match_id": 5, "team_id": 11, "lineup": [man(3, "Starting XI")]}]
    roster = event_feeds.roster_a(event_feeds.read(spark, put(tmp_path / "l.json", lineups), event_feeds.LINEUPS_A))
    filled = event_feeds.zero_filled(roster, event_feeds.players_a(df))
    r = {x.player_id: x for x in filled.collect()}
    assert set(r) == {1, 3, 5} and (r[1].red_cards, r[1].second_yellow_cards, r[1].started) == (1, 1, True) and (r[5].touches, r[5].started) == (0, False)
    k = event_feeds.goalkeepers_a(filled).collect()
    assert [(x.player_id, x.shots_on_target_faced, x.save_pct) for x in k] == [(3, 2, 50.0)]
    s = {x.player_id: x for x in event_feeds.season_totals(filled, ["player_id"], ["goals"]).collect()}
    assert (s[1].goals, s[1].starts, s[5].sub_appearances) == (1, 1, 1)
    sheets = event_feeds.read(spark, str(tmp_path / "l.json"), event_feeds.LINEUPS_A)
    one_match = event_feeds.match_a(df, sheets, 5)
    assert one_match["players"].count() == 3 and one_match["teams"].count() == 2 and one_match["goalkeepers"].count() == 1 and event_feeds.match_a(df, sheets, 6)["players"].count() == 0
    games = spark.createDataFrame([(5, 2, 27)], "match_id long, competition_id int, season_id int")
    assert event_feeds.season_a(games, df, sheets, 2, 27, complete=1)["player_seasons"].count() == 3 and "player_seasons" not in event_feeds.season_a(games, df, sheets, 2, 27, complete=380)
    with pytest.raises(ValueError):
        event_feeds.season_a(games, df, sheets, 2, 28)
    facts = event_feeds.long_facts(one_match["players"].select("match_id", "player_id", "goals", "shots_on_target_pct"), ["match_id", "player_id"], "player_match")
    assert {(r.player_id, r.metric, r.value) for r in facts.collect()} == {(1, "goals", 1.0), (1, "shots_on_target_pct", 50.0), (3, "goals", 0.0), (5, "goals", 0.0)}


def test_feed_b(spark, tmp_path):
    def event(name, sub, player, *tags, team=10):
        return {"matchId": 5, "playerId": player, "teamId": team, "eventName": name, "subEventName": sub, "tags": [{"id": event_feeds.TAGS[t]} for t in tags]}

    events = [event("Pass", "Cross", 1, "accurate", "assist"), event("Pass", "Launch", 1), event("Shot", "Shot", 1, "accurate", "goal", "head", "counter_attack"), event("Free Kick", "Penalty", 1, "not_accurate"), event("Free Kick", "Corner", 1), event("Duel", "Air duel", 1, "won"), event("Duel", "Ground loose ball duel", 1), event("Foul", "Foul", 1, "second_yellow"),
              event("Others on the ball", "Clearance", 1, "interception"), event("Pass", "x", 0, "accurate"), event("Save attempt", "Reflexes", 3, "accurate", team=11)]
    df = event_feeds.read(spark, put(tmp_path / "e.json", events), event_feeds.EVENTS_B)
    p = {r.player_id: r for r in event_feeds.players_b(df).collect()}
    a = p[1]
    assert set(p) == {1, 3} and (a.touches, a.passes_total, a.passes_accurate, a.assists, a.crosses, a.launches, a.shots_total, a.shots_on_target, a.goals, a.penalties_attempted, a.penalty_goals) == (9, 2, 1, 1, 1, 1, 2, 1, 1, 1, 0)
    assert (a.duels_total, a.duels_won, a.aerial_duels_won, a.ground_duels, a.ground_duels_won, a.red_cards, a.second_yellow_cards, a.interceptions, a.clearances, p[3].saves) == (2, 1, 1, 1, 0, 1, 1, 1, 1, 1)
    matches = [{"wyId": 5, "competitionId": 364, "seasonId": 1, "teamsData": {"10": {"side": "home", "score": 1, "formation": {"lineup": [{"playerId": 1}, {"playerId": 0}], "bench": [{"playerId": 2}, {"playerId": 4}], "substitutions": [{"playerIn": 2, "playerOut": 1, "minute": 60}, {"playerIn": 99}]}}, "11": {"side": "away", "score": 0, "formation": {"lineup": [{"playerId": 3}], "bench": [], "substitutions": "null"}}}}]
    m = event_feeds.read(spark, put(tmp_path / "m.json", matches), event_feeds.MATCHES_B)
    roster = event_feeds.roster_b(m)
    assert {(r.player_id, r.started, r.participated) for r in roster.collect()} == {(1, True, True), (2, False, True), (4, False, False), (3, True, True)}
    filled = event_feeds.zero_filled(roster, event_feeds.players_b(df))
    k = event_feeds.goalkeepers_b(filled, spark.createDataFrame([(3,)], "player_id long"), event_feeds.teams_b(df)).collect()
    assert [(r.player_id, r.shots_on_target_faced, r.save_pct) for r in k] == [(3, 1, 100.0)]
    season = event_feeds.season_b(m, df, spark.createDataFrame([(3,)], "player_id long"), 364, 1)
    assert season["players"].count() == 3 and season["goalkeepers"].count() == 1 and season["player_seasons"].count() == 3
    with pytest.raises(ValueError):
        event_feeds.season_b(m, df, spark.createDataFrame([(3,)], "player_id long"), 364, 2)
    assert event_feeds.outside_scope(m, "competitionId", "seasonId", 364, 1).count() == 0 and event_feeds.outside_scope(m, "competitionId", "seasonId", 2, 1).count() == 1


def test_text(spark):
    r = one(spark, X.player_name(F.lit(" José  O’Brien-Núñez, Jr. ")), X.player_name(F.lit(None).cast("string")), X.team_name(F.lit("1. FC Bayern München")), X.team_name(F.lit("Bayern Munich")), X.team_name(F.lit("Nott'm Forest")), X.folded(F.lit("Straße  ÉLAN")))
    assert tuple(r) == ("jose o brien nunez jr", "", "bayern munchen", "bayern munchen", "forest nottingham", "strasse elan")
    odd = ["Ångström ﬁn", "Ⅷ  İ", None]
    assert [x.v for x in spark.createDataFrame([(t,) for t in odd], "t string").select(X.folded_fully(F.col("t")).alias("v")).collect()] == ["angstrom fin", "viii i", None]
    urls = {"HTTPS://Ex.com:443/a?utm_source=1&b=2&a&fbclid=3#f": "https://ex.com/a?a=&b=2", "http://ex.com:8080": "http://ex.com:8080/", "ftp://x/y": None, "https://u:p@x/": None, "nothing": None, None: None}
    found = {r.u: r.v for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", X.canonical_url(F.col("u")).alias("v")).collect()}
    assert found == urls
    times = {"2024-08-01T18:00:00Z": 18, "2024-08-01T18:00:00+02:00": 16, "2024-08-01 18:00:00": 18, "Thu, 01 Aug 2024 18:00:00 +0200": 16, "Thu, 1 Aug 2024 18:00:00 GMT": 18, "nonsense": None}
    found = {r.t: r.v and r.v.hour for r in spark.createDataFrame([(t,) for t in times], "t string").select("t", X.utc_timestamp(F.col("t")).alias("v")).collect()}
    assert found == times
    labels = {"2025": "2025-2026", "2526": "2025-2026", "2025/26": "2025-2026", "2025-2026": "2025-2026", "x": None, "9900": "9900-9901"}
    found = {r.t: r.v for r in spark.createDataFrame([(t,) for t in labels], "t string").select("t", X.season_label(F.col("t")).alias("v")).collect()}
    assert {k: v for k, v in found.items() if k != "9900"} == {k: v for k, v in labels.items() if k != "9900"}
    r = one(spark, X.lenient_number(F.lit("55%")), X.lenient_int(F.lit(" 7.9 ")), X.lenient_number(F.lit("a")), X.position_family(F.lit(" rwb ")), X.position_role(F.lit("goalkeeper")), X.position_family(F.lit("?")), X.unescaped_twice(F.lit("Jos\\u00e9")), X.unescaped_twice(F.lit("plain")), X.pair_key(F.array(F.lit("b"), F.lit("a"))) == X.pair_key(F.array(F.lit("a"), F.lit("b"))))
    assert tuple(r) == (55.0, 7, None, "fullback_wingback", "goalkeeper", None, "José", "plain", True)


def test_html_text(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages").limit(20)
    r = pages.select(X.plain_html(F.col("html")).alias("a"), X.html_text(F.col("html")).alias("b")).collect()
    bare = [("".join(html.unescape(x.a).split()), "".join(x.b.split())) for x in r]
    assert all(a == b for a, b in bare)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "snap")
    a = spark.createDataFrame([("s1", "v1", 1), ("s2", "v1", 2)], "scope_key string, model_version string, x int")
    sinks.replace_scopes(a, path)
    for _ in range(2):
        sinks.replace_scopes(spark.createDataFrame([("s1", "v1", 9)], a.schema), path)
    assert {(r.scope_key, r.x) for r in spark.read.parquet(path).collect()} == {("s1", 9), ("s2", 2)}
    rows = spark.createDataFrame([("{}",), ("[1]",), ("{}",)], "payload string")
    for _ in range(2):
        sinks.put_objects(rows, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2
    known, fresh = sinks.mapped_upsert(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 5)], "k string, id long"), ["k"], "id")
    assert [r.id for r in known.collect()] == [5] and [r.k for r in fresh.collect()] == ["b"]
    stored = spark.createDataFrame([("u1", "e1", 1), ("u2", "e2", 2)], "url string, ext string, id int")
    assert sinks.identity_conflicts(spark.createDataFrame([("u1", "e2"), ("u1", "e1")], "url string, ext string"), stored, ["url", "ext"], "id").count() == 1
    kept = sinks.replaced_children(spark.createDataFrame([(1, "x"), (2, "y")], "p int, c string"), spark.createDataFrame([(1, "z")], "p int, c string"), "p")
    assert {tuple(r) for r in kept.collect()} == {(1, "z"), (2, "y")}
    f = one(spark, *(sinks.request_fingerprint(F.lit("/a"), m) for m in (F.create_map(F.lit("x"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("2"), F.lit("x"), F.lit("1")))))
    assert f[0] == f[1]
    for status, n in (("success", 3), ("failed", 0)):
        sinks.log_run(spark, str(tmp_path / "log"), "job", status, {"rows": n}, "2024-01-01", f"2024-01-0{n + 1}")
    r = sinks.run_summary(spark.read.parquet(str(tmp_path / "log"))).head()
    assert (r.runs, r.failures, r.rows, r.last_success) == (2, 1, 3, "2024-01-04")
    sinks.write_report(a, str(tmp_path / "report"))
    assert {r["rows"] for r in sinks.preflight({"a": a, "b": a.limit(1)}).collect()} == {2, 1}
    assert sinks.guarded_target("/data/x", ["/data"]) == "/data/x"
    for bad in ("/database/x", "/data/../etc", "s3://b/x"):
        with pytest.raises(ValueError):
            sinks.guarded_target(bad, ["/data", "s3://b"])
    assert sinks.guarded_target("s3://b/x", ["s3://b"], confirmed=True)


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(i, i % 5, dt.datetime(2024, 1, 1 + i // 50, i % 24)) for i in range(200)]
    schema = "id long, user long, ts timestamp"
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50] + rows[50 * k : 50 * k + 3], schema).coalesce(1).write.mode("append").parquet(source)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    read = streams.files(spark, source, schema, 1)
    got = run(streams.deduplicated(read, "ts", "10 days", ["id"]), "unique")
    assert sorted(r.id for r in got) == list(range(200))
    days = run(streams.windowed(read, "ts", "1 day", "1 day", None, [], F.count("*").alias("n")), "days")
    assert {r.window.start.day: r.n for r in days} == {1: 53, 2: 53}
    quiet = run(streams.sessions(read, "ts", "1 hour", "30 minutes", ["user"], F.count("*").alias("n")), "quiet")
    assert quiet and all(r.n >= 1 for r in quiet)
    q = streams.keep_latest(read, str(tmp_path / "table"), str(tmp_path / "ck"), ["user"], [F.desc("ts"), F.desc("id")]).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for i, u, t in rows:
        last[u] = max(last.get(u, (t, i)), (t, i))
    assert {r.user: (r.ts, r.id) for r in streams.latest_version(spark, str(tmp_path / "table")).collect()} == last


def test_versions_rewrite_what_they_touch(spark, tmp_path):
    """Each batch writes the buckets of its own keys; a batch that runs again changes nothing, and old versions go."""
    import os

    schema = "user int, at int, v string"
    table, place = str(tmp_path / "table"), str(tmp_path / "in")
    batches = [[(u, 1, "a") for u in range(40)], [(3, 2, "b")], [(3, 1, "late"), (99, 1, "new")], [(3, 3, "c"), (3, 3, "c")], [(3, 4, "d")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)
        read = streams.files(spark, place, schema)
        streams.keep_latest(read, table, str(tmp_path / "ck"), ["user"], [F.desc("at")], buckets=8, kept=2).trigger(availableNow=True).start().awaitTermination()
    found = {r.user: r.v for r in streams.latest_version(spark, table).collect()}
    assert found == {u: "a" for u in range(40)} | {3: "d", 99: "new"}
    counts = [len(os.listdir(f"{table}/{b}")) for b in os.listdir(table) if b.startswith("bucket=")]
    assert max(counts) <= 2 and min(counts) == 1 and not [b for b in os.listdir(table) if b.startswith("_batch")]


def test_elo_stream(spark, tmp_path):
    from .test_operators import plain_elo

    matches = [("x", i, i, f"T{i % 4}", f"T{(i + 1 + i % 3) % 4 if (i + 1 + i % 3) % 4 != i % 4 else (i + 1) % 4}", i % 3, (i * 7) % 4) for i in range(40)]
    schema = "season string, match_id long, kickoff int, home_team string, away_team string, home_score int, away_score int"
    matches[5:5] = [("x", 500, 5, "T0", "T1", None, 2), ("x", 501, 5, "T2", "T2", 1, 0), ("x", 502, 5, "T0", "T3", None, None)]
    for k in range(5):
        spark.createDataFrame(matches[10 * k : 10 * k + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = streams.elo_stream(streams.files(spark, str(tmp_path / "in"), schema, 1))
    q = df.writeStream.format("memory").queryName("ratings").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    found = {(r.match_id, r.is_home): r.post for r in spark.table("ratings").collect()}
    assert found == {(m, home): pytest.approx(post, abs=6e-5) for _, m, home, _, _, post, _ in plain_elo(matches)}


def test_configuration(spark, tmp_path):
    from tallyforge.sources import config

    def file(value):
        path = tmp_path / "c.json"
        path.write_text(json.dumps(value))
        return str(path)

    one = {"code": "A_B", "name": "Liga", "country": "X"}
    assert [tuple(r) for r in config.competitions(spark, file([one])).collect()] == [("A_B", "Liga", "X")]
    for bad in ({"a": 1}, [one, one], [{**one, "more": 1}], [{**one, "name": " "}], [{"code": "A"}]):
        with pytest.raises(ValueError):
            config.competitions(spark, file(bad))
    source = {"code": "a-b", "display_name": "A", "source_kind": "media", "feed_url": "https://x.example/rss"}
    row = config.news_sources(spark, file([source])).head()
    assert (row.code, row.homepage_url, row.is_active) == ("a-b", None, True)
    for bad in ({"feed_url": "http://x.example"}, {"feed_url": "https://u:p@x.example"}, {"source_kind": "blog"}, {"code": "A B"}, {"homepage_url": "ftp://x"}, {"display_name": ""}):
        with pytest.raises(ValueError):
            config.news_sources(spark, file([{**source, **bad}]))
    with pytest.raises(ValueError):
        config.news_sources(spark, file([source, source]))


def test_checks_and_objects(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "k int, v int")
    assert {r.rule: r.violations for r in sinks.violations(rows, {"range": F.col("v") < 6, "known": F.col("v").isNotNull()}).collect()} == {"range": 1, "known": 1}
    teams = spark.createDataFrame([(1, "a", "b")], "m int, home string, away string")
    lines = spark.createDataFrame([(1, "a"), (1, "c"), (1, None), (2, "a")], "m int, team string")
    assert sorted(map(repr, map(tuple, sinks.not_members(lines, teams, "m", "team", ["home", "away"]).collect()))) == ["(1, 'c')", "(1, None)", "(2, 'a')"]
    path = str(tmp_path / "raw")
    put = lambda *texts: sinks.put_objects(spark.createDataFrame([(t,) for t in texts], "payload string"), path)
    put('{"b": 1, "a": [2, null]}', '{"a":[2,null],"b":1}')
    put('{ "b":1,"a":[2,null] }', '{"c": 1}')
    assert sorted(r.payload for r in spark.read.parquet(path).collect()) == ['{"a":[2,null],"b":1}', '{"c":1}']
    spark.read.parquet(path).limit(1).selectExpr("address", "'{}' as payload").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="another payload"):
        sinks.put_objects(spark.createDataFrame([('{"a":[2,null],"b":1}',), ('{"c":1}',)], "payload string"), str(tmp_path / "bad"))
    log = spark.createDataFrame([(1, "add", None, None, 1), (1, "remove", None, None, 2), (2, "remove", None, None, 1), (2, "add", "emerging", "x", 2), (3, "add", "odd", " ", 1)], "player_id int, action string, category string, reason string, at int")
    listed = sinks.watchlist(log)
    assert {(r.player_id, r.category) for r in listed.collect()} == {(2, "emerging"), (3, "odd")}
    assert {r.rule: r.violations for r in sinks.violations(listed, sinks.watchlist_rules()).collect()} == {"category": 1, "reason": 1}


def test_identities_of_feeds(spark):
    from tallyforge.functions import catalog
    from tallyforge.sources import event_feeds as E

    known = {(m, g) for m, g, *_ in catalog.entries()}
    for emitted, n in ((E.EMITTED_A, 110), (E.EMITTED_B, 77)):
        own = E.identities(emitted)
        assert len(own) == len(set(own)) == n and set(own) <= known
        assert E.registry(spark, emitted).where("safe").count() == n
    assert catalog.duplicates() == [] and catalog.duplicates([("a", "m", 1), ("a", "m", 2), ("a", "t", 1)]) == [("a", "m")]


def test_views_by_name(spark):
    from tallyforge.plans.views import shown

    found = shown(spark, "/root/testdata/sf0.001")
    assert len(found) == 10
    for name, df in found.items():
        assert spark.table(name).columns == df.columns
