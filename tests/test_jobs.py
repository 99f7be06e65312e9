"""Every job over small tables, by its command; and a JDBC scan where a driver is there."""

import datetime as dt
import random

import pytest

from tallyforge import __main__ as command
from tallyforge import jobs
from tallyforge.operators.profiles import ROLE_WEIGHTS


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place, rng = tmp_path_factory.mktemp("tables"), random.Random(1)
    day = dt.datetime(2024, 8, 1)

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{place}/{name}.parquet")

    metrics = sorted({m for own in ROLE_WEIGHTS.values() for m in own})
    put("appearances", [(p, m, day + dt.timedelta(m), 90, ("forward", "defender", None)[(p + m // 8) % 3], *(float(rng.randint(0, 5)) for _ in metrics)) for p in range(12) for m in range(12)], "player_id int, match_id int, kickoff timestamp, minutes int, role string, " + ", ".join(f"{m} double" for m in metrics))
    put("team_matches", [("C", "S", f"t{t}", m, day + dt.timedelta(m), rng.randint(0, 3), rng.randint(0, 3), float(rng.randint(1, 9))) for t in range(4) for m in range(6)], "competition string, season string, team string, match_id int, kickoff timestamp, goals_for int, goals_against int, shots_total_for double")
    put("matches", [("C", "S", m, day + dt.timedelta(m), f"t{m % 4}", f"t{(m + 1) % 4}", rng.randint(0, 3), rng.randint(0, 3)) for m in range(60)], "competition string, season string, match_id int, kickoff timestamp, home_team string, away_team string, home_score int, away_score int")
    put("scores", [(p, "forward", period, w, float(rng.randint(20, 90)), 0.8) for p in range(30) for period, w in ((0, "season"), (0, "last_3"), (0, "last_5"), (0, "last_10"), (1, "season"))], "player_id int, role string, period int, window_key string, overall double, confidence double")
    put("performance", [(p, 60.0, 0.8) for p in range(3)], "player_id int, stable double, stable_confidence double")
    put("evidence", [(p, s, 1.0, 0.8, 3) for p in range(2) for s in ("a", "b", "c", "d")], "player_id int, source string, score double, confidence double, age_days int")
    put("teams", [("t0", 10, 70.0, 70.0, 80.0, 0.9, 30.0), ("t1", 10, 30.0, 30.0, 20.0, 0.2, None)], "team string, matches int, control double, chance_generation double, defense double, source_confidence double, results_process_delta double")
    put("formations", [("t0", m, day + dt.timedelta(m), "4-3-3") for m in range(5)], "team string, match_id int, kickoff timestamp, formation string")
    put("candidates", [(p, "Forward", 900, 10, p, 2 * p, ["topscorers"]) for p in range(5)], "player_id int, position string, minutes int, appearances int, goals int, assists int, source_lists array<string>")
    put("players", [(1, 2.0, 8.0, 900, 30, 0.9)], "player_id int, goals double, xg double, minutes int, shots int, confidence double")
    put("entries", [("E", "match", "status", "current", "current_available")], "competition string, granularity string, metric string, role string, state string")
    put("wanted", [("E", "match", "status"), ("E", "match", "goals")], "competition string, granularity string, metric string")
    put("ratings", [("underrated", 0.4, 70.0, 1, 1, 1, 0.1)], "rating_signal string, rating_confidence double, polarization double, evidence int, scored int, sources int, perception_confidence double")
    put("tactics", [(9, 7, "counter_attack", "balanced")], "formation_matches int, matches int, style_signal string, defensive_signal string")
    put("rows", [(1, None), (2, "x")], "a int, b string")
    put("log", [("j", "success", "1", "2", {"rows": 3})], "job string, status string, started_at string, finished_at string, counts map<string,bigint>")
    people = [(s, "player", f"{s}1", m, "player_match", f"{s}-{m}", {"season": "2024", "match_id": f"{s}{m}", "home_team_id": f"{s}h", "home_team_name": "Red", "away_team_id": f"{s}w", "away_team_name": "Blue", "kickoff_date": f"2024-08-0{m + 1}", "team_id": f"{s}h", "player_id": f"{s}1", "player_name": "Ann Lee"}, "1", m) for s in ("statsbomb-open", "wyscout-open") for m in (0, 4)]
    rows = [("C", s, k, e, "goals" if k == "player" else "home_score", g if k == "player" else "match", i, h, v, a) for s, k, e, a, g, i, h, v, _ in people for k in ("player", "match")]
    put("observations", [(c, s, k, i, m, g, "objective_web", {"statsbomb-open": "statsbomb-open-v0.4", "wyscout-open": "wyscout-open-v0.2"}[s], h, v, a) for c, s, k, _, m, g, i, h, v, a in rows], "competition string, source string, entity_type string, entity_id string, metric string, granularity string, source_type string, version string, hints map<string,string>, value string, observed_at int")
    return str(place)


_OTHER = {"player-features-v2", "player-scores-v2", "team-scores-v2"}  # their observations are tested with their operators


def test_every_job_runs(spark, folder, tmp_path):
    counts = {}
    for name in (n for n in jobs.JOBS if n not in _OTHER):
        if name == "reconcile":
            spark.read.parquet(f"{tmp_path}/crosswalk").write.parquet(f"{folder}/crosswalk.parquet")
        command.main([name, folder, f"{tmp_path}/{name}"])
        counts[name] = spark.read.parquet(f"{tmp_path}/{name}").count()
    assert all(counts.values()), counts
    assert counts["elo"] == 120 and counts["meta"] == 30 and counts["crosswalk"] == 2
    decisions = {(r.metric, r.status) for r in spark.read.parquet(f"{tmp_path}/reconcile").collect()}
    assert decisions == {("goals", "agreed"), ("home_score", "agreed")}
    capped = spark.read.parquet(f"{tmp_path}/player-scores")
    assert capped.where("confidence > 1 or overall < 0 or overall > 100").count() == 0 and {r.role for r in capped.collect()} <= {"forward", "defender"}


def test_list_and_unknown(capsys, tmp_path):
    command.main(["list"])
    assert "entity_scores_v1" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        command.main(["run", "none", "a", "b"])


def test_jdbc_scan(spark):
    from tallyforge.sources.tables import jdbc

    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:
        pytest.skip("no database driver beside Spark")
    url = "jdbc:derby:memory:tallyforge;create=true"
    spark.range(50).selectExpr("id", "id * 2 AS twice").write.jdbc(url, "pairs")
    found = jdbc(spark, url, "pairs", "id", 0, 50, 4)
    assert found.rdd.getNumPartitions() == 4 and sorted(tuple(r) for r in found.collect()) == [(i, 2 * i) for i in range(50)]
    assert jdbc(spark, url, '(SELECT "twice" FROM pairs WHERE "id" > 47) q').count() == 2
