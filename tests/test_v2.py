"""Catalogued features and evidence, audits, and what fetches."""

import datetime as dt
import io
import json
import urllib.error
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import catalog
from tallyforge.operators import audits, entity_v2, profiles
from tallyforge.operators import teams as team_operators
from tallyforge.plans import domain, registry
from tallyforge.sources import edge


def test_catalog(spark):
    df = catalog.catalog(spark)
    assert df.count() == 194 and df.select("metric", "granularity").distinct().count() == 194
    assert df.where("metric = 'clean_sheets'").count() == 2
    assert catalog.targets(spark).where("importance = 'critical'").count() > 0


def test_weights_sum_to_one():
    known = {m for m, *_ in catalog.entries()}
    dims = {d: {m: w for m, w, _, _ in own} for d, own in (*profiles.PLAYER_DIMENSIONS.items(), *((f"team {d}", own) for d, own in profiles.TEAM_DIMENSIONS.items() if own))}
    assert audits.weight_faults(dims, known) == []
    assert audits.weight_faults(profiles.FAMILY_WEIGHTS, set(profiles.PLAYER_DIMENSIONS)) == [] and audits.weight_faults({"team": profiles.TEAM_WEIGHTS}, set(profiles.TEAM_DIMENSIONS)) == []
    assert audits.weight_faults(profiles.ROLE_WEIGHTS, known) == [] and audits.weight_faults(profiles.TEAM_V1) == []
    assert len(audits.weight_faults({"a": {}, "b": {"x": 0.5}, "c": {"x": 0.0, "y": 1.0}}, {"x", "y"})) == 3


def players(spark):
    rows = []
    for p in range(1, 5):
        for m in range(10):
            rows.append((p, m, m, 90, "ST", {"goals": float(p), "assists": 1.0, "xg": 0.5 * p, "shots_total": 4.0, "shots_on_target": 2.0 if (p, m) != (4, 0) else None, "pass_completion_pct": 70.0 + p, "made_up": 9.0, "saves": 3.0}))
    rows += [(9, 0, 0, 30, "ST", {"goals": 9.0}), (8, m := 0, 0, 90, "GK", {"saves": 4.0, "shots_on_target_faced": 5.0, "goals": 0.0}), (7, 0, 0, 90, "??", {"goals": 1.0})]
    return spark.createDataFrame(rows, "player_id int, match_id int, kickoff int, minutes int, position string, stats map<string,double>")


def test_player_features(spark):
    found = {(r.player_id, r.window_key, r.metric): r for r in entity_v2.player_features(players(spark)).collect()}
    g = found[2, "last_5", "goals"]
    assert (g.raw_value, g.adjusted, g.basis, g.appearances, g.family) == (10.0, 2.0, "per90", 5, "forward")
    assert found[2, "last_5", "pass_completion_pct"].raw_value == 72.0 and found[2, "last_5", "pass_completion_pct"].basis == "raw_rate"
    assert found[2, "season", "goal_contributions"].raw_value == 30.0 and found[2, "season", "goals_minus_xg"].adjusted == 10.0 and found[2, "season", "goals_minus_xg"].basis == "derived_rate"
    assert (4, "season", "shots_on_target_pct") not in found and (4, "last_3", "shots_on_target_pct") in found and (2, "season", "shots_on_target_pct") in found
    assert not any(m == "made_up" for *_, m in found)
    assert [found[p, "last_5", "goals"].percentile for p in (1, 2, 3, 4)] == [0.0, 33.33, 66.67, 100.0] and found[1, "last_5", "goals"].reference_size == 4
    small = found[9, "last_5", "goals"]
    assert (small.percentile, small.raw_value) == (None, 9.0)
    assert found[8, "season", "save_pct"].raw_value == 80.0 and found[8, "season", "saves"].granularity == "goalkeeper_match"


def test_player_scores(spark):
    parts, whole = entity_v2.player_scores(entity_v2.player_features(players(spark)))
    p = {(r.player_id, r.window_key, r.dimension): r for r in parts.collect()}
    assert p[4, "last_5", "performance"].state == "ready" and p[4, "last_5", "underlying_performance"].state == "insufficient_evidence"
    w = {(r.player_id, r.window_key): r for r in whole.collect()}
    assert w[4, "last_5"].overall is None and w[4, "last_5"].state == "partial" and 0 < w[4, "last_5"].coverage < 1
    full = {m for d in profiles.FAMILY_WEIGHTS["goalkeeper"] for m, *_ in profiles.PLAYER_DIMENSIONS[d]}
    rows = [(1, "goalkeeper", "season", m, 50.0, 10, 900.0, 20) for m in full]
    feats = spark.createDataFrame(rows, "player_id int, family string, window_key string, metric string, percentile double, appearances int, minutes double, reference_size int")
    r = entity_v2.player_scores(feats)[1].head()
    assert (r.overall, r.state, r.confidence) == (pytest.approx(50.0), "ready", 1.0)


def teams(spark):
    rows = [(t, m, m, t, 1, {"shots_total_for": 10.0 * t, "passes_total": 100.0, "passes_accurate": 80.0 if m else 60.0, "pass_accuracy_pct": 50.0, "xg": 0.5, "goals_for": 99.0, "unknown": 1.0}) for t in (1, 2, 3) for m in range(4)]
    return spark.createDataFrame(rows, "team_id int, match_id int, kickoff int, goals_for int, goals_against int, stats map<string,double>")


def test_team_features_and_scores(spark):
    feats = entity_v2.team_features(teams(spark))
    found = {(r.team_id, r.window_key, r.metric): r for r in feats.collect()}
    r = found[2, "season", "pass_accuracy_pct"]
    assert (r.raw_value, r.basis) == (75.0, "derived_rate")  # of sums, not of the matches' percentages
    assert found[2, "season", "goals_for"].raw_value == 8.0 and found[2, "season", "goals_for"].adjusted == 2.0 and found[2, "season", "shots_total"].raw_value == 80.0
    assert [found[t, "season", "shots_total"].percentile for t in (1, 2, 3)] == [0.0, 50.0, 100.0]
    parts, whole = entity_v2.team_scores(feats)
    w = {(r.team_id, r.window_key): r for r in whole.collect()}
    assert all(r.overall is None for r in w.values()) and "results_above_process" in w[3, "season"].findings and "results_above_process" in w[1, "season"].findings
    assert parts.where("dimension = 'defensive_transition' and state <> 'insufficient_evidence'").count() == 0
    issues = team_operators.issue_rows(whole.withColumnRenamed("findings", "signals"), ["team_id", "window_key"])
    assert issues.count() == sum(len(r.findings) for r in w.values())


def test_audits(spark):
    rows = spark.createDataFrame([("underrated", 0.6, 10.0, 5, 4, 3, 0.6), ("overrated", 0.4, 70.0, 1, 1, 1, 0.1), ("polarized", 0.0, 90.0, 0, 0, 0, 0.0)], "rating_signal string, rating_confidence double, polarization double, evidence int, scored int, sources int, perception_confidence double")
    found = {r.rule: r.violations for r in audits.rating_violations(rows).collect()}
    assert set(found.values()) == {1} and len(found) == 6
    assert {r.signal: r.rows for r in audits.prevalence(rows, "rating_signal").collect()} == {"underrated": 1, "overrated": 1, "polarized": 1}
    tactical = spark.createDataFrame([(3, 5, "high_press", "average"), (5, 3, "balanced", "low_block")], "matches int, formation_matches int, style_signal string, defensive_signal string")
    assert {r.violations for r in audits.tactical_violations(tactical).collect()} == {1}
    cover = {r.column: (r.pct, r.state) for r in audits.column_coverage(spark.createDataFrame([(1, None, None), (2, 3, None)], "a int, b int, c int"), ["a", "b", "c"]).collect()}
    assert cover == {"a": (100.0, "available"), "b": (50.0, "partial"), "c": (0.0, "unavailable")}
    assert json.loads(audits.report({"r": audits.rating_violations(rows)}, []))["hard_status"] == "fail" and json.loads(audits.report({}, []))["hard_status"] == "pass"


class Answer(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def test_requests():
    import email.message

    calls, waits = [], []

    def answers(*codes):
        def open_url(request, timeout):
            calls.append(request)
            code, headers = codes[min(len(calls) - 1, len(codes) - 1)], email.message.Message()
            if code == 200:
                return Answer(b'{"a": 1}')
            headers["Retry-After"] = "99"
            headers["Location"] = "https://there/"
            raise urllib.error.HTTPError("u", code, "", headers, None)
        calls.clear()
        return open_url

    assert edge.get_json("https://x", parameters={"b": "1", "a": "2"}, open_url=answers(429, 200), sleep=waits.append) == {"a": 1} and waits == [10] and calls[0].full_url == "https://x?a=2&b=1"
    for codes, n in (((404,), 1), ((500, 500, 500), 3)):
        with pytest.raises(urllib.error.HTTPError):
            edge.get_json("https://x", open_url=answers(*codes), sleep=waits.append)
        assert len(calls) == n
    public = lambda *_: [(0, 0, 0, "", ("93.184.216.34", 443))]
    assert edge.fetch_feed("https://x", answers(302, 200), public) == b'{"a": 1}' and calls[-1] == "https://there/"
    for url, resolve in (("http://x", public), ("https://u:p@x", public), ("https://x", lambda *_: [(0, 0, 0, "", ("10.0.0.1", 443))])):
        with pytest.raises(ValueError):
            edge.fetch_feed(url, answers(200), resolve)
    with pytest.raises(ValueError):
        edge.fetch_feed("https://x", answers(302), public)


def test_edges(tmp_path):
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as out:
        out.writestr("d/a.txt", "x")
    assert [p.read_text() for p in edge.unpack(z, tmp_path / "to")] == ["x"]
    with zipfile.ZipFile(z, "w") as out:
        out.writestr("../b.txt", "x")
    with pytest.raises(ValueError):
        edge.unpack(z, tmp_path / "to")
    assert edge.planned_requests(6, 8) == 54
    with pytest.raises(ValueError):
        edge.planned_requests(7, 8)
    day = dt.date(2024, 1, 10)
    assert edge.sync_window(None, None, 3, day) == (dt.date(2024, 1, 8), day) and edge.sync_window(day, day, 3, day) == (day, day)
    for bad in ((day, None, 3), (day, dt.date(2024, 1, 1), 3), (None, None, 15)):
        with pytest.raises(ValueError):
            edge.sync_window(*bad, day)
    assert edge.unique_league([("1", "England ", "Premier"), ("2", "Wales", "Premier")], "england", "PREMIER") == "1"
    with pytest.raises(ValueError):
        edge.unique_league([], "a", "b")


def test_jdbc_options(spark):
    from tallyforge.sources.tables import jdbc

    with pytest.raises(Exception, match="(?i)driver"):
        jdbc(spark, "jdbc:none://x", "(select 1) q", "id", 0, 10, 2).count()


def test_ratings_read_each_text_once(spark):
    from tallyforge.plans import registry

    found = registry.queries()["rating_snapshots"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("masterclass(?!") == 1


def test_hints_are_a_map_or_a_struct(spark):
    from pyspark.sql import functions as F

    from tallyforge.operators import identity

    rows = spark.range(1).selectExpr("map('team_id', '1', 'team_name', ' ') AS m", "named_struct('team_id', '1', 'team_name', ' ') AS s")
    for kind in ("m", "s"):
        found = rows.select(F.col(kind).alias("hints")).select(identity.hint("team_id").alias("i"), identity.hint("team_name").alias("n")).head()
        assert (found.i, found.n) == ("1", None)


def test_what_is_ranked_is_summed_once(spark):
    """Ranks are joined back by value: sums taken twice could differ by the order in which their parts arrive."""
    from tallyforge.operators import entity_scores
    from tallyforge.plans import domain

    rows = [(e, "r", "season", 90.0 * e, 1, "m", 0.1 * e) for e in range(1, 5)]
    found = entity_scores.adjusted(spark.createDataFrame(rows, "entity int, role string, window_key string, exposure double, appearances int, metric string, value double"), "role")
    assert [r.percentile for r in found.orderBy("entity").collect()] == [12.5, 37.5, 62.5, 87.5]
    for df, summed in ((found, "sum((value"), (domain.yearly(spark, "/root/testdata/sf0.001"), "sum(o_totalprice")):
        assert summed not in df._jdf.queryExecution().optimizedPlan().toString()


def test_player_scores_are_made_in_small_plans(spark, monkeypatch):
    """The driver holds each plan, its code and its text for every stage that ends."""
    sizes, own = [], entity_v2.written

    def size(df):
        return len(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(entity_v2, "written", lambda df, name: (sizes.append(size(df)), own(df, name))[1])
    sizes.append(size(entity_v2.player_scores(entity_v2.player_features(players(spark)))[1]))
    assert max(sizes) < 20_000, sizes


def test_hints_are_made_once_a_match(spark):
    from tallyforge.plans import identity as plans

    lines = plans.observations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    exploding = [i for i, x in enumerate(lines) if "Generate inline" in x]
    assert exploding and not any("smith" in x for x in lines[: exploding[0]]) and any("smith" in x for x in lines[exploding[0]:])


def test_levels_read_the_scores_once(spark):
    """Present scores aren't joined to the past ones: what ranks them would run again for each reader."""
    from tallyforge.operators import meta
    from tallyforge.plans import registry

    plan = registry.queries()["rating_snapshots"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("Join ") == 2
    rows = [(1, "a", 0, 80.0, 0.5), (1, "b", 1, 10.0, 0.0), (2, "a", 1, 10.0, 0.9), (3, None, 0, 10.0, 0.9), (4, "a", 0, None, 0.5), (4, "a", 4, 10.0, 0.9)]
    found = {r.e: r for r in meta.meta_levels(spark.createDataFrame(rows, "e int, role string, period int, overall double, confidence double"), "e").collect()}
    assert {e: (r.role, r.current, r.stable, r.seasons) for e, r in found.items()} == {1: ("a", 80.0, 80.0, 0), 4: ("a", None, None, 0)}


def test_phrases_are_looked_for_plainly_first(spark):
    from pyspark.sql import functions as F

    from tallyforge.operators import ratings

    texts = spark.createDataFrame([("a heroic flop",), ("hero? a superb, key player",), (None,), ("U.S.A wins",)], "t string")
    own = texts.select("t", ratings.stance(F.col("t")).alias("s"))
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") == plan.count("RLIKE(") > 20
    assert [r.s.terms if r.s else None for r in own.collect()] == [["flop"], ["superb", "hero", "key player"], [], []]
    assert [r.n for r in texts.select(ratings.stance(F.col("t"), {r"u\.s\.a": 1.0})["hits"].alias("n")).collect()] == [0, 0, 0, 1]


@pytest.mark.parametrize("name", ["entity_snapshots", "entity_watchlist"])
def test_customers_without_lines_have_no_snapshot(spark, tmp_path, name):
    con = duckdb.connect()
    own = {"customer": "SELECT 900001 AS c_custkey, 'BUILDING' AS c_mktsegment", "orders": "SELECT 900001 AS o_orderkey, 900001 AS o_custkey, 1e9 AS o_totalprice, TIMESTAMP '2001-06-26' AS o_orderdate", "lineitem": "SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet' WHERE false"}
    for t, more in own.items():
        con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{t}.parquet' UNION ALL BY NAME {more}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    found = registry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert 900001 not in {r[0] for r in want}
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_snapshots_round_halves_alike(spark, monkeypatch):
    """Three orders of one sum, whose true value is 63.078125; below and above it nothing changes."""
    rows = [(1, 63.07812499999999), (2, 63.078125), (3, 63.07812500000001), (4, 63.07812499), (5, 63.07812501), (6, -63.07812499999999), (7, None)]
    made = spark.createDataFrame(rows, "entity long, form double").selectExpr("entity", "form", *(f"form AS {c}" for c in ("stable", "trend", "watchlist_score")), *(f"'none' AS {c}_signal" for c in ("surprise", "trend", "watchlist")))
    monkeypatch.setattr(domain, "snapshots", lambda spark, sf: made)
    want = {1: 63.07813, 2: 63.07813, 3: 63.07813, 4: 63.07812, 5: 63.07813, 6: -63.07813, 7: None}
    for c in ("stable", "form", "trend", "watchlist_score"):
        assert {r.entity: r[c] for r in domain.entity_snapshots(spark, "").collect()} == want
    assert {r.entity: r.watchlist for r in domain.entity_watchlist(spark, "").collect()} == want
