"""Expected values of the operators on small inputs, and plain versions of what SQL can't say."""

import math

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import derived, elo, entity_scores, findings, identity, mesh, meta, percentile, radar, ratings, scoring, tactics, teams, validation, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_percentiles_share_ties(spark):
    df = frame(spark, [("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", 3.0), ("alone", 5.0), ("g", None), (None, 1.0), (None, 1.0)], "k string, v double")

    def of(method, **more):
        return sorted(((r.k, r.v, r.percentile, r.reference_size) for r in percentile.percentile(df, ["k"], "v", method, **more).collect()), key=repr)

    assert [x[2] for x in of("mid_rank") if x[0] == "g"] == [12.5, 50.0, 50.0, 87.5, None]
    assert [x[2] for x in of("tie_average") if x[0] == "g"] == [0.0, 50.0, 50.0, 100.0, None]
    assert [x[2] for x in of("tie_average") if x[0] == "alone"] == [50.0] and [x[2] for x in of("mid_rank_or_50") if x[0] == "alone"] == [50.0]
    assert [x[2:] for x in of("mid_rank") if x[0] is None] == [(50.0, 2)] * 2
    gated = of("tie_average", eligible=F.col("v") >= 2)
    assert [x[2:] for x in gated if x[0] == "g"] == [(None, 0), (25.0, 3), (25.0, 3), (100.0, 3), (None, 0)]
    with pytest.raises(ValueError):
        percentile.percentile(df, ["k"], "v", "other")
    many = frame(spark, [(i % 3, float(i * i % 101)) for i in range(500)] + [(None, 1.0), (0, None)], "k int, v double")
    plain, cut = (sorted(map(tuple, percentile.percentile(many, ["k"], "v", "tie_average", buckets=b).collect()), key=repr) for b in (1, 7))
    assert plain == cut


def test_recent_windows(spark):
    df = frame(spark, [(1, d) for d in range(12)] + [(2, 0)], "e int, d int")
    found = windows.recent_windows(df, ["e"], [F.desc("d")])
    counts = {(r.e, r.window_key): r.n for r in found.groupBy("e", "window_key").agg(F.count("*").alias("n")).collect()}
    assert counts == {(1, "last_3"): 3, (1, "last_5"): 5, (1, "last_10"): 10, (1, "season"): 12, (2, "last_3"): 1, (2, "last_5"): 1, (2, "last_10"): 1, (2, "season"): 1}
    weights = [r.weight for r in found.where("e = 1 and window_key = 'last_5'").orderBy(F.desc("d")).collect()]
    assert weights == pytest.approx([0.5 ** (i / 3) for i in range(5)])
    assert {r.weight for r in found.where("window_key = 'season'").collect()} == {1.0}


def test_evidence_is_never_scaled_up(spark):
    profiles = scoring.profile_table(spark, {"all": (("a", 0.5, 1, True), ("b", 0.5, -1, False)), "some": (("a", 0.7, 1, True), ("x", 0.3, 1, False)), "little": (("a", 0.5, 1, False), ("x", 0.5, 1, False)), "no_core": (("a", 0.9, 1, False), ("x", 0.1, 1, True)), "none": (("x", 1.0, 1, False),)})
    df = frame(spark, [(1, "a", 80.0), (1, "b", 30.0)], "e int, metric string, percentile double")
    found = {r.dimension: (r.score, r.coverage, r.state) for r in scoring.evidence(df, profiles, ["e"]).collect()}
    assert found == {"all": (75.0, 1.0, "ready"), "some": (None, 0.7, "partial"), "little": (None, 0.5, "insufficient_evidence"), "no_core": (None, 0.9, "insufficient_evidence"), "none": (None, 0.0, "insufficient_evidence")}
    shares = frame(spark, [("all", 0.6), ("some", 0.4)], "dimension string, share double")
    row = scoring.composed(scoring.evidence(df, profiles, ["e"]), shares, ["e"]).head()
    assert (row.overall, row.coverage, row.state) == (None, 0.88, "partial")
    row = scoring.composed(scoring.evidence(df, profiles, ["e"]), shares.where("dimension = 'all'").withColumn("share", F.lit(1.0)), ["e"]).head()
    assert (row.overall, row.state) == (75.0, "ready")


def test_renormalized_scores(spark):
    df = frame(spark, [(1, 80.0, 0.5, 1), (1, None, 0.3, 1), (1, 40.0, 0.2, -1), (2, None, 1.0, 1)], "e int, percentile double, weight double, direction int")
    found = {r.e: r.score for r in scoring.renormalized(df, ["e"], default=50.0).collect()}
    assert found == {1: pytest.approx((80 * 0.5 + 60 * 0.2) / 0.7), 2: 50.0}


def test_derived_metrics(spark):
    rows = [("goals", 3.0, 2, 2), ("assists", 1.0, 2, 2), ("penalty_goals", 1.0, 2, 2), ("npxg", 0.5, 2, 2), ("shots_total", 9.0, 1, 2), ("saves", 0.0, 2, 2), ("shots_on_target_faced", 0.0, 2, 2), ("goals_prevented", 9.0, 2, 2), ("psxg", 1.0, 2, 2), ("goals_conceded", 1.0, 2, 2)]
    df = frame(spark, [(1, *r) for r in rows], "k int, metric string, value double, observed int, rows int")
    found = {r.metric: r.value for r in derived.derive(df, ["k"]).where("derived").collect()}
    assert found == {"goal_contributions": 4.0, "non_penalty_goals": 2.0, "non_penalty_goals_minus_npxg": 1.5}


def plain_elo(matches):
    ratings, out = {}, []
    for c, m, k, h, a, hs, as_ in sorted(matches, key=lambda x: (x[0], x[2], x[1])):
        if hs is None or as_ is None or h == a:
            continue
        x, y = ratings.get((c, h), 1500.0), ratings.get((c, a), 1500.0)
        e = 1 / (1 + 10 ** ((y - x - 60) / 400))
        d = 20 * ((hs > as_) + 0.5 * (hs == as_) - e)
        ratings[c, h], ratings[c, a] = x + d, y - d
        out += [(c, m, True, h, x, x + d, e), (c, m, False, a, y, y - d, 1 - e)]
    return out


def test_elo(spark):
    import random

    rng = random.Random(1)
    matches = [(rng.choice("xy"), i, rng.randint(0, 40), *rng.sample("ABCDE", 2), rng.randint(0, 3), rng.randint(0, 3)) for i in range(200)] + [("x", 900, 3, "A", "A", 1, 0), ("x", 901, 3, "A", "B", None, 0)]
    df = frame(spark, matches, "season string, match_id int, kickoff int, home_team string, away_team string, home_score int, away_score int")
    history_ = elo.elo_history(df.repartition(4), ["season"])
    found = {(r.season, r.match_id, r.is_home): (r.team, r.pre, r.post, r.expected) for r in history_.collect()}
    want = plain_elo(matches)
    assert len(found) == len(want)
    for c, m, home, team, pre, post, e in want:
        assert found[c, m, home] == (team, pytest.approx(pre, abs=6e-5), pytest.approx(post, abs=6e-5), pytest.approx(e, abs=6e-7))
    last = {}
    for c, _, _, team, pre, post, _ in want:
        last.setdefault((c, team), []).append((pre, post))
    for r in elo.elo_summary(history_, ["season"]).collect():
        own = last[r.season, r.team]
        assert r.elo == pytest.approx(own[-1][1], abs=1e-4) and r.elo_change == pytest.approx(own[-1][1] - own[-5:][0][0], abs=2e-4)


def test_shrinkage_and_possession(spark):
    row = spark.range(1).select(scoring.shrunk(F.lit(1.0), F.lit(0.5), F.lit(450.0), 450.0).alias("a"), scoring.shrunk_ratio(F.lit(3.0), F.lit(10.0), F.lit(0.1), 20.0).alias("b"), *(entity_scores.possession_adjusted(F.lit(10.0), F.lit(p)).alias(f"p{i}") for i, p in enumerate((50.0, 75.0, 96.0, 120.0, None)))).head()
    assert (row.a, row.b) == (0.75, pytest.approx(5 / 30))
    assert [row.p0, row.p1, row.p2, row.p3, row.p4] == [10.0, 20.0, 10.0, 10.0, 10.0]


def test_meta_counts_the_same_role_only(spark):
    rows = [(1, "f", 0, 80.0, 0.9), (1, "f", 1, 60.0, 0.9), (1, "m", 2, 10.0, 0.9), (2, "f", 0, 50.0, 0.2), (2, "f", 1, 20.0, 0.9), (3, "f", 1, 50.0, 0.9), (4, "f", 0, 70.0, 0.8), (5, "f", 0, 40.0, 0.8), (5, "f", 3, 60.0, 0.8)]
    schema = "e int, role string, period int, overall double, confidence double"
    found = {r.e: r for r in meta.meta_levels(frame(spark, rows, schema), "e").collect()}
    assert set(found) == {1, 2, 4, 5}
    assert found[1].stable == pytest.approx((80 + 0.6 * 60) / 1.6) and found[1].expected == 60 and found[1].surprise_signal == "surprise" and found[1].stable_confidence == pytest.approx(0.9 * 0.9)
    assert found[2].surprise_signal == "insufficient_evidence" and found[5].surprise_signal == "disappointment"
    assert (found[4].surprise_signal, found[4].expected, found[4].expected_confidence, found[4].seasons) == ("insufficient_history", None, None, 0)
    nought = frame(spark, [(1, "f", 0, 80.0, 0.0)], schema)
    with pytest.raises(Exception, match="nought"):
        meta.meta_levels(nought, "e").collect()
    assert meta.meta_levels(nought, "e", strict=False).head().stable is None


def test_trend(spark):
    rows = [(1, w, o, 0.8) for w, o in (("last_3", 80.0), ("last_5", 70.0), ("last_10", 60.0), ("season", 60.0))] + [(2, w, 50.0, 0.1) for w in ("last_3", "last_5", "last_10", "season")] + [(3, "last_3", 50.0, 0.9), (4, "last_3", 50.0, 0.0), (4, "last_10", 10.0, 0.9), (5, "last_5", 50.0, 0.9), (5, "season", 51.0, 0.9)]
    found = {r.e: (r.trend, r.trend_confidence, r.trend_signal) for r in meta.trend(frame(spark, rows, "e int, window_key string, overall double, confidence double"), "e").collect()}
    assert found == {1: (pytest.approx(16.0), pytest.approx(0.8), "rising"), 2: (0.0, pytest.approx(0.1), "insufficient_evidence"), 3: (None, None, "insufficient_data"), 4: (None, 0.0, "insufficient_evidence"), 5: (pytest.approx(-1.0), pytest.approx(0.9), "stable")}


def test_watchlist(spark):
    rows = [(80.0, 12.0, 6.0), (80.0, 12.0, 5.0), (54.0, 30.0, 30.0), (80.0, None, 8.0), (60.0, 11.0, 7.0), (60.0, None, None), (100.0, 100.0, 100.0)]
    score = meta.watchlist_score(F.col("s"), F.col("u"), F.col("t"))
    found = [(r.score, r.signal) for r in frame(spark, rows, "s double, u double, t double").select(score.alias("score"), meta.watchlist_signal(F.col("s"), F.col("u"), F.col("t"), score).alias("signal")).collect()]
    assert [x for _, x in found] == ["breakout", "outperforming", "none", "rising", "none", "none", "breakout"]
    assert found[0][0] == pytest.approx(0.45 * 80 + 0.35 * 48 + 0.20 * 30) and found[-1][0] == 100.0 and found[5][0] == pytest.approx(27.0)


def test_stance(spark):
    texts = ["A superb, world-class goal.", "Costly error; booed. Poor.", "superbly heroic", "", "An inspired flop"]
    found = [r.s for r in frame(spark, [(t,) for t in texts], "t string").select(ratings.stance(F.col("t")).alias("s")).collect()]
    assert [(round(s.score, 4), round(s.confidence, 4), s.hits) for s in found] == [(1.0, 0.8, 2), (-1.0, 0.95, 3), (0.0, 0.0, 0), (0.0, 0.0, 0), (round(-0.3 / 1.7, 4), 0.8, 2)]
    assert found[1].terms == ["costly error", "poor", "booed"]
    row = spark.range(1).select(ratings.focus(F.lit("Ann scored. José-Bob  fell!\nWho won; nobody"), F.lit("jose bob")).alias("a"), ratings.focus(F.lit("Nobody  here."), F.lit("bob")).alias("b"), ratings.evidence_text(F.lit("a"), F.lit(" ")).alias("c")).head()
    assert (row.a, row.b, row.c) == ("José-Bob fell!", "Nobody here.", "a")


def test_stance_is_found_once_a_row(spark):
    texts = frame(spark, [(1, "a", "Ann was good.", 0), (1, "b", None, 3)], "e long, source string, t string, age_days int")
    said = texts.withColumn("s", ratings.stance(ratings.focus(F.col("t"), F.lit("ann")), {"good": 1.0})).select("e", "source", "age_days", "s.score", "s.confidence")
    found = ratings.perception(said, "e")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("good(?!") == 1
    assert [(r.score, r.scored, r.evidence) for r in found.collect()] == [(100.0, 1, 2)]


def test_sources_are_balanced(spark):
    rows = [("p", "loud", 1.0, 1.0, 0)] * 50 + [("p", "calm", -1.0, 1.0, 45), ("q", "a", 0.0, 0.0, 0), ("r", "a", 1.0, 0.8, 45), ("r", "a", 1.0, 0.8, 0), ("r", "b", 0.5, 0.65, 0)]
    found = {r.e: r for r in ratings.perception(frame(spark, rows, "e string, source string, score double, confidence double, age_days int"), "e").collect()}
    assert (found["p"]["mean"], found["p"].polarization, found["p"].score, found["p"].sources, found["p"].perception_signal) == (0.0, 100.0, 50.0, 2, "mixed")
    assert found["p"].confidence == pytest.approx(0.35 + 0.30 * 2 / 3 + 0.20 + 0.15 * 0.75)  # the sources' recency, each the same
    assert (found["q"].score, found["q"].confidence, found["q"].perception_signal, found["q"].evidence) == (None, 0.0, "insufficient_evidence", 1)
    assert found["r"]["mean"] == pytest.approx(0.75) and found["r"].perception_signal == "positive"
    performance = frame(spark, [("p", 80.0, 0.9), ("r", 40.0, 0.6), ("none", 50.0, 0.9)], "e string, stable double, stable_confidence double")
    rated = {r.e: r for r in ratings.rating_snapshots(performance, ratings.perception(frame(spark, rows, "e string, source string, score double, confidence double, age_days int"), "e"), "e").collect()}
    assert rated["p"].rating_signal == "polarized" and rated["p"].rating_confidence == pytest.approx(min(0.9, found["p"].confidence) * 0.5)
    assert (rated["none"].rating_signal, rated["none"].rating_gap, rated["none"].confidence) == ("insufficient_evidence", None, 0.0)


def test_rating_signals(spark):
    rows = [(4, 3, 2, 0.55, 0.0, 0.5, 12.0), (4, 3, 2, 0.55, 0.0, 0.5, -12.0), (4, 3, 2, 0.55, None, 0.5, 11.9), (3, 3, 2, 0.9, 0.0, 0.9, 30.0), (4, 3, 2, 0.9, 60.0, 0.9, 30.0), (4, 3, 2, 0.9, 0.0, 0.49, 30.0), (4, 3, 2, 0.9, 0.0, 0.9, None)]
    df = frame(spark, rows, "a int, b int, c int, d double, p double, r double, g double")
    assert [r.v for r in df.select(ratings.rating_signal(*(F.col(c) for c in "abcdprg")).alias("v")).collect()] == ["underrated", "overrated", "aligned", "insufficient_evidence", "polarized", "insufficient_evidence", "insufficient_evidence"]


def test_formations(spark):
    rows = [("a", 3, "4-3-3"), ("a", 2, "4-4-2"), ("a", 1, "4-3-3"), ("a", 0, "4-4-2"), ("b", 1, "4-4-3"), ("b", 0, None), ("c", 0, "4-3-3"), ("c", 1, "4-3-3"), ("c", 2, "4-3-3"), ("d", 0, "4-3-3")]
    found = {r.team: r for r in tactics.formation_profile(frame(spark, rows, "team string, at int, f string"), "team", "f", [F.desc("at")]).collect()}
    assert (found["a"].primary, found["a"].share, found["a"].label, [(x.formation, x.matches) for x in found["a"].alternatives]) == ("4-3-3", 0.5, "variable", [("4-3-3", 2), ("4-4-2", 2)])
    assert (found["b"].primary, found["b"].label, found["b"].confidence, found["b"].formation_matches) == (None, "unavailable", 0.0, 0)
    assert found["c"].label == "stable" and found["d"].label == "limited_evidence"
    texts = ["4-3-3", "3-4-2-1", "4-4-3", "10", "5-5", "4-3-x", "4-3-3-0", None]
    assert [r.v for r in frame(spark, [(t,) for t in texts], "t string").select(tactics.valid_formation(F.col("t")).alias("v")).collect()] == [True, True, False, False, False, False, False, False]


def test_styles(spark):
    rows = [(65.0, 65.0, 0.35), (65.0, 54.9, 0.9), (49.9, 65.0, 0.9), (40.0, 40.0, 0.9), (65.0, 55.0, 0.9), (65.0, 65.0, 0.34), (None, 65.0, 0.9)]
    df = frame(spark, rows, "c double, v double, s double")
    assert [r.v for r in df.select(tactics.style_signal(F.col("c"), F.col("v"), F.col("s")).alias("v")).collect()] == ["control_and_volume", "possession_control", "volume_without_control", "low_control_low_volume", "balanced", "insufficient_evidence", "insufficient_evidence"]
    assert [r.v for r in df.select(tactics.defensive_signal(F.col("c"), F.col("s")).alias("v")).collect()] == ["restrictive_shot_profile", "restrictive_shot_profile", "balanced", "balanced", "restrictive_shot_profile", "insufficient_evidence", "insufficient_evidence"]
    r = spark.range(1).select(tactics.tactical_confidence(F.lit(0.8), F.lit(0.5), F.lit(3)).alias("a"), tactics.tactical_confidence(F.lit(0.8), F.lit(0.5), F.lit(0)).alias("b")).head()
    assert (r.a, r.b) == (pytest.approx(0.8 * 0.925), pytest.approx(0.68))


def test_radar(spark):
    rows = [(1, "Forward", 900, 10, 9, 1, ["topscorers", "topassists"]), (2, "Midfield", 900, 10, 1, 9, ["topassists"]), (3, "Forward", 0, 0, 5, 5, ["topscorers"]), (4, None, 900, 20, 1, 0, []), (5, "Forward", 90, None, None, None, [])]
    found = {r.id: r for r in radar.radar(frame(spark, rows, "id int, position string, minutes int, appearances int, goals int, assists int, source_lists array<string>"), "id", ["goals", "assists"]).collect()}
    # all candidates are one pool, whatever their profile: 4 has goals with 2, and the fewest assists
    assert set(found) == {1, 2, 4, 5} and found[2].profile == "midfielder" and found[5].radar_score == 0.0
    assert found[1].radar_score == round((0.35 * 100 * 2.5 / 3 + 0.20 * 50) / 0.55, 2) and found[2].radar_score == round((0.20 * 100 / 3 + 0.30 * 100 * 2.5 / 3) / 0.50, 2)
    assert found[1].reasons == ["top_scorer_feed", "top_assist_feed"] and found[1].confidence == pytest.approx(0.5 * 0.75 + 0.3 * 10 / 15 + 0.2)


def test_findings(spark):
    none = [None] * 5
    schema = "t string, results_process_delta double, confidence double, defense double, signals array<string>, possession double, creation double, volume_allowed double, on_target_allowed double, xga_allowed double"
    teams_ = frame(spark, [("a", 30.0, 0.4, 90.0, [], *none), ("b", -12.0, 0.9, 10.0, ["defensive_process_issue"], *none), ("c", 0.0, 0.9, 65.0, ["creation_issue"], 70.0, 31.0, 70.0, 90.0, 30.0), ("d", None, 0.9, None, None, 95.0, 30.0, 30.0, 70.0, None)], schema)
    found = {(r.t, r.code, r.severity) for r in findings.team_findings(teams_, ["t"]).collect()}
    assert found == {("a", "results_above_process", "high"), ("a", "defensive_process_strong", "high"), ("a", "regression_risk", "high"), ("b", "results_below_process", "notable"), ("b", "defensive_process_weak", "notable"),
                     ("c", "defensive_process_strong", "notable"), ("c", "creation_problem", "notable"), ("c", "sterile_possession", "info"), ("c", "few_but_high_quality_chances_allowed", "notable"), ("d", "sterile_possession", "high"), ("d", "high_volume_low_quality_allowed", "notable")}
    players = frame(spark, [("p", 2.0, 6.0, None, None, 900, 20, 0.9, 70.0, 20.0, "breakout", 85.0, "overrated", -30.0), ("q", 2.0, 6.0, None, None, 400, 20, 0.9, None, None, None, None, None, None), ("r", 9.0, 9.0, 2.0, 7.0, None, None, 0.9, None, None, "monitor", 90.0, "underrated", None)],
                    "p string, goals double, xg double, non_penalty_goals double, npxg double, minutes int, shots int, confidence double, volume_pct double, accuracy_pct double, watchlist_signal string, watchlist_score double, rating_signal string, rating_gap double")
    rows = findings.player_findings(players, ["p"]).collect()
    assert {(r.p, r.code, r.severity) for r in rows} == {("p", "finishing_underperformance", "notable"), ("p", "high_volume_low_quality_shooting", "notable"), ("p", "breakout_signal", "high"), ("p", "overrated", "high"), ("r", "finishing_underperformance", "high")}
    sure = {(r.p, r.code): r.confidence for r in rows}
    assert sure["p", "finishing_underperformance"] == pytest.approx(6 / 11) and sure["r", "finishing_underperformance"] == pytest.approx(7 / 12)


def test_backtest(spark):
    pairs = [(0.1 * (i % 10) + 0.05, float(i % 3 == 0)) for i in range(60)]
    r = validation.backtest(frame(spark, pairs, "expected double, actual double")).head()
    brier = sum((e - a) ** 2 for e, a in pairs) / 60
    assert r.brier == round(brier, 6) and r.baseline == 0.25 and r.skill == round(1 - brier / 0.25, 6) and r.status == ("pass" if r.skill > 0 else "warn")
    bins = {}
    for e, a in pairs:
        bins.setdefault(min(int(e * 5), 4), []).append((e, a))
    assert r.ece == round(sum(len(b) * round(abs(sum(e for e, _ in b) / len(b) - sum(a for _, a in b) / len(b)), 4) for b in bins.values()) / 60, 6)
    few = validation.backtest(frame(spark, pairs[:49], "expected double, actual double")).head()
    assert few.brier is None and few.status == "insufficient_data"
    perfect = validation.backtest(frame(spark, [(0.5, 0.5)] * 50, "expected double, actual double")).head()
    assert (perfect.baseline, perfect.skill, perfect.status) == (0.0, 0.0, "warn")


def test_stability(spark):
    rows = [(i, "f", w, o, c) for i in range(25) for w, o, c in (("season", float(i), 0.5 if i < 22 else 0.49), ("last_10", float(-i), 0.9))] + [(99, "g", w, 1.0, 0.9) for w in ("season", "last_10")]
    found = {r.role: (r.n, r.status, r.spearman) for r in validation.stability(frame(spark, rows, "e int, role string, window_key string, overall double, confidence double"), "e").collect()}
    assert found == {"f": (22, "measured", pytest.approx(-1.0)), "g": (1, "insufficient_data", None)}


def test_half_even_is_pythons_round(spark):
    import random

    from tallyforge.functions.numbers import half_even

    rng = random.Random(3)
    xs = [2.675, 0.125, 0.375, 1.005, 8.345, -2.675, 0.5, 1.5, -0.5, 0.0, 1e300, 99.99995, 1e-9] + [rng.uniform(-100, 100) for _ in range(500)] + [round(rng.uniform(-100, 100), 5) for _ in range(500)] + [rng.randint(-9999, 9999) / 2 ** rng.randint(0, 12) for _ in range(500)]
    for digits in (0, 2, 4):
        assert [r.v for r in frame(spark, [(x,) for x in xs], "x double").select(half_even(F.col("x"), digits).alias("v")).collect()] == [round(x, digits) for x in xs]
    assert spark.range(1).select(half_even(F.lit(None).cast("double"), 2).alias("v")).head().v is None


def plain_team_scores(rows):
    """Teams' composites of one scope and window of all matches, by dictionaries."""
    from tallyforge.operators.profiles import TEAM_V1

    each = {}
    for r in rows:
        p, a, o = r["passes_total"], r["passes_accurate"], r["opponent_passes_total"]
        v = {**{m: r[m] for m in teams.GIVEN}, "goals_for": r["goals_for"], "goals_against": r["goals_against"], "goal_difference_per_match": r["goals_for"] - r["goals_against"], "points_per_match": 3 if r["goals_for"] > r["goals_against"] else int(r["goals_for"] == r["goals_against"]),
             "pass_accuracy_pct": 100 * a / p if p and a is not None else None, "pass_share": 100 * p / (p + o) if p is not None and o is not None and p + o > 0 else None}
        each.setdefault(r["team"], []).append(v)
    raw, parts = {}, {}
    for t, vs in each.items():
        raw[t] = {m: sum(x) / len(x) for m in vs[0] if (x := [v[m] for v in vs if v[m] is not None])}
        for name, (attempts, _) in teams.RATIOS.items():
            seen = [v for v in vs if v[attempts] is not None]
            if sum(v[attempts] for v in seen) > 0:
                parts[t, name] = sum(v["goals_for"] for v in seen), sum(v[attempts] for v in seen)
    for name, (_, prior) in teams.RATIOS.items():
        own = {t: p for (t, n), p in parts.items() if n == name}
        mean = sum(a for a, _ in own.values()) / sum(b for _, b in own.values()) if own else 0
        for t, (a, b) in own.items():
            raw[t][name] = (a + prior * mean) / (b + prior)
    pct = {t: {} for t in raw}
    for m in {m for own in raw.values() for m in own}:
        values = {t: round(own[m], 9) for t, own in raw.items() if m in own}
        for t, x in values.items():
            p = 100 * (sum(y < x for y in values.values()) + 0.5 * sum(y == x for y in values.values())) / len(values)
            pct[t][m] = 100 - p if m in teams.LOWER else p

    def share(values, weights):
        there = {m: w for m, w in weights.items() if values.get(m) is not None}
        return sum(values[m] * w for m, w in there.items()) / sum(there.values()) if there else None

    out = {}
    for t, own in pct.items():
        d = {k: share(own, TEAM_V1[k]) for k in ("chance", "defense", "control", "finishing", "results")}
        process, attack = share(d, TEAM_V1["process"]), share(d, TEAM_V1["attack"])
        if process is None or d["results"] is None:
            continue
        overall = share({"process": process, "results": d["results"]}, TEAM_V1["overall"])
        coverage = sum(sum(v[m] is not None for v in each[t]) / len(each[t]) for m in teams.COVERAGE) / 10
        signals = ["finishing_issue"] if (d["chance"] or 0) >= 65 and d["finishing"] is not None and d["finishing"] <= 35 else ["creation_issue"] if d["chance"] is not None and d["chance"] <= 35 and (d["finishing"] or 0) >= 45 else []
        signals += ["defensive_process_issue"] if d["defense"] is not None and d["defense"] <= 35 else []
        delta = d["results"] - process
        signals += ["results_above_process"] if delta >= 12 else ["results_below_process"] if delta <= -12 else []
        out[t] = {"overall": overall, "process": process, "attack": attack, "coverage": coverage, "delta": delta, "signals": signals, "confidence": min(1, (1 - math.exp(-len(each[t]) / 5)) * (0.55 + 0.45 * coverage) * (0.75 + 0.25 * min(1, len(pct) / 12)))}
    return out


def test_team_scores(spark):
    import random

    rng = random.Random(4)
    names = ["team", "match_id", "goals_for", "goals_against", "passes_total", "passes_accurate", "opponent_passes_total", *teams.GIVEN]
    rows = []
    for i in range(90):
        maybe = lambda x, i=i: None if rng.random() < 0.2 or i % 9 == 8 else float(x)
        rows.append((f"t{i % 9}", i, rng.randint(0, 4), rng.randint(0, 4), maybe(rng.choice([0, 300, 500])), maybe(rng.randint(0, 300)), maybe(rng.choice([0, 400])), *(maybe(rng.randint(0, 20)) for _ in teams.GIVEN)))
    df = frame(spark, rows, "team string, match_id int, goals_for int, goals_against int, " + ", ".join(f"{n} double" for n in names[4:])).withColumn("season", F.lit(1))
    windows_ = teams.team_windows(df, ["season"], [F.desc("match_id")])
    found = {r.team: r for r in teams.team_scores(teams.team_features(windows_, ["season"]), ["season"]).where("window_key = 'season'").collect()}
    want = plain_team_scores([dict(zip(names, r, strict=True)) for r in rows])
    assert set(found) == set(want) and "t8" not in found  # nothing of its process is known
    for t, w in want.items():
        r = found[t]
        for c, name in (("overall", "overall"), ("process", "process"), ("attack", "attack"), ("coverage", "coverage"), ("results_process_delta", "delta"), ("confidence", "confidence")):
            assert r[c] == pytest.approx(w[name], abs=1e-6), (t, c)
        assert r.signals == w["signals"]
    with pytest.raises(ValueError, match="one scope"):
        teams.only_scope(df.withColumn("season", F.col("match_id") % 2), {"season": 1})
    assert teams.only_scope(df, {"season": 1}).count() == 90


def test_reconciliation(spark):
    rows = [("one", "a", "1", 1), ("same", "a", "2.0", 1), ("same", "b", "2.0", 1), ("three", "a", "x", 1), ("three", "b", "x", 1), ("three", "c", "x", 1), ("differ", "a", "1", 1), ("differ", "b", "2", 1), ("later", "a", "9", 1), ("later", "a", "2", 5), ("later", "b", "2", 2), (None, "a", "1", 1), ("half", "a", "3", 1), ("half", "b", None, 9), ("nothing", "a", None, 1)]
    df = frame(spark, rows, "fact_key string, source string, value string, observed_at int").withColumn("metric", F.lit("goals")).withColumn("granularity", F.lit("player_match"))
    found = {r.fact_key: (r.status, r.confidence, r.sources, r.value, r.winner) for r in mesh.reconcile(df, priority={"goals": ["b", "a"]}).collect()}
    assert found == {"one": ("single_source", 0.35, 1, "1", "a"), "same": ("agreed", 0.7, 2, "2.0", None), "three": ("agreed", 0.8, 3, "x", None), "differ": ("conflict", 0.2, 2, "2", "b"), "later": ("agreed", 0.7, 2, "2", None), "half": ("single_source", 0.35, 1, "3", "a"), "nothing": ("unresolved", 0.0, 0, None, None)}
    assert {r.fact_key: r.value for r in mesh.reconcile(df).collect()}["differ"] is None
    gated = {r.fact_key: r.status for r in mesh.reconcile_by_policy(df, mesh.policies(spark, "a", "b")).collect()}
    assert gated == {"one": "single_source", "same": "agreed", "three": "methodology_pending", "differ": "conflict", "later": "agreed", "half": "single_source", "nothing": "unresolved"}
    other = {r.fact_key: r.status for r in mesh.reconcile_by_policy(df.withColumn("metric", F.lit("touches")), mesh.policies(spark, "a", "b")).collect()}
    assert other["same"] == "not_comparable"
    assert mesh.policies(spark).count() == 22 and mesh.policies(spark).head().sources == ["statsbomb-open@statsbomb-open-v0.4", "wyscout-open@wyscout-open-v0.2"]
    pinned = mesh.policies(spark, "a", "b", {"a": "v1", "b": "v2"})
    versions = F.when(F.col("source") == "a", "v1").when((F.col("fact_key") == "same"), "v3").otherwise("v2")
    by_version = {r.fact_key: r.status for r in mesh.reconcile_by_policy(df.withColumn("version", versions), pinned).collect()}
    assert by_version["same"] == "methodology_pending" and by_version["differ"] == "conflict"
    mixed = df.withColumn("version", F.when((F.col("fact_key") == "later") & (F.col("observed_at") == 5), "v0").otherwise(versions))
    assert {r.fact_key: r.status for r in mesh.reconcile_by_policy(mixed, pinned).collect()}["later"] == "methodology_pending"
    counts = mesh.resolution_report(df.withColumn("granularity", F.when(F.col("source") != "c", F.col("granularity")))).head()
    assert (counts.resolved, counts.unresolved, counts.missing_granularity) == (13, 1, 1)
    kinds = df.withColumn("source_type", F.when(F.col("source") == "b", "qualitative_fan").otherwise("objective_web"))
    assert {r.fact_key: r.sources for r in mesh.reconcile(kinds).collect()}["differ"] == 1


def test_values_compare_by_class(spark):
    rows = [("int", 2.0, None, None), ("float", 2.0, None, None), ("bool", None, None, True), ("str", None, "2.0", None)]
    found = [r.v for r in frame(spark, rows, "k string, n double, t string, b boolean").select(mesh.comparable_value(F.col("k"), F.col("n"), F.col("t"), F.col("b")).alias("v")).collect()]
    assert found[0] == found[1] and len(set(found)) == 3


def test_identity_conflicts(spark):
    rows = [("a", "match", {"match_id": "1", "season": "2024", "home_team_id": "h", "home_team_name": "Red FC", "away_team_id": "w", "away_team_name": "Blue", "kickoff_date": "2024-08-01"}), ("b", "match", {"match_id": "9", "season": "2024-2025", "home_team_name": "red", "away_team_name": "BLUE", "kickoff_date": "2024-08-02T10:00:00Z"}),
            ("b", "match", {"match_id": "8", "season": " ", "home_team_name": "red", "away_team_name": "blue", "kickoff_date": "2024-08-02"}), ("a", "team", {"match_id": "1", "team_id": "h"}), ("a", "team", {"match_id": "2", "team_id": "h"})]
    df = frame(spark, rows, "source string, entity_type string, hints map<string,string>").withColumn("entity_id", F.lit("x"))
    teams_, matches_ = identity.local_index(df, F.lit("C"))
    assert {(r.source, r.provider_id, r.key) for r in identity.checked(teams_).collect()} == {("a", "h", "team:C:red"), ("a", "w", "team:C:blue")}
    assert {(r.source, r.provider_id): r.key for r in matches_.collect()} == {("a", "1"): "match:C:2024-2025:team:C:red:team:C:blue:2024-08-01", ("b", "9"): "match:C:2024-2025:team:C:red:team:C:blue:2024-08-01"}
    apart = {(r.source, r.provider_id): r.key for r in identity.match_index(df, F.lit("C"), teams_, tolerance=None).collect()}
    assert apart["b", "9"].endswith("2024-08-02")
    scoped = sorted((r.resolution.status, r.resolution.key or "", r.resolution.confidence) for r in identity.team_in_match(df.where("entity_type = 'team'"), teams_, matches_).collect())
    assert scoped == [("resolved", "team-match:match:C:2024-2025:team:C:red:team:C:blue:2024-08-01:team:C:red", 0.85), ("unresolved", "", 0.0)]
    twice = df.unionByName(frame(spark, [("a", "team", {"team_id": "h", "team_name": "Green"}, "x")], "source string, entity_type string, hints map<string,string>, entity_id string"))
    with pytest.raises(ValueError, match="a h stands for 2"):
        identity.checked(identity.team_index(twice, F.lit("C")))


def test_date_clusters_dont_chain(spark):
    import datetime as dt
    import random

    day = dt.date(2024, 1, 1)
    rows = [("k", day + dt.timedelta(d)) for d in (2, 0, 1, 5, 6, 0)] + [("k", None), (None, day)]
    found = [(r.k, r.d, r.cluster) for r in mesh.date_clusters(frame(spark, rows, "k string, d date"), ["k"], "d").collect()]
    first = {0: 0, 1: 0, 2: 2, 5: 5, 6: 5}
    assert all(c == day + dt.timedelta(first[(d - day).days]) for k, d, c in found if k and d) and ("k", None, None) in found and (None, day, day) in found
    rng = random.Random(2)
    many = [(str(rng.randint(0, 5)), day + dt.timedelta(rng.randint(0, 60))) for _ in range(200)]
    want = {}
    for k in {k for k, _ in many}:
        at = None
        for d in sorted({d for x, d in many if x == k}):
            at = d if at is None or (d - at).days > 1 else at
            want[k, d] = at
    assert all(want[r.k, r.d] == r.cluster for r in mesh.date_clusters(frame(spark, many, "k string, d date"), ["k"], "d").collect())


def test_identities(spark):
    rows = spark.range(1).select(mesh.team_key(F.lit("ENG_PL"), F.lit("Man City")).alias("a"), mesh.team_key(F.lit("ENG_PL"), F.lit("Manchester City FC")).alias("b"), mesh.team_key(F.lit("C"), F.lit("FC 04")).alias("c"),
        mesh.match_key(F.lit("C"), F.lit("2024-2025"), F.lit("t1"), F.lit("t1"), F.lit("2024-08-01").cast("date")).alias("d"), mesh.fact_key(F.lit("team_match"), F.lit("C"), F.lit(None).cast("string"), F.lit("m"), F.lit(" "), F.lit("p")).alias("e"), mesh.fact_key(F.lit("player_season"), F.lit("C"), F.lit("S"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("p")).alias("f")).head()
    assert rows.a == rows.b == "team:ENG_PL:city manchester" and rows.c is None and rows.d is None and rows.e is None and rows.f == "player-season:C:S:p"
    found = mesh.resolve_competitions(frame(spark, [("openligadb", "bl1"), ("openligadb", "zz")], "source string, external_id string")).collect()
    assert {r.external_id: r.competition for r in found} == {"bl1": "GER_BL1", "zz": None} and len(mesh.COMPETITIONS) == 31


def test_crosswalk(spark):
    rows = [("s", "1", "José Ruiz", "m1", "t"), ("w", "9", "Jose Ruiz", "m1", "t"), ("s", "1", "José Ruiz", "m2", "t"), ("w", "9", "Jose  Ruiz", "m2", "t"), ("s", "2", "Twin", "m1", "t"), ("s", "3", "Twin", "m1", "t"), ("w", "8", "Twin", "m1", "t"), ("s", "4", "Ann", "m1", "t"), ("w", "7", "Ann", "m1", "t"), ("w", "6", "Ann", "m2", "t"), ("s", "4", "Ann", "m2", "t"), ("s", "5", "", "m1", "t"), ("w", "5", "", "m1", "t")]
    found = mesh.crosswalk(frame(spark, rows, "source string, player string, name string, match_key string, team_key string")).collect()
    assert {(r.source, r.player, r.matches) for r in found} == {("s", "1", 2), ("w", "9", 2)} and len({r.canonical for r in found}) == 1


def test_mentions_against_every_pair(spark):
    import re

    names = [(1, "Ann Lee"), (2, "Bob"), (3, "Lee"), (4, "Carla"), (5, "carla"), (6, "Jo-Jo Smith"), (7, "Émile Zo")]
    texts = [(1, "ann lee and Carla met."), (2, "JoAnn Leeds"), (3, "the jo-jo smith show; EMILE ZO!"), (4, None), (5, "Ann  Lee,bobby")]
    found = {(r.text_id, r.name_id) for r in mesh.mentions(frame(spark, texts, "text_id int, text string"), frame(spark, names, "name_id int, name string")).collect()}
    want = set()
    for t, x in texts:
        for n, name in ((1, "ann lee"), (6, "jo jo smith"), (7, "emile zo")):
            plain = re.sub(r"\W+", " ", (x or "").lower().replace("é", "e"))
            if f" {name} " in f" {plain} ":
                want.add((t, n))
    assert found == want


def test_coverage_states(spark):
    rows = [(None, False, "ok", "current", 10, 10, True), ("full", True, "ok", "current", 10, 10, True), ("full", False, None, "current", None, None, None), ("full", False, "skipped_token_required", "current", None, None, None), ("full", False, "error", "current", 1, 1, True), ("full", False, "ok", "current", 10, 0, True),
            ("full", False, "ok", "current", 10, 10, False), ("full", False, "ok", "current", 10, 4, True), ("full", False, "ok", "historical", 10, 10, False), ("full", False, "ok", "historical", 10, 4, False), ("full", False, "ok", "current", 10, 10, True), ("partial", False, "ok", "current", 10, 10, True)]
    df = frame(spark, rows, "r string, t boolean, p string, k string, n int, o int, c boolean")
    assert [r.v for r in df.select(mesh.coverage_state(*(F.col(c) for c in "rtpknoc")).alias("v")).collect()] == ["unsupported", "token_required", "not_probed", "token_required", "not_probed", "missing", "previous_season", "partial", "historical_only", "partial", "current_available", "partial"]


def test_requirements(spark):
    entries = frame(spark, [("E", "match", "status", "current", "current_available"), ("E", "match", "goals", "current", "previous_season"), ("E", "match", "venue", "historical", "historical_only"), ("F", "match", "goals", "historical", "current_available")], "competition string, granularity string, metric string, role string, state string")
    wanted = frame(spark, [(c, "match", m) for c in "EF" for m in ("status", "goals", "venue")], "competition string, granularity string, metric string")
    now, old, recent = (mesh.coverage_fraction(x).head() for x in (mesh.requirements(entries, wanted), mesh.requirements(entries, wanted, "historical"), mesh.recent_requirements(entries, wanted)))
    assert (now.numerator, now.denominator, now.critical_gap_keys) == (1, 6, ["E:match:goals", "F:match:goals", "F:match:status"])
    assert (old.numerator, old.critical_gap_keys) == (1, []) and (recent.numerator, recent.critical_gap_keys) == (1, []) and "E:match:goals" not in recent.gap_keys


def test_confidence_formulas(spark):
    r = spark.range(1).select(entity_scores.team_confidence(F.lit(5), F.lit(0.5), F.lit(6)).alias("a"), entity_scores.evidence_confidence(F.lit(5), F.lit(20), F.lit(0.8)).alias("b")).head()
    assert r.a == pytest.approx((1 - math.exp(-1)) * 0.775 * 0.875) and r.b == 0.4


def test_shared_folder_is_never_a_machines_own():
    from tallyforge.functions.shared import shared_dir

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        def __init__(self, **conf):
            self.conf, self.sparkContext = Conf({k.replace("_", "."): v for k, v in conf.items()}), type("Context", (), {"applicationId": "app"})

    assert shared_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(Session(spark_master="local[4]")).startswith("file://")
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1000]", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(spark_master=master))
