"""Queries of facts from several sources. A source is an event type, a fact a user's day, its value the k of props."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import _MARKED, _PLAIN
from ..operators import mesh
from ..sources.tables import table
from .registry import query


def observations(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 4
    return table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "props").select(F.concat_ws(":", F.lit("u"), "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("fact_key"), F.lit("goals").alias("metric"), F.lit("player_match").alias("granularity"), F.col("event_type").alias("source"), k.cast("string").alias("value"), F.struct("ts", "event_id").alias("observed_at"))


_LATEST = """o AS (SELECT 'u:' || user_id || ':' || strftime(ts, '%Y-%m-%d') AS fact_key, event_type AS source, arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER) % 4, (ts, event_id)) AS value FROM events GROUP BY 1, 2),
g AS (SELECT fact_key, count(*) AS sources, count(DISTINCT value) AS v, min(value)::VARCHAR AS value FROM o GROUP BY 1)"""


@query("mesh_reconcile", f"""WITH {_LATEST}, p AS (SELECT fact_key, max(value) FILTER (source = 'purchase')::VARCHAR AS one, max(value) FILTER (source = 'click')::VARCHAR AS two, min(source) AS lone FROM o GROUP BY 1)
SELECT fact_key, CASE WHEN sources = 1 THEN 'single_source' WHEN v = 1 THEN 'agreed' ELSE 'conflict' END AS status, CASE WHEN sources = 1 THEN 0.35 WHEN v = 1 THEN round(least(0.95, 0.60 + 0.10 * (sources - 1)), 6) ELSE 0.20 END::DOUBLE AS confidence, sources, CASE WHEN v = 1 THEN value ELSE coalesce(one, two) END AS value,
  CASE WHEN sources = 1 THEN lone WHEN v > 1 AND one IS NOT NULL THEN 'purchase' WHEN v > 1 AND two IS NOT NULL THEN 'click' END AS winner FROM g JOIN p USING (fact_key)""")
def mesh_reconcile(spark, sf):
    """Conflicts show the value of the first source by priority, and stay conflicts."""
    return mesh.reconcile(observations(spark, sf), priority={"goals": ["purchase", "click"]}).drop("metric", "granularity")


@query("mesh_objective_only", f"""WITH {_LATEST.replace("FROM events GROUP", "FROM events WHERE event_type NOT IN ('view', 'error') AND value >= 10 GROUP")}, k AS (SELECT DISTINCT 'u:' || user_id || ':' || strftime(ts, '%Y-%m-%d') AS fact_key FROM events)
SELECT fact_key, CASE WHEN sources IS NULL THEN 'unresolved' WHEN sources = 1 THEN 'single_source' WHEN v = 1 THEN 'agreed' ELSE 'conflict' END AS status, coalesce(sources, 0) AS sources FROM k LEFT JOIN g USING (fact_key)""")
def mesh_objective_only(spark, sf):
    """Views and errors are opinions, and low values unknown: neither counts, but their facts stay, unresolved."""
    kind = F.when(F.col("event_type").isin("view", "error"), "qualitative_fan").otherwise("objective_official")
    rows = observations(spark, sf).withColumn("event_id", F.col("observed_at.event_id"))
    events = table(spark, sf, "events", "event_id", "event_type", "value").select("event_id", kind.alias("source_type"), (F.col("value") >= 10).alias("fine"))
    rows = rows.join(events, "event_id").withColumn("value", F.when(F.col("fine"), F.col("value")))
    return mesh.reconcile(rows).select("fact_key", "status", "sources")


@query("mesh_reconcile_by_policy", f"""WITH {_LATEST}, p AS (SELECT fact_key, list_sort(list(DISTINCT source)) AS pair FROM o GROUP BY 1)
SELECT fact_key, CASE WHEN sources = 1 THEN 'single_source' WHEN sources > 2 OR pair <> ['click', 'view'] THEN 'methodology_pending' WHEN v = 1 THEN 'agreed' ELSE 'conflict' END AS status, sources FROM g JOIN p USING (fact_key)""")
def mesh_reconcile_by_policy(spark, sf):
    return mesh.reconcile_by_policy(observations(spark, sf), mesh.policies(spark, "click", "view")).select("fact_key", "status", "sources")


@query("mesh_date_clusters", """
WITH RECURSIVE d AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events)),
c AS (SELECT user_id, day, i, day AS first FROM d WHERE i = 1 UNION ALL SELECT d.user_id, d.day, d.i, CASE WHEN d.day - c.first > 1 THEN d.day ELSE c.first END FROM c JOIN d ON d.user_id = c.user_id AND d.i = c.i + 1)
SELECT event_id, first AS cluster FROM events e JOIN c ON c.user_id = e.user_id AND c.day = e.ts::DATE""")
def mesh_date_clusters(spark, sf):
    rows = table(spark, sf, "events", "event_id", "user_id", "ts").select("event_id", "user_id", F.col("ts").cast("date").alias("day"))
    return mesh.date_clusters(rows, ["user_id"], "day").select("event_id", "cluster")


@query("mesh_fact_keys", """SELECT event_id, CASE event_type WHEN 'click' THEN 'player-match:m' || user_id || ':p' || user_id WHEN 'view' THEN 'team-match:m' || user_id || ':t' || user_id WHEN 'purchase' THEN 'player-season:C:2024-2025:p' || user_id END AS fact_key FROM events""")
def mesh_fact_keys(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    grain = F.when(kind == "click", "player_match").when(kind == "view", "team_match").when(kind == "purchase", "player_season").otherwise("player_appearance")
    match = F.when(kind.isin("click", "view"), F.concat(F.lit("m"), user)).otherwise(" ")
    return table(spark, sf, "events", "event_id", "event_type", "user_id").select("event_id", mesh.fact_key(grain, F.lit("C"), F.lit("2024-2025"), match, F.concat(F.lit("t"), user), F.concat(F.lit("p"), user)).alias("fact_key"))


@query("mesh_overlap", """SELECT coalesce(a.nation, b.nation) AS nation, CASE WHEN a.nation IS NULL THEN 'second_only' WHEN b.nation IS NULL THEN 'first_only' ELSE 'shared' END AS "where"
FROM (SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000) a FULL JOIN (SELECT DISTINCT s_nationkey AS nation FROM supplier) b ON a.nation = b.nation""")
def mesh_overlap(spark, sf):
    a, b = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return mesh.overlap(a, b, ["nation"])


@query("mesh_contradictions", "SELECT user_id, event_type, count(DISTINCT value) AS values FROM events GROUP BY 1, 2 HAVING count(DISTINCT value) > 1")
def mesh_contradictions(spark, sf):
    return mesh.contradictions(table(spark, sf, "events", "user_id", "event_type", "value"), ["user_id", "event_type"])


@query("mesh_coverage_by_source", "SELECT event_type AS source, 'k' AS metric, count(*) AS n, count(DISTINCT user_id) AS entities FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def mesh_coverage_by_source(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events", "event_type", "user_id", "props").where(k.isNotNull()).groupBy(F.col("event_type").alias("source")).agg(F.lit("k").alias("metric"), F.count("*").alias("n"), F.countDistinct("user_id").alias("entities"))


_FOLD = rf"trim(regexp_replace(translate(replace(replace(lower({{0}}), 'ß', 'ss'), chr(160), ' '), '{_MARKED}', '{_PLAIN}'), '\s+', ' ', 'g'))"


@query("mesh_mentions", rf"""
WITH n AS (SELECT name, min(item_id) AS name_id FROM (SELECT item_id, {_FOLD.format("array_to_string(string_split(text, ' ')[1:4], ' ')")} AS name FROM benchmark) WHERE length(name) >= 4 AND regexp_matches(name, '\w') GROUP BY 1 HAVING count(DISTINCT item_id) = 1),
p AS (SELECT name_id, ' ' || trim(regexp_replace(name, '\W+', ' ', 'g')) || ' ' AS wanted FROM n),
t AS (SELECT doc_id, ' ' || regexp_replace({_FOLD.format("text")}, '\W+', ' ', 'g') || ' ' AS padded FROM documents)
SELECT doc_id AS text_id, name_id FROM t JOIN p ON contains(padded, wanted)""")
def mesh_mentions(spark, sf):
    """Benchmark passages' first four words as names in documents."""
    names = table(spark, sf, "benchmark").select(F.col("item_id").alias("name_id"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("name"))
    return mesh.mentions(table(spark, sf, "documents", "doc_id", "text").withColumnRenamed("doc_id", "text_id"), names)


_GRID = """g AS (SELECT n_nationkey AS nation, seg AS metric, CASE WHEN n_nationkey % 6 = 5 THEN 'historical' ELSE 'current' END AS role FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer)),
h AS (SELECT c_nationkey AS nation, c_mktsegment AS metric, count(*) AS sample, count(*) FILTER (c_acctbal > 0) AS observed, count(*) FILTER (c_acctbal > 9000) AS fresh FROM customer GROUP BY 1, 2),
e AS (SELECT g.*, CASE WHEN nation % 5 = 4 AND metric = 'BUILDING' THEN 'unsupported' WHEN nation % 7 = 6 THEN 'token_required' WHEN sample IS NULL THEN 'not_probed' WHEN nation % 11 = 10 THEN 'token_required' WHEN nation % 13 = 12 THEN 'not_probed' WHEN observed = 0 THEN 'missing'
  WHEN role = 'current' AND fresh = 0 THEN 'previous_season' WHEN observed < CASE WHEN nation % 2 = 0 THEN observed ELSE sample END THEN 'partial' WHEN role = 'historical' THEN 'historical_only' WHEN metric = 'MACHINERY' THEN 'partial' ELSE 'current_available' END AS state FROM g LEFT JOIN h USING (nation, metric))"""
STATES = ("unsupported", "token_required", "not_probed", "missing", "previous_season", "partial", "historical_only", "current_available")


def coverage(spark, sf):
    """nation, metric, role, state: every other nation's probes count what they observe as their sample."""
    c = table(spark, sf, "customer", "c_nationkey", "c_mktsegment", "c_acctbal")
    n, metric, sample = F.col("nation"), F.col("metric"), F.col("sample")
    grid = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation")).crossJoin(c.select(F.col("c_mktsegment").alias("metric")).distinct())  # two dimensions' values
    probes = c.groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("metric")).agg(F.count("*").alias("sample"), F.count_if(F.col("c_acctbal") > 0).alias("observed"), F.count_if(F.col("c_acctbal") > 9000).alias("fresh"))
    joined = grid.join(probes, ["nation", "metric"], "left").withColumn("role", F.when(n % 6 == 5, "historical").otherwise("current"))
    reliability = F.when((n % 5 == 4) & (metric == "BUILDING"), F.lit(None)).when(metric == "MACHINERY", "partial").otherwise("full")
    probe = F.when(sample.isNull(), F.lit(None)).when(n % 11 == 10, "skipped_token_required").when(n % 13 == 12, "error").otherwise("ok")
    state = mesh.coverage_state(reliability, n % 7 == 6, probe, F.col("role"), F.when(n % 2 == 0, F.col("observed")).otherwise(sample), F.col("observed"), F.col("fresh") > 0)
    return joined.select("nation", "metric", "role", state.alias("state"))


@query("coverage_states", f"WITH {_GRID} SELECT nation, metric, state FROM e")
def coverage_states(spark, sf):
    return coverage(spark, sf).drop("role")


def _entries(spark, sf):
    """Two providers' entries for each requirement: every nation stands for a provider of its region."""
    regions = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").cast("string").alias("competition"))
    return coverage(spark, sf).join(regions, "nation").select("competition", F.lit("match").alias("granularity"), "metric", "role", "state")


_REQUIRED = """r AS (SELECT n_regionkey::VARCHAR AS competition, e.metric, bool_or(state = '{state}') FILTER (role = '{role}') AS has FROM e JOIN nation ON n_nationkey = nation GROUP BY 1, 2)
SELECT count(*) FILTER (coalesce(has, false)) AS numerator, count(*) AS denominator, coalesce(string_agg(competition || ':match:' || metric, ',' ORDER BY competition || ':match:' || metric) FILTER (NOT coalesce(has, false)), '') AS gaps FROM r"""


def _fraction(rows):
    return mesh.coverage_fraction(rows).select("numerator", "denominator", F.array_join("gap_keys", ",").alias("gaps"))


@query("coverage_product", f"WITH {_GRID}, {_REQUIRED.format(state='current_available', role='current')}")
def coverage_product(spark, sf):
    entries = _entries(spark, sf)
    return _fraction(mesh.requirements(entries, entries))


@query("coverage_historical", f"WITH {_GRID}, {_REQUIRED.format(state='historical_only', role='historical')}")
def coverage_historical(spark, sf):
    entries = _entries(spark, sf)
    return _fraction(mesh.requirements(entries, entries, "historical"))


@query("coverage_recent", f"WITH {_GRID}, {_REQUIRED.format(state='previous_season', role='current')}")
def coverage_recent(spark, sf):
    entries = _entries(spark, sf)
    return _fraction(mesh.recent_requirements(entries, entries))


@query("coverage_matrix", f"""WITH {_GRID} SELECT metric, {", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in STATES)} FROM e GROUP BY 1""")
def coverage_matrix(spark, sf):
    return coverage(spark, sf).groupBy("metric").agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES))


@query("coverage_probes", """
WITH o AS (SELECT l_returnflag AS source, CASE l_linenumber % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'team' ELSE 'player' END AS entity_type, CASE l_linenumber % 3 WHEN 0 THEN l_orderkey::VARCHAR WHEN 1 THEN l_suppkey::VARCHAR ELSE l_partkey::VARCHAR END AS entity_id, CASE WHEN l_orderkey % 4 > 0 THEN l_orderkey END AS match_id, CASE WHEN l_discount > 0.05 THEN 'goals' ELSE 'shots' END AS metric FROM lineitem),
t AS (SELECT source, count(DISTINCT entity_id) FILTER (entity_type = 'match') AS matches, count(DISTINCT (entity_id, match_id)) FILTER (entity_type = 'team' AND match_id IS NOT NULL) AS slots FROM o GROUP BY 1)
SELECT source, metric, CASE entity_type WHEN 'match' THEN 'match' WHEN 'team' THEN 'team_match' ELSE 'player_match' END AS granularity, count(*) AS observed, CASE entity_type WHEN 'match' THEN any_value(matches) WHEN 'team' THEN any_value(slots) ELSE count(DISTINCT entity_id) END AS sample FROM o JOIN t USING (source) GROUP BY source, metric, entity_type""")
def coverage_probes(spark, sf):
    kind = F.col("l_linenumber") % 3
    rows = table(spark, sf, "lineitem", "l_returnflag", "l_linenumber", "l_orderkey", "l_suppkey", "l_partkey", "l_discount").select(
        F.col("l_returnflag").alias("source"), F.when(kind == 0, "match").when(kind == 1, "team").otherwise("player").alias("entity_type"), F.when(kind == 0, F.col("l_orderkey")).when(kind == 1, F.col("l_suppkey")).otherwise(F.col("l_partkey")).cast("string").alias("entity_id"),
        F.when(F.col("l_orderkey") % 4 > 0, F.col("l_orderkey")).alias("match_id"), F.when(F.col("l_discount") > 0.05, "goals").otherwise("shots").alias("metric"))
    return mesh.probe_summary(rows)


#: Events as feed B's: clicks are passes (accurate from k = 50), purchases shots, signups duels.
_FEED_B = {"click": ("Pass", "Simple pass"), "purchase": ("Shot", "Shot"), "signup": ("Duel", "Air duel"), "view": ("Others on the ball", "Clearance"), "error": ("Foul", "Foul")}


def feed_b(spark, sf):
    e = table(spark, sf, "events", "user_id", "event_id", "event_type", "props", "value")
    k = F.get_json_object("props", "$.k").cast("int")
    names = [F.coalesce(*(F.when(F.col("event_type") == t, F.lit(n[i])) for t, n in _FEED_B.items())) for i in (0, 1)]
    tags = F.array_compact(F.array(F.when(k >= 50, F.struct(F.lit(1801).alias("id"))), F.when(k >= 80, F.struct(F.lit(101).alias("id"))), F.when(k % 2 == 0, F.struct(F.lit(703).alias("id"))), F.when(k % 10 == 0, F.struct(F.lit(1702).alias("id")))))
    return e.select((F.col("event_id") % 40).alias("matchId"), F.when(F.col("user_id") % 29 == 0, 0).otherwise(F.col("user_id")).alias("playerId"), (F.col("user_id") % 2 + 1).alias("teamId"), names[0].alias("eventName"), names[1].alias("subEventName"), tags.alias("tags"))


_B = """b AS (SELECT event_id % 40 AS match_id, CASE WHEN user_id % 29 = 0 THEN 0 ELSE user_id END AS player_id, user_id % 2 + 1 AS team_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


@query("event_counters", f"""WITH {_B} SELECT match_id, player_id, count(*) AS touches, count(*) FILTER (event_type = 'click') AS passes_total, count(*) FILTER (event_type = 'click' AND k >= 50) AS passes_accurate, count(*) FILTER (event_type = 'purchase') AS shots_total,
  count(*) FILTER (event_type = 'purchase' AND k >= 50) AS shots_on_target, count(*) FILTER (event_type = 'purchase' AND k >= 80) AS goals, count(*) FILTER (event_type = 'signup') AS aerial_duels, count(*) FILTER (event_type = 'signup' AND k % 2 = 0) AS duels_won, count(*) FILTER (event_type = 'view') AS clearances,
  count(*) FILTER (event_type = 'error') AS fouls_committed, count(*) FILTER (event_type = 'error' AND k % 10 = 0) AS yellow_cards FROM b WHERE player_id <> 0 GROUP BY 1, 2""")
def event_counters(spark, sf):
    """All counters of nested events in one pass; player 0 stands for nobody."""
    from ..sources.event_feeds import players_b

    return players_b(feed_b(spark, sf)).select("match_id", "player_id", "touches", "passes_total", "passes_accurate", "shots_total", "shots_on_target", "goals", "aerial_duels", "duels_won", "clearances", "fouls_committed", "yellow_cards")


@query("event_teams", f"""WITH {_B}, t AS (SELECT match_id, team_id, count(*) FILTER (event_type = 'purchase') AS shots, count(*) FILTER (event_type = 'purchase' AND k >= 50) AS on_target, count(*) FILTER (event_type = 'click') AS passes FROM b GROUP BY 1, 2)
SELECT t.match_id, t.team_id, t.shots AS shots_total, t.on_target AS shots_on_target, t.passes AS passes_total, o.shots AS shots_allowed, o.on_target AS shots_on_target_allowed FROM t LEFT JOIN t o ON o.match_id = t.match_id AND o.team_id <> t.team_id""")
def event_teams(spark, sf):
    from ..sources.event_feeds import teams_b

    return teams_b(feed_b(spark, sf)).select("match_id", "team_id", "shots_total", "shots_on_target", "passes_total", "shots_allowed", "shots_on_target_allowed")


def _roster(spark, sf):
    """Who took part: customers whose nation is even, in each of three matches."""
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey").where("c_custkey <= 3 * c_nationkey + 30")
    return c.select(F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("match_id"), F.lit(1).cast("long").alias("team_id"), F.col("c_custkey").alias("player_id"), (F.col("c_custkey") % 3 == 0).alias("started"), (F.col("c_nationkey") % 2 == 0).alias("participated"), (F.col("c_custkey") % 10 == 0).alias("goalkeeper"))


_FILLED = f"""{_B}, n AS (SELECT match_id, player_id, count(*) AS touches, count(*) FILTER (event_type = 'click') AS passes, count(*) FILTER (event_type = 'purchase' AND k >= 80) AS goals FROM b WHERE player_id <> 0 GROUP BY 1, 2),
r AS (SELECT m.match_id, c_custkey AS player_id, c_custkey % 3 = 0 AS started FROM customer, (VALUES (0), (1), (2)) m(match_id) WHERE c_custkey <= 3 * c_nationkey + 30 AND c_nationkey % 2 = 0),
z AS (SELECT r.*, coalesce(touches, 0) AS touches, coalesce(passes, 0) AS passes, coalesce(goals, 0) AS goals FROM r LEFT JOIN n USING (match_id, player_id))"""


@query("event_zero_fill", f"WITH {_FILLED} SELECT match_id::BIGINT AS match_id, player_id, touches, passes AS passes_total, goals FROM z")
def event_zero_fill(spark, sf):
    """Noughts for those who took part; nothing for those who didn't."""
    from ..sources.event_feeds import players_b, zero_filled

    return zero_filled(_roster(spark, sf), players_b(feed_b(spark, sf))).select("match_id", "player_id", "touches", "passes_total", "goals")


@query("event_seasons", f"WITH {_FILLED} SELECT player_id, count(*) AS appearances, count(*) FILTER (started) AS starts, count(*) FILTER (NOT started) AS sub_appearances, sum(goals)::BIGINT AS goals, sum(passes)::BIGINT AS passes_total FROM z GROUP BY 1")
def event_seasons(spark, sf):
    from ..sources.event_feeds import players_b, season_totals, zero_filled

    return season_totals(zero_filled(_roster(spark, sf), players_b(feed_b(spark, sf))), ["player_id"], ["goals", "passes_total"])


@query("event_outside_scope", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' OR year(o_orderdate) <> 1997")
def event_outside_scope(spark, sf):
    from ..sources.event_feeds import outside_scope

    rows = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").withColumn("season", F.year("o_orderdate"))
    return outside_scope(rows, "o_orderstatus", "season", "F", 1997).select("o_orderkey")
