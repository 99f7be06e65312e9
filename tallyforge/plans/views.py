"""The product's views over scores and findings, the pages that read them, and the watchlist.

Scores have a context (real or demo), a model version, a scope, and when they
were made; a scope is a year's, and the last one made is active.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import half_even
from ..operators.entity_scores import LEAST_EXPOSURE
from ..operators.scoring import RANKING_CONFIDENCE
from ..sources import sinks
from ..sources.tables import table, views
from .registry import query

#: The models whose scores products show.
PLAYER_MODEL, TEAM_MODEL = "player-v2.0", "team-v2.0"


def _detail(scores: DataFrame, model: str) -> DataFrame:
    return scores.where((F.col("data_context") == "real") & (F.col("model_version") == model))


def _least(window: Column) -> Column:
    out = F.lit(2147483647)
    for w, m in LEAST_EXPOSURE.items():
        out = F.when(window == w, m).otherwise(out)
    return out


def _active(detail: DataFrame) -> DataFrame:
    """The scope that was made last; of several made at once the last by name. One row, or none."""
    return detail.groupBy("scope_key", "model_version").agg(F.max("calculated_at").alias("calculated_at")).orderBy(F.desc("calculated_at"), F.desc("scope_key")).limit(1)


def _found(findings: DataFrame, kind: str, model: str, active: DataFrame) -> DataFrame:
    own = findings.where((F.col("entity_type") == kind) & (F.col("data_context") == "real") & (F.col("source_model_version") == model))
    return own.join(F.broadcast(active.select("scope_key")), "scope_key").select(*findings.columns)  # one row


def product_views(players: DataFrame, teams: DataFrame, findings: DataFrame, watchlist: DataFrame) -> dict[str, DataFrame]:
    """The ten views that products read.

    players, teams: entity, window_key, scope_key, data_context, model_version,
    calculated_at, evidence_state, overall_score, confidence, minutes.
    findings: entity, entity_type, scope_key, data_context, source_model_version.
    watchlist: player_id, category, reason, created_at.
    """
    player, team = _detail(players, PLAYER_MODEL), _detail(teams, TEAM_MODEL)
    scopes = {"player": _active(player), "team": _active(team)}
    return {
        "product_player_score_snapshots": player.where("evidence_state = 'ready' and overall_score is not null"),
        "product_player_detail_v2": player,
        "product_player_ranking_candidates_v2": player.where((F.col("confidence") >= RANKING_CONFIDENCE) & (F.col("minutes") >= _least(F.col("window_key")))),
        "product_team_detail_v2": team,
        "product_team_ranking_candidates_v2": team.where(F.col("confidence") >= RANKING_CONFIDENCE),
        "product_player_watchlist_v2": watchlist.join(player.select(F.col("entity").alias("player_id")).distinct(), "player_id", "left_semi"),
        "product_active_player_scope_v2": scopes["player"],
        "product_active_team_scope_v2": scopes["team"],
        "product_player_diagnostic_findings_v2": _found(findings, "player", PLAYER_MODEL, scopes["player"]),
        "product_team_diagnostic_findings_v2": _found(findings, "team", TEAM_MODEL, scopes["team"]),
    }


# -- the driver's tables as stored scores --------------------------------------------------

_K = "o_orderkey"
STORED = f"""p AS (SELECT o_custkey AS entity, CASE {_K} % 4 WHEN 0 THEN 'last_3' WHEN 1 THEN 'last_5' WHEN 2 THEN 'last_10' ELSE 'season' END AS window_key, year(o_orderdate)::VARCHAR AS scope_key, CASE WHEN {_K} % 7 = 0 THEN 'demo' ELSE 'real' END AS data_context, CASE WHEN {_K} % 5 = 0 THEN 'player-v1.0' ELSE 'player-v2.0' END AS model_version,
  o_orderdate AS calculated_at, CASE {_K} % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'partial' ELSE 'insufficient_evidence' END AS evidence_state, CASE WHEN {_K} % 3 < 2 THEN ({_K} % 101)::DOUBLE END AS overall_score, ({_K} % 100) / 100.0::DOUBLE AS confidence, {_K} % 600 AS minutes, {_K} AS id, o_orderpriority AS position FROM orders),
t AS (SELECT o_custkey % 50 AS entity, CASE {_K} % 2 WHEN 0 THEN 'last_5' ELSE 'season' END AS window_key, year(o_orderdate)::VARCHAR AS scope_key, CASE WHEN {_K} % 7 = 0 THEN 'demo' ELSE 'real' END AS data_context, CASE WHEN {_K} % 5 = 0 THEN 'team-v1.0' ELSE 'team-v2.0' END AS model_version, o_orderdate AS calculated_at, 'partial' AS evidence_state, ({_K} % 89)::DOUBLE AS overall_score, ({_K} % 97) / 100.0::DOUBLE AS confidence, {_K} % 600 AS minutes, {_K} AS id FROM orders),
f AS (SELECT o_custkey AS entity, CASE {_K} % 2 WHEN 0 THEN 'player' ELSE 'team' END AS entity_type, year(o_orderdate)::VARCHAR AS scope_key, CASE WHEN {_K} % 7 = 0 THEN 'demo' ELSE 'real' END AS data_context, CASE {_K} % 2 WHEN 0 THEN 'player-v2.0' ELSE 'team-v2.0' END AS source_model_version, CASE {_K} % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'notable' ELSE 'info' END AS severity, {_K} AS id FROM orders),
wl AS (SELECT user_id AS player_id, arg_max(event_type, (ts, event_id)) AS action, arg_max(event_id, (ts, event_id)) AS id FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1),
pd AS (SELECT * FROM p WHERE data_context = 'real' AND model_version = 'player-v2.0'), td AS (SELECT * FROM t WHERE data_context = 'real' AND model_version = 'team-v2.0'),
pa AS (SELECT scope_key, max(calculated_at) AS at FROM pd GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1), ta AS (SELECT scope_key, max(calculated_at) AS at FROM td GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1)"""


def stored(spark, sf):
    """players, teams, findings and the watchlist's log."""
    o, k = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), F.col(_K)
    both = {"scope_key": F.year("o_orderdate").cast("string"), "data_context": F.when(k % 7 == 0, "demo").otherwise("real"), "calculated_at": F.col("o_orderdate"), "minutes": k % 600, "id": k}
    players = o.select(F.col("o_custkey").alias("entity"), F.when(k % 4 == 0, "last_3").when(k % 4 == 1, "last_5").when(k % 4 == 2, "last_10").otherwise("season").alias("window_key"), F.when(k % 5 == 0, "player-v1.0").otherwise(PLAYER_MODEL).alias("model_version"),
        F.when(k % 3 == 0, "ready").when(k % 3 == 1, "partial").otherwise("insufficient_evidence").alias("evidence_state"), F.when(k % 3 < 2, (k % 101).cast("double")).alias("overall_score"), ((k % 100) / F.lit(100.0)).alias("confidence"), F.col("o_orderpriority").alias("position"), *(v.alias(c) for c, v in both.items()))
    teams = o.select((F.col("o_custkey") % 50).alias("entity"), F.when(k % 2 == 0, "last_5").otherwise("season").alias("window_key"), F.when(k % 5 == 0, "team-v1.0").otherwise(TEAM_MODEL).alias("model_version"), F.lit("partial").alias("evidence_state"), (k % 89).cast("double").alias("overall_score"), ((k % 97) / F.lit(100.0)).alias("confidence"), *(v.alias(c) for c, v in both.items()))
    findings = o.select(F.col("o_custkey").alias("entity"), F.when(k % 2 == 0, "player").otherwise("team").alias("entity_type"), F.when(k % 2 == 0, PLAYER_MODEL).otherwise(TEAM_MODEL).alias("source_model_version"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "notable").otherwise("info").alias("severity"), *(v.alias(c) for c, v in both.items() if c in ("scope_key", "data_context", "id")))
    e = table(spark, sf, "events", "user_id", "event_id", "event_type", "ts").where("event_type in ('signup', 'error')")
    log = e.select(F.col("user_id").alias("player_id"), F.when(F.col("event_type") == "signup", "add").otherwise("remove").alias("action"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("reason"), F.struct("ts", "event_id").alias("at"))
    return players, teams, findings, sinks.watchlist(log)


def shown(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    found = product_views(*stored(spark, sf))
    views(found)
    return found


@query("views_rows", f"""WITH {STORED}
SELECT 'product_player_score_snapshots' AS view, count(*) AS n, sum(id)::BIGINT AS ids FROM pd WHERE evidence_state = 'ready' AND overall_score IS NOT NULL
UNION ALL SELECT 'product_player_detail_v2', count(*), sum(id)::BIGINT FROM pd
UNION ALL SELECT 'product_player_ranking_candidates_v2', count(*), sum(id)::BIGINT FROM pd WHERE confidence >= 0.40 AND minutes >= CASE window_key WHEN 'last_3' THEN 90 WHEN 'last_5' THEN 180 WHEN 'last_10' THEN 270 ELSE 450 END
UNION ALL SELECT 'product_team_detail_v2', count(*), sum(id)::BIGINT FROM td
UNION ALL SELECT 'product_team_ranking_candidates_v2', count(*), sum(id)::BIGINT FROM td WHERE confidence >= 0.40
UNION ALL SELECT 'product_player_watchlist_v2', count(*), sum(player_id)::BIGINT FROM wl WHERE action = 'signup' AND player_id IN (SELECT entity FROM pd)
UNION ALL SELECT 'product_active_player_scope_v2', count(*), sum(scope_key::INTEGER)::BIGINT FROM pa UNION ALL SELECT 'product_active_team_scope_v2', count(*), sum(scope_key::INTEGER)::BIGINT FROM ta
UNION ALL SELECT 'product_player_diagnostic_findings_v2', count(*), sum(id)::BIGINT FROM f WHERE entity_type = 'player' AND data_context = 'real' AND scope_key IN (SELECT scope_key FROM pa)
UNION ALL SELECT 'product_team_diagnostic_findings_v2', count(*), sum(id)::BIGINT FROM f WHERE entity_type = 'team' AND data_context = 'real' AND scope_key IN (SELECT scope_key FROM ta)""")
def views_rows(spark, sf):
    """Each view's rows and the sum of their keys, read by SQL from the views' names."""
    keys = {"product_player_watchlist_v2": "player_id", "product_active_player_scope_v2": "CAST(scope_key AS INT)", "product_active_team_scope_v2": "CAST(scope_key AS INT)"}
    names = list(shown(spark, sf))
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS view, count(*) AS n, sum({keys.get(n, 'id')}) AS ids FROM {n}" for n in names))


@query("page_home", f"""WITH {STORED},
a AS (SELECT * FROM pd WHERE scope_key IN (SELECT scope_key FROM pa)),
s AS (SELECT entity, max(overall_score) FILTER (window_key = 'season') AS season, max(overall_score) FILTER (window_key = 'last_5') AS form FROM a GROUP BY 1),
b AS (SELECT 'best' AS list, entity, season AS score FROM s WHERE season IS NOT NULL ORDER BY season DESC, entity LIMIT 10), r AS (SELECT 'rising' AS list, entity, form - season AS score FROM s WHERE form - season IS NOT NULL ORDER BY form - season DESC, entity LIMIT 10)
SELECT * FROM b UNION ALL SELECT * FROM r""")
def page_home(spark, sf):
    """The ten best of the active scope and the ten whose form is most above their season."""
    v = shown(spark, sf)
    own = v["product_player_detail_v2"].join(F.broadcast(v["product_active_player_scope_v2"].select("scope_key")), "scope_key")  # one row
    wide = own.groupBy("entity").agg(*(F.max(F.when(F.col("window_key") == w, F.col("overall_score"))).alias(c) for w, c in (("season", "season"), ("last_5", "form"))))
    lists = [wide.select(F.lit(name).alias("list"), "entity", score.alias("score")).where("score is not null").orderBy(F.desc("score"), "entity").limit(10) for name, score in (("best", F.col("season")), ("rising", F.col("form") - F.col("season")))]
    return lists[0].unionByName(lists[1])


@query("page_rankings_v1", f"""WITH {STORED},
l AS (SELECT o_custkey AS entity, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS position FROM orders GROUP BY 1)
SELECT p.entity, l.position, scope_key, max(overall_score) AS score FROM p JOIN l USING (entity) WHERE model_version = 'player-v1.0' AND l.position = '1-URGENT' AND window_key = 'season' GROUP BY 1, 2, 3 ORDER BY score DESC NULLS LAST, p.entity, scope_key LIMIT 25""")
def page_rankings_v1(spark, sf):
    """Each player with the position of the latest match; the filter comes before the limit, so that no list is short."""
    players = stored(spark, sf)[0].where(f"model_version = 'player-v1.0' and window_key = 'season'").drop("position")
    last = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority").groupBy(F.col("o_custkey").alias("entity")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("position")).where("position = '1-URGENT'")
    return players.join(last, "entity").groupBy("entity", "position", "scope_key").agg(F.max("overall_score").alias("score")).orderBy(F.desc_nulls_last("score"), "entity", "scope_key").limit(25)


def by_dimension(scores: DataFrame, dimension: str, limit: int = 25) -> DataFrame:
    """The best of a dimension: overall, or one of the map dimension_scores; those without it are left out."""
    value = F.col("overall_score") if dimension == "overall" else F.try_element_at("dimension_scores", F.lit(dimension))
    return scores.withColumn("value", value).where("value is not null").orderBy(F.desc("value"), F.desc("confidence"), "entity", "id").limit(limit)


@query("page_dimension_rankings", f"""WITH {STORED}, d AS (SELECT *, CASE WHEN id % 4 > 0 THEN (id % 83)::DOUBLE END AS passing FROM pd WHERE confidence >= 0.4 AND minutes >= CASE window_key WHEN 'last_3' THEN 90 WHEN 'last_5' THEN 180 WHEN 'last_10' THEN 270 ELSE 450 END)
SELECT 'passing' AS dimension, * FROM (SELECT entity, id, passing AS value FROM d WHERE passing IS NOT NULL ORDER BY passing DESC, confidence DESC, entity, id LIMIT 25) UNION ALL SELECT 'overall', * FROM (SELECT entity, id, overall_score FROM d WHERE overall_score IS NOT NULL ORDER BY overall_score DESC, confidence DESC, entity, id LIMIT 25)""")
def page_dimension_rankings(spark, sf):
    k = F.col("id")
    rows = shown(spark, sf)["product_player_ranking_candidates_v2"].withColumn("dimension_scores", F.when(k % 4 > 0, F.create_map(F.lit("passing"), (k % 83).cast("double"))))
    lists = [by_dimension(rows, d).select(F.lit(d).alias("dimension"), "entity", "id", "value") for d in ("passing", "overall")]
    return lists[0].unionByName(lists[1])


@query("page_player_detail", f"""WITH {STORED}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, window_key ORDER BY calculated_at DESC, id DESC) AS rn FROM pd), l AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY calculated_at DESC, id DESC) AS rn FROM pd),
x AS (SELECT entity, string_agg(window_key || '=' || coalesce(round(overall_score, 1)::VARCHAR, '-'), ',' ORDER BY CASE window_key WHEN 'season' THEN 1 WHEN 'last_10' THEN 2 WHEN 'last_5' THEN 3 ELSE 4 END) AS windows FROM r WHERE rn = 1 GROUP BY 1)
SELECT l.entity, l.scope_key, l.id, l.confidence, windows, c_name AS name FROM l JOIN x USING (entity) JOIN customer ON c_custkey = l.entity WHERE rn = 1""")
def page_player_detail(spark, sf):
    """A player's latest row, and the latest score of each window in the page's order."""
    d = shown(spark, sf)["product_player_detail_v2"]
    newest = F.struct("calculated_at", "id")
    last = d.groupBy("entity").agg(F.max_by(F.struct("scope_key", "id", "confidence"), newest).alias("x")).select("entity", "x.*")
    w = F.col("window_key")
    each = d.groupBy("entity", "window_key").agg(F.max_by(F.struct("overall_score"), newest)["overall_score"].alias("score"))
    said = F.concat(w, F.lit("="), F.coalesce(F.round("score", 1).cast("string"), F.lit("-")))
    lists = each.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(F.when(w == "season", 1).when(w == "last_10", 2).when(w == "last_5", 3).otherwise(4).alias("o"), said.alias("s")))).alias("l"))
    names = table(spark, sf, "customer", "c_custkey", "c_name").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"))
    return last.join(lists, "entity").join(names, "entity").select("entity", "scope_key", "id", "confidence", F.array_join(F.transform("l", lambda x: x["s"]), ",").alias("windows"), "name")


@query("page_team_lab", f"""WITH {STORED}, s AS (SELECT entity, max(overall_score) FILTER (window_key = 'season') AS season, max(overall_score) FILTER (window_key = 'last_5') AS form, count(*) AS n FROM td GROUP BY 1)
SELECT entity, season, form, n, (SELECT count(*) FROM f WHERE f.entity_type = 'team' AND f.entity % 50 = s.entity) AS findings FROM s""")
def page_team_lab(spark, sf):
    """Season and form side by side, with the number of a team's findings."""
    d, findings = shown(spark, sf)["product_team_detail_v2"], stored(spark, sf)[2]
    wide = d.groupBy("entity").agg(*(F.max(F.when(F.col("window_key") == w, F.col("overall_score"))).alias(c) for w, c in (("season", "season"), ("last_5", "form"))), F.count("*").alias("n"))
    counts = findings.where("entity_type = 'team'").groupBy((F.col("entity") % 50).alias("entity")).agg(F.count("*").alias("findings"))
    return wide.join(counts, "entity", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


@query("page_diagnostics", f"""WITH {STORED}, x AS (SELECT * FROM f WHERE data_context = 'real' AND ((entity_type = 'player' AND scope_key IN (SELECT scope_key FROM pa)) OR (entity_type = 'team' AND scope_key IN (SELECT scope_key FROM ta))))
SELECT entity_type, x.entity, severity, id, CASE WHEN entity_type = 'player' THEN c_name ELSE s_name END AS name FROM x LEFT JOIN customer ON entity_type = 'player' AND c_custkey = x.entity LEFT JOIN supplier ON entity_type = 'team' AND s_suppkey = x.entity
ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'notable' THEN 2 ELSE 3 END, id LIMIT 100""")
def page_diagnostics(spark, sf):
    """Findings of players and teams in one list, the gravest first, each with its name by what it is of."""
    v = shown(spark, sf)
    both = v["product_player_diagnostic_findings_v2"].unionByName(v["product_team_diagnostic_findings_v2"])
    people = table(spark, sf, "customer", "c_custkey", "c_name").select(F.lit("player").alias("entity_type"), F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"))
    clubs = table(spark, sf, "supplier", "s_suppkey", "s_name").select(F.lit("team").alias("entity_type"), F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"))
    rank = F.when(F.col("severity") == "high", 1).when(F.col("severity") == "notable", 2).otherwise(3)
    return both.join(people.unionByName(clubs), ["entity_type", "entity"], "left").orderBy(rank, "id").limit(100).select("entity_type", "entity", "severity", "id", "name")


@query("page_season_validation", f"""WITH {STORED} SELECT scope_key, model_version, count(*) AS rows, count(DISTINCT entity) AS entities, count(*) FILTER (evidence_state = 'ready') AS ready, round(sum(confidence), 4) AS confidence, max(calculated_at)::DATE::VARCHAR AS last FROM p WHERE data_context = 'real' GROUP BY 1, 2""")
def page_season_validation(spark, sf):
    rows = stored(spark, sf)[0].where("data_context = 'real'")
    return rows.groupBy("scope_key", "model_version").agg(F.count("*").alias("rows"), F.count_distinct("entity").alias("entities"), F.count_if(F.col("evidence_state") == "ready").alias("ready"), F.round(F.sum("confidence"), 4).alias("confidence"), F.date_format(F.max("calculated_at"), "yyyy-MM-dd").alias("last"))


@query("page_severity_summary", f"""WITH {STORED}, n AS (SELECT severity, count(*) AS n FROM f GROUP BY 1) SELECT string_agg(severity || ':' || n, ', ' ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'notable' THEN 2 ELSE 3 END) AS summary FROM n""")
def page_severity_summary(spark, sf):
    """One line: how many findings there are, the gravest first."""
    counts = stored(spark, sf)[2].groupBy("severity").agg(F.count("*").alias("n"))
    order = F.when(F.col("severity") == "high", 1).when(F.col("severity") == "notable", 2).otherwise(3)
    return counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat_ws(":", "severity", F.col("n").cast("string")).alias("s")))), lambda x: x["s"]), ", ").alias("summary"))


@query("page_evidence", f"""WITH {STORED}, e AS (SELECT source, lang, doc_id, n_chars FROM documents), k AS (SELECT source, string_agg(doc_id::VARCHAR || ':' || n_chars, ',' ORDER BY doc_id) FILTER (n_chars > 5000) AS long_texts FROM e GROUP BY 1)
SELECT e.source, count(*) AS texts, count(*) FILTER (lang = 'en') AS english, coalesce(any_value(long_texts), '') AS long_texts FROM e JOIN k USING (source) WHERE e.source ILIKE '%1%' OR EXISTS (SELECT 1 FROM e x WHERE x.source = e.source AND x.n_chars > 20000) GROUP BY 1""")
def page_evidence(spark, sf):
    """Sources found by name or by having a very long text, with their long texts as one ordered list."""
    d = table(spark, sf, "documents", "doc_id", "source", "lang", "n_chars")
    big = d.where("n_chars > 20000").select("source").distinct().withColumn("_big", F.lit(True))
    listed = F.array_sort(F.collect_list(F.when(F.col("n_chars") > 5000, F.struct("doc_id", "n_chars"))))
    found = d.groupBy("source").agg(F.count("*").alias("texts"), F.count_if(F.col("lang") == "en").alias("english"), listed.alias("l")).join(big, "source", "left")
    return found.where(F.col("source").ilike("%1%") | F.col("_big")).select("source", "texts", "english", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["n_chars"].cast("string"))), ",").alias("long_texts"))


@query("page_context", f"""WITH {STORED} SELECT entity, id, severity FROM f WHERE data_context = 'real' AND entity_type = 'player' AND scope_key IN (SELECT scope_key FROM pa) ORDER BY id DESC LIMIT 20""")
def page_context(spark, sf):
    """The newest findings of the last scope that was made."""
    return shown(spark, sf)["product_player_diagnostic_findings_v2"].orderBy(F.desc("id")).limit(20).select("entity", "id", "severity")


@query("watchlist_entries", f"WITH {STORED} SELECT player_id, id FROM wl WHERE action = 'signup'")
def watchlist_entries(spark, sf):
    """The log of additions and removals folded to who is on the list."""
    return stored(spark, sf)[3].select("player_id", F.col("created_at.event_id").alias("id"))


@query("f_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 2) AS a, round_even(l_extendedprice, 0) AS b, round_even(-l_quantity / 16, 3) AS c FROM lineitem")
def f_half_even(spark, sf):
    """Published scores: eighths and sixteenths tie, and go to the even neighbour."""
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", half_even(q / 8, 2).alias("a"), half_even(F.col("l_extendedprice"), 0).alias("b"), half_even(-q / 16, 3).alias("c"))
