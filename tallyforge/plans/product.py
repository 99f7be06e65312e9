"""Read queries: rankings, details, listings, health, and the checks of what is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import elo
from ..sources.tables import table
from .domain import _SCORES, ELO, entity_scores_of
from .registry import query
from .relational import SIDES, matches


@query("product_rankings", f"""WITH {_SCORES} SELECT s.entity, c_name AS name, o_orderpriority AS position, round(overall, 6) AS overall FROM scores s JOIN customer ON c_custkey = s.entity
LEFT JOIN (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) l ON o_custkey = s.entity AND rn = 1
WHERE window_key = 'last_10' AND o_orderpriority = '1-URGENT' ORDER BY round(overall, 9) DESC, s.entity LIMIT 25""")
def product_rankings(spark, sf):
    """Filters come before the limit, so that a position's list is never short."""
    last = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority").groupBy(F.col("o_custkey").alias("entity")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("position"))
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"))
    found = entity_scores_of(spark, sf).where("window_key = 'last_10'").join(last.where("position = '1-URGENT'"), "entity").join(names, "entity")
    return found.orderBy(F.round("overall", 9).desc(), "entity").limit(25).select("entity", "name", "position", F.round("overall", 6).alias("overall"))


@query("product_detail", f"""WITH {_SCORES} SELECT entity, round(max(overall) FILTER (window_key = 'last_5'), 6) AS form, round(max(overall) FILTER (window_key = 'season'), 6) AS season, max(appearances) AS appearances FROM scores GROUP BY 1""")
def product_detail(spark, sf):
    rows = entity_scores_of(spark, sf)
    return rows.groupBy("entity").agg(*(F.round(F.max(F.when(F.col("window_key") == w, F.col("overall"))), 6).alias(c) for w, c in (("last_5", "form"), ("season", "season"))), F.max("appearances").alias("appearances"))


@query("product_directory", "SELECT n_name AS competition, count(*) AS teams, min(s_name) AS first, max(s_name) AS last FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def product_directory(spark, sf):
    s = table(spark, sf, "supplier", "s_name", "s_nationkey").join(table(spark, sf, "nation", "n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy(F.col("n_name").alias("competition")).agg(F.count("*").alias("teams"), F.min("s_name").alias("first"), F.max("s_name").alias("last"))


@query("product_watch_candidates", """SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 8000 AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'signup') ORDER BY c_acctbal DESC, c_custkey LIMIT 50""")
def product_watch_candidates(spark, sf):
    listed = table(spark, sf, "events", "user_id", "event_type").where("event_type = 'signup'").select(F.col("user_id").alias("c_custkey"))
    return table(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal").where("c_acctbal > 8000").join(listed, "c_custkey", "left_anti").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "c_name")


@query("product_evidence_page", """SELECT source, count(*) AS texts, count(*) FILTER (n_chars > 2000) AS long_texts, count(DISTINCT lang) AS languages, string_agg(DISTINCT lang, ',' ORDER BY lang) AS names FROM documents GROUP BY 1""")
def product_evidence_page(spark, sf):
    return table(spark, sf, "documents", "source", "n_chars", "lang").groupBy("source").agg(F.count("*").alias("texts"), F.count_if(F.col("n_chars") > 2000).alias("long_texts"), F.countDistinct("lang").alias("languages"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("names"))


@query("product_mesh_health", """SELECT s.event_type, n, coalesce(users, '') AS heavy_users FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) s LEFT JOIN
(SELECT event_type, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) FILTER (value > 99) AS users FROM events GROUP BY 1) u USING (event_type)""")
def product_mesh_health(spark, sf):
    heavy = F.array_sort(F.collect_set(F.when(F.col("value") > 99, F.col("user_id").cast("string"))))
    return table(spark, sf, "events", "event_type", "user_id", "value").groupBy("event_type").agg(F.count("*").alias("n"), F.array_join(heavy, ",").alias("heavy_users"))


@query("product_elo_series", f"""WITH RECURSIVE {ELO} SELECT season, team, strftime(kickoff, '%Y-%m') AS month, count(*) AS n, arg_max(post, (kickoff, match_id)) AS rating FROM elo GROUP BY 1, 2, 3""")
def product_elo_series(spark, sf):
    """A team's rating at the end of each month."""
    rows = elo.elo_history(matches(spark, sf), ["season"])
    return rows.groupBy("season", "team", F.date_format("kickoff", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.max_by("post", F.struct("kickoff", "match_id")).alias("rating"))


@query("check_constraints", """
SELECT 'quantity_range' AS rule, count(*) FILTER (NOT (l_quantity BETWEEN 1 AND 50)) AS violations FROM lineitem UNION ALL SELECT 'flag_enum', count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) FROM lineitem
UNION ALL SELECT 'order_exists', count(*) FILTER (o_orderkey IS NULL) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def check_constraints(spark, sf):
    from ..sources.sinks import violations

    lines = table(spark, sf, "lineitem", "l_orderkey", "l_quantity", "l_returnflag")
    own = violations(lines, {"quantity_range": F.col("l_quantity").between(1, 50), "flag_enum": F.col("l_returnflag").isin("A", "N", "R")})
    orphans = lines.join(table(spark, sf, "orders", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.lit("order_exists").alias("rule"), F.count("*").alias("violations"))
    return own.unionByName(orphans)


@query("check_key_conflicts", """
WITH r AS (SELECT c_custkey, 'n' || c_nationkey AS url, 'm' || (c_custkey % 400) AS external_id FROM customer WHERE c_custkey % 3 = 0), s AS (SELECT 'n' || n_nationkey AS url, 'm' || (n_nationkey * 7) AS external_id, n_nationkey AS id FROM nation)
SELECT c_custkey, count(DISTINCT s.id) AS matches FROM r JOIN s ON s.url = r.url OR s.external_id = r.external_id GROUP BY 1 HAVING count(DISTINCT s.id) > 1""")
def check_key_conflicts(spark, sf):
    """Rows that two identifiers match to several stored ones."""
    from ..sources.sinks import identity_conflicts

    k, n = F.col("c_custkey"), F.col("n_nationkey")
    rows = table(spark, sf, "customer", "c_custkey", "c_nationkey").where(k % 3 == 0).select(k, F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("url"), F.concat(F.lit("m"), (k % 400).cast("string")).alias("external_id"))
    stored = table(spark, sf, "nation", "n_nationkey").select(F.concat(F.lit("n"), n.cast("string")).alias("url"), F.concat(F.lit("m"), (n * 7).cast("string")).alias("external_id"), n.alias("id"))
    return identity_conflicts(rows, stored, ["url", "external_id"], "id").select("c_custkey", "matches")


@query("check_membership", f"WITH {SIDES} SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem LEFT JOIN matches ON match_id = l_orderkey WHERE match_id IS NULL OR l_suppkey NOT IN (home_team, away_team)")
def check_membership(spark, sf):
    """Lines whose supplier is neither side of the order's match, or whose order has none."""
    from ..sources.sinks import not_members

    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").withColumnRenamed("l_orderkey", "match_id")
    return not_members(lines, matches(spark, sf), "match_id", "l_suppkey", ["home_team", "away_team"]).select(F.col("match_id").alias("l_orderkey"), "l_linenumber", "l_suppkey")


@query("check_nulls_pass", """
SELECT 'range' AS rule, count(*) FILTER (CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END > 25) AS violations FROM lineitem UNION ALL SELECT 'known', count(*) FILTER (l_linenumber % 2 = 1) FROM lineitem""")
def check_nulls_pass(spark, sf):
    """As a CHECK does, a rule lets null pass; that a value is known is a rule of its own."""
    from ..sources.sinks import violations

    rows = table(spark, sf, "lineitem", "l_linenumber", "l_quantity").select(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("v"))
    return violations(rows, {"range": F.col("v") <= 25, "known": F.col("v").isNotNull()})


@query("check_content_address", """SELECT event_id, 'sha256/' || substr(sha256('{"k":' || json_extract_string(props, '$.k') || '}'), 1, 2) || '/' || sha256('{"k":' || json_extract_string(props, '$.k') || '}') || '.json.gz' AS address FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def check_content_address(spark, sf):
    """An address is of the JSON's canonical text, whatever its white space."""
    from ..sources.sinks import content_address

    return table(spark, sf, "events", "event_id", "props").where(F.get_json_object("props", "$.k").isNotNull()).select("event_id", content_address(F.col("props")).alias("address"))


@query("upsert_latest", """
WITH v AS (SELECT user_id, event_type, value, ts, event_id, 1 AS version FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, value, ts, event_id, 2 FROM events WHERE event_id % 2 = 1)
SELECT user_id, event_type, value, version FROM v QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY version DESC, ts DESC, event_id DESC) = 1""")
def upsert_latest(spark, sf):
    from ..sources.sinks import upserted

    e = table(spark, sf, "events", "event_id", "user_id", "event_type", "value", "ts")
    old, new = e.where("event_id % 2 = 0").withColumn("version", F.lit(1)), e.where("event_id % 2 = 1").withColumn("version", F.lit(2))
    return upserted(old, new, ["user_id", "event_type"], [F.desc("version"), F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "value", "version")
