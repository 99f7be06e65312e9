"""The relational surface: projections, filters, joins, aggregates, windows, sets, sorts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import percentile as P
from ..operators.windows import recent_windows
from ..sources.tables import table
from .registry import query


def day(column):
    return F.date_format(column, "yyyy-MM-dd")


# -- projections and filters ---------------------------------------------------

@query("p_project_alias", "SELECT c_custkey AS customer, c_name AS name, c_acctbal * 2 AS twice FROM customer")
def p_project_alias(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"), (F.col("c_acctbal") * 2).alias("twice"))


@query("p_conjunction", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND o_custkey IS NOT NULL")
def p_conjunction(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'F' and o_totalprice > 1000 and o_custkey is not null").select("o_orderkey", "o_totalprice")


@query("p_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def p_in_list(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("p_any_of_set", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def p_any_of_set(spark, sf):
    keys = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf, "customer", "c_custkey", "c_nationkey").join(keys, "c_nationkey", "left_semi").select("c_custkey")


def optional_filter(df, column, wanted="all"):
    """The predicate only where a value is asked for."""
    return df if wanted in (None, "all") else df.where(F.col(column) == wanted)


@query("p_optional_parameter", "SELECT c_custkey, c_mktsegment FROM customer WHERE ('BUILDING' = 'all' OR c_mktsegment = 'BUILDING') AND ('all' = 'all' OR c_name = 'all')")
def p_optional_parameter(spark, sf):
    df = table(spark, sf, "customer", "c_custkey", "c_mktsegment")
    return optional_filter(optional_filter(df, "c_mktsegment", "BUILDING"), "c_name")


@query("p_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%1%' OR p_brand ILIKE '%#2%'")
def p_ilike(spark, sf):
    return table(spark, sf, "part").where(F.col("p_name").ilike("%a%1%") | F.col("p_brand").ilike("%#2%")).select("p_partkey", "p_name")


@query("p_search_with_exists", """
SELECT c_custkey FROM customer c WHERE c_name ILIKE '%7%' OR c_mktsegment ILIKE 'auto%'
   OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000)""")
def p_search_with_exists(spark, sf):
    big = table(spark, sf, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    return table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment").join(big, "c_custkey", "left").where(F.col("c_name").ilike("%7%") | F.col("c_mktsegment").ilike("auto%") | F.col("has")).select("c_custkey")


@query("p_case", "SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'low' END AS severity FROM orders")
def p_case(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.when(p >= 200000, "high").when(p >= 100000, "medium").otherwise("low").alias("severity"))


@query("p_coalesce_nullif", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), 'none') AS flag, CAST(NULL AS VARCHAR) AS note FROM lineitem")
def p_coalesce_nullif(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("N")), F.lit("none")).alias("flag"), F.lit(None).cast("string").alias("note"))


@query("p_minimum_by_window", """
SELECT e.event_id, w.key AS window_key FROM events e JOIN (VALUES ('short', 90.0), ('long', 95.0)) w(key, least) ON e.value >= w.least""")
def p_minimum_by_window(spark, sf):
    least = F.create_map(F.lit("short"), F.lit(90.0), F.lit("long"), F.lit(95.0))
    rows = table(spark, sf, "events", "event_id", "value").select("event_id", "value", F.explode(least).alias("window_key", "least"))
    return rows.where("value >= least").select("event_id", "window_key")


@query("p_concat", "SELECT n_nationkey, n_name || ' / ' || CAST(n_regionkey AS VARCHAR) AS label FROM nation")
def p_concat(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.concat(F.col("n_name"), F.lit(" / "), F.col("n_regionkey").cast("string")).alias("label"))


@query("p_json_not_empty", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE props <> '{}' AND json_extract_string(props, '$.k') IS NOT NULL")
def p_json_not_empty(spark, sf):
    props = F.from_json("props", "map<string,bigint>")
    return table(spark, sf, "events").withColumn("m", props).where((F.size("m") > 0) & F.col("m").getItem("k").isNotNull()).select("event_id", F.col("m").getItem("k").alias("k"))


# -- joins -----------------------------------------------------------------------

@query("j_star", """
SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def j_star(spark, sf):
    # the dimensions' sizes are left to the planner, which broadcasts by their statistics
    n = table(spark, sf, "nation").join(table(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, sf, "orders", "o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("j_left_composite", """
SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS returned FROM lineitem a LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def j_left_composite(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    returned = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("returned"))
    return lines.select("l_orderkey", "l_linenumber").join(returned, ["l_orderkey", "l_linenumber"], "left")


def sides(spark, sf):
    """Matches: the two first suppliers of each order by line, the score being their quantities."""
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    each = lines.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("line"), F.sum("l_quantity").cast("int").alias("goals"))
    w = W.partitionBy("l_orderkey").orderBy("line", "l_suppkey")
    return each.withColumn("side", F.row_number().over(w)).where("side <= 2").select(F.col("l_orderkey").alias("match_id"), "side", F.col("l_suppkey").alias("team"), "goals")


SIDES = """s AS (
  SELECT l_orderkey AS match_id, l_suppkey AS team, min(l_linenumber) AS line, CAST(sum(l_quantity) AS INTEGER) AS goals FROM lineitem GROUP BY 1, 2),
sides AS (SELECT match_id, team, goals, row_number() OVER (PARTITION BY match_id ORDER BY line, team) AS side FROM s QUALIFY side <= 2),
matches AS (
  SELECT h.match_id, o.o_orderdate AS kickoff, year(o.o_orderdate) AS season, h.team AS home_team, a.team AS away_team, h.goals AS home_score, a.goals AS away_score
  FROM sides h JOIN sides a ON h.match_id = a.match_id AND h.side = 1 AND a.side = 2 JOIN orders o ON o.o_orderkey = h.match_id)"""


def matches(spark, sf):
    """One row a match with both sides; orders with one supplier only have no match."""
    own = sides(spark, sf)
    both = own.groupBy("match_id").agg(
        F.max_by("team", -F.col("side")).alias("home_team"), F.max_by("goals", -F.col("side")).alias("home_score"),
        F.max_by("team", "side").alias("away_team"), F.max_by("goals", "side").alias("away_score"), F.count("*").alias("n")).where("n = 2").drop("n")
    orders = table(spark, sf, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("kickoff"), F.year("o_orderdate").alias("season"))
    return both.join(orders, "match_id")


@query("j_pair_halves", f"WITH {SIDES} SELECT match_id, season, home_team, away_team, home_score, away_score FROM matches")
def j_pair_halves(spark, sf):
    return matches(spark, sf).select("match_id", "season", "home_team", "away_team", "home_score", "away_score")


def doubled(rows):
    """A row for each side of a match, made in the same task."""
    return rows.select("match_id", "season", "kickoff", F.inline(F.array(
        F.struct(F.lit(True).alias("is_home"), F.col("home_team").alias("team"), F.col("away_team").alias("opponent"), F.col("home_score").alias("goals_for"), F.col("away_score").alias("goals_against")),
        F.struct(F.lit(False).alias("is_home"), F.col("away_team").alias("team"), F.col("home_team").alias("opponent"), F.col("away_score").alias("goals_for"), F.col("home_score").alias("goals_against")))))


DOUBLED = f"""{SIDES},
team_rows AS (
  SELECT match_id, season, kickoff, true AS is_home, home_team AS team, away_team AS opponent, home_score AS goals_for, away_score AS goals_against FROM matches
  UNION ALL SELECT match_id, season, kickoff, false, away_team, home_team, away_score, home_score FROM matches)"""


@query("j_row_doubling", f"WITH {DOUBLED} SELECT match_id, season, is_home, team, opponent, goals_for, goals_against FROM team_rows")
def j_row_doubling(spark, sf):
    return doubled(matches(spark, sf)).drop("kickoff")


@query("j_two_roles", f"""WITH {SIDES}
SELECT m.match_id, h.s_name AS home_name, a.s_name AS away_name FROM matches m LEFT JOIN supplier h ON h.s_suppkey = m.home_team LEFT JOIN supplier a ON a.s_suppkey = m.away_team""")
def j_two_roles(spark, sf):
    names = table(spark, sf, "supplier", "s_suppkey", "s_name")
    home = names.select(F.col("s_suppkey").alias("home_team"), F.col("s_name").alias("home_name"))
    away = names.select(F.col("s_suppkey").alias("away_team"), F.col("s_name").alias("away_name"))
    return matches(spark, sf).join(home, "home_team", "left").join(away, "away_team", "left").select("match_id", "home_name", "away_name")


@query("j_self_across_windows", """
WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
f AS (SELECT o_custkey, avg(o_totalprice) AS v FROM r WHERE rn <= 5 GROUP BY 1), s AS (SELECT o_custkey, avg(o_totalprice) AS v FROM r GROUP BY 1)
SELECT s.o_custkey, round(f.v - s.v, 6) AS form_change FROM s LEFT JOIN f USING (o_custkey)""")
def j_self_across_windows(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    ranked = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice").withColumn("rn", F.row_number().over(w))
    # both windows of a customer in one aggregation: the self-join's rows without the join
    return ranked.groupBy("o_custkey").agg(F.round(F.avg(F.when(F.col("rn") <= 5, F.col("o_totalprice"))) - F.avg("o_totalprice"), 6).alias("form_change"))


@query("j_latest_per_key", """
SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) l ON l.o_custkey = c_custkey AND rn = 1""")
def j_latest_per_key(spark, sf):
    newest = F.struct("o_orderdate", "o_orderkey")
    last = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderkey", "o_orderpriority"), newest).alias("l"))
    return table(spark, sf, "customer", "c_custkey").join(last, "c_custkey", "left").select("c_custkey", "l.o_orderkey", "l.o_orderpriority")


@query("j_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')")
def j_semi(spark, sf):
    open_orders = table(spark, sf, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, sf, "customer", "c_custkey").join(open_orders, "c_custkey", "left_semi")


@query("j_anti", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_returnflag = 'R')")
def j_anti(spark, sf):
    returned = table(spark, sf, "lineitem", "l_partkey", "l_returnflag").where("l_returnflag = 'R'").withColumnRenamed("l_partkey", "p_partkey")
    return table(spark, sf, "part", "p_partkey").join(returned, "p_partkey", "left_anti")


@query("j_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders, (SELECT max(o_orderkey) FROM orders o WHERE o.o_custkey = c.c_custkey) AS last_key FROM customer c")
def j_correlated_count(spark, sf):
    n = table(spark, sf, "orders", "o_custkey", "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))
    return table(spark, sf, "customer", "c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_key")


@query("j_by_discriminator", """
SELECT e.event_id, c.c_name AS buyer, s.s_name AS seller FROM events e LEFT JOIN customer c ON e.event_type = 'purchase' AND c.c_custkey = e.user_id LEFT JOIN supplier s ON e.event_type = 'view' AND s.s_suppkey = e.user_id""")
def j_by_discriminator(spark, sf):
    e = table(spark, sf, "events", "event_id", "event_type", "user_id")
    c = table(spark, sf, "customer", F.col("c_custkey"), F.col("c_name").alias("buyer"))
    s = table(spark, sf, "supplier", F.col("s_suppkey"), F.col("s_name").alias("seller"))
    joined = e.join(c, (F.col("event_type") == "purchase") & (F.col("c_custkey") == F.col("user_id")), "left")
    return joined.join(s, (F.col("event_type") == "view") & (F.col("s_suppkey") == F.col("user_id")), "left").select("event_id", "buyer", "seller")


@query("j_active_scope", "SELECT event_id, event_type FROM events WHERE event_type = (SELECT event_type FROM events GROUP BY event_type ORDER BY max(ts) DESC, event_type LIMIT 1)")
def j_active_scope(spark, sf):
    e = table(spark, sf, "events", "event_id", "event_type", "ts")
    active = e.groupBy("event_type").agg(F.max("ts").alias("at")).orderBy(F.desc("at"), "event_type").limit(1).select("event_type")
    return e.select("event_id", "event_type").join(F.broadcast(active), "event_type", "left_semi")  # one row


@query("j_unique_on_both_sides", """
WITH a AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, min(c_custkey) AS k FROM customer GROUP BY 1, 2 HAVING count(DISTINCT c_custkey) = 1),
b AS (SELECT s_nationkey AS nation, min(s_suppkey) AS k FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1)
SELECT a.nation, a.seg, a.k AS customer, b.k AS supplier FROM a JOIN b USING (nation)""")
def j_unique_on_both_sides(spark, sf):
    def single(df, keys, value, name):
        return df.groupBy(*keys).agg(F.min(value).alias(name), F.max(value).alias("_max")).where(F.col(name) == F.col("_max")).drop("_max")

    a = single(table(spark, sf, "customer").withColumnsRenamed({"c_nationkey": "nation", "c_mktsegment": "seg"}), ["nation", "seg"], "c_custkey", "customer")
    b = single(table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "nation"), ["nation"], "s_suppkey", "supplier")
    return a.join(b, "nation").select("nation", "seg", "customer", "supplier")


@query("j_cross_grid", """
WITH have AS (SELECT c_nationkey AS n, c_mktsegment AS s, count(*) AS c FROM customer GROUP BY 1, 2)
SELECT n_nationkey, seg, coalesce(c, 0) AS customers FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) LEFT JOIN have ON n = n_nationkey AND s = seg""")
def j_cross_grid(spark, sf):
    c = table(spark, sf, "customer", "c_nationkey", "c_mktsegment")
    have = c.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg")).count()
    grid = table(spark, sf, "nation", "n_nationkey").crossJoin(c.select(F.col("c_mktsegment").alias("seg")).distinct())  # two dimensions' values
    return grid.join(have, ["n_nationkey", "seg"], "left").select("n_nationkey", "seg", F.coalesce("count", F.lit(0)).alias("customers"))


@query("j_full_outer", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 9000 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def j_full_outer(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("c"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("s"))
    return c.join(s, "nation", "full").select("nation", "c", "s")


@query("j_right_outer", "SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey = 2")
def j_right_outer(spark, sf):
    n = table(spark, sf, "nation").where("n_regionkey = 2")
    return n.join(table(spark, sf, "supplier", "s_suppkey", "s_nationkey"), F.col("n_nationkey") == F.col("s_nationkey"), "right").select("s_suppkey", "n_name")


@query("j_as_of", """
SELECT p.event_id, max(v.event_id) AS seen FROM events p ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v
ON p.user_id = v.user_id AND v.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY 1""")
def j_as_of(spark, sf):
    """Each purchase with the user's newest view at or before it: one sort by user and time, no range join."""
    e = table(spark, sf, "events", "event_id", "user_id", "event_type", "ts").where(F.col("event_type").isin("view", "purchase"))
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, W.currentRow)
    view = F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))
    return e.withColumn("seen", F.max(view).over(w).getField("event_id")).where("event_type = 'purchase' and seen is not null").select("event_id", "seen")


# -- aggregates --------------------------------------------------------------------

@query("g_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, max(l_extendedprice) AS top, min(l_tax) AS low FROM lineitem GROUP BY 1, 2")
def g_basic(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.max("l_extendedprice").alias("top"), F.min("l_tax").alias("low"))


@query("g_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT (o_custkey, o_orderpriority)) AS pairs, count(DISTINCT o_custkey) FILTER (o_totalprice > 150000) AS rich FROM orders GROUP BY 1")
def g_count_distinct(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_custkey", "o_orderpriority").alias("pairs"), F.countDistinct(F.when(F.col("o_totalprice") > 150000, F.col("o_custkey"))).alias("rich"))


@query("g_filter_counts", """
SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors, bool_or(event_type = 'signup') AS signed, bool_and(value >= 0) AS positive
FROM events GROUP BY 1""")
def g_filter_counts(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "view").alias("views"), F.count_if(kind == "error").alias("errors"), F.bool_or(kind == "signup").alias("signed"), F.bool_and(F.col("value") >= 0).alias("positive"))


@query("g_bool_or_two_levels", "SELECT event_type, count(*) FILTER (hot) AS hot_users, count(*) AS users FROM (SELECT event_type, user_id, bool_or(value > 90) AS hot FROM events GROUP BY 1, 2) GROUP BY 1")
def g_bool_or_two_levels(spark, sf):
    each = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.bool_or(F.col("value") > 90).alias("hot"))
    return each.groupBy("event_type").agg(F.count_if("hot").alias("hot_users"), F.count("*").alias("users"))


@query("g_array_agg", "SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(c_mktsegment) FILTER (c_acctbal > 5000))), ',') AS segments FROM customer GROUP BY 1 HAVING count(*) FILTER (c_acctbal > 5000) > 0")
def g_array_agg(spark, sf):
    sets = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")))).alias("s"))
    return sets.where(F.size("s") > 0).select("c_nationkey", F.array_join("s", ",").alias("segments"))


@query("g_json_agg", """
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus, ';' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1""")
def g_json_agg(spark, sf):
    rows = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderstatus").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("r"))
    return rows.select("o_custkey", F.array_join(F.transform("r", lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), x["o_orderstatus"])), ";").alias("orders"))


@query("g_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def g_distinct(spark, sf):
    return table(spark, sf, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("g_mode_with_ties", """
WITH r AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(rn) AS seen FROM r GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority AS mode, n, round(n * 1.0 / sum(n) OVER (PARTITION BY o_custkey), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, seen, o_orderpriority) = 1""")
def g_mode_with_ties(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    counted = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority").withColumn("rn", F.row_number().over(w)).groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.min("rn").alias("seen"))
    best = counted.groupBy("o_custkey").agg(F.min_by(F.struct(F.col("o_orderpriority").alias("mode"), "n"), F.struct(-F.col("n"), "seen", "o_orderpriority")).alias("b"), F.sum("n").alias("all"))
    return best.select("o_custkey", "b.mode", "b.n", F.round(F.col("b.n") / F.col("all"), 6).alias("share"))


@query("g_argmax_by_sum", """
WITH s AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS role, round(v / sum(v) OVER (PARTITION BY user_id), 6) AS role_confidence FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(v, 6) DESC, event_type) = 1""")
def g_argmax_by_sum(spark, sf):
    each = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    best = each.groupBy("user_id").agg(F.min_by(F.struct("event_type", "v"), F.struct(-F.round("v", 6), "event_type")).alias("b"), F.sum("v").alias("all"))
    return best.select("user_id", F.col("b.event_type").alias("role"), F.round(F.col("b.v") / F.col("all"), 6).alias("role_confidence"))


@query("g_latest_per_source", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS seen FROM events GROUP BY 1, 2")
def g_latest_per_source(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("seen"))


@query("g_null_coverage", """
SELECT 'discount' AS column_name, count(nullif(l_discount, 0)) AS present, count(*) AS rows, round(100.0 * count(nullif(l_discount, 0)) / count(*), 2) AS pct FROM lineitem
UNION ALL SELECT 'tax', count(nullif(l_tax, 0)), count(*), round(100.0 * count(nullif(l_tax, 0)) / count(*), 2) FROM lineitem""")
def g_null_coverage(spark, sf):
    """One pass counts every column; the single row is then turned on its side."""
    df = table(spark, sf, "lineitem").select(F.nullif(F.col("l_discount"), F.lit(0)).alias("discount"), F.nullif(F.col("l_tax"), F.lit(0)).alias("tax"))
    counts = df.agg(F.count("*").alias("rows"), *(F.count(c).alias(c) for c in df.columns))
    return counts.unpivot("rows", ["discount", "tax"], "column_name", "present").select("column_name", "present", "rows", F.round(F.lit(100.0) * F.col("present") / F.col("rows"), 2).alias("pct"))


@query("g_histogram", "SELECT least(floor(value / 20), 4)::BIGINT AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def g_histogram(spark, sf):
    return table(spark, sf, "events", "value").groupBy(F.least(F.floor(F.col("value") / 20), F.lit(4)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("g_weighted_variance", """
WITH m AS (SELECT l_returnflag, l_quantity AS w, l_discount AS x, sum(l_quantity * l_discount) OVER (PARTITION BY l_returnflag) / sum(l_quantity) OVER (PARTITION BY l_returnflag) AS mean FROM lineitem)
SELECT l_returnflag, round(sum(w * (x - mean) * (x - mean)) / sum(w), 9) AS variance FROM m GROUP BY 1""")
def g_weighted_variance(spark, sf):
    """Two passes, so that no digits are lost where means are large against spreads: partial sums for the means, which are joined back."""
    w, x = F.col("l_quantity"), F.col("l_discount")
    rows = table(spark, sf, "lineitem", "l_returnflag", "l_quantity", "l_discount")
    means = rows.groupBy("l_returnflag").agg((F.sum(w * x) / F.sum(w)).alias("mean"))
    away = x - F.col("mean")
    return rows.join(means, "l_returnflag").groupBy("l_returnflag").agg(F.round(F.sum(w * away * away) / F.sum(w), 9).alias("variance"))


@query("g_opponent_rollup", f"WITH {DOUBLED} SELECT team, season, count(*) AS played, sum(goals_for)::BIGINT AS scored, sum(goals_against)::BIGINT AS allowed FROM team_rows GROUP BY 1, 2")
def g_opponent_rollup(spark, sf):
    return doubled(matches(spark, sf)).groupBy("team", "season").agg(F.count("*").alias("played"), F.sum("goals_for").alias("scored"), F.sum("goals_against").alias("allowed"))


@query("g_rollup", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def g_rollup(spark, sf):
    return table(spark, sf, "customer").rollup("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("g_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def g_cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("g_grouping_sets", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def g_grouping_sets(spark, sf):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf, "lineitem").groupingSets([[flag], [status], []], flag, status).agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("g_approximate", "SELECT event_type, true AS users_near, true AS quartiles_near FROM events GROUP BY 1")
def g_approximate(spark, sf):
    """Sketches: distinct users within a tenth, and quantiles whose ranks lie within two hundredths, of the exact ones."""
    e = table(spark, sf, "events", "event_type", "user_id", "value")
    cuts = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.count_distinct("user_id").alias("exact"), F.percentile_approx("value", [0.25, 0.5, 0.75], 10_000).alias("q"))
    ranks = e.join(F.broadcast(cuts), "event_type").groupBy("event_type").agg(  # a row for each type
        F.max(F.abs(F.col("users") / F.col("exact") - 1) <= 0.1).alias("users_near"),
        *(F.abs(F.count_if(F.col("value") <= F.col("q")[i]) / F.count("*") - q).alias(f"d{i}") for i, q in enumerate((0.25, 0.5, 0.75))), F.count("*").alias("n"))
    return ranks.select("event_type", "users_near", (F.greatest("d0", "d1", "d2") <= 0.02 + 1 / F.col("n")).alias("quartiles_near"))


# -- windows ---------------------------------------------------------------------------

@query("n_recent_windows", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey, rn::INTEGER AS recency_rank, w AS window_key, round(CASE WHEN n IS NULL THEN 1 ELSE pow(0.5, (rn - 1) / 3.0) END, 9) AS weight
FROM r JOIN (VALUES ('last_3', 3), ('last_5', 5), ('last_10', 10), ('season', NULL)) t(w, n) ON n IS NULL OR rn <= n""")
def n_recent_windows(spark, sf):
    orders = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    found = recent_windows(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], rank_all=True)
    return found.select("o_custkey", "o_orderkey", "recency_rank", "window_key", F.round("weight", 9).alias("weight"))


def _percentile_sql(expression: str) -> str:
    return f"""
SELECT c_custkey, round({expression}, 6) AS percentile, n AS reference_size FROM (
  SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY v) - 1 AS below, count(*) OVER (PARTITION BY c_mktsegment, v) AS same, count(*) OVER (PARTITION BY c_mktsegment) AS n
  FROM (SELECT c_custkey, c_mktsegment, round(c_acctbal, -3) AS v FROM customer))"""


def _percentiles(spark, sf, method):
    rows = table(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_acctbal").withColumn("v", F.round("c_acctbal", -3))
    return P.percentile(rows, ["c_mktsegment"], "v", method).select("c_custkey", F.round("percentile", 6).alias("percentile"), "reference_size")


@query("n_percentile_mid_rank", _percentile_sql("100.0 * (below + 0.5 * same) / n"))
def n_percentile_mid_rank(spark, sf):
    return _percentiles(spark, sf, "mid_rank")


@query("n_percentile_single_is_50", _percentile_sql("CASE WHEN n <= 1 THEN 50 ELSE 100.0 * (below + 0.5 * same) / n END"))
def n_percentile_single_is_50(spark, sf):
    return _percentiles(spark, sf, "mid_rank_or_50")


@query("n_percentile_tie_average", _percentile_sql("CASE WHEN n = 1 THEN 50 ELSE 100.0 * (below + (same - 1) / 2.0) / (n - 1) END"))
def n_percentile_tie_average(spark, sf):
    return _percentiles(spark, sf, "tie_average")


@query("n_percentile_eligible", """
WITH c AS (SELECT c_custkey, c_mktsegment, round(c_acctbal, -2) AS v, c_acctbal >= 0 AS fit FROM customer),
p AS (SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY v) - 1 AS below, count(*) OVER (PARTITION BY c_mktsegment, v) AS same, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM c WHERE fit)
SELECT c.c_custkey, round(100 - CASE WHEN n = 1 THEN 50 ELSE 100.0 * (below + (same - 1) / 2.0) / (n - 1) END, 6) AS inverted, coalesce(n, 0) AS reference_size FROM c LEFT JOIN p USING (c_custkey)""")
def n_percentile_eligible(spark, sf):
    rows = table(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_acctbal").withColumn("v", F.round("c_acctbal", -2))
    found = P.percentile(rows, ["c_mktsegment"], "v", "tie_average", F.col("c_acctbal") >= 0)
    return found.select("c_custkey", F.round(100 - F.col("percentile"), 6).alias("inverted"), "reference_size")


@query("n_average_rank", "SELECT s_suppkey, rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2.0 AS average_rank FROM supplier")
def n_average_rank(spark, sf):
    return P.average_rank(table(spark, sf, "supplier", "s_suppkey", "s_nationkey").withColumn("all", F.lit(1)), ["all"], "s_nationkey").select("s_suppkey", "average_rank")


@query("n_population_mean", """
SELECT o_orderkey, round(o_totalprice - sum(o_totalprice * (o_orderkey % 7 + 1)) OVER (PARTITION BY o_orderpriority) / sum(o_orderkey % 7 + 1) OVER (PARTITION BY o_orderpriority), 4) AS above FROM orders""")
def n_population_mean(spark, sf):
    """The group's weighted mean on every row: aggregated first and joined back, so that no group is one task's."""
    weight = F.col("o_orderkey") % 7 + 1
    orders = table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    means = orders.groupBy("o_orderpriority").agg((F.sum(F.col("o_totalprice") * weight) / F.sum(weight)).alias("mean"))
    return orders.join(means, "o_orderpriority").select("o_orderkey", F.round(F.col("o_totalprice") - F.col("mean"), 4).alias("above"))


@query("n_first_seen_and_change", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, round(max(o_totalprice) FILTER (rn = 1) - arg_max(o_totalprice, rn) FILTER (rn <= 5), 4) AS change, min(rn) FILTER (o_orderstatus = 'F') AS first_f FROM r GROUP BY 1""")
def n_first_seen_and_change(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    r = table(spark, sf, "orders").withColumn("rn", F.row_number().over(w).cast("long"))
    return r.groupBy("o_custkey").agg(F.round(F.max(F.when(F.col("rn") == 1, F.col("o_totalprice"))) - F.max_by("o_totalprice", F.when(F.col("rn") <= 5, F.col("rn"))), 4).alias("change"), F.min(F.when(F.col("o_orderstatus") == "F", F.col("rn"))).alias("first_f"))


@query("n_frames", """
SELECT event_id, lag(value) OVER w AS before_, lead(event_id) OVER w AS next_, ntile(4) OVER w AS quarter, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving, nth_value(event_id, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def n_frames(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.lag("value").over(w).alias("before_"), F.lead("event_id").over(w).alias("next_"), F.ntile(4).over(w).cast("long").alias("quarter"),
        F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"), F.nth_value("event_id", 2).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("second"))


# -- sorts and limits ---------------------------------------------------------------------

@query("t_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def t_top_k(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("t_nulls_last", "SELECT c_custkey, b FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer) ORDER BY b DESC NULLS LAST, c_custkey LIMIT 40")
def t_nulls_last(spark, sf):
    return table(spark, sf, "customer", "c_custkey", "c_acctbal").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("b")).orderBy(F.col("b").desc_nulls_last(), "c_custkey").limit(40)


@query("t_case_order", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey LIMIT 30")
def t_case_order(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").orderBy(rank, F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey")


@query("t_top_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 4")
def t_top_per_group(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice").withColumn("r", F.row_number().over(w)).where("r <= 4").select("o_custkey", "o_orderkey")


@query("t_offset", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def t_offset(spark, sf):
    return table(spark, sf, "part", "p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").offset(40).limit(20).select("p_partkey")


# -- sets -------------------------------------------------------------------------------------

@query("u_union_all", "SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def u_union_all(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind")))


@query("u_intersect", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def u_intersect(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("u_difference_both_ways", """
SELECT nation, 'customers only' AS side FROM (SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT nation, 'suppliers only' FROM (SELECT s_nationkey AS nation FROM supplier EXCEPT SELECT c_nationkey FROM customer)""")
def u_difference_both_ways(spark, sf):
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return c.subtract(s).withColumn("side", F.lit("customers only")).union(s.subtract(c).withColumn("side", F.lit("suppliers only")))


@query("u_buckets", """
SELECT n_nationkey, CASE WHEN c AND s THEN 'both' WHEN c THEN 'first' WHEN s THEN 'second' ELSE 'neither' END AS bucket FROM (
  SELECT n_nationkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9500) AS c, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation)""")
def u_buckets(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(True).alias("c")).distinct()
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(True).alias("s")).distinct()
    both = table(spark, sf, "nation", "n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return both.select("n_nationkey", F.when(F.col("c") & F.col("s"), "both").when(F.col("c"), "first").when(F.col("s"), "second").otherwise("neither").alias("bucket"))


@query("u_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def u_union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))).distinct()
