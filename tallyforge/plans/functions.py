"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import elo, ratings, scoring, windows
from ..sources.tables import table
from .mesh import _FOLD
from .registry import query


@query("f_fingerprint", f"SELECT doc_id, sha256({_FOLD.format("coalesce(text, '')")} || '|' || {_FOLD.format("coalesce(source, '')")}) AS sha FROM documents")
def f_fingerprint(spark, sf):
    """Every document's whole text and source; null counts as empty."""
    return table(spark, sf, "documents", "doc_id", "text", "source").select("doc_id", X.fingerprint(F.col("text"), F.col("source")).alias("sha"))


@query("f_duplicate_root", """
WITH h AS (SELECT doc_id, source, sha256(text) AS sha FROM documents)
SELECT h.doc_id, min(r.doc_id) AS root FROM h JOIN h r ON h.sha = r.sha AND r.source <> h.source AND r.doc_id < h.doc_id GROUP BY 1""")
def f_duplicate_root(spark, sf):
    """The lowest earlier row of the same text from another source.

    For each text the first row of each source: whatever the copies, a row needs
    only the lowest of them that isn't its own source's. Sums come first; no pairs are made.
    """
    rows = table(spark, sf, "documents", "doc_id", "source", "text").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    firsts = rows.groupBy("sha", "source").agg(F.min("doc_id").alias("first"))
    best = firsts.groupBy("sha").agg(F.min(F.struct("first", "source")).alias("one"), F.count("*").alias("sources"))
    other = firsts.join(best.where("sources > 1"), "sha").where(F.col("source") != F.col("one.source")).groupBy("sha").agg(F.min("first").alias("two"))
    known = best.where("sources > 1").join(other, "sha")
    root = F.when(F.col("source") != F.col("one.source"), F.col("one.first")).otherwise(F.col("two"))
    return rows.join(known, "sha").select("doc_id", root.alias("root"), "source").where("root < doc_id").select("doc_id", "root")


@query("f_sentences", r"SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '[\r\n;]+', chr(1), 'g'), chr(1)), lambda s: length(trim(s, chr(32) || chr(9))) > 0))::INTEGER AS n FROM documents")
def f_sentences(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.size(ratings.sentences(F.col("text"))).alias("n"))


@query("f_safe_ratio", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, 6) AS ratio FROM lineitem")
def f_safe_ratio(spark, sf):
    return table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_tax", "l_discount").select("l_orderkey", "l_linenumber", F.round(F.try_divide("l_tax", "l_discount"), 6).alias("ratio"))


@query("f_age_decay", "SELECT o_orderkey, round(greatest(0, epoch(TIMESTAMP '2001-07-01') - epoch(o_orderdate)) / 86400.0, 6) AS age, round(pow(0.5, (o_orderkey % 9) / 3.0), 9) AS weight FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01' - INTERVAL 180 DAY")
def f_age_decay(spark, sf):
    """Ages of the last 180 days' evidence, and the weights of recent rows."""
    rows = table(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.lit(None).cast("timestamp").alias("published_at"), F.col("o_orderdate").cast("timestamp").alias("discovered_at"))
    return ratings.recent(rows, F.lit("2001-07-01")).select("o_orderkey", F.round("age_days", 6).alias("age"), F.round(windows.recency_weight(F.col("o_orderkey") % 9 + 1), 9).alias("weight"))


@query("f_logistic", "SELECT event_id, round(1 / (1 + pow(10, (50 - value) / 400)), 6) AS expected, round(1 - exp(-value / 450), 6) AS saturation, least(100, greatest(10, value)) AS clamped FROM events")
def f_logistic(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events", "event_id", "value").select("event_id", F.round(elo.expected(v, F.lit(50.0)), 6).alias("expected"), F.round(scoring.saturation(v, 450.0), 6).alias("saturation"), scoring.clamp(v, 10.0, 100.0).alias("clamped"))


@query("f_season_label", "SELECT o_orderkey, year(o_orderdate)::VARCHAR || '-' || (year(o_orderdate) + 1)::VARCHAR AS season FROM orders")
def f_season_label(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", X.season_label(F.year("o_orderdate").cast("string")).alias("season"))


@query("f_lenient_number", "SELECT event_id, value AS number FROM events")
def f_lenient_number(spark, sf):
    return table(spark, sf, "events", "event_id", "value").select("event_id", X.lenient_number(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" %"))).alias("number"))


@query("f_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def f_json_path(spark, sf):
    return table(spark, sf, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))


@query("f_team_name", r"SELECT s_suppkey, array_to_string(list_sort(list_filter(regexp_split_to_array(trim(regexp_replace(lower(s_name), '[^a-z0-9\s]', ' ', 'g')), '\s+'), lambda t: NOT regexp_full_match(t, '\d+') AND t <> '')), ' ') AS name FROM supplier")
def f_team_name(spark, sf):
    return table(spark, sf, "supplier", "s_suppkey", "s_name").select("s_suppkey", X.team_name(F.col("s_name")).alias("name"))


@query("f_position", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'winger' WHEN 'MACHINERY' THEN 'goalkeeper' END AS family FROM customer")
def f_position(spark, sf):
    code = F.when(F.col("c_mktsegment") == "BUILDING", " lw").when(F.col("c_mktsegment") == "MACHINERY", "gk").otherwise("?")
    return table(spark, sf, "customer", "c_custkey", "c_mktsegment").select("c_custkey", X.position_family(code).alias("family"))


@query("f_vector_distance", "SELECT vec_id, round(sqrt(pow(embedding[1]::DOUBLE - embedding[3], 2) + pow(embedding[2]::DOUBLE - embedding[4], 2)), 6) AS d FROM embeddings")
def f_vector_distance(spark, sf):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", F.round(X.distance(F.array(v[0], v[1]), F.array(v[2], v[3])), 6).alias("d"))


_BARE = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _entity, _c in X.ENTITIES:
    _BARE = "replace(%s, '%s', '%s')" % (_BARE, _entity, _c.replace("'", "''"))


@query("f_page_text", rf"SELECT page_id, trim(regexp_replace({_BARE}, '\s+', ' ', 'g')) AS text FROM pages")
def f_page_text(spark, sf):
    """Pages as plain text by built-in functions; tests compare it with the parser's."""
    return table(spark, sf, "pages", "page_id", "html").select("page_id", X.plain_html(F.col("html")).alias("text"))


@query("f_canonical_url", r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*:(\d+)', 1) AS port, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
l AS (SELECT *, list_sort(list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|dclid|msclkid)(=|$)')), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)) AS params FROM p)
SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND host <> '' AND NOT regexp_matches(url, '^[A-Za-z]+://[^/?#]*@') THEN scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
  || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS url FROM l""")
def f_canonical_url(spark, sf):
    """Every page's URL: parameters that track and fragments go, the others are sorted."""
    return table(spark, sf, "pages", "page_id", "url").select("page_id", X.canonical_url(F.col("url")).alias("url"))
