"""Streaming counterparts, registered as the batch queries that they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import query


@query("x_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x_tumbling(spark, sf):
    found = table(spark, sf, "events", "ts", "event_type", "value").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("x_sliding", """
SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1""")
def x_sliding(spark, sf):
    found = table(spark, sf, "events", "ts").groupBy(F.window(F.col("ts").cast("timestamp"), "2 days", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return found.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


@query("x_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def x_sessions(spark, sf):
    found = table(spark, sf, "events", "ts", "user_id").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
