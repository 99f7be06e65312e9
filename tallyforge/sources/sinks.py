"""Writes: replaced scopes, upserts, content-addressed objects, run logs, reports, and the checks before them."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def replace_scopes(df: DataFrame, path: str, scope: Sequence[str] = ("scope_key", "model_version")) -> None:
    """Write snapshots; the scopes that df has are replaced, others stay. Running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """Both tables' rows, one for each natural key: the newest."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*newest))).where("_r = 1").drop("_r")


def mapped_upsert(rows: DataFrame, bridge: DataFrame, natural: Sequence[str], internal: str) -> tuple[DataFrame, DataFrame]:
    """(rows that the bridge knows, with their internal id; rows to insert, with an id from their natural key's hash)."""
    known = rows.join(bridge.select(*natural, internal), list(natural))
    fresh = rows.join(bridge.select(*natural), list(natural), "left_anti").withColumn(internal, F.xxhash64(*natural))
    return known, fresh


def replaced_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of the parents in new are replaced; others stay."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def identity_conflicts(rows: DataFrame, stored: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """Rows that match several stored ids by any of the keys; an upsert must fail if there are any."""
    hits = None
    for k in keys:
        found = rows.join(stored.select(k, F.col(id_column).alias("_hit")).where(F.col(k).isNotNull()), k).select(*rows.columns, "_hit")
        hits = found if hits is None else hits.unionByName(found)
    return hits.groupBy(*rows.columns).agg(F.count_distinct("_hit").alias("matches")).where("matches > 1")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule and violations, for all rules in one pass. A rule that is null passes, as a CHECK does; that a column has values is a rule of its own (isNotNull)."""
    counts = df.agg(*(F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()))
    return counts.unpivot([], list(rules), "rule", "violations")


def not_members(rows: DataFrame, groups: DataFrame, key: str, member: str, members: Sequence[str]) -> DataFrame:
    """rows whose `member` is none of the group's (`members` of the row of groups with the same key), or whose group doesn't exist: a team that is neither side of its match."""
    own = groups.select(F.col(key).alias("_k"), F.array(*members).alias("_members"))
    return rows.join(own, F.col(key) == F.col("_k"), "left").where(~F.coalesce(F.array_contains("_members", F.col(member)), F.lit(False))).drop("_k", "_members")


def canonical_json(payload: Column) -> Column:
    """A JSON text with the names of its objects in order and without white space between; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(payload)), payload)


def content_address(payload: Column) -> Column:
    """sha256/ab/abcdef....json.gz of a payload's canonical JSON text."""
    sha = F.sha2(canonical_json(payload), 256)
    return F.concat(F.lit("sha256/"), F.substring(sha, 1, 2), F.lit("/"), sha, F.lit(".json.gz"))


def request_fingerprint(endpoint: Column, parameters: Column) -> Column:
    """SHA-256 of the endpoint and its parameters (a map) in order of names."""
    pairs = F.transform(F.array_sort(F.map_entries(parameters)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.sha2(F.concat_ws("?", endpoint, F.array_join(pairs, "&")), 256)


def put_objects(rows: DataFrame, path: str) -> None:
    """Append (address, payload) rows that aren't stored, in canonical form. An address with another content, here or there, is an error."""
    spark = rows.sparkSession
    fresh = rows.select(content_address(F.col("payload")).alias("address"), canonical_json(F.col("payload")).alias("payload")).distinct()
    if fresh.groupBy("address").count().where("count > 1").head(1):
        raise ValueError("two payloads have one address")
    try:
        stored = spark.read.parquet(path).select("address", F.col("payload").alias("_stored"))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    if stored is not None:
        if fresh.join(stored, "address").where(F.col("payload") != F.col("_stored")).head(1):
            raise ValueError("a stored address has another payload")
        fresh = fresh.join(stored, "address", "left_anti")
    fresh.write.mode("append").option("compression", "gzip").parquet(path)


def watchlist(entries: DataFrame) -> DataFrame:
    """player_id, category, reason and created_at of a log of changes (player_id, action: add or remove, category, reason, at): of each player the last change counts, if it added.

    violations() checks them by watchlist_rules().
    """
    last = entries.groupBy("player_id").agg(F.max_by(F.struct("action", "category", "reason", "at"), F.struct("at", "action")).alias("x"))
    return last.where("x.action = 'add'").select("player_id", F.coalesce("x.category", F.lit("manual")).alias("category"), "x.reason", F.col("x.at").alias("created_at"))


#: The categories of a watchlist and the longest reason.
WATCHLIST_CATEGORIES, REASON = ("manual", "emerging", "regression_watch", "underperforming_process"), 500


def watchlist_rules() -> dict[str, Column]:
    """What violations() checks of a watchlist."""
    return {"category": F.col("category").isin(*WATCHLIST_CATEGORIES), "reason": (F.trim("reason") != "") & (F.length("reason") <= REASON)}


def log_run(spark: SparkSession, path: str, job: str, status: str, counts: dict[str, int], started: str, finished: str) -> None:
    """Append a run to the log."""
    spark.createDataFrame([(job, status, started, finished, {k: int(v) for k, v in counts.items()})], "job string, status string, started_at string, finished_at string, counts map<string,bigint>").write.mode("append").parquet(path)


def run_summary(log: DataFrame) -> DataFrame:
    """job, runs, failures, rows and last_success."""
    rows = F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return log.groupBy("job").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failures"), F.sum(rows).alias("rows"), F.max(F.when(F.col("status") == "success", F.col("finished_at"))).alias("last_success"))


def write_report(df: DataFrame, path: str) -> None:
    """A small report as JSON lines with names in order."""
    df.select(*sorted(df.columns)).coalesce(1).write.mode("overwrite").json(path)


def guarded_target(uri: str, allowed: Sequence[str], confirmed: bool = False) -> str:
    """uri, if it lies below an allowed root; a remote one also needs confirmation. Else an error."""
    remote = urlsplit(uri).scheme not in ("", "file")
    if ".." in uri.split("/") or not any(uri == root or uri.startswith(root.rstrip("/") + "/") for root in allowed):
        raise ValueError(f"{uri} lies below none of the allowed roots")
    if remote and not confirmed:
        raise ValueError(f"{uri} is remote and isn't confirmed")
    return uri


def preflight(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    found = None
    for name, df in tables.items():
        n = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        found = n if found is None else found.unionByName(n)
    return found
