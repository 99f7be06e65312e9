"""Streams of files: windows with watermarks, duplicates, versions of a table, and ratings with state."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.ship import ship
from ..operators.elo import HOME, INITIAL, STEP, expectation, played
from ..sources.sinks import upserted


def files(spark: SparkSession, path: str, schema: str, per_trigger: int = 64, kind: str = "parquet") -> DataFrame:
    """New files of a folder as a stream, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def windowed(stream: DataFrame, time: str, late: str, size: str, step: str | None, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Tumbling or sliding windows; rows later than `late` are dropped, and a window's row comes once it is closed."""
    window = F.window(time, size, step) if step else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(window, *keys).agg(*aggregates)


def sessions(stream: DataFrame, time: str, late: str, gap: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Windows that end when a key is silent for `gap`."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)


def deduplicated(stream: DataFrame, time: str, late: str, keys: Sequence[str]) -> DataFrame:
    """The first row of each key; keys are remembered for `late`."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def keep_latest(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], newest: Sequence[Column], buckets: int = 64, kept: int = 3):
    """A writer that keeps a table's newest row of each key, in buckets of the keys' hash; latest_version() reads it.

    A batch rewrites only the buckets that it touches, as folders
    bucket=B/version=N, N its own number, so that a batch that runs again writes
    the same folders anew. Of each bucket the last `kept` versions stay, for
    readers that have begun.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # `buckets` at most
        if not touched:
            return
        before = latest_version(spark, path, below=number, only=touched)
        rows = rows if before is None else upserted(before.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), rows, keys, newest)
        rows = upserted(rows.limit(0), rows, keys, newest).withColumn("version", F.lit(f"{number:012d}"))
        folder = f"{path}/_batch-{number:012d}"
        rows.write.mode("overwrite").partitionBy("bucket", "version").parquet(folder)
        _moved(spark, folder, path, number, touched, kept)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _moved(spark: SparkSession, folder: str, path: str, number: int, touched: Sequence[int], kept: int) -> None:
    """Move a batch's buckets to their place; a bucket's version is there whole or not at all."""
    jvm = spark._jvm.org.apache.hadoop.fs
    system = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket in touched:
        name = f"bucket={bucket}/version={number:012d}"
        to = jvm.Path(f"{path}/{name}")
        system.mkdirs(to.getParent())
        system.delete(to, True)
        if not system.rename(jvm.Path(f"{folder}/{name}"), to):
            raise OSError(f"{to} can't be written")
        for old in _versions(spark, f"{path}/bucket={bucket}", number)[: -max(1, kept) + 1 or None]:
            system.delete(jvm.Path(old[1]), True)
    system.delete(jvm.Path(folder), True)


def _versions(spark: SparkSession, folder: str, below: int | None) -> list[tuple[int, str]]:
    """(number, path) of a bucket's versions, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    found = [(int(s.getPath().getName()[8:]), s.getPath().toString()) for s in system.listStatus(root) if s.getPath().getName().startswith("version=")]
    return sorted(x for x in found if below is None or x[0] < below)


def latest_version(spark: SparkSession, path: str, below: int | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
    """The rows of each bucket's highest version (below a number; of some buckets only), or None."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return None
    buckets = [s.getPath() for s in system.listStatus(root) if s.getPath().getName().startswith("bucket=")]
    buckets = [b for b in buckets if only is None or int(b.getName()[7:]) in set(only)]
    last = [v[-1][1] for b in buckets if (v := _versions(spark, b.toString(), below))]
    return spark.read.parquet(*last) if last else None


def elo_stream(matches: DataFrame, context: str = "season") -> DataFrame:
    """Ratings that follow a stream of matches: context, match_id, team, is_home, pre, post.

    The state of a context is its teams' ratings. Within a batch matches go by
    kickoff and match_id; batches must come in order of time. As in the batch
    fold, matches without both scores, or of a team against itself, don't count.
    """
    ship(matches.sparkSession)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ratings = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["kickoff", "match_id"])
        out = []
        for r in rows.itertuples():
            h, a = str(r.home_team), str(r.away_team)
            x, y = ratings.get(h, INITIAL), ratings.get(a, INITIAL)
            s = 0.5 if r.home_score == r.away_score else float(r.home_score > r.away_score)
            d = STEP * (s - expectation(x + HOME, y))
            ratings[h], ratings[a] = x + d, y - d
            out += [(str(key[0]), r.match_id, h, True, round(x, 4), round(x + d, 4)), (str(key[0]), r.match_id, a, False, round(y, 4), round(y - d, 4))]
        state.update((json.dumps(ratings),))
        yield pd.DataFrame(out, columns=["context", "match_id", "team", "is_home", "pre", "post"])

    return played(matches).groupBy(context).applyInPandasWithState(follow, "context string, match_id long, team string, is_home boolean, pre double, post double", "ratings string", "append", GroupStateTimeout.NoTimeout)
