"""What the operators share: the shared folder, bounded batches, column checks and components."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import new_dir, shared_dir, written
from ..functions.ship import ship

__all__ = ["new_dir", "shared_dir", "written"]  # beside what is defined here

#: Rows, of a few numbers or a digest each, that may be broadcast or held by the driver; larger sets take the shuffled way.
BROADCAST_ROWS = 250_000
#: Bytes of text that a Python worker handles at once, and entries of its largest cache.
SLICE_BYTES, CACHE = 4 << 20, 100_000
_state: dict = {}


def held(name: str, of: object, make: Callable[[], object]) -> object:
    """What make() gives, kept in this worker process for its next task of the same operator and value.

    One operator's state is kept at a time, so that a worker that serves one
    operator after another doesn't gather the state of all.
    """
    if _state.get("name") != name or _state.get("of") is not of:
        _state.clear()
        _state.update({"name": name, "of": of, "made": make()})
    return _state["made"]


def tidy(run: Callable) -> Callable:
    """run (batches to batches), after which the worker gives unused memory back to the system."""

    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return tidied


def trim() -> None:
    """Give unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        return


def distinct_names(df: DataFrame) -> DataFrame:
    """df, in which of columns whose names differ in case alone, or not at all, the lower-case one, else the first, keeps its name; others get a number."""
    names, first = list(df.columns), {}
    for i, c in enumerate(names):
        if c.lower() not in first or c == c.lower() and names[first[c.lower()]] != c:
            first[c.lower()] = i
    if len(first) == len(names):
        return df
    return df.toDF(*(c if first[c.lower()] == i else f"{c}_{i}" for i, c in enumerate(names)))


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The column as `kind`, or nulls where the table has none of that name."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)


def prepare(spark: SparkSession) -> None:
    """Ship the package, and lower the session's Arrow batches to what a worker holds with long texts; smaller ones stay."""
    ship(spark)
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2048), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or int(now) == 0 or int(now) > most:
            spark.conf.set(name, str(most))


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id long, text string (null: empty), and the further columns named as strings. Extra columns stay behind."""
    prepare(df.sparkSession)
    df = distinct_names(df)
    return df.select(
        column(df, "doc_id", "long").alias("doc_id"),
        F.coalesce(column(df, "text", "string"), F.lit("")).alias("text"),
        *(column(df, name, "string").alias(name) for name in more),
    )


def crc32_mod(name: str, n: int) -> Column:
    """crc32(id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", rows: int = 4096, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has at most `rows` rows and about `size` bytes in the text column; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, before + size, "right"))), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def units(batches: Iterable[pa.RecordBatch], rows: int, size: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """As slices(), but small batches are put together up to `rows` rows or `size` bytes."""
    own, n, held_bytes = [], 0, 0
    for part in slices(batches, text, rows, size):
        more = part.column(text).nbytes
        if own and (n + part.num_rows > rows or held_bytes + more > size):
            yield pa.Table.from_batches(own).combine_chunks().to_batches()[0]
            own, n, held_bytes = [], 0, 0
        own.append(part)
        n, held_bytes = n + part.num_rows, held_bytes + more
    if own:
        yield pa.Table.from_batches(own).combine_chunks().to_batches()[0]


def dealing(total: float, group: int) -> tuple[int, int]:
    """(parts, bytes of a unit) for `total` items that meet in groups of about `group`.

    A unit of texts sends one row to each part that it has items of. So that
    rows stay well filled, groups grow up to eightfold beyond 4096 parts, and
    units with the number of parts, up to 64 MB.
    """
    group = min(8 * group, max(group, math.ceil(total / 4096)))
    parts = max(1, math.ceil(total / group))
    return parts, min(64 << 20, max(SLICE_BYTES, 64 * 6 * parts))


def roots(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node joined to each) of the links given, by repeated hooking to the smaller root."""
    nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if not (low != high).any():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task as stars, so that long chains become short before the shuffles."""
    for batch in batches:
        nodes, root = roots(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        keep = nodes != root
        yield pa.record_batch({"a": pa.array(nodes[keep], pa.int64()), "b": pa.array(root[keep], pa.int64())})


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a long, b long).

    Links become a forest within each task; then large-star and small-star steps
    alternate, each written to the shared folder, until the stars stand. Nodes
    without links don't appear. No links, no rows.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        .mapInArrow(_forest, "a long, b long").distinct(), "links")
    for _ in range(rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # large star: larger neighbours hook to the smallest neighbour
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: smaller neighbours, and the node itself, hook to the smallest one
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b")
        after = written(small.distinct(), "stars")
        # stars stand when no root is a leaf elsewhere and no leaf has two roots
        leaves = after.groupBy("a").count()
        moved = leaves.where("count > 1").select("a").union(after.select(F.col("b").alias("a")).distinct().join(leaves.select("a"), "a", "left_semi"))
        done = not moved.head(1)
        edges = after
        if done:
            break
    else:
        raise RuntimeError(f"components don't stand after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
