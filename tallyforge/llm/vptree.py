"""Approximate nearest neighbours by cosine: a vantage-point tree for each shard, pruned by the triangle inequality.

Vectors are dealt to cells by their nearest pivot, and cells to shards by hash.
A query first searches the shards of its own cell; the distance of its k-th
neighbour there then prunes whole shards by their distances from their pivots,
and what is left is searched by their trees.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, distinct_names, held, prepare, written

#: Vectors in a leaf, queries that walk a tree together, and pairs scored at once.
LEAF, TOGETHER, PAIRS = 128, 512, 32_768
#: Pivots, at most, for all vectors of one length.
PIVOTS = 2048
#: By how much a distance or cosine that the tree computes may differ from the exact one.
_SLACK = 1e-7


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of equal rows in double precision, each sum taken in the order of components."""
    dot, a, b = (np.zeros(len(queries)) for _ in range(3))
    for x, y in zip(queries.T, vectors.T, strict=True):
        dot += x * y
        a += x * x
        b += y * y
    return dot / (np.sqrt(a) * np.sqrt(b))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row by a power of two, so that squares neither overflow nor vanish; cosines keep every bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _chords(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cos))


class Best:
    """The k best (score, id) of each query, best first: larger scores, then smaller ids. A bounded table."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates, in any order, several for a query."""
        own = np.unique(query)
        q = np.concatenate([np.repeat(own, self.k), query])
        s, i = np.concatenate([self.score[own].ravel(), score]), np.concatenate([self.id[own].ravel(), ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        fresh = np.ones(len(q), bool)  # parallel vectors of one id are one candidate
        fresh[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | np.isinf(s[1:])
        q, s, i = q[fresh], s[fresh], i[fresh]
        at = np.arange(len(q)) - np.searchsorted(q, q)
        keep = at < self.k
        self.score[q[keep], at[keep]], self.id[q[keep], at[keep]] = s[keep], i[keep]

    def chord(self, active: np.ndarray) -> np.ndarray:
        """The distance of the k-th best of each query; infinite where there are fewer."""
        last = self.score[active, -1]
        return np.where(np.isinf(last), np.inf, _chords(last))


class Tree:
    """Distinct vectors with the ids that have them; distances are those of the unit vectors' chords, sqrt(2 - 2 cos)."""

    def __init__(self, vectors: np.ndarray, copies: list[np.ndarray]):
        self.vectors, self.points = vectors, unit(vectors)
        self.first = np.concatenate([[0], np.cumsum([len(c) for c in copies])]).astype(np.int64)
        self.ids = np.concatenate(copies) if copies else np.zeros(0, np.int64)
        self.visited = 0
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, own: np.ndarray):
        """(members) of a leaf, or (vantage, [(low, high, child) near and far]); far vantages part best."""
        if len(own) <= LEAF:
            return own
        rows = self.points[own]
        at = int(np.argmin(rows @ rows.mean(axis=0)))
        away = _chords(rows[at : at + 1] @ rows.T)[0]
        away[at] = -1
        order = np.argsort(away, kind="stable")[1:]
        half = len(order) // 2
        sides = [s for s in (order[:half], order[half:]) if len(s)]
        return own[at], [(away[s[0]], away[s[-1]], self._build(own[s])) for s in sides]

    def _add(self, best: Best, active: np.ndarray, members: np.ndarray, queries: np.ndarray, units: np.ndarray, own: np.ndarray) -> None:
        """Score the members that may be among the k best of each active query, ties with the k-th included, and keep the best."""
        self.visited += len(active) * len(members)
        near = units[active] @ self.points[members].T
        least = best.score[active, -1]
        if len(members) > best.k:  # one of a query's points may be its own row alone, so one more counts
            least = np.maximum(least, -np.partition(-near, best.k, axis=1)[:, best.k])
        q, m = np.nonzero(near >= least[:, None] - _SLACK)
        for lo in range(0, len(q), PAIRS):
            a, p = active[q[lo : lo + PAIRS]], members[m[lo : lo + PAIRS]]
            score = cosines(queries[a], self.vectors[p])
            many = self.first[p + 1] - self.first[p]
            where = np.repeat(self.first[p], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            a, score, ids = np.repeat(a, many), np.repeat(score, many), self.ids[where]
            other = ids != own[a]
            if other.any():
                best.add(a[other], score[other], ids[other])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, limit: np.ndarray | None = None) -> Best:
        """The k best rows for each query but those of its own id; `limit`: the distance beyond which none is wanted.

        A side is left out if factor times the least distance that the triangle
        inequality allows there exceeds the k-th distance so far. With factor 1
        the result is exact: whatever ties with the k-th is scored, so that
        ties go to the smaller id, whatever their number.
        """
        q, best = unit(queries), Best(len(queries), k)
        limit = np.full(len(q), np.inf) if limit is None else limit
        stack = [(self.root, np.arange(len(q)), np.zeros(len(q)))]
        while stack:
            node, active, bound = stack.pop()
            active = active[factor * bound <= np.minimum(best.chord(active), limit[active]) + _SLACK]
            if not len(active):
                continue
            if isinstance(node, np.ndarray):
                self._add(best, active, node, queries, q, own)
                continue
            vantage, sides = node
            away = _chords(q[active] @ self.points[vantage])
            self._add(best, active, np.array([vantage]), queries, q, own)
            bounds = [np.maximum(0, np.maximum(low - away, away - high)) for low, high, _ in sides]
            nearer = np.argmin(np.stack(bounds + [np.full(len(active), np.inf)] * (2 - len(sides))), axis=0)
            # each query takes its nearer side first: pushed last, so popped first
            for turn in (1, 0):
                for i, (_, _, child) in enumerate(sides):
                    mine = (nearer == i) == (turn == 0)
                    if mine.any():
                        stack.append((child, active[mine], bounds[i][mine]))
        return best


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null or empty, not all zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy().reshape(rows, -1))


def _by_size(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches by the length of their vectors."""
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            yield size, batch.filter(pa.array(sizes == size))


def _pivots(shared) -> dict[int, np.ndarray]:
    value = shared.value
    return held("vptree", value, lambda: {n: unit(scaled(v)) for n, v in value.items()})


def _cell(pivots):
    """Each vector's nearest pivot (ties: the first) and its distance from it. A batch's equal rows become one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _pivots(pivots)
        for size, part in _by_size(batches):
            raw = np.ascontiguousarray(part.column("vector").flatten().to_numpy().reshape(part.num_rows, -1))
            marks = np.stack([part.column("vec_id").to_numpy(), np.array(part.column("asks").to_pylist(), np.int64)], axis=1)
            rows = np.ascontiguousarray(np.concatenate([marks.view(np.uint8), raw.view(np.uint8)], axis=1))
            part = part.take(pa.array(np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_index=True)[1]))
            away = _chords(unit(_matrix(part.column("vector"), part.num_rows)) @ known[size].T)
            cell = np.argmin(away, axis=1)
            yield pa.record_batch({c: part.column(c) for c in ("size", "vec_id", "vector", "asks")} | {"cell": pa.array(cell, pa.int32()), "away": pa.array(away[np.arange(len(cell)), cell])})

    return run


def _others(pivots, cells, factor: float):
    """For each query (with its k-th distance in its own cell) the shards of other cells that may hold nearer rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _pivots(pivots)
        for size, part in _by_size(batches):
            cell, subs, low, high = (np.array(x) for x in zip(*cells.value[size], strict=True))
            for lo in range(0, part.num_rows, TOGETHER):
                own = part.slice(lo, TOGETHER)
                away = _chords(unit(_matrix(own.column("vector"), own.num_rows)) @ known[size].T)[:, cell]
                bound = np.maximum(0, np.maximum(low - away, away - high))
                far, mine = (own.column(c).to_numpy(zero_copy_only=False) for c in ("far", "cell"))
                q, c = np.nonzero((factor * bound <= far[:, None] + _SLACK) & (cell[None, :] != mine[:, None]))
                sub = np.arange(subs[c].sum()) - np.repeat(np.cumsum(subs[c]) - subs[c], subs[c])
                q, c = np.repeat(q, subs[c]), np.repeat(c, subs[c])
                for at in range(0, len(q), 2 * TOGETHER):
                    rows, to = own.take(pa.array(q[at : at + 2 * TOGETHER])), slice(at, at + 2 * TOGETHER)
                    yield pa.record_batch({"size": rows.column("size"), "cell": pa.array(cell[c[to]], pa.int32()), "sub": pa.array(sub[to], pa.int64()), "kind": pa.array(np.ones(rows.num_rows), pa.int32()), "vec_id": rows.column("vec_id"), "vector": rows.column("vector"), "far": rows.column("far")})

    return run


def _walk(k: int, factor: float):
    """Reads rows by shard, its vectors before the queries that come to it: query_id, vec_id, score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members, tree, asked = None, [], None, []

        def build():
            nonlocal tree
            if tree is not None or not members:
                return
            ids = np.concatenate([x for x, _ in members])
            vectors = np.concatenate([x for _, x in members])
            members.clear()
            # copies are one point, with the smallest ids that any query can return
            _, first, where = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
            order = np.lexsort((ids, where))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (where[order][1:] != where[order][:-1]) | (ids[order][1:] != ids[order][:-1])
            order = order[fresh]
            starts = np.searchsorted(where[order], np.arange(len(first) + 1))
            tree = Tree(vectors[first], [ids[order[a : min(b, a + k + 1)]] for a, b in zip(starts, starts[1:], strict=False)])

        def answer() -> pa.RecordBatch:
            queries, ids, far = (np.concatenate(x) for x in zip(*asked, strict=True))
            asked.clear()
            best = tree.search(queries, ids, k, factor, far)
            q, at = np.nonzero(np.isfinite(best.score))
            return pa.record_batch({"query_id": pa.array(ids[q]), "vec_id": pa.array(best.id[q, at]), "score": pa.array(best.score[q, at])})

        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("size", "cell", "sub")), strict=True))
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if names[lo] != shard:
                    if asked and tree is not None:
                        yield answer()
                    shard, tree = names[lo], None
                    members.clear()
                    asked.clear()
                ids, kind = part.column("vec_id").to_numpy(), part.column("kind").to_numpy()
                vectors, far = _matrix(part.column("vector"), len(ids)), part.column("far").to_numpy(zero_copy_only=False)
                if (kind == 0).any():
                    mine, fresh = np.nonzero(kind == 0)[0], np.ones((kind == 0).sum(), bool)
                    fresh[1:] = (ids[mine][1:] != ids[mine][:-1]) | (vectors[mine][1:] != vectors[mine][:-1]).any(axis=1)  # equal rows follow each other
                    members.append((ids[mine[fresh]], vectors[mine[fresh]]))
                mine = np.nonzero(kind == 1)[0]
                if len(mine):
                    build()
                    for at in range(0, len(mine), TOGETHER):
                        asked.append((vectors[mine[at : at + TOGETHER]], ids[mine[at : at + TOGETHER]], far[mine[at : at + TOGETHER]]))
                        if tree is None:  # a shard without vectors
                            asked.clear()
                        elif sum(len(x[1]) for x in asked) >= TOGETHER:
                            yield answer()
        if asked and tree is not None:
            yield answer()

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, factor: float = 1.0, shard_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows of largest cosine for each row that `queries` holds for.

    vectors: vec_id, embedding. Pivots, at most PIVOTS for each length of
    vectors and about one for each `shard_rows` rows, are drawn by a hash of
    vec_id; a vector's cell is that of its nearest pivot, and cells of more rows
    are dealt to several shards by hash. Each query visits its own cell, then
    only the shards whose distances from their pivot allow a row nearer than its
    k-th so far. With factor 1 the result is exact; a larger one prunes more, of
    sides in a tree and of shards alike. Scores are cosines of the original
    vectors in double precision; ties go to the smaller vec_id, whatever the
    number of rows that tie.

    Null, empty and zero vectors, those with a null or non-finite component and
    those without id take no part; vectors of other lengths than the query's
    aren't compared. Rows with the query's own id are its own; equal rows
    count once. Empty tables give no rows; further columns are left out.
    """
    spark = vectors.sparkSession
    prepare(spark)
    vectors = distinct_names(vectors)
    rows = vectors.select(column(vectors, "vec_id", "long").alias("vec_id"), column(vectors, "embedding", "array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("size", F.size("vector")).withColumn("mark", F.xxhash64("vec_id", F.lit(3)))
    drawn: dict[int, list] = {}
    for r in rows.groupBy("size", F.pmod("mark", F.lit(PIVOTS)).alias("bucket")).agg(F.min("mark").alias("mark"), F.count("*").alias("rows")).collect():
        drawn.setdefault(r["size"], []).append((r.mark, r.rows))  # PIVOTS rows for a length of vectors, at most
    marks = [(size, m) for size, own in drawn.items() for m, _ in sorted(own)[: -(-sum(n for _, n in own) // shard_rows)]]
    named = F.broadcast(spark.createDataFrame(marks, "_s int, _m long"))
    points: dict[int, list] = {}
    for r in rows.join(named, (F.col("size") == F.col("_s")) & (F.col("mark") == F.col("_m"))).dropDuplicates(["size", "mark"]).select("size", "mark", "vector").collect():
        points.setdefault(r["size"], []).append((r.mark, r.vector))
    pivots = spark.sparkContext.broadcast({size: np.array([v for _, v in sorted(own, key=lambda x: x[0])]) for size, own in points.items()})
    placed = written(rows.select("size", "vec_id", "vector", "asks").mapInArrow(_cell(pivots), "size int, vec_id long, vector array<double>, asks boolean, cell int, away double"), "cells")
    cells: dict[int, list] = {}
    for r in placed.groupBy("size", "cell").agg(F.count("*").alias("rows"), F.min("away").alias("low"), F.max("away").alias("high")).collect():  # a row for each pivot
        cells.setdefault(r["size"], []).append((r.cell, -(-r.rows // shard_rows), r.low, r.high))
    parts = F.broadcast(spark.createDataFrame([(size, c, n) for size, own in cells.items() for c, n, *_ in own], "_s int, _c int, subs long"))
    dealt = placed.join(parts, (F.col("size") == F.col("_s")) & (F.col("cell") == F.col("_c")))
    nowhere = F.lit(float("inf"))
    members = dealt.select("size", "cell", F.pmod(F.xxhash64("vec_id", "vector"), F.col("subs")).alias("sub"), F.lit(0).alias("kind"), "vec_id", "vector", nowhere.alias("far"))

    def walk(asked: DataFrame) -> DataFrame:
        ordered = members.union(asked).repartition("size", "cell", "sub").sortWithinPartitions("size", "cell", "sub", "kind", "vec_id", "vector")
        return ordered.mapInArrow(_walk(k, factor), "query_id long, vec_id long, score double").distinct()

    asking = dealt.where("asks")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))
    found = written(walk(asking.select("size", "cell", every.alias("sub"), F.lit(1).alias("kind"), "vec_id", "vector", nowhere.alias("far"))), "home")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    if any(len(own) > 1 for own in cells.values()):
        last = found.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("_far"))
        searched = asking.join(last, F.col("vec_id") == F.col("_q"), "left").select("size", "cell", "vec_id", "vector", F.coalesce("_far", nowhere).alias("far"))
        further = searched.mapInArrow(_others(pivots, spark.sparkContext.broadcast(cells), factor), "size int, cell int, sub long, kind int, vec_id long, vector array<double>, far double")
        found = found.union(walk(further)).distinct()
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_vptree(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth embedding; see nearest()."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
