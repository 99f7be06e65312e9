"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and its components.

1. Every document's shingles are hashed and met by hash in packed arrays. A
   document of which fewer than the threshold's share of shingles occur in any
   other row can't link; the others go on. Of a batch's common shingles one
   copy is sent, so that a frequent shingle costs a task no more than a rare one.
2. Equal sets become one node.
3. Small sets (up to a boundary chosen by cost) are met by the subsets that a
   linked pair must share; larger ones by the inverted lists of their prefixes,
   rarest shingles first. Pairs of short lists are verified one by one; long
   lists are cut into blocks whose pairs are counted by matrix products.
4. Links become components.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, CACHE, column, components, dealing, distinct_names, documents, held, roots, slices, tidy, units, written

#: Shingles that a task meets at once.
GROUP = 3_000_000
#: Sets in a list whose pairs are verified one by one.
SHORT = 64
#: From this many sets a shingle can count as frequent.
FREQUENT = 8
#: Sets and bytes of sets in a block of a long list.
BLOCK, BLOCK_BYTES = 256, 8 << 20
#: Shares into which a frequent token's rows are split where they meet its counts.
SALTS = 16
#: Largest boundary between small and large sets that is weighed.
SMALLEST_LARGE = 24
#: Position of a shingle that stands for several documents of its batch.
_MANY = 65_535


class _Words(dict):
    """Words' hashes, kept in a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found




def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `width` words of the text, A to Z in lower case.

    Words are runs of anything but a space and the characters 9 to 13. Fewer
    words make one shingle; no words make none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(held("ngram_join", None, _Words).__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(words) - size + 1 + i])
    return np.unique(out)


def _packed(p, batch, kind, a, b, c=b"", ids=None) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p], pa.int32()), pa.array([batch], pa.int64()), pa.array([kind], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary()), pa.array([c], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=["p", "batch", "kind", "a", "b", "c", "ids"])


_PACKED = "p int, batch long, kind int, a binary, b binary, c binary, ids array<long>"


def _by_part(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indexes) of the hashes dealt to each part."""
    part = hashes % np.uint32(parts)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if ends[p] < ends[p + 1]:
            yield p, order[ends[p] : ends[p + 1]]


def _spread(width: int, parts: int, size: int):
    """Each batch's shingles (32 bits) with their documents' positions, dealt by hash; and a row with its documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in units(batches, _MANY - 1, size):
            sets = [shingles(x, width) for x in part.column("text").to_pylist()]
            sizes = np.array([len(s) for s in sets], np.uint32)
            prints = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
            ids, marks = part.column("doc_id"), part.column("mark").to_numpy().astype(np.int64).tobytes()
            batch = xxhash.xxh3_64_intdigest(prints + repr(ids.to_pylist()).encode()) - (1 << 63)
            low = np.concatenate(sets).astype(np.uint32) if sets else np.zeros(0, np.uint32)
            at = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            del sets
            seen, where, count = np.unique(low, return_inverse=True, return_counts=True)
            again = count[where] > 1
            shared = np.bincount(at[again], minlength=len(sizes)).astype(np.uint32)
            low, at = np.concatenate([low[~again], seen[count > 1]]), np.concatenate([at[~again], np.full((count > 1).sum(), _MANY, np.uint16)])
            for p, own in _by_part(low, parts):
                yield _packed(p, batch, 0, low[own].tobytes(), at[own].tobytes())
            yield _packed(batch % parts, batch, 1, sizes.tobytes(), shared.tobytes(), prints + marks, ids.to_pylist())

    return tidy(run)


def _meet(table: pa.Table) -> pa.Table:
    """For each batch's row of a part: the documents' numbers of shingles that occur elsewhere too."""
    rows = table.to_pylist()
    hashes = np.concatenate([np.frombuffer(r["a"], np.uint32) for r in rows if not r["kind"]] or [np.zeros(0, np.uint32)])
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = np.zeros(len(hashes) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(hashes), bool)
    shared[order] = same[1:] | same[:-1]
    out, at = [table.schema.empty_table()], 0
    for r in rows:
        if r["kind"]:
            out.append(pa.Table.from_pylist([r], table.schema))
            continue
        n = len(r["a"]) // 4
        place = np.frombuffer(r["b"], np.uint16)[shared[at : at + n]]
        at += n
        found, count = np.unique(place[place != _MANY], return_counts=True)
        out.append(pa.Table.from_pylist([r | {"a": found.astype(np.uint16).tobytes(), "b": count.astype(np.uint32).tobytes()}], table.schema))
    return pa.concat_tables(out)


def _decide(percent: int):
    """A batch's documents: doc_id, mark, n, print and whether enough of the shingles occur elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = {"doc_id": [], "mark": [], "n": [], "print": [], "goes_on": []}
        for docs in (r for r in rows if r["kind"]):
            n = np.frombuffer(docs["a"], np.uint32).astype(np.int64)
            shared = np.frombuffer(docs["b"], np.uint32).astype(np.int64)
            for r in rows:
                if not r["kind"]:
                    np.add.at(shared, np.frombuffer(r["a"], np.uint16), np.frombuffer(r["b"], np.uint32))
            out["doc_id"] += docs["ids"]
            out["mark"] += np.frombuffer(docs["c"], np.int64, len(n), 16 * len(n)).tolist()
            out["n"] += n.tolist()
            out["print"] += [docs["c"][16 * i : 16 * i + 16] for i in range(len(n))]
            out["goes_on"] += ((n > 0) & (100 * shared >= percent * n)).tolist()
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("goes_on", pa.bool_())]))

    return run


def _sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=512, size=2 << 20):
            sets = [shingles(x, width).tobytes() for x in part.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "print": pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), "n": pa.array([len(s) // 8 for s in sets], pa.int32()), "items": pa.array(sets, pa.binary())})

    return tidy(run)


def _set_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for part in slices(batches, text="items", rows=2048):
        yield part.column("node").to_pylist(), [np.frombuffer(x, np.uint64) for x in part.column("items").to_pylist()]


def _tally(parts: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _set_batches(batches):
            seen, count = np.unique(np.concatenate(sets).astype(np.uint32), return_counts=True)
            for p, own in _by_part(seen, parts):
                yield _packed(p, 0, 0, seen[own].tobytes(), count[own].astype(np.uint32).tobytes())

    return tidy(run)


def _frequent(table: pa.Table) -> pa.Table:
    """A part's shingles that at least FREQUENT sets have, their counts, and how many there are by powers of two."""
    hashes = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("a").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("b").to_pylist()])
    seen, where = np.unique(hashes, return_inverse=True)
    total = np.bincount(where, counts).astype(np.int64)
    seen, total = seen[total >= FREQUENT], total[total >= FREQUENT]
    powers = [int((total >= 1 << k).sum()) for k in range(40)]
    return pa.table({"a": pa.array([seen.tobytes()], pa.binary()), "b": pa.array([total.tobytes()], pa.binary()), "powers": pa.array([powers], pa.list_(pa.int64()))})


def _at_least(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                counts = np.frombuffer(b, np.int64)
                keep = counts >= least
                yield pa.record_batch({"a": pa.array([np.frombuffer(a, np.uint32)[keep].tobytes()], pa.binary()), "b": pa.array([counts[keep].tobytes()], pa.binary())})

    return run


def overlap(a: int, b: int, percent: int) -> int:
    """The least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    """Of a set of n in any fixed order, linked sets have one of the first so many in common."""
    return n - -(-percent * n // 100) + 1


def partners(n: int, percent: int) -> range:
    """Sizes that can link with n."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_keys(n: int, percent: int) -> int:
    """Keys by which a small set of n is met."""
    return sum(math.comb(n, overlap(n, m, percent)) for m in partners(n, percent))


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest size whose sets are met by subsets, of least cost for the sizes' numbers of sets.

    A small set costs its subset keys. A large one costs, for each shingle of
    its prefix, a list of up to FREQUENT sets and, for each half of them, a
    comparison of n shingles. Sets that a larger one can link with are in both.
    """
    def cost(x: int) -> int:
        large = -(-percent * (x + 1) // 100)
        return sum(c * subset_keys(n, percent) for n, c in sizes.items() if n <= x) + sum(c * prefix(n, percent) * (1 + FREQUENT // 2 * n // 8) for n, c in sizes.items() if n >= large)

    return min(range(SMALLEST_LARGE + 1), key=cost)


def _postings(percent: int, small: int, frequent):
    """token, node, n, at (place in the set's order), kind: 0 a list's, 1 a subset's of the smaller (or either) size that it stands for, 3 of the larger, 2 a long list's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = (np.frombuffer(x, t) for x, t in zip(frequent.value, (np.uint32, np.int64), strict=True))
        large = -(-percent * (small + 1) // 100)
        for nodes, sets in _set_batches(batches):
            rows: list[list] = [[], [], [], [], []]

            def add(tokens, node, n, at, kinds, rows=rows):
                k = len(tokens)
                for to, values in zip(rows, (tokens, np.full(k, node), np.full(k, n, np.int32), at, kinds), strict=True):
                    to.append(values)

            for node, own in zip(nodes, sets, strict=True):
                n = len(own)
                if n >= large:
                    low = own.astype(np.uint32)
                    found = np.searchsorted(known, low)
                    hit = np.zeros(n, bool)
                    if len(known):
                        found = np.minimum(found, len(known) - 1)
                        hit = known[found] == low
                    count = np.where(hit, counts[found] if len(known) else 0, 0)
                    first = np.lexsort((own, count))[: prefix(n, percent)]
                    add(own[first].view(np.int64), node, n, np.arange(len(first), dtype=np.int32), np.where(count[first] > SHORT, 2, 0).astype(np.int32))
                if n <= small:
                    whole, keys, kinds = int(own.sum(dtype=np.uint64)), [], []
                    for m in partners(n, percent):
                        tag = (min(n, m) << 8 | max(n, m)) * 0x9E3779B97F4A7C15
                        values = own.tolist()
                        for out in combinations(values, n - overlap(n, m, percent)):
                            keys.append((whole - sum(out) ^ tag) & (1 << 64) - 1)
                        kinds += [1 if n <= m else 3] * (len(keys) - len(kinds))
                    keys = _mixed(np.array(keys, np.uint64)).view(np.int64)
                    add(keys, node, n, np.zeros(len(keys), np.int32), np.array(kinds, np.int32))
            if rows[0]:
                c = [np.concatenate(x) for x in rows]
                yield pa.record_batch([pa.array(x) for x in c], names=["token", "node", "n", "at", "kind"])

    return tidy(run)


def _subset_pairs(postings: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) of the sets that meet by a subset.

    A subset's sets share all that a link between its two sizes takes, and so
    what one between two of the smaller takes: the first of the smaller ones,
    which partial minima find, goes with each other set and joins them all. It
    is a join that Spark can split where very many sets have one subset.
    """
    first = postings.where("kind = 1").groupBy("token").agg(F.min("node").alias("first")).withColumnRenamed("token", "_token")
    met = postings.where("kind in (1, 3)").select("token", "node").join(first, F.col("token") == F.col("_token")).where("node <> first")
    return met.select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))


def _pairs(percent: int, small: int):
    """Reads lists' postings ordered by token, n: candidate pairs (a < b), or a token whose list is long (a null)."""

    def pairs_of(nodes, n, at):
        nodes, n, at = np.array(nodes), np.array(n, np.int64), np.array(at, np.int64)
        i, j = np.triu_indices(len(nodes), 1)  # n[i] <= n[j]
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        keep = (100 * n[i] >= percent * n[j]) & (n[j] > small)
        keep &= np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j]) >= need
        return nodes[i[keep]], nodes[j[keep]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, held, out, made = None, ([], [], []), [], 0

        def close():
            nonlocal made
            if len(held[0]) > 1:
                if len(held[0]) > SHORT:
                    out.append((np.array([-1]), np.array([token])))
                else:
                    out.append(pairs_of(*held))
                made += len(out[-1][0])
            for x in held:
                x.clear()

        def ready():
            nonlocal made
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            made = 0
            return pa.record_batch({"a": pa.array(np.where(a < 0, a, np.minimum(a, b))), "b": pa.array(np.where(a < 0, b, np.maximum(a, b)))})

        for batch in batches:
            for t, node, n, at in zip(*(batch.column(c).to_pylist() for c in ("token", "node", "n", "at")), strict=True):
                if t != token:
                    close()
                    token = t
                if len(held[0]) <= SHORT:  # a long list is only named here
                    for x, v in zip(held, (node, n, at), strict=True):
                        x.append(v)
            if made > 50_000:
                yield ready()
        close()
        if out:
            yield ready()

    return run


def _verify(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch({c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")})

    return run


def matched(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the linked pairs between two blocks of sets, by matrix products over slices of their common items."""
    items, where, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    column_of = np.where(count > 1, rank, -1)[where]
    row_of = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(column_of, kind="stable")
    column_of, row_of = column_of[order], row_of[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(rank[-1]) + 1 if len(rank) else 0, 2048):
        lo, hi = np.searchsorted(column_of, (start, start + 2048))
        part = np.zeros((len(left) + len(right), 2048), np.float32)
        part[row_of[lo:hi], column_of[lo:hi] - start] = 1
        both += part[: len(left)] @ part[len(left) :].T
    both = both.astype(np.int64)
    n, m = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    return np.nonzero(100 * both >= percent * (n[:, None] + m[None, :] - both))


def _stars(a: np.ndarray, b: np.ndarray) -> pa.Table:
    nodes, root = roots(a, b) if len(a) else (np.zeros(0, np.int64),) * 2
    keep = nodes != root
    return pa.table({"a": pa.array(nodes[keep], pa.int64()), "b": pa.array(root[keep], pa.int64())})


def _block(percent: int):
    """A block's links, as stars: among its sets, or between its own (side 0) and the others brought to it (side 1)."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        nodes = table.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        left = np.nonzero(side == 0)[0]
        right = np.nonzero(side == 1)[0] if (side == 1).any() else left
        if not len(left):
            return _stars(np.zeros(0, np.int64), np.zeros(0, np.int64))
        i, j = matched([sets[k] for k in left], [sets[k] for k in right], percent)
        return _stars(nodes[left[i]], nodes[right[j]])

    return run


def _few(df: DataFrame) -> DataFrame:
    """A stored table as a broadcast side where it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _on(name: str, other: str) -> Column:
    return F.col(name).eqNullSafe(F.col(other))


def _with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (token, node ..) with their token's counts. Few counts are broadcast; else a token's rows are split into SALTS shares."""
    counts = counts.withColumnRenamed("token", "_token")
    if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(counts), F.col("token") == F.col("_token")).drop("_token")
    salted = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, (F.col("token") == F.col("_token")) & (F.pmod(F.xxhash64("node"), F.lit(SALTS)) == F.col("_salt"))).drop("_token", "_salt")


def _long_links(long: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links that the long lists add, and `links`. long: token, node, n.

    First the pairs within each block of a list; blocks are drawn anew for each
    list. Then, where a list has several blocks, the sets outside its largest
    component so far meet every block of it. Sets within one component need no
    further pairs, so a large group of near copies costs its size, not its square.
    """
    long = written(long, "lists")
    if not long.head(1):
        return links
    stats = written(long.groupBy("token").agg(F.count("*").alias("size"), F.max("n").alias("top")), "sizes")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("size") * F.col("top") * 8 / BLOCK_BYTES))
    placed = written(_with_counts(long, stats).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("token", "node"), F.col("blocks"))), "long")
    items = sets.select("node", "items")
    spot = "a long, b long"
    inner = placed.join(items, "node").select("token", "block", F.lit(0).alias("side"), "node", "items").groupBy("token", "block").applyInArrow(_block(percent), spot)
    links = written(links.union(inner).distinct(), "links1")
    several = placed.where("blocks > 1")
    if not several.head(1):
        return links
    label = components(links).withColumnRenamed("node", "_n")
    several = several.join(label, F.col("node") == F.col("_n"), "left").withColumn("component", F.coalesce("component", "node"))
    several = written(several, "labelled")
    main = written(several.groupBy("token", "component").count().groupBy("token").agg(F.max_by("component", F.struct("count", "component")).alias("main")), "main")
    several = written(_with_counts(several, main).select("token", "node", "n", "blocks", "block", (F.col("component") != F.col("main")).alias("rest")), "several")
    rest = several.where("rest")
    if not rest.head(1):
        return links
    chunks = written(rest.groupBy("token").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).alias("chunks")), "chunks")
    own = _with_counts(several, chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select("token", "block", "chunk", F.lit(0).alias("side"), "node")
    brought = _with_counts(rest, chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("token", "block", "chunk", F.lit(1).alias("side"), "node")
    outer = own.union(brought).join(items, "node").groupBy("token", "block", "chunk").applyInArrow(_block(percent), spot)
    return links.union(outer)


def link(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """A row for each document: doc_id, n_shingles and component_id; see linked()."""
    return linked(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A row for each document: doc_id, mark (its text's 64-bit hash), n_shingles, component and component_id.

    Documents link when 100 * common >= percent * all of their distinct shingles
    of `width` words (A to Z in lower case; words are runs of anything but a
    space and the characters 9 to 13). component_id is the smallest doc_id that
    links reach; component is the same for all that are linked, and null for a
    document that can have no link and no copy. Sets hold 64-bit hashes of shingles.

    Null and empty texts have no shingles and link with nothing; fewer words
    than width are one shingle. Rows with a null id take part and have the
    smallest id of the others, or null. Repeated rows are one set and each get
    their row. Empty tables give no rows; further columns are left out.
    """
    docs = documents(docs).withColumn("mark", F.xxhash64("text"))
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts, unit = dealing(size / 6, GROUP)
    met = docs.mapInArrow(_spread(width, parts, unit), _PACKED).groupBy("p").applyInArrow(_meet, _PACKED)
    decided = written(met.groupBy("batch").applyInArrow(_decide(percent), "doc_id long, mark long, n long, print binary, goes_on boolean"), "decided")
    ids = decided.where("goes_on").select(F.col("doc_id").alias("_id")).distinct()
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    going = docs.join(F.broadcast(ids) if few else ids, _on("doc_id", "_id"), "left_semi")
    nodes = going.mapInArrow(_sets(width), "doc_id long, print binary, n int, items binary").where("n > 0")
    nodes = nodes.groupBy("print").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("items").alias("items"))
    sets = written(nodes.withColumn("node", F.monotonically_increasing_id()), "sets")
    total = sets.agg(F.sum("n"), F.count("*")).head()
    if not total[1]:
        return decided.select("doc_id", "mark", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    parts, _ = dealing(total[0], GROUP)
    frequent = written(sets.select("node", "items").mapInArrow(_tally(parts), _PACKED).groupBy("p").applyInArrow(_frequent, "a binary, b binary, powers array<long>"), "frequent")
    powers = frequent.select(F.posexplode("powers").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("c")).collect()
    least = min(1 << r.k for r in powers if r.c <= BROADCAST_ROWS and 1 << r.k >= FREQUENT)
    known = frequent.mapInArrow(_at_least(least), "a binary, b binary").collect()
    hashes = np.concatenate([np.frombuffer(r.a, np.uint32) for r in known])
    order = np.argsort(hashes)
    counts = np.concatenate([np.frombuffer(r.b, np.int64) for r in known])
    table = spark.sparkContext.broadcast((hashes[order].tobytes(), counts[order].tobytes()))
    sizes = {r.n: r["count"] for r in sets.where(F.col("n") <= 2 * SMALLEST_LARGE).groupBy("n").count().collect()}
    small = boundary(sizes, percent)
    postings = written(sets.select("node", "items").mapInArrow(_postings(percent, small, table), "token long, node long, n int, at int, kind int"), "postings")
    ordered = postings.where("kind = 0").repartition("token").sortWithinPartitions("token", "n", "node")
    pairs = written(ordered.mapInArrow(_pairs(percent, small), "a long, b long").union(_subset_pairs(postings)).distinct(), "pairs")
    one, two = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    links = pairs.where("a >= 0").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long")
    named = pairs.where("a < 0").select(F.col("b").alias("token"))
    long = postings.where("kind = 2").select("token", "node", "n").union(postings.where("kind = 0").join(named, "token", "left_semi").select("token", "node", "n"))
    links = _long_links(long, sets, written(links, "links0"), percent)
    label = components(links).withColumnRenamed("node", "_n")
    grouped = sets.select("print", "least", "node").join(label, F.col("node") == F.col("_n"), "left").withColumn("component", F.coalesce("component", "node"))
    smallest = written(grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("_sets")).where("_sets > 1").drop("_sets").withColumnRenamed("component", "_c"), "smallest")
    # a set that is alone has its own smallest id; the others' components are few, or dealt by their key
    found = grouped.join(_few(smallest), F.col("component") == F.col("_c"), "left")
    named = written(found.select(F.col("print").alias("_p"), "component", F.when(F.col("_c").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "named")
    few = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = decided.join(F.broadcast(named) if few else named, F.col("print") == F.col("_p"), "left")
    return found.select("doc_id", "mark", F.col("n").alias("n_shingles"), "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one row of each linked group does: that of the smallest id, nulls last, then of the smallest hash of the text.

    Rows are told apart by id and text, so that rows which share an id, or have
    none, are decided one by one; of rows equal in both, the first in the order
    of their JSON stays. Rows without words are linked with nothing, and all stay.
    """
    docs = distinct_names(docs)
    found = written(linked(docs, width, percent).where("component is not null").groupBy("component", "doc_id", "mark").agg(F.count("*").alias("rows")), "linked")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"), F.count("*").alias("_own")).where("_own > 1").drop("_own")
    first = written(first.withColumnRenamed("component", "_c"), "first")
    stays = F.col("_c").isNull() | _on("doc_id", "first.doc_id") & (F.col("mark") == F.col("first.mark"))  # what is alone stays
    judged = found.join(_few(first), F.col("component") == F.col("_c"), "left").withColumn("stays", stays)
    judged = written(judged.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "stays", "rows"), "judged")
    own, mark = column(docs, "doc_id", "long"), F.xxhash64(F.coalesce(column(docs, "text", "string"), F.lit("")))

    def those(some: DataFrame, how: str, of: DataFrame) -> DataFrame:
        few = some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        some = some.select("_id", "_mark")
        return of.join(F.broadcast(some) if few else some, own.eqNullSafe(F.col("_id")) & (mark == F.col("_mark")), how)

    kept = those(judged.where("not stays"), "left_anti", docs)
    again = judged.where("stays and rows > 1")
    if not again.head(1):
        return kept
    rows = those(again, "left_semi", kept).select(own.alias("_id"), mark.alias("_mark"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    single = rows.groupBy("_id", "_mark").agg(F.min_by("row", F.to_json("row")).alias("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    return those(again, "left_anti", kept).unionByName(single)


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Linked documents by three-word shingles, at nine tenths; see link()."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))
