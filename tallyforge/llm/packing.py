"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, held, slices, tidy
from .tokens import encoder

#: Ends each document.
END = 0
_PIECES = "group long, key long, doc_id long, start long, length long, doc_tokens long, ids binary"
_PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Bins in order of opening; each inner node holds the larger free capacity below it."""

    def __init__(self, capacity: int, bins: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """The first bin with room for `need`, whose room it takes."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        found = at - self.leaves
        tree[at] -= need
        at //= 2
        while at:
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into lengths (each at most capacity). Ties keep their order."""
    tree, bins = Tournament(capacity, len(lengths)), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = tree.place(lengths[i])
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def cut_bin(lengths: list[int], capacity: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """One bin's pieces as sequences of (index, start in the piece, length).

    A bin with more than `slack` free stays no sequence of its own: it is cut
    where its length's binary digits say, into sequences that need no padding.
    """
    total = sum(lengths)
    if capacity - total <= slack:
        sizes = [total]
    else:
        sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    out, i, at = [], 0, 0
    for size in sizes:
        row = []
        while size:
            take = min(size, lengths[i] - at)
            row.append((i, at, take))
            size, at = size - take, at + take
            if at == lengths[i]:
                i, at = i + 1, 0
        out.append(row)
    return out


def _pieces(path: str | None, capacity: int, wide: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held("packing", path, lambda: encoder(path))  # what other operators held goes
        for part in slices(batches, size=2 << 20):
            rows: list[tuple] = []
            for group, key, doc, text in zip(*(part.column(c).to_pylist() for c in ("group", "key", "doc_id", "text")), strict=True):
                ids = np.append(coder.encode(text), np.uint32(END)).astype(wide)
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((group, key, doc, start, len(piece), len(ids), piece.tobytes()))
                if len(rows) >= 2048:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(x, pa.int64()) for x in c[:6]] + [pa.array(c[6], pa.binary())], names=["group", "key", "doc_id", "start", "length", "doc_tokens", "ids"])

    return tidy(run)


def _fill(capacity: int, most: int, slack: int, wide: str):
    """Reads pieces ordered by group; holds at most `most` pieces shorter than a sequence."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, count, short, out = None, 0, [], []

        def flush():
            nonlocal count, short
            for members in first_fit_decreasing([x[2] for x in short], capacity):
                for row in cut_bin([short[m][2] for m in members], capacity, slack):
                    offset = 0
                    for i, at, take in row:
                        doc, start, _, tokens, ids = short[members[i]]
                        step = np.dtype(wide).itemsize
                        out.append((doc, start + at, take, ids[at * step : (at + take) * step], tokens, (group << 32) + count, offset))
                        offset += take
                    count += 1
            short = []

        def ready() -> pa.RecordBatch:
            nonlocal out
            c = list(zip(*out, strict=True))
            out = []
            ids = [np.frombuffer(x, wide).astype("<u4").tobytes() for x in c[3]]
            named = zip(_PACKED.split(", "), (*c[:3], ids, *c[4:]), strict=True)
            return pa.record_batch({k.split()[0]: pa.array(v, pa.binary() if k == "ids binary" else pa.int64()) for k, v in named})

        for batch in batches:
            for g, doc, start, length, tokens, ids in zip(*(batch.column(c).to_pylist() for c in ("group", "doc_id", "start", "length", "doc_tokens", "ids")), strict=True):
                if g != group:
                    flush()
                    group, count = g, 0
                if length == capacity:
                    out.append((doc, start, length, ids, tokens, (group << 32) + count, 0))
                    count += 1
                else:
                    short.append((doc, start, length, tokens, ids))
                    if len(short) >= most:
                        flush()
                if len(out) >= 2048:
                    yield ready()
        flush()
        if out:
            yield ready()

    return tidy(run)


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, group_docs: int = 4096, slack: int = 32) -> DataFrame:
    """Pack every document's ids, then id 0, into sequences of at most `capacity` tokens.

    Returns a row for each piece: doc_id, start (the document's ids before it),
    length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id and
    offset in the sequence, gapless from 0. Full pieces are sequences by
    themselves; what is left of each document is placed by first-fit decreasing
    within its group, drawn by a hash of doc_id, of about `group_docs` documents.
    A worker holds at most twice so many short pieces, whatever a group's size.
    A bin with over `slack` free is cut at powers of two, which aren't padded.

    Null and empty texts are one id 0; a null doc_id stays null; repeated rows
    and equal ids are packed each for itself; an empty table gives no rows;
    further columns are left out.
    """
    docs = documents(docs)
    groups = max(1, docs.count() // group_docs)
    # ids of the vocabulary of 50,257 take two bytes on the way
    wide = "<u2" if path is None or path.endswith("byte_bpe_50k.json") else "<u4"
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(17))
    return (
        docs.select(F.pmod(key, F.lit(groups)).alias("group"), F.xxhash64(key, F.lit(3)).alias("key"), "doc_id", "text")
        .mapInArrow(_pieces(path, capacity, wide), _PIECES)
        .repartition("group")
        .sortWithinPartitions("group", "key", "doc_id", "start")
        .mapInArrow(_fill(capacity, 2 * group_docs, slack, wide), _PACKED)
    )


def op1_pack(spark, sf_dir: str) -> DataFrame:
    """Packing of all documents; see pack()."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
