"""Token counts: a broadcast table of frequent pre-token lengths, then a bounded cache in each worker."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE, documents, held, slices, tidy
from .tokens import SPECIAL, encoder, has_unassigned

_special = next(iter(SPECIAL))
#: Pre-tokens longer than this many bytes are encoded without being kept in the cache.
KEPT_BYTES = 256


@lru_cache(maxsize=2)
def splitter(path: str | None) -> Callable[[str], list[str]]:
    """A function from a text without special strings to its pieces: pre-tokens as the vocabulary's pattern cuts them.

    A word with an unassigned character is a piece of its own, together with
    the white space before it, for the library to cut: no pre-token runs from
    anything else into white space, so nothing beside it depends on it.
    """
    findall, word = regex.compile(encoder(path).pattern).findall, regex.compile(r"\s*+\S+")

    def split(text: str) -> list[str]:
        if not has_unassigned(text):
            return findall(text)
        pieces, at = [], 0
        for found in word.finditer(text):
            if has_unassigned(found.group()):
                pieces += findall(text[at : found.start()])
                pieces.append(found.group())
                at = found.end()
        return pieces + findall(text[at:])

    return split


def _frequent(path: str | None, most: int):
    """The most frequent pieces of a task's texts, `most` of them at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(path), Counter()
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                seen.update(p for s in text.split(_special) for p in split(s) if len(p) <= KEPT_BYTES // 4)
            if len(seen) > 8 * most:
                seen = Counter(dict(seen.most_common(4 * most)))
        best = seen.most_common(most)
        yield pa.record_batch({"piece": pa.array([p for p, _ in best], pa.string()), "n": pa.array([n for _, n in best], pa.int64())})

    return run


class Lengths(dict):
    """Second tier: lengths of pieces that the table doesn't have, encoded once while the cache holds them."""

    def __init__(self, table: dict, length: Callable[[str], int]):
        super().__init__()
        self.table, self.length = table, length

    def __missing__(self, piece: str) -> int:
        n = self.table.get(piece)
        if n is None:
            n = self.length(piece)
            if len(piece) > KEPT_BYTES // 4:  # seldom met again, and the cache is bounded in bytes too
                return n
            if len(self) >= CACHE:  # full: start anew
                self.clear()
        self[piece] = n
        return n


def _count(path: str | None, table):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, value = encoder(path), table.value
        if coder.pieces:
            split = splitter(path)
            length = held("token_counts", value, lambda: Lengths(dict(zip(value[0], np.frombuffer(value[1], np.uint32).tolist(), strict=True)), coder.piece_length)).__getitem__

            def count(text: str) -> int:
                runs = text.split(_special)
                return len(runs) - 1 + sum(sum(map(length, split(s))) for s in runs)
        else:
            count = coder.length
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array([count(t) for t in texts], pa.int64())})

    return tidy(run)


def count_tokens(docs: DataFrame, path: str | None = None, table_size: int = 50_000, sample_docs: int = 2_000) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every whole text, as the tokenizers library counts them.

    The first tier is a broadcast table of the lengths of at most `table_size`
    frequent pre-tokens of at most 64 characters. It is a cache's first filling,
    taken from about `sample_docs` documents drawn by hash, and bears on speed
    alone: what it lacks is encoded and kept in the worker's bounded cache. No
    pre-token of the documents is shuffled. Texts of every script take this way;
    only words with a character that has no Unicode category are cut by the
    library itself, and they are cached too. A vocabulary (`path`) other than
    byte_bpe_50k.json has another pattern: its texts are encoded whole.

    Null and empty texts have 0; null ids and repeated rows stay as they are;
    empty tables give no rows; further columns are left out.
    """
    docs = documents(docs)
    spark, coder = docs.sparkSession, encoder(path)
    seen: Counter = Counter()
    if coder.pieces:
        drawn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(min(1, sample_docs / max(docs.count(), 1)) * 1_000_000)
        for row in docs.where(drawn).select("text").repartition(4).mapInArrow(_frequent(path, table_size), "piece string, n long").toLocalIterator():
            seen[row.piece] += row.n
    pieces = [p for p, _ in seen.most_common(table_size)]
    table = spark.sparkContext.broadcast((pieces, np.array([coder.piece_length(p) for p in pieces], np.uint32).tobytes()))
    return docs.mapInArrow(_count(path, table), "doc_id long, n_bytes long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents; see count_tokens()."""
    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
