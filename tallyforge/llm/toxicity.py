"""Toxicity: nearest labelled examples by exact TF-IDF cosine in a block-max inverted index; votes weighted by nearness.

Every word of the examples is a term. A term's weight is (1 + log times) * idf
* relevance squared; relevance is log2(2 + a / max(1, c)) for the a toxic
examples and c clean ones (at equal class sizes) that have it, so that a term
which marks neither class has but its idf. Votes become shares of toxic
documents by examples that had no part in idf, relevance or the index: each of
FOLDS parts of them is voted on by an index of the others.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE, column, crc32_mod, distinct_names, documents, held, prepare, slices, tidy, trim, written

#: Tasks that read the examples, and parts of the examples for the calibration.
TASKS, FOLDS = 8, 5
#: Examples in a block of the index; a term that one of so many examples has is common; texts that are scored together.
BLOCK, COMMON, TOGETHER = 32, 16, 128
#: Weight of the classes' share among the votes, and bins of the calibration.
PRIOR, BINS = 0.2, 20
#: Stripped from words' ends.
_EDGES = ".,;:!?\"'()[]{}<>*_|-"
_EVIDENCE = "array<struct<doc_id:bigint,similarity:double,toxic:int>>"
_EVIDENCE_ARROW = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))


class _Terms(dict):
    """word -> its term's hash (0: nothing but edges), in a bounded cache."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        bare = word.strip(_EDGES)
        self[word] = found = xxhash.xxh3_64_intdigest(bare) if bare else 0
        return found


def counted(text: str, known: _Terms) -> tuple[np.ndarray, np.ndarray]:
    """(terms, times) of a whole text, terms in order."""
    words = text.lower().split()
    terms, times = np.unique(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), return_counts=True)
    return (terms[1:], times[1:]) if len(terms) and terms[0] == 0 else (terms, times)


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each start to its end, and their numbers."""
    many = ends - starts
    return np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum()), many


class Index:
    """Examples as TF-IDF vectors of unit length, in blocks.

    A term has an entry for each block of examples that has it: its largest
    weight there, and its postings. The lists of common terms are laid out as
    rows of a matrix, so that those of many texts are summed by one product.
    """

    FIELDS = ("vocabulary", "weight", "terms", "blocks", "most", "starts", "rows", "weights", "ids", "labels")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        n = len(self.ids)
        self.size = -(-n // BLOCK)
        first, last = self.starts[self.terms[:-1]], self.starts[self.terms[1:]]
        often = np.nonzero(last - first >= max(1, n / COMMON))[0]
        self.common = np.full(len(self.vocabulary), -1)
        self.common[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.size * BLOCK))
        places, many = _spans(first[often], last[often])
        self.dense[np.repeat(np.arange(len(often)), many), self.rows[places]] = self.weights[places]

    def vector(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary's numbers of the terms that it has, and their weights, of unit length."""
        if not len(self.vocabulary) or not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == terms
        own = at[hit]
        weights = (1 + np.log(times[hit])) * self.weight[own]
        return own, weights / np.sqrt((weights * weights).sum()) if len(own) else weights

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of the k nearest of each vector with any term in common, ties to the smaller id. Exact.

        The common terms' sums are known for every example; the k-th largest of
        them is a threshold that the k-th cosine can't be below. A block's bound
        is its largest such sum, and the sum of the query's other weights times
        the block's largest ones: blocks with bounds below the threshold hold
        no nearer example, and the other terms' postings are read in the rest alone.
        """
        out = []
        for lo in range(0, len(vectors), TOGETHER):
            part = vectors[lo : lo + TOGETHER]
            asked = np.zeros((len(part), len(self.dense)))
            for i, (own, weights) in enumerate(part):
                at = self.common[own]
                asked[i, at[at >= 0]] = weights[at >= 0]
            sums = asked @ self.dense
            tops = sums.reshape(len(part), self.size, BLOCK).max(axis=2) if self.size else np.zeros((len(part), 0))
            for (own, weights), found, bounds in zip(part, sums, tops, strict=True):
                out.append(self._nearest(own, weights, found, bounds, k))
        return out

    def _nearest(self, own: np.ndarray, weights: np.ndarray, found: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        least = np.partition(found, len(found) - k)[-k] if len(found) >= k else 0.0
        rare = self.common[own] < 0
        entries, many = _spans(self.terms[own[rare]], self.terms[own[rare] + 1])
        weights, blocks = np.repeat(weights[rare], many), self.blocks[entries]
        bounds = bounds + np.bincount(blocks, weights * self.most[entries], minlength=self.size)
        chosen = bounds >= max(least - 1e-9, 1e-12)
        mine = chosen[blocks]
        at = entries[mine]
        places, many = _spans(self.starts[at], self.starts[at + 1])
        found = found + np.bincount(self.rows[places], np.repeat(weights[mine], many) * self.weights[places], minlength=len(found))
        # products of matrices may differ in the last bits, which shall not order what ties
        rows = np.nonzero(chosen)[0][:, None] * BLOCK + np.arange(BLOCK)
        rows = rows.ravel()
        scores = np.round(found[rows], 12)
        if len(rows) > k:
            keep = scores >= max(np.partition(scores, len(scores) - k)[-k], 1e-12)
            rows, scores = rows[keep], scores[keep]
        rows, scores = rows[scores > 0], scores[scores > 0]
        keep = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[keep], scores[keep]

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, prior: float) -> list[tuple[float | None, np.ndarray, np.ndarray]]:
        """For each vector its neighbours' labels weighted by nearness, with a weight of PRIOR on the classes' share (None: no neighbour), the neighbours and cosines."""
        return [(float(((near * self.labels[rows]).sum() + PRIOR * prior) / (near.sum() + PRIOR)) if len(rows) else None, rows, near) for rows, near in self.nearest(vectors, k)]


def term_weights(df: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> np.ndarray:
    """idf times relevance squared, for terms that df examples have, `toxic` of them toxic ones; n: clean and toxic examples."""
    clean = (df - toxic) * (n[1] / max(n[0], 1))
    return np.log((n.sum() + 1) / (df + 0.5)) * np.log2(2 + toxic / np.maximum(1, clean)) ** 2


def fit_index(examples: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Index:
    """The index of examples (id, label, terms, times)."""
    vocabulary, at = np.unique(np.concatenate([e[2] for e in examples] or [np.zeros(0, np.uint64)]), return_inverse=True)
    times = np.concatenate([e[3] for e in examples] or [np.zeros(0, np.int64)])
    return index_of(vocabulary, at.astype(np.int32), np.array([len(e[2]) for e in examples], np.int64), times, np.array([e[0] for e in examples], np.int64), np.array([e[1] for e in examples], np.int64))


def index_of(vocabulary: np.ndarray, at: np.ndarray, sizes: np.ndarray, times: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Index:
    """The index of examples by their terms' numbers. Neighbouring rows share their heaviest common term, so that blocks are alike."""
    n = np.bincount(labels, minlength=2).astype(float)
    df = np.bincount(at, minlength=len(vocabulary)).astype(float)
    weight = term_weights(df, np.bincount(at[np.repeat(labels, sizes) == 1], minlength=len(vocabulary)), n)
    row, w = np.repeat(np.arange(len(ids), dtype=np.int32), sizes), (1 + np.log(times)) * weight[at]
    w /= np.sqrt(np.bincount(row, w * w, minlength=len(ids)))[row]
    common = np.full(len(ids), -1)
    often = np.nonzero(df[at] >= max(2, 0.02 * n.sum()))[0]
    often = often[np.lexsort((at[often], w[often], row[often]))]
    common[row[often]] = at[often]  # the last of a row's is its heaviest
    place = np.empty(len(ids), np.int32)
    place[np.lexsort((ids, common))] = np.arange(len(ids), dtype=np.int32)
    row, by = place[row], np.argsort(place)
    order = np.lexsort((row, at))
    row, w, at = row[order], w[order], at[order]
    block = row // BLOCK
    first = np.nonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (block[1:] != block[:-1])]))[0] if len(at) else np.zeros(0, np.int64)
    return Index(
        vocabulary=vocabulary, weight=weight, terms=np.searchsorted(at[first], np.arange(len(vocabulary) + 1)), blocks=block[first], starts=np.append(first, len(at)).astype(np.int32),
        most=np.maximum.reduceat(w, first) if len(first) else np.zeros(0), rows=row, weights=w, ids=ids[by], labels=labels[by])


def calibrated(votes: np.ndarray, labels: np.ndarray, rates: tuple[float, float]) -> np.ndarray:
    """Shares of toxic documents for votes at the ends and in the middle of BINS bins, never falling, from examples with known labels.

    Examples weigh as much as their class has rows for each of its examples. A
    bin without any has its middle; pooled neighbours never fall.
    """
    weight = np.where(labels == 1, rates[1], rates[0])
    bins = np.minimum((votes * BINS).astype(int), BINS - 1)
    mass, toxic = np.bincount(bins, weight, minlength=BINS), np.bincount(bins, weight * labels, minlength=BINS)
    unit = max(min(rates), 1e-9)
    pooled: list[list[float]] = []
    for t, m, middle in zip(toxic, mass, (np.arange(BINS) + 0.5) / BINS, strict=True):
        pooled.append([(t + unit * middle) / (m + unit), m + unit, 1])
        while len(pooled) > 1 and pooled[-2][0] > pooled[-1][0]:
            b, a = pooled.pop(), pooled.pop()
            pooled.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    values = np.concatenate([np.full(int(c), v) for v, _, c in pooled])
    return np.concatenate([[values[0] / 2], values, [(1 + values[-1]) / 2]])


def fold(doc: int) -> int:
    """Of FOLDS parts of the examples, that which calibrates by the index of the others."""
    return xxhash.xxh3_64_intdigest(f"fold {doc}") % FOLDS


def votes_apart(examples: list[tuple[int, int, np.ndarray, np.ndarray]], part: int, k: int, prior: float) -> list[tuple[int, float | None]]:
    """(label, vote) of a part's examples by an index of all others, in whose idf, relevance and vocabulary they had no part; None: no neighbour."""
    index = fit_index([e for e in examples if fold(e[0]) != part and len(e[2])])
    own = [e for e in examples if fold(e[0]) == part]
    found = index.votes([index.vector(*e[2:]) for e in own], k, prior)
    return [(e[1], vote) for e, (vote, *_) in zip(own, found, strict=True)]


class Model:
    """score(texts) -> scores and evidence."""

    def __init__(self, index: Index, curve: np.ndarray, nothing: float, prior: float, k: int):
        self.index, self.k, self.known = index, k, _Terms()
        self.curve, self.nothing, self.prior = curve, nothing, prior
        self.votes = np.concatenate([[0], (np.arange(BINS) + 0.5) / BINS, [1]])

    def score(self, texts: list[str]) -> tuple[np.ndarray, pa.Array]:
        found = self.index.votes([self.index.vector(*counted(t, self.known)) for t in texts], self.k, self.prior)
        scores = np.array([self.nothing if vote is None else np.interp(vote, self.votes, self.curve) for vote, *_ in found])
        rows, near = [x[1] for x in found], [x[2] for x in found]
        ends = np.cumsum([0, *map(len, rows)])
        r = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        near = np.concatenate(near) if near else np.zeros(0)
        found = pa.StructArray.from_arrays([pa.array(self.index.ids[r], pa.int64()), pa.array(near, pa.float64()), pa.array(self.index.labels[r], pa.int32())], fields=list(_EVIDENCE_ARROW.value_type))
        return scores, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found).cast(_EVIDENCE_ARROW)


def packed(examples: list[tuple[int, int, np.ndarray, np.ndarray]]) -> bytes:
    """Examples as numbers of their vocabulary and times, compressed: a small part of the index, which each worker makes of them."""
    sizes = np.array([len(e[2]) for e in examples], np.int64)
    vocabulary, at = np.unique(np.concatenate([e[2] for e in examples] or [np.zeros(0, np.uint64)]), return_inverse=True)
    ends = np.cumsum(sizes)
    steps = np.diff(at, prepend=0)  # an example's numbers rise
    first = (ends - sizes)[sizes > 0]
    steps[first] = at[first]
    out = io.BytesIO()
    np.savez_compressed(out, vocabulary=vocabulary, steps=steps.astype(np.int32), sizes=sizes, times=np.concatenate([e[3] for e in examples] or [np.zeros(0)]).astype(np.int32), ids=np.array([e[0] for e in examples], np.int64), labels=np.array([e[1] for e in examples], np.int64))
    return out.getvalue()


def unpacked(value: bytes) -> Index:
    """The index of the packed examples that have any term."""
    with np.load(io.BytesIO(value)) as a:
        sizes, at = a["sizes"], a["steps"]
        ends = np.cumsum(sizes)
        if len(at):
            at = np.cumsum(at, dtype=np.int64)
            first = (ends - sizes)[sizes > 0]
            before = np.concatenate([[0], at[first[1:] - 1]])  # an example's numbers begin anew
            at = (at - np.repeat(before, sizes[sizes > 0])).astype(np.int32)
        has = sizes > 0
        return index_of(a["vocabulary"], at, sizes[has], a["times"], a["ids"][has], a["labels"][has])


def closing(votes: list[tuple[int, float | None]], rates: tuple[float, float], prior: float) -> dict:
    """What a model has besides its index: the curve from votes to shares, the share where there is no neighbour, the prior."""
    met = [v for v in votes if v[1] is not None]
    none = np.bincount([label for label, vote in votes if vote is None], minlength=2) * np.array(rates)
    curve = calibrated(np.array([v for _, v in met], float), np.array([label for label, _ in met], np.int64), rates)
    return {"curve": curve, "nothing": float((none[1] + 0.5 * prior) / (none.sum() + 0.5)), "prior": prior}


def loaded(shared, k: int) -> Model:
    """The model of a broadcast value, made and kept in the worker."""
    value = shared.value

    def make() -> Model:
        model = Model(unpacked(value[0]), k=k, **value[1])
        trim()  # what making it took
        return model

    return held("toxicity", value, make)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples as their terms and times."""
    known = _Terms()
    for part in slices(batches):
        found = [counted(t, known) for t in part.column("text").to_pylist()]
        yield pa.record_batch({"doc_id": part.column("doc_id"), "toxic": part.column("toxic"), "a": pa.array([f[0].tobytes() for f in found], pa.binary()), "b": pa.array([f[1].astype(np.int32).tobytes() for f in found], pa.binary())})


def _fit(part: int, k: int, prior: float):
    """All examples, packed (part -1), or a part's votes by the index of the others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(doc, label, np.frombuffer(a, np.uint64), np.frombuffer(b, np.int32)) for batch in batches for doc, label, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "a", "b")), strict=True)]
        if part < 0:
            rows = [(None, None, packed(examples))]
        else:
            rows = [(label, vote, None) for label, vote in votes_apart(examples, part, k, prior)]
        yield pa.record_batch({"toxic": pa.array([r[0] for r in rows], pa.int32()), "vote": pa.array([r[1] for r in rows], pa.float64()), "packed": pa.array([r[2] for r in rows], pa.binary())})

    return tidy(run)


def learned(docs: DataFrame, labels: DataFrame, examples: int, example_bytes: int, k: int):
    """The broadcast model of the labelled rows, as score() describes it. docs: doc_id, text."""
    spark = docs.sparkSession
    labels = distinct_names(labels)
    given = labels.select(column(labels, "doc_id", "long").alias("doc_id"), column(labels, "toxic", "int").alias("toxic"))
    given = given.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = given.where(crc32_mod("doc_id", 5) != 0)
    n = {r.toxic: r["count"] for r in given.groupBy("toxic").count().collect()}
    mark = F.xxhash64("doc_id", F.lit(23))
    drawn = [given.where(F.col("toxic") == c).orderBy(mark, "doc_id").limit(examples) for c in (0, 1)]
    drawn = written(drawn[0].union(drawn[1]), "drawn")  # at most 2 * examples rows
    chosen = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    chosen = written(chosen.withColumn("mark", mark), "examples")
    taken: dict[int, list] = {0: [], 1: []}
    left = {0: example_bytes, 1: example_bytes}
    for r in chosen.select("doc_id", "toxic", "mark", F.octet_length("text").alias("bytes")).orderBy("mark", "doc_id").collect():
        if r.bytes <= left[r.toxic]:
            left[r.toxic] -= r.bytes
            taken[r.toxic].append(r.doc_id)
    rates = tuple(n.get(c, 0) / max(1, len(taken[c])) for c in (0, 1))
    prior = n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0))
    own = F.broadcast(spark.createDataFrame([(d,) for x in taken.values() for d in x], "doc_id long"))
    arrays = chosen.join(own, "doc_id").select("doc_id", "toxic", "text").repartition(TASKS).mapInArrow(tidy(_counted), "doc_id long, toxic int, a binary, b binary")
    whole = written(arrays, "terms").repartition(1).sortWithinPartitions("doc_id", "toxic")
    # each part's votes, and the examples together, are tasks of their own
    made = reduce(DataFrame.union, (whole.mapInArrow(_fit(part, k, prior), "toxic int, vote double, packed binary") for part in range(-1, FOLDS))).collect()
    together = [bytes(r.packed) for r in made if r.packed is not None]
    votes = [(r.toxic, r.vote) for r in made if r.packed is None]
    return spark.sparkContext.broadcast((together[0] if together else packed([]), closing(votes, rates, prior)))


def score(docs: DataFrame, labels: DataFrame, examples: int = 2_000, example_bytes: int = 32 << 20, k: int = 15) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (the nearest examples) of every document.

    Learns from labels (doc_id, toxic) of rows whose crc32(doc_id) mod 5 isn't 0:
    at most `examples` of each class, drawn by a hash of doc_id, and of these as
    many as have `example_bytes` of text together, fit the model in one task; the
    classes' numbers are counted over all labels. Every whole text is scored by
    its `k` nearest examples among all, over all of their words.

    Null and empty texts, and others without a word in common with any example,
    get the share of toxic documents among such examples, with half a document
    of the classes' share. Labels of an id that is given twice count as toxic if
    one is; null labels and labels without document are left out; of several
    texts with one labelled id the smallest is the example. Null ids and
    repeated rows are scored as any. Empty tables give no rows, and without
    labels every score is 0.
    """
    docs = documents(docs)
    model = learned(docs.select("doc_id", "text"), labels, examples, example_bytes, k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model, k)
        for part in slices(batches):
            scores, evidence = own.score(part.column("text").to_pylist())
            yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(scores, pa.float64()), "evidence": evidence})

    asked = docs.select("doc_id", "text", (crc32_mod("doc_id", 5) == 0).alias("held_out"))
    scored = asked.mapInArrow(tidy(run), f"doc_id long, held_out boolean, score double, evidence {_EVIDENCE}")
    return scored.select("doc_id", "held_out", "score", _predicted(F.col("score")).alias("predicted"), "evidence")


def _predicted(score: Column) -> Column:
    return (score >= 0.5).cast("int")


def without_toxic(docs: DataFrame, labels: DataFrame, examples: int = 2_000, example_bytes: int = 32 << 20, k: int = 15) -> DataFrame:
    """The rows of docs that score() doesn't predict toxic, with all their columns, in one pass.

    Each row goes or stays by its own text, whatever its id: rows that share an
    id, or have none, don't decide for each other. Empty texts are scored as
    score() does. Empty tables give no rows.
    """
    prepare(docs.sparkSession)
    docs = distinct_names(docs)
    model = learned(documents(docs).select("doc_id", "text"), labels, examples, example_bytes, k)

    # the rows stay in the JVM: only their texts go out, and scores come back
    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = loaded(model, k)
        for batch in texts:
            parts = [own.score(p.column("text").to_pylist())[0] for p in slices([pa.record_batch({"text": batch})])]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
        trim()

    return docs.where(scored(F.coalesce(column(docs, "text", "string"), F.lit(""))) < 0.5)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents with their evidence; see score()."""
    return score(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
