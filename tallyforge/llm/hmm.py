"""Language-model scores of a hidden Markov model.

Words are counted by hash: each batch sends each of its distinct words once, in
packed arrays, and gets back sums for its documents. The model's symbols are
the most frequent words, classes of all other words by their endings, and the
end of a text. Baum-Welch counts of all training texts, summed over tasks,
train its states, round by round over all of them until the likelihood hardly
grows; a word of a class has its count's share of the class. The recursions run
over each whole text, scaled: a long one is cut into runs, between which the
exact messages pass.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE, crc32_mod, dealing, documents, held, slices, tidy, units, written

#: Classes of words that have no symbol of their own.
CLASSES = 256
#: Words that a task counts at once, and symbols of a run in training and in scoring.
GROUP, TRAIN_RUN, SCORE_RUN = 4_000_000, 512, 128
_EDGES = b".,;:!?\"')]}"


def key_of(word: bytes) -> int:
    """56 bits of the word's hash and 8 of its class, which is of its last three bytes."""
    return xxhash.xxh3_64_intdigest(word) & ~0xFF | xxhash.xxh3_64_intdigest((word.rstrip(_EDGES) or word)[-3:]) % CLASSES


class _Keys(dict):
    """word -> its key, kept in a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = key = key_of(word)
        return key




def words_of(text: str) -> list[bytes]:
    """Runs of anything but a space and the characters 9 to 13, A to Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


_PACKED = "p int, batch long, kind int, a binary, b binary, c binary, d binary, e binary, ids array<long>"
_FIELDS = [("p", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abcde"), ("ids", pa.list_(pa.int64()))]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)], schema=pa.schema(_FIELDS))


def _count(parts: int, size: int):
    """kind 0, for each part: words, their training counts and numbers of documents; those documents' places and times. kind 1: a batch's documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of = held("hmm_keys", None, _Keys).__getitem__
        for part in units(batches, 60_000, size):
            texts, train = part.column("text").to_pylist(), np.array(part.column("train").to_pylist(), bool)
            keys, place, times, sizes = [], [], [], []
            for i, text in enumerate(texts):
                words = words_of(text)
                own, n = np.unique(np.fromiter(map(keys_of, words), np.uint64, len(words)), return_counts=True)
                keys.append(own)
                times.append(n)
                place.append(np.full(len(own), i, np.uint16))
                sizes.append(len(words))
            prints = b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts)
            ids = part.column("doc_id").to_pylist()
            batch = xxhash.xxh3_64_intdigest(prints + repr(ids).encode()) - (1 << 63)
            every, place, times = np.concatenate(keys), np.concatenate(place), np.concatenate(times).astype(np.uint32)
            order = np.lexsort((every, every >> np.uint64(8), (every >> np.uint64(8)) % np.uint64(parts)))
            every, place, times = every[order], place[order], times[order]
            first = np.nonzero(np.concatenate([[True], every[1:] != every[:-1]]))[0] if len(every) else np.zeros(0, np.int64)
            words, many = every[first], np.diff(np.append(first, len(every))).astype(np.uint32)
            counts = np.add.reduceat(np.where(train[place], times, 0), first).astype(np.uint32) if len(first) else many
            of = (words >> np.uint64(8)) % np.uint64(parts)
            cuts = np.searchsorted(of, np.arange(parts + 1))
            pair = np.append(first, len(every))
            for p in range(parts):
                lo, hi = cuts[p], cuts[p + 1]
                if lo < hi:
                    yield _packed([(p, batch, 0, words[lo:hi].tobytes(), counts[lo:hi].tobytes(), many[lo:hi].tobytes(), place[pair[lo] : pair[hi]].tobytes(), times[pair[lo] : pair[hi]].tobytes(), None)])
            yield _packed([(batch % parts, batch, 1, np.array(sizes, np.int64).tobytes(), train.tobytes(), prints, None, None, ids)])

    return tidy(run)


def _total(most: int):
    """A part's counts over all batches: kind 0, for each batch the sums of its documents; kind 2: the part's totals and its most frequent words."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        packed = [r for r in rows if r["kind"] == 0]
        out = [tuple(r[c] for c, _ in _FIELDS) for r in rows if r["kind"] == 1]
        if packed:
            words = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in packed])
            seen, where = np.unique(words, return_inverse=True)
            total = np.bincount(where, np.concatenate([np.frombuffer(r["b"], np.uint32) for r in packed])).astype(np.int64)
            del words
            log, at = np.log10(total + 1.0), 0
            for r in packed:
                n = len(r["a"]) // 8
                own = np.repeat(where[at : at + n], np.frombuffer(r["c"], np.uint32))
                at += n
                place, times = np.frombuffer(r["d"], np.uint16), np.frombuffer(r["e"], np.uint32).astype(float)
                sums, known = np.bincount(place, times * log[own]), np.bincount(place, times * (total[own] > 0)).astype(np.int64)
                there = np.unique(place)
                out.append((r["p"], r["batch"], 0, there.tobytes(), sums[there].tobytes(), known[there].tobytes(), None, None, None))
            kind = (seen & np.uint64(0xFF)).astype(np.int64)
            mass = np.bincount(kind, total, minlength=CLASSES).astype(np.int64)
            types = np.bincount(kind, total > 0, minlength=CLASSES).astype(np.int64)
            best = np.lexsort((seen, -total))[:most]
            best = best[total[best] > 0]
            out.append((packed[0]["p"], 0, 2, mass.tobytes(), types.tobytes(), seen[best].tobytes(), total[best].tobytes(), None, None))
        return pa.Table.from_batches([_packed(out)])

    return run


def _summed(table: pa.Table) -> pa.Table:
    """A batch's documents with their sums."""
    rows = table.to_pylist()
    out: dict[str, list] = {"doc_id": [], "print": [], "train": [], "words": [], "log_sum": [], "known": []}
    for docs in (r for r in rows if r["kind"] == 1):
        n = len(docs["b"])
        sums, known = np.zeros(n), np.zeros(n, np.int64)
        done = set()
        for r in rows:
            if r["kind"] == 0 and r["p"] not in done:  # a batch that came twice has the same sums twice
                done.add(r["p"])
                place = np.frombuffer(r["a"], np.uint16)
                sums[place] += np.frombuffer(r["b"], np.float64)
                known[place] += np.frombuffer(r["c"], np.int64)
        out["doc_id"] += docs["ids"]
        out["print"] += [docs["c"][16 * i : 16 * i + 16] for i in range(n)]
        out["train"] += np.frombuffer(docs["b"], bool).tolist()
        out["words"] += np.frombuffer(docs["a"], np.int64).tolist()
        out["log_sum"] += sums.tolist()
        out["known"] += known.tolist()
    return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("print", pa.binary()), ("train", pa.bool_()), ("words", pa.int64()), ("log_sum", pa.float64()), ("known", pa.int64())]))


class Vocabulary:
    """Frequent words as symbols 0 to M-1, classes as M to M+255, the end as M+256; counts of each."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, class_tokens: np.ndarray, class_types: np.ndarray, ends: int):
        self.keys, self.counts, self.ends = keys, counts, ends
        kind = (keys & np.uint64(0xFF)).astype(np.int64)
        tokens = class_tokens - np.bincount(kind, counts, minlength=CLASSES).astype(np.int64)
        types = class_types - np.bincount(kind, minlength=CLASSES)
        #: A class's words have (count + 1) of this mass each; one word that was never seen has 1.
        self.mass = (tokens + types + 1).astype(float)
        self.seen = np.concatenate([counts, tokens, [ends]]).astype(float)
        self.weight = np.concatenate([counts, self.mass, [max(1, ends)]]).astype(float)
        self.size = len(keys) + CLASSES + 1
        #: What symbols are stored as.
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<i4")
        self._met: dict[bytes, int] = {}  # frequent words met so far: no more than there are symbols
        self._number = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """The text's symbols with its end."""
        met, number, classes = self._met, self._number, len(self.keys)
        out = np.fromiter(map(met.get, words, repeat(-1)), np.int32, len(words))
        for i in np.nonzero(out < 0)[0].tolist():
            key = key_of(words[i])
            found = number.get(key)
            if found is None:
                found = classes + (key & 0xFF)
            else:
                met[words[i]] = found
            out[i] = found
        return np.append(out, self.size - 1).astype(self.kind)


def first_guess(vocabulary: Vocabulary, states: int) -> dict[str, np.ndarray]:
    """Every state has the symbols' shares, each disturbed by a hash; states tend to stay."""
    noise = np.random.default_rng(7).uniform(0.5, 1.5, (vocabulary.size, states))
    share = vocabulary.weight[:, None] * noise
    return {"emit": share / share.sum(axis=0), "move": np.full((states, states), 0.01 / states) + 0.99 * np.eye(states), "start": np.full(states, 1 / states)}


def _runs(texts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All symbols, and each run's beginning, length and text, long runs first; runs cover the texts."""
    begin, size, of, at = [], [], [], 0
    for i, text in enumerate(texts):
        starts = np.arange(0, len(text), length)
        begin.append(at + starts)
        size.append(np.minimum(length, len(text) - starts))
        of.append(np.full(len(starts), i))
        at += len(text)
    begin, size, of = (np.concatenate(x) for x in (begin, size, of))
    return np.concatenate(texts), begin, size, of


def _products(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, opening: np.ndarray, model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each run (longest first) the product of its steps' matrices, scaled, and the scale's log10. A text's first symbol (`opening`) has no move before it."""
    move, states = model["move"], len(model["move"])
    emit, turned = np.ascontiguousarray(model["emit"].T), np.ascontiguousarray(move.T)
    # runs lie along the last axis, where numpy is fast
    through = np.where(opening, np.eye(states)[:, :, None], move[:, :, None]) * emit.take(symbols[begin], axis=1)
    logs = np.zeros(len(begin))
    for t in range(1, int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, "left"))
        step = np.matmul(turned, through[:, :, :n])
        np.multiply(step, emit.take(symbols[begin[:n] + t], axis=1), out=through[:, :, :n])
        if t % 8 == 0:
            top = through[:, :, :n].max(axis=(0, 1))
            through[:, :, :n] /= top
            logs[:n] += np.log10(top)
    return through.transpose(2, 0, 1), logs


def _messages(through: np.ndarray, of: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs in the order of their texts (`of`): the state before each run given all before it, and the weight of what comes after it by state."""
    states = through.shape[1]
    first = np.concatenate([[True], of[1:] != of[:-1]])
    begins = np.nonzero(first)[0]
    runs = np.diff(np.append(begins, len(of)))
    into, after = np.empty((len(of), states)), np.ones((len(of), states))
    into[begins] = start
    rank = begins[np.argsort(-runs, kind="stable")]
    runs = np.sort(runs)[::-1]
    for j in range(1, int(runs[0])):
        at = rank[: np.searchsorted(-runs, -j, "left")] + j
        own = np.matmul(into[at - 1][:, None, :], through[at - 1])[:, 0, :]
        into[at] = own / own.sum(axis=1, keepdims=True)
    for j in range(int(runs[0]) - 1, 0, -1):
        at = rank[: np.searchsorted(-runs, -j, "left")] + j
        own = np.matmul(through[at], after[at][:, :, None])[:, :, 0]
        after[at - 1] = own / own.sum(axis=1, keepdims=True)
    return into, after


def expected(texts: list[np.ndarray], model: dict[str, np.ndarray], at_once: int = 4096) -> dict[str, np.ndarray]:
    """Baum-Welch counts of the whole texts (emissions, moves, starts) and `fit`: their log10 probability and number of symbols.

    Texts longer than TRAIN_RUN are cut into runs that are stepped through
    together; the products of their matrices give each run its exact messages
    from before and after, and the move into a run is counted with it.
    """
    emit, move, start = (model[c] for c in ("emit", "move", "start"))
    states = len(move)
    out = {c: np.zeros_like(model[c]) for c in ("emit", "move", "start")} | {"fit": np.zeros(2)}
    if not texts:
        return out
    symbols, begin, size, of = _runs(texts, TRAIN_RUN)
    out["fit"][1] = len(symbols)
    later = np.concatenate([[False], of[1:] == of[:-1]])
    into, after = np.repeat(start[None, :], len(of), axis=0), np.ones((len(of), states))
    cut = later | np.concatenate([later[1:], [False]])
    if cut.any():
        own = np.nonzero(cut)[0]
        order = np.argsort(-size[own], kind="stable")
        through = np.empty((len(own), states, states))
        through[order] = _products(symbols, begin[own][order], size[own][order], ~later[own][order], model)[0]
        into[own], after[own] = _messages(through, of[own], start)
    order, turned, emits = np.argsort(-size, kind="stable"), np.ascontiguousarray(move.T), np.ascontiguousarray(emit.T)
    for lo in range(0, len(order), at_once):
        own = order[lo : lo + at_once]
        b, s, moved, before = begin[own], size[own], later[own], into[own].T
        active = np.searchsorted(-s, -np.arange(s[0]), "left")  # runs longer than t come first
        ends = np.cumsum(active)
        # all symbols, those of a step side by side; states along the first axis, as numpy is fast along the last
        codes = np.concatenate([symbols[b[:n] + t] for t, n in enumerate(active.tolist())]).astype(np.intp)
        seen = emits.take(codes, axis=1)
        alpha, scale = np.empty_like(seen), np.empty(len(codes))
        steps = [slice(hi - n, hi) for hi, n in zip(ends.tolist(), active.tolist(), strict=True)]
        last = np.where(moved, turned @ before, before)
        for at in steps:
            n = at.stop - at.start
            a = (last if at.start == 0 else turned @ last[:, :n]) * seen[:, at]
            c = a.sum(axis=0, out=scale[at])
            last = np.divide(a, c, out=alpha[:, at])
        out["fit"][0] += float(np.log10(scale).sum())
        seen /= scale
        # what comes after a run, where all of a run's symbols are past; scaled so that alpha * beta sums to one
        beyond, final = after[own].T, alpha[:, ends[s - 1] - active[s - 1] + np.arange(len(own))]
        beta, moves = beyond / (final * beyond).sum(axis=0), np.zeros((states, states))
        for at, following in zip(steps[::-1], [None, *steps[:0:-1]], strict=True):
            if following is not None:
                k = following.stop - following.start
                follows = seen[:, following] * beta[:, :k]
                moves += alpha[:, at.start : at.start + k] @ follows.T
                np.matmul(move, follows, out=beta[:, :k])
            alpha[:, at] *= beta[:, : at.stop - at.start]
        out["move"] += move * (moves + before[:, moved] @ (seen[:, steps[0]] * beta)[:, moved].T)
        out["start"] += alpha[:, steps[0]][:, ~moved].sum(axis=1)
        for k in range(states):
            out["emit"][:, k] += np.bincount(codes, alpha[k], minlength=len(emit))
    return out


def improved(counts: dict[str, np.ndarray], vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters from expected counts. A class's count grows by what its words' added ones and an unseen word weigh; all are smoothed by a little."""
    grown = vocabulary.weight / np.maximum(vocabulary.seen, 1)
    emit = counts["emit"] * grown[:, None] + vocabulary.weight[:, None] / vocabulary.weight.sum()
    move, start = counts["move"] + 0.1, counts["start"] + 0.1
    return {"emit": emit / emit.sum(axis=0), "move": move / move.sum(axis=1, keepdims=True), "start": start / start.sum()}


def log_likelihoods(texts: list[np.ndarray], model: dict[str, np.ndarray]) -> np.ndarray:
    """log10 of each symbol sequence's exact probability.

    The forward recursion is a product of matrices; those of each run of
    SCORE_RUN symbols are multiplied for all runs at once, scaled, and then
    taken in order by each text's state. Any length takes memory for its runs alone.
    """
    symbols, begin, size, of = _runs(texts, SCORE_RUN)
    order = np.argsort(-size, kind="stable")
    first = np.concatenate([[True], of[1:] != of[:-1]])
    through, logs = (np.empty((len(of), *shape)) for shape in ((len(model["move"]),) * 2, ()))
    through[order], logs[order] = _products(symbols, begin[order], size[order], first[order], model)
    into, _ = _messages(through, of, model["start"])
    logs += np.log10(np.matmul(into[:, None, :], through)[:, 0, :].sum(axis=1))
    return np.add.reduceat(logs, np.nonzero(first)[0])


def _pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(shared) -> tuple[Vocabulary, dict[str, np.ndarray]]:
    """The vocabulary and model of a broadcast value."""
    value = shared.value

    def read() -> tuple[Vocabulary, dict[str, np.ndarray]]:
        with np.load(io.BytesIO(value)) as arrays:
            own = {c: arrays[c] for c in arrays.files}
        return Vocabulary(*(own.pop(c) for c in ("keys", "counts", "class_tokens", "class_types")), int(own.pop("ends"))), own

    return held("hmm", value, read)


_CODED = "doc_id long, print binary, train boolean, symbols binary"


def _code(shared):
    """Texts as symbols, which every later pass reads in their place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = _load(shared)
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            prints = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.record_batch({"doc_id": part.column("doc_id"), "print": pa.array(prints, pa.binary()), "train": part.column("train"), "symbols": pa.array([vocabulary.symbols(words_of(t)).tobytes() for t in texts], pa.binary())})

    return tidy(run)


def _texts(batches: Iterable[pa.RecordBatch], vocabulary: Vocabulary, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in slices(batches, text="symbols", size=size):
        yield part, [np.frombuffer(x, vocabulary.kind) for x in part.column("symbols").to_pylist()]


_CHUNKS = 8


def _expect(shared, salts: int):
    """A task's Baum-Welch counts, in chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = _load(shared)
        sums = expected([], model)
        for _, texts in _texts(batches, vocabulary):
            for c, v in expected(texts, model).items():
                sums[c] += v
        flat = np.concatenate([sums[c].ravel() for c in ("emit", "move", "start", "fit")])
        salt = TaskContext.get().partitionId() % salts
        for i, part in enumerate(np.array_split(flat, _CHUNKS)):
            yield pa.record_batch({"chunk": pa.array([i], pa.int32()), "salt": pa.array([salt], pa.int32()), "sums": pa.array([part.tobytes()], pa.binary())})

    return tidy(run)


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x) for x in table.column("sums").to_pylist()], axis=0)
    return pa.table({"chunk": table.column("chunk")[:1], "salt": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _score(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = _load(shared)
        m = len(vocabulary.keys)
        # what a symbol's words have besides log10(count + 1): frequent words give theirs back, classes divide by their mass
        per = np.concatenate([-np.log10(vocabulary.counts + 1.0), -np.log10(vocabulary.mass), [0.0]])
        assert len(per) == m + CLASSES + 1
        for part, texts in _texts(batches, vocabulary):
            scores = log_likelihoods(texts, model) + np.array([per[t].sum() for t in texts])
            yield pa.record_batch({"doc_id": part.column("doc_id"), "print": part.column("print"), "symbols_score": pa.array(scores, pa.float64())})

    return tidy(run)


def score(docs: DataFrame, train: Column, states: int = 6, symbols: int = 16_384, gain: float = 0.003, rounds: int = 20) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every whole text.

    `train` says of which rows (by doc_id) the counts and the model are learned.
    All training texts are counted, and rounds of Baum-Welch run over all of
    them, whole, from a start that the counts give: until a round's log10
    probability of the training symbols has grown by less than `gain` a symbol
    over the round before, `rounds` at most. `symbols` words at most have states'
    probabilities of their own.

    Null and empty texts are one end. Without training texts every count is 0,
    the states are alike, and the scores stay finite. Null ids and repeated rows
    are scored as any; repeated rows count each time. Empty tables give no rows;
    further columns are left out.
    """
    docs = documents(docs).withColumn("train", train)
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts, unit = dealing(size / 6, GROUP)
    most = 4 * symbols // parts + 256
    met = docs.mapInArrow(_count(parts, unit), _PACKED).groupBy("p").applyInArrow(_total(most), _PACKED)
    met = written(met, "counts")
    sums = written(met.where("kind < 2").groupBy("batch").applyInArrow(_summed, "doc_id long, print binary, train boolean, words long, log_sum double, known long"), "sums")
    ends = sums.where("train").count()
    mass, types, keys, counts = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in met.where("kind = 2").select("a", "b", "c", "d").toLocalIterator():
        mass += np.frombuffer(r.a, np.int64)
        types += np.frombuffer(r.b, np.int64)
        keys.append(np.frombuffer(r.c, np.uint64))
        counts.append(np.frombuffer(r.d, np.int64))
        if len(keys) > 64:  # only the most frequent so far are held
            k, c = np.concatenate(keys), np.concatenate(counts)
            best = np.lexsort((k, -c))[:symbols]
            keys, counts = [k[best]], [c[best]]
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    best = np.lexsort((keys, -counts))[:symbols]
    known = {"keys": keys[best], "counts": counts[best], "class_tokens": mass, "class_types": types, "ends": np.array(ends)}
    vocabulary = Vocabulary(*known.values())
    model = first_guess(vocabulary, states)

    def shared():
        return spark.sparkContext.broadcast(_pack_arrays(known | model))

    coded = written(docs.select("doc_id", "text", "train").mapInArrow(_code(shared()), _CODED), "coded")
    if ends:
        taught = coded.where("train").select("symbols")
        salts = max(1, math.isqrt(taught.rdd.getNumPartitions()))
        cut, before = np.cumsum([model[c].size for c in ("emit", "move", "start")]), -math.inf
        for _ in range(rounds):
            added = taught.mapInArrow(_expect(shared(), salts), "chunk int, salt int, sums binary")
            added = added.groupBy("chunk", "salt").applyInArrow(_add, added.schema).groupBy("chunk").applyInArrow(_add, added.schema)
            flat = np.concatenate([np.frombuffer(r.sums) for r in sorted(added.collect(), key=lambda r: r.chunk)])
            *parts_of, (fit, seen) = np.split(flat, cut)
            model = improved({c: v.reshape(model[c].shape) for c, v in zip(("emit", "move", "start"), parts_of, strict=True)}, vocabulary)
            if fit / seen - before < gain:
                break
            before = fit / seen
    n, v = int(mass.sum()) + ends, int(types.sum()) + (ends > 0)
    scored = coded.select("doc_id", "print", "symbols").mapInArrow(_score(shared()), "doc_id long, print binary, symbols_score double").dropDuplicates(["doc_id", "print"])
    scored = scored.select(F.col("doc_id").alias("_d"), F.col("print").alias("_p"), "symbols_score")
    tokens, end = F.col("words") + 1, F.lit(math.log10(ends + 1))
    return sums.join(scored, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("print") == F.col("_p"))).select(
        "doc_id", "train", tokens.alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_sum") + end - tokens * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("symbols_score") + F.col("log_sum")).alias("score"))


def op3_hmm(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose crc32(doc_id) mod 7 isn't 2; see score()."""
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), crc32_mod("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
