"""Hidden Markov scores, toxicity and nearest neighbours, against plain versions."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import hmm, toxicity, vptree
from tallyforge.llm.common import crc32_mod, distinct_names

from .helpers import SCHEMA, awkward, empty, frame, words


def random_model(symbols=7, states=3):
    rng = np.random.default_rng(0)

    def shares(*shape):
        x = rng.random(shape)
        return x / x.sum(axis=-1, keepdims=True)

    return {"emit": shares(states, symbols).T.copy(), "move": shares(states, states), "start": shares(states)}


def forward(text, m):
    a = m["start"] * m["emit"][text[0]]
    for s in text[1:]:
        a = a @ m["move"] * m["emit"][s]
    return math.log10(a.sum())


def test_forward_is_exact(monkeypatch):
    monkeypatch.setattr(hmm, "SCORE_RUN", 8)
    m, rng = random_model(), np.random.default_rng(1)
    texts = [rng.integers(0, 7, n).astype(np.int32) for n in (1, 2, 7, 8, 9, 16, 17, 100, 3)]
    assert np.allclose(hmm.log_likelihoods(texts, m), [forward(t, m) for t in texts])
    every = [np.array([a, b]) for a in range(7) for b in range(7)]
    assert np.isclose((10 ** hmm.log_likelihoods(every, m)).sum(), 1)


@pytest.mark.parametrize("run", [1, 2, 7, 50])
def test_expected_counts_are_baum_welch(monkeypatch, run):
    """Also of texts that are cut into runs."""
    monkeypatch.setattr(hmm, "TRAIN_RUN", run)
    m, rng = random_model(), np.random.default_rng(2)
    texts = [rng.integers(0, 7, n).astype(np.int32) for n in (1, 5, 12, 12, 30, 7, 14, 8, 100)]
    found = hmm.expected(texts, m, at_once=3)
    emit, move, start, fit = plain_expected(texts, m)
    assert np.allclose(found["emit"], emit) and np.allclose(found["move"], move) and np.allclose(found["start"], start)
    assert np.allclose(found["fit"], [fit, sum(map(len, texts))]) and np.isclose(found["move"].sum(), sum(len(t) - 1 for t in texts))


def test_expected_counts_keep_two_arrays_of_the_symbols():
    """What is known of each symbol by state is kept twice at most, and never copied whole."""
    m = random_model(5000, 6)
    texts = list(np.random.default_rng(3).integers(0, 5000, (1000, 200)).astype(np.int32))
    states, symbols = len(m["move"]), 200_000
    tracemalloc.start()
    hmm.expected(texts, m)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * symbols * (3 * states + 3)


def plain_expected(texts, m):
    """Counts of one text after another, by the textbook's recursions."""
    emit, move, start = (np.zeros_like(m[c]) for c in ("emit", "move", "start"))
    fit, states = 0.0, len(m["move"])
    for t in texts:
        a = [m["start"] * m["emit"][t[0]]]
        scale = [a[0].sum()]
        a[0] = a[0] / scale[0]
        for s in t[1:]:
            x = a[-1] @ m["move"] * m["emit"][s]
            scale.append(x.sum())
            a.append(x / scale[-1])
        b = [np.ones(states)]
        for s, c in zip(t[:0:-1], scale[:0:-1], strict=True):
            b.insert(0, m["move"] @ (m["emit"][s] * b[0]) / c)
        for i, s in enumerate(t):
            emit[s] += a[i] * b[i]
            if i + 1 < len(t):
                move += np.outer(a[i], m["emit"][t[i + 1]] * b[i + 1] / scale[i + 1]) * m["move"]
        start += a[0] * b[0]
        fit += sum(map(math.log10, scale))
    return emit, move, start, fit


def plain_hmm(rows, held, states=6, symbols=40, gain=0.003):
    """The score of each row by counts in dictionaries, the textbook's Baum-Welch and the forward recursion."""
    texts = [words(t) for _, t, *_ in rows]
    count = Counter(hmm.key_of(w.encode()) for (d, *_), t in zip(rows, texts, strict=True) if not held(d) for w in t)
    ends = sum(not held(d) for d, *_ in rows)
    mass, types = np.zeros(hmm.CLASSES, np.int64), np.zeros(hmm.CLASSES, np.int64)
    for k, c in count.items():
        mass[k % 256] += c
        types[k % 256] += 1
    best = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:symbols]
    place = {k: i for i, (k, _) in enumerate(best)}
    rest, kinds = mass.copy(), types.copy()
    for k, c in best:
        rest[k % 256] -= c
        kinds[k % 256] -= 1
    vocabulary = hmm.Vocabulary(np.array([k for k, _ in best], np.uint64), np.array([c for _, c in best], np.int64), mass, types, ends)
    coded = [[place.get(hmm.key_of(w.encode()), len(best) + hmm.key_of(w.encode()) % 256) for w in t] + [len(best) + 256] for t in texts]
    model, before = hmm.first_guess(vocabulary, states), -math.inf
    taught = [c for (d, *_), c in zip(rows, coded, strict=True) if not held(d)]
    for _ in range(20):
        emit, move, start, fit = plain_expected(taught, model)
        model = hmm.improved({"emit": emit, "move": move, "start": start}, vocabulary)
        if fit / sum(map(len, taught)) - before < gain:
            break
        before = fit / sum(map(len, taught))
    out = []
    for (d, *_), text, own in zip(rows, texts, coded, strict=True):
        a, total = None, 0.0
        for s in own:
            a = (model["start"] if a is None else a @ model["move"]) * model["emit"][s]
            total += math.log10(a.sum())
            a = a / a.sum()
        for w in text:  # a class's word has its share of the class
            k = hmm.key_of(w.encode())
            if k not in place:
                total += math.log10((count[k] + 1) / (rest[k % 256] + kinds[k % 256] + 1))
        out.append((d, round(total, 5)))
    return Counter(out)


def test_hmm_scores_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(hmm, "TRAIN_RUN", 16)
    rows = [r for r in awkward() if len(r[1] or "") < 5_000]

    def held(d):
        return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2

    found = hmm.score(frame(spark, rows).repartition(3), crc32_mod("doc_id", 7) != 2, symbols=40).collect()
    assert Counter((r.doc_id, round(r.score, 5)) for r in found) == plain_hmm(rows, held)


def test_hmm_scores(spark):
    rows = hmm.score(frame(spark).repartition(3), crc32_mod("doc_id", 7) != 2, symbols=40).collect()

    def held(d):
        return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2

    counts = Counter()
    for d, t, *_ in awkward():
        if not held(d):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t, *_ in awkward():
        own = [*words(t), None]
        want[d, not held(d), len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 6)] += 1
    assert Counter((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert hmm.score(empty(spark), F.lit(True)).count() == 0
    untaught = hmm.score(frame(spark), F.lit(False)).collect()
    assert len(untaught) == len(awkward()) and all(math.isfinite(r.score) and r.base_score == 0 for r in untaught)


def test_hmm_beats_counts_where_topics_last(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{'abcd'[i % 4]}{rng.integers(0, 60)}" for _ in range(80)), None, None, None) for i in range(300)]
    found = hmm.score(spark.createDataFrame(rows, SCHEMA), crc32_mod("doc_id", 7) != 2).where("not train").collect()
    assert found and sum(r.score for r in found) > sum(r.base_score for r in found) + 0.3 * sum(r.n_tokens for r in found)


def plain_vectors(examples):
    """Each term's weight, and examples (id, label, {term: weight}) of unit length, by dictionaries."""
    n = Counter(label for _, label, _ in examples)
    df, toxic = Counter(w for _, _, t in examples for w in t), Counter(w for _, label, t in examples if label for w in t)
    weight = {w: math.log((sum(n.values()) + 1) / (df[w] + 0.5)) * math.log2(2 + toxic[w] / max(1, (df[w] - toxic[w]) * n[1] / max(n[0], 1))) ** 2 for w in df}
    return weight, [(d, label, plain_vector(t, weight)) for d, label, t in examples]


def plain_vector(times, weight):
    own = {w: (1 + math.log(c)) * weight[w] for w, c in times.items() if w in weight}
    norm = math.sqrt(sum(x * x for x in own.values()))
    return {w: x / norm for w, x in own.items()}


def plain_nearest_examples(times, weight, vectors, k):
    q = plain_vector(times, weight)
    found = [(d, label, sum(x * v.get(w, 0) for w, x in q.items())) for d, label, v in vectors]
    return sorted((x for x in found if x[2] > 0), key=lambda x: (-round(x[2], 12), x[0]))[:k]


def plain_terms(text):
    return Counter(w for w in (x.strip(".,;:!?\"'()[]{}<>*_|-") for x in text.lower().split()) if w)


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(8)
    known = toxicity._Terms()
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 60)) % 400) for _ in range(500)]
    examples = [(1000 - i, int(i % 3 == 0), t) for i, t in enumerate(texts)]
    index = toxicity.fit_index([(d, label, *toxicity.counted(t, known)) for d, label, t in examples])
    weight, vectors = plain_vectors([(d, label, plain_terms(t)) for d, label, t in examples])
    asked = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(0, 80)) % 420) for _ in range(300)] + ["", "nowhere", texts[3]]
    assert (index.common >= 0).any() and (index.common < 0).any()
    for text, (got, near) in zip(asked, index.nearest([index.vector(*toxicity.counted(t, known)) for t in asked], 7), strict=True):
        want = plain_nearest_examples(plain_terms(text), weight, vectors, 7)
        assert np.allclose(near, [x[2] for x in want], atol=1e-12) and index.ids[got].tolist() == [x[0] for x in want]


def plain_toxicity(docs, labels, k=15):
    """{(doc, text): score} by all cosines and the minimax form of isotonic regression."""
    def share(votes, rates):
        points = []
        for b in range(20):
            own = [(label, rates[label]) for label, v in votes if v is not None and min(19, int(v * 20)) == b]
            unit, middle = min(rates), (b + 0.5) / 20
            points.append((sum(w for label, w in own if label) + unit * middle, sum(w for _, w in own) + unit))
        mean = lambda a, b: sum(x for x, _ in points[a : b + 1]) / sum(m for _, m in points[a : b + 1])
        return [max(min(mean(a, b) for b in range(i, 20)) for a in range(i + 1)) for i in range(20)]

    given = {d: t for d, _, t in labels if zlib.crc32(str(d).encode()) % 5}
    examples = [(d, given[d], plain_terms(t)) for d, t, *_ in docs if d in given]
    prior = sum(given.values()) / len(given)

    def vote(times, weight, vectors):
        near = plain_nearest_examples(times, weight, vectors, k)
        return (sum(s for _, label, s in near if label) + 0.2 * prior) / (sum(s for *_, s in near) + 0.2) if near else None

    votes = []
    for part in range(toxicity.FOLDS):
        weight, vectors = plain_vectors([e for e in examples if toxicity.fold(e[0]) != part and e[2]])
        votes += [(label, vote(t, weight, vectors)) for d, label, t in examples if toxicity.fold(d) == part]
    rates = tuple(sum(x == c for x in given.values()) / max(1, sum(e[1] == c for e in examples)) for c in (0, 1))
    curve = share(votes, rates)
    curve = [curve[0] / 2, *curve, (1 + curve[-1]) / 2]
    none = [sum(rates[c] for label, v in votes if v is None and label == c) for c in (0, 1)]
    weight, vectors = plain_vectors([e for e in examples if e[2]])
    out = {}
    for d, t, *_ in docs:
        v = vote(plain_terms(t or ""), weight, vectors)
        out[d, t] = (none[1] + 0.5 * prior) / (sum(none) + 0.5) if v is None else float(np.interp(v, [0, *((i + 0.5) / 20 for i in range(20)), 1], curve))
    return out


def test_toxicity_scores_equal_plain_ones(spark):
    rows, labels = toxic_rows(300)
    rows += [(9000, "", "en", "s", 1), (9001, None, "en", "s", 1), (9002, "nowhere else", "en", "s", 1), (None, rows[6][1], "en", "s", 1), (6, rows[6][1], "en", "s", 1)]
    found = toxicity.score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_toxicity(rows[:300], labels) | plain_toxicity(rows[:-1], labels)
    plain = {d: want[d, t] for d, t, *_ in rows}
    assert len(found) == len(rows) and all(abs(r.score - plain[r.doc_id]) < 1e-9 for r in found)
    assert len({r.score for r in found}) > 100


def toxic_rows(n=900):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        own = [f"w{rng.integers(0, 300)}" for _ in range(40)]
        if bad:
            for _ in range(3):
                own[rng.integers(0, 40)] = ("grumble", "snarlax", "snarlot", "snarler")[rng.integers(0, 4)]
        rows.append((i, " ".join(own), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, SCHEMA), given).collect()}
    held = [i for i in found if found[i].held_out]
    assert held and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    right = [found[i].predicted == int(i % 6 == 0) for i in held]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())
    assert all(len(r.evidence) == 15 and r.evidence[0].similarity >= r.evidence[-1].similarity > 0 for r in found.values())
    few = [(d, q, t) for d, q, t in labels if not t] + [x for x in labels if x[2]][:2]  # two toxic examples are examples too
    scores = toxicity.score(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(few, "doc_id long, quality int, toxic int")).collect()
    assert len({r.score for r in scores}) > 100
    flipped = spark.createDataFrame([(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, SCHEMA), flipped).collect()}
    assert again == {d: r.score for d, r in found.items()}


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(d, 1, i % 2) for i, (d, *_) in enumerate(awkward())] + [(None, 1, 1), (100, None, None), (101, 1, 0), (101, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(frame(spark), labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, *_ in awkward())
    assert all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(0 <= r.score < 0.5 for r in toxicity.score(frame(spark), none).collect())
    assert toxicity.score(empty(spark), none).count() == 0
    assert toxicity.without_toxic(frame(spark), none).count() == len(awkward())
    kept = toxicity.without_toxic(frame(spark), labels)
    bad = Counter((r.doc_id, r.score) for r in rows if r.predicted)
    assert kept.columns == distinct_names(frame(spark)).columns and kept.count() == len(awkward()) - sum(bad.values())
    assert toxicity.without_toxic(empty(spark), none).count() == 0


def test_rows_that_share_an_id_are_judged_alone(spark):
    rows, labels = toxic_rows()
    toxic, clean = rows[6][1], rows[7][1]
    rows += [(5000, toxic, "x", "s", 1), (5000, clean, "y", "s", 1), (None, toxic, "x", "s", 1), (None, clean, "y", "s", 1), (None, None, "z", "s", 1)]
    kept = toxicity.without_toxic(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert Counter(r.lang for r in kept.collect() if r.lang != "en") == Counter("yyz")


def plain_nearest(rows, k, step):
    fit = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, a in fit:
        if q % step:
            continue
        best = {}
        for c, b in fit:
            if c != q and len(b) == len(a):
                a2, b2 = a / np.abs(a).max(), b / np.abs(b).max()
                s = sum(x * y for x, y in zip(a2, b2, strict=True)) / (math.sqrt(sum(x * x for x in a2)) * math.sqrt(sum(x * x for x in b2)))
                best[c] = max(best.get(c, -9), s)
        for rank, (c, s) in enumerate(sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]):
            out.add((q, rank + 1, c, round(s, 9)))
    return out


def test_nearest_vectors(spark):
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(60)]  # copies: ties go to the smaller id
    rows += [(2000, None), (2001, []), (2002, [0.0] * 6), (2003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2004, [float("nan")] * 6), (2005, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0]), (2010, [1.0, 2.0]), (2011, [2.0, 1.0]), (None, [1.0] * 6), (2020, [1e200] * 6), (2030, [1e-200, 0.0, 0.0, 0.0, 0.0, 0.0]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as rank", "1 as shard")
    found = vptree.nearest(df, F.col("vec_id") % 10 == 0, shard_rows=100).collect()
    assert {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found} == plain_nearest(rows, 5, 10)
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("kind", ["one_hot", "length_1", "collinear", "signs"])
def test_nearest_with_many_ties(spark, kind):
    rng = np.random.default_rng(12)
    rows = {
        "one_hot": [(i, np.eye(40)[i].tolist()) for i in range(40)],
        "length_1": [(i, [float(rng.choice([-2.0, 1.0, 3.0]))]) for i in range(120)],
        "collinear": [(i, [float(1 + i % 7), 0.0, 0.0]) for i in range(150)] + [(200 + i, [0.0, 1.0, float(i % 2)]) for i in range(60)],
        "signs": [(i, rng.choice([-1.0, 1.0], 4).tolist()) for i in range(300)],
    }[kind]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard_rows in (16, 10_000):
        found = vptree.nearest(df, F.col("vec_id") % 10 == 0, shard_rows=shard_rows).collect()
        want = set()
        for q, a in rows:
            if q % 10 == 0:  # as the query computes them, in the order of components
                others = [(c, float(vptree.cosines(np.array([a]), np.array([b]))[0])) for c, b in rows if c != q]
                want |= {(q, n + 1, c, s) for n, (c, s) in enumerate(sorted(others, key=lambda x: (-x[1], x[0]))[:5])}
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == want


def test_pruning_factor():
    rng = np.random.default_rng(11)
    points = rng.normal(size=(3000, 8)) + 4 * rng.integers(0, 4, (3000, 1))
    tree, q = vptree.Tree(points, [np.array([i]) for i in range(3000)]), rng.normal(size=(50, 8)) + 2
    none = np.full(50, -1)
    cos = (q @ points.T) / np.linalg.norm(points, axis=1)
    want = np.argsort(-cos, axis=1)[:, :5]
    assert (tree.search(q, none, 5, 1.0).id == want).all()
    assert tree.visited < 0.9 * 50 * 3000  # sides are left out, and the result is exact
    loose = tree.search(q, none, 5, 3.0).id
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(loose, want, strict=True)]) > 0.5
