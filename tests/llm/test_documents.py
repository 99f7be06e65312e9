"""Packing, mixing, media, token counts and the n-gram join over awkward rows, against plain versions."""

import hashlib
import io
import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyforge.llm import media, mixing, ngram_join, packing, token_counts
from tallyforge.llm.common import components, distinct_names
from tallyforge.llm.tokens import Encoder, _other

from .helpers import awkward, empty, frame, words


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokens_equal_the_library(library):
    coder = Encoder()
    plain = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F))]
    assert not any(_other.search(c) for c in plain)
    for c in plain:
        for text in (c, f"a{c}b", f" {c}{c} x", f"1{c}2", f"don't{c}'ll", f"{c}  {c}"):
            assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for _, text, *_ in awkward():
        assert coder.encode(text or "").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_pieces_of_every_character(library):
    """The pattern here cuts every assigned character as the library does, and odd words are left to it."""
    split = token_counts.splitter(None)
    for block in range(0, 0x110000, 8192):
        own = [chr(c) for c in range(block, block + 8192) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
        text = "".join(f"x{c}9{c}!{c}  {c} \n{c}" for c in own)
        assert split(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
    coder, rng = Encoder(), random.Random(5)
    odd = ["\u0558", "\U0003d000", "\U000187f8", "\U00010940"]
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", "中", "🎉", "9", " ", "  ", "\n", "\u3000", "'s", "€", *odd]) for _ in range(rng.randint(0, 40)))
        assert sum(map(coder.piece_length, split(text))) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_first_fit_decreasing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 200):
        lengths = rng.integers(1, 1025, n).tolist()
        plain = []  # the first bin with room, by looking at each
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            for b in plain:
                if sum(lengths[j] for j in b) + lengths[i] <= 1024:
                    b.append(i)
                    break
            else:
                plain.append([i])
        assert packing.first_fit_decreasing(lengths, 1024) == plain


@pytest.mark.parametrize("group_docs", [4096, 10])
def test_packing_round_trip(spark, library, group_docs):
    rows = packing.pack(frame(spark), group_docs=group_docs).collect()
    want = Counter(tuple(library.encode(t or "", add_special_tokens=False).ids + [0]) for _, t, *_ in awkward())
    assert Counter(r.doc_tokens for r in rows if r.start == 0) == Counter(len(x) for x in want.elements())
    sequences = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
        padding += (1024 - at) * bool(at & (at - 1))
    assert padding <= 32 * len(sequences)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    for doc, text in ((4, awkward()[3][1]), (14, awkward()[15][1]), (5, ""), (12, awkward()[13][1])):
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(by_id[doc], key=lambda r: r.start)])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [0]
    assert packing.pack(empty(spark)).count() == 0


def test_mixing(spark):
    docs = frame(spark).selectExpr("*", "1 as target", "2 as row", "3 as range", "4 as source_size", "5 as `a.b`")
    rows = mixing.mix(docs, bucket_rows=7).collect()
    assert len(rows) == len(awkward())
    sizes = defaultdict(int)
    for _, t, _, s, _ in awkward():
        sizes[s] += len(words(t))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:  # share by weight, cap, share the rest anew
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        got = r.whole * r.size + r.part
        assert 0 <= got <= 3 * r.size
        taken[r.source] += got
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix(docs, bucket_rows=50_000, with_rows=False).collect()
    assert Counter((r.doc_id, r.size, r.whole, r.part) for r in rows) == Counter((r.doc_id, r.size, r.whole, r.part) for r in again)
    texts = mixing.mixed(docs, 3, 3)
    assert texts.columns == distinct_names(docs).columns and "TEXT" not in texts.columns
    counts = defaultdict(int)
    for r in texts.collect():
        counts[r.source] += len(words(r.text))
    assert {s: n for s, n in taken.items() if n} == dict(counts)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


@pytest.mark.parametrize("table_size", [50, 50_000, 0])
def test_token_counts(spark, library, table_size):
    runs = [c * n for c in ("\u2030", "\u023f", "€", "中", "🎉", "я", "\u0558", " ", "a", "!") for n in (150, 199, 255, 256, 600)]
    mixed = ["a € b 中文字符 и слово 🎉🎉 x", "\n\n  \u0558x y\u0558 \n \u3000中", "w" * 3000 + " \u0558", "<|endoftext|>€<|endoftext|>"]
    rows = awkward() + [(1000 + i, t, "en", "a", 1) for i, t in enumerate(runs + mixed)]
    found = token_counts.count_tokens(frame(spark, rows), table_size=table_size, sample_docs=2000).collect()
    want = Counter((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == want
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_token_counts_of_another_vocabulary(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    found = token_counts.count_tokens(frame(spark), path=path).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in found) == Counter((d, len(other.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in awkward())


def plain_means(rows, height, width):
    """Means of the areas that height by width cells cover of a grey image, overlap by overlap."""
    def cuts(n, m):
        return [[(k, min(k + 1, (i + 1) * n / m) - max(k, i * n / m)) for k in range(int(i * n / m), min(n, math.ceil((i + 1) * n / m)))] for i in range(m)]

    down, across = cuts(len(rows), height), cuts(len(rows[0]), width)
    return [[sum(a * b * rows[y][x] for y, a in d for x, b in c) / sum(a * b for _, a in d for _, b in c) for c in across] for d in down]


def test_features_equal_plain_ones(spark):
    """Bits and samples may differ only where the plain mean lies on the edge."""
    rows = [r for r in awkward() if r[0] is not None and len((r[1] or "").encode()) < 3_000]
    found = {r.doc_id: r for r in media.tiles(media.as_pgm(frame(spark, rows)), 4, 5).collect()}
    for d, t, *_ in rows:
        data = (t or "").encode()
        data += b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        image = [list(data[y : y + 64]) for y in range(0, len(data), 64)]
        steps = np.diff(np.array(plain_means(image, 8, 9)), axis=1).ravel()
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(found[d].difference_hash), np.uint8)).astype(bool)
        assert (bits == (steps > 1e-9))[np.abs(steps) > 1e-8].all() and not bits[steps < -1e-8].any()
        small, means = np.load(io.BytesIO(bytes(found[d].tile)))[:, :, 0].astype(float), np.array(plain_means(image, 4, 5))
        assert (np.abs(small - means) <= 0.5 + 1e-6).all()


def test_media_round_trip(spark):
    rows = media.tiles(media.as_pgm(frame(spark)), payload=True).collect()
    want = Counter()
    for d, t, *_ in awkward():
        data = (t or "").encode()
        data += b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        want[d, len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert media.tiles(media.as_pgm(empty(spark))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"P5\n3 3\n255\nab")), (3, bytearray(b"nothing")), (4, bytearray(b""))], "id int, media binary")
    assert [r.tile for r in media.tiles(odd.selectExpr("*", "1 as height")).collect()] == [None] * 4


def test_images():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (37, 53, 3), dtype=np.uint8)
    ppm = b"P6\n# made\n53 37\n255\n" + image.tobytes()
    assert (media.decode(ppm) == image).all()
    text = b"P3 53 37 255\n" + b" ".join(b"%d" % v for v in image.ravel())
    assert (media.decode(text) == image).all()
    import struct
    step = (53 * 3 + 3) // 4 * 4
    rows = b"".join(image[y, :, ::-1].tobytes().ljust(step, b"\0") for y in range(36, -1, -1))
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 53, 37, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (media.decode(bmp) == image).all()
    bits = rng.integers(0, 2, (5, 11), dtype=np.uint8)
    assert (media.decode(b"P4 11 5\n" + np.packbits(bits, axis=1).tobytes())[:, :, 0] == (1 - bits) * 255).all()
    assert (media.decode(b"P1 11 5\n" + b" ".join(b"%d" % b for b in bits.ravel()))[:, :, 0] == (1 - bits) * 255).all()

    def plain(image, height, width):  # every pixel's share of each new one
        h, w, c = image.shape
        out = np.zeros((height, width, c))
        for y in range(height):
            for x in range(width):
                t, b, l, r = y * h / height, (y + 1) * h / height, x * w / width, (x + 1) * w / width
                for j in range(int(t), min(h, int(np.ceil(b)))):
                    for i in range(int(l), min(w, int(np.ceil(r)))):
                        out[y, x] += image[j, i] * (min(b, j + 1) - max(t, j)) * (min(r, i + 1) - max(l, i))
        return out / ((h / height) * (w / width))

    for shape in ((8, 9), (5, 5), (64, 70), (1, 1)):
        assert np.allclose(media.area_resize(image, *shape), plain(image, *shape))
    import io
    assert np.load(io.BytesIO(media.tile(image, 4, 4))).shape == (4, 4, 3)


def brute_join(rows, width, percent):
    sets, find = brute_groups(rows, width, percent)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i))) for i, ((d, *_), s) in enumerate(zip(rows, sets, strict=True)))


def brute_groups(rows, width, percent):
    """Each row's shingles, and a function from a row's place to its group's."""
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    return sets, find


def near_rows():
    """Groups of near copies around the threshold, short and long, with frequent words."""
    rng = np.random.default_rng(5)
    rows, doc = [], 1000
    for size in (4, 5, 8, 9, 10, 11, 12, 14, 19, 25, 40, 120):
        base = [f"w{rng.integers(0, 400)}" for _ in range(size)]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.integers(0, 3)):
                own[rng.integers(0, len(own))] = f"v{rng.integers(0, 50)}"
            if rng.random() < 0.3:
                own.append(f"z{rng.integers(0, 9)}")
            rows.append((doc, " ".join(own), None, None, None))
            doc += 1
    base = [f"h{i}" for i in range(150)]
    for _ in range(150):  # one large group, so that lists are long
        own = list(base)
        for _ in range(rng.integers(0, 6)):
            own[rng.integers(0, len(own))] = f"v{rng.integers(0, 50)}"
        rows.append((doc, " ".join(own), None, None, None))
        doc += 1
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 90), (2, 70)])
def test_join_against_all_pairs(spark, monkeypatch, width, percent):
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    rows = near_rows() + awkward()
    found = ngram_join.link(frame(spark, rows).repartition(5), width, percent).collect()
    assert Counter(map(tuple, found)) == brute_join(rows, width, percent)


def test_join_of_nothing(spark):
    assert ngram_join.link(empty(spark)).count() == 0
    assert ngram_join.one_of_each(empty(spark)).count() == 0
    alone = [(1, "a b c d e f", None, None, None), (2, None, None, None, None), (3, "", None, None, None)]
    assert Counter(map(tuple, ngram_join.link(frame(spark, alone)).collect())) == Counter({(1, 4, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1})


def kept_rows(rows, width, percent):
    """How often each id stays: of a group's rows one, of the smallest id, nulls last; rows without words all."""
    sets, find = brute_groups(rows, width, percent)
    groups = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        groups[find(i) if sets[i] else -1 - i].append((d is None, d or 0))
    return Counter(d if not none else None for none, d in map(min, groups.values()))


def test_one_of_each(spark, monkeypatch):
    rows = near_rows() + awkward()
    rows += [(50, rows[0][1], None, None, None), (50, "quite another text of its own here", None, None, None), (None, rows[0][1] + " z0", None, None, None), (None, "no id but some words", "a", None, None), (None, "no id but some words", "b", None, None), (None, "", None, None, None)]
    kept = ngram_join.one_of_each(frame(spark, rows).repartition(4), 3, 90)
    assert kept.columns == distinct_names(frame(spark, rows)).columns
    assert Counter(r.doc_id for r in kept.collect()) == kept_rows(rows, 3, 90)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 3)  # the shuffled ways
    assert Counter(r.doc_id for r in ngram_join.one_of_each(frame(spark, rows), 3, 90).collect()) == kept_rows(rows, 3, 90)
    assert Counter(map(tuple, ngram_join.link(frame(spark, rows)).collect())) == brute_join(rows, 3, 90)


def test_sets_that_share_one_subset(spark):
    """Very many small sets with one subset, of two sizes, meet in a join that Spark can split."""
    base = [f"b{i}" for i in range(14)]
    rows = [(i, " ".join([*base, f"x{i}"][: 14 + i % 2]), None, None, None) for i in range(200)] + [(1000 + i, " ".join([*base, f"y{i}", f"z{i}"]), None, None, None) for i in range(50)]
    assert Counter(map(tuple, ngram_join.link(frame(spark, rows), 1, 90).collect())) == brute_join(rows, 1, 90)
    assert Counter(map(tuple, ngram_join.link(frame(spark, rows[1::2]), 1, 90).collect())) == brute_join(rows[1::2], 1, 90)


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(a) + 1) for a in rng.permutation(400)[:330]] + [(900, 5), (7, 7)]
    root = {x: x for l in links for x in l}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    found = components(spark.createDataFrame(links, "a long, b long").repartition(7))
    assert {r.node: r.component for r in found.collect()} == {n: c for n, c in root.items() if n != 7 or any(7 in l and l != (7, 7) for l in links)}


def test_boundary_and_sizes():
    for percent in (70, 80, 90):
        for a in range(1, 60):
            for b in ngram_join.partners(a, percent):
                need = ngram_join.overlap(a, b, percent)
                assert 100 * need >= percent * (a + b - need) and (need == 0 or 100 * (need - 1) < percent * (a + b - need + 1))
                assert need <= min(a, b)
    assert 0 <= ngram_join.boundary({5: 10, 30: 4}, 90) <= ngram_join.SMALLEST_LARGE
