"""WARC archives and chat formatting: round trips over awkward rows."""

import hashlib
from collections import Counter, defaultdict

from tallyforge.llm import chat, warc


def pages():
    big = "x" * 1500
    return [
        (1, "http://www.Example.com/a?b=1#c", "<p>one</p>"), (2, "https://sub.example.com:8080/", big), (3, "http://example.com/a?b=1", big), (9, None, big), (4, "not a url", None), (5, "http://é.example/ü", ""), (None, "http://x/", big),
        (6, "http://x/" + "p" * 5000, "é" * 600), (7, "http://x/", "é" * 600), (8, "http://x/\r\nX: y", "<p>one</p>"), (9, None, big), (10, "http://[bad", "\x00\r\n\r\nend"), (11, "http://example.com/a?b=1", "z" * 200_000),
    ]


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    monkeypatch.setattr(warc, "PAGE", 2)
    monkeypatch.setattr(warc, "CUT", 12)
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as top", "'k' as key")
    archive = warc.write_archive(df.repartition(3))
    rows = archive.records(payload=True).collect()
    top, copies = {}, Counter()
    for p, _, h in pages():
        data = (h or "").encode()
        if len(data) >= 1000:
            copies[data] += 1
            top[data] = max(x for x in (p, top.get(data)) if x is not None) if (p, top.get(data)) != (None, None) else None
    want = Counter()
    for p, _, h in pages():
        data = (h or "").encode()
        again = copies[data] > 1 and p != top.get(data)
        want[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[data] if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    texts = {p: (h or "").encode() for p, _, h in pages()}
    assert all(bytes(r.payload) == texts[r.page_id] for r in rows if r.record_type == "response")
    asked = spark.createDataFrame([("http://example.com/a?b=1",), ("https://nowhere.example/",), (None,)], "url string")
    assert Counter(r.page_id for r in archive.lookup(asked).collect()) == Counter({1: 1, 3: 1, 11: 1, 9: 2})
    every = archive.lookup(df, payload=False).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in every) == want
    nothing = warc.write_archive(df.limit(0))
    assert nothing.records().count() == nothing.lookup(df).count() == archive.lookup(df.limit(0)).count() == 0


def test_urls_with_every_control_character(spark, monkeypatch):
    """Also in URLs that can't be parted; the captures of each are found again, one key over many blocks and pages."""
    monkeypatch.setattr(warc, "BLOCK", 4)
    monkeypatch.setattr(warc, "PAGE", 3)
    urls = [f(chr(c)) for c in (*range(33), 127, 0x2028, 0x85) for f in (lambda c: f"http://[a{c}b", lambda c: f"http://h{c}.example/a{c}b?{c}", lambda c: c)]
    rows = [(i, u, f"page {i}") for i, u in enumerate(urls)] + [(10_000 + i, "http://hot.example/", "hot") for i in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write_archive(df.repartition(3))
    assert sorted(r.page_id for r in archive.lookup(df).collect()) == [r[0] for r in rows]
    assert {r.page_id: r.url for r in archive.records().collect()} == {i: warc._clean(u) for i, u, _ in rows}
    for page, url, _ in rows[::17]:
        found = archive.lookup(spark.createDataFrame([(url,)], "url string")).collect()
        assert page in {r.page_id for r in found} and {warc.url_key(r[1]) for r in rows if r[0] in {x.page_id for x in found}} == {warc.url_key(url)}
    plan = archive.find(df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_url_keys_and_members():
    assert warc.url_key("http://www.Example.com:80/A?b#c") == "com,example)/a?b"
    assert warc.url_key("https://a.b.org:8443") == "org,b,a:8443)/"
    assert warc.url_key(None) == ")/"
    member = warc.record(3, "http://x/", b"payload", None, False)
    assert warc.parse(member)["payload"] == b"payload"
    assert warc.parse(warc.record(3, None, b"payload", 8, True)) == {"page_id": 3, "url": "", "payload_bytes": 7, "payload_digest": hashlib.sha1(b"payload").hexdigest(), "record_type": "revisit", "refers_to": 8, "payload": None}


def turns():
    long = "word " * 20_000
    return [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</turn> <turn user>\n\\l \\\\ \\g <>"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "assistant", "\n</turn>\n"), (3, 5, None, "no role"), (3, 5, "user", "tie"), (3, 5, "user", "tie"),
        (None, 0, "user", "no conversation"), (None, 1, "assistant", "ok"), (4, None, "user", "no turn"), (4, 1, "assistant", long), (5, 0, "a>b\n<", "x"), (6, 0, "assistant", "\\"), (6, 1, "assistant", "日本\u0000é🎉"),
    ] + [(7, i, ("user", "assistant")[i % 2], f"m{i}") for i in range(70)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations_round_trip(spark):
    df = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node", "2 as tree")
    rows = chat.digests(chat.format_paths(chat.conversations(df))).collect()
    own = defaultdict(list)
    for c, t, r, x in turns():
        own[c].append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or ""), r or "", x or ""))
    want = {}
    for c, ts in own.items():
        ts.sort()
        said = "".join(x for *_, r, x in ts if r == "assistant")
        want[c] = (len(ts), sha("".join(f"{r}\n{x}\n" for *_, r, x in ts)), len(said), sha(said), sum(17 + sum(1 + (ch in "\\<>") for ch in r + x) for *_, r, x in ts))
    assert {r.conv_id: tuple(r)[1:] for r in rows} == want
    assert chat.digests(chat.format_paths(chat.conversations(df.limit(0)))).count() == 0
    plan = chat.digests(chat.format_paths(chat.conversations(df)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_reply_trees(spark):
    tree = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 2, 0.0), ("t", 5, 4, None), ("t", 6, 3, 9.0), ("t", 7, 99, 2.0), ("u", 1, None, 0.0), ("u", 8, 9, 1.0), ("u", 9, 8, 1.0)]
    df = spark.createDataFrame([(*x, "user", f"n{x[1]}") for x in tree], "tree string, node long, parent long, score double, role string, text string")
    found = defaultdict(dict)
    for r in chat.paths(df).collect():
        found[r.tree, r.leaf][r.depth] = r.node
    assert {k: [v[d] for d in sorted(v)] for k, v in found.items()} == {("t", 5): [5, 4, 2, 1], ("t", 6): [6, 3, 1], ("t", 7): [7], ("u", 1): [1]}
    best = {(r.tree, r.leaf): r.path_score for r in chat.paths(df, best=1).collect()}
    assert best == {("t", 6): (1 + 1 + 9) / 3, ("u", 1): 0.0}
    assert [r.formatted for r in chat.format_paths(df, best=1).where("tree = 't'").collect()] == ["".join(f"<turn user>\nn{n}\n</turn>\n" for n in (1, 3, 6))]
