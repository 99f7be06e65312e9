"""WARC archives and a two-level capture index: sorted URL keys in compressed blocks, a sparse directory, range reads.

The directory has each block's first and last key. It is cut into pages, of
which the driver broadcasts only the ends: that is a few hundred bytes for some
millions of captures, whatever the length of a URL. A lookup searches the ends,
then the page, then the block, each by bisection, and then reads byte ranges.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column, distinct_names, new_dir, prepare, slices, written

#: Captures in a block of the index, blocks in a page of the directory, and characters of a key that the directory keeps.
BLOCK, PAGE, CUT = 3000, 1000, 256
#: A new archive file begins when the last has so many bytes.
FILE_BYTES = 256 << 20
_CAPTURES = "key string, page_id long, file string, offset long, length long"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Where a URI or path leads: local, HDFS, S3 and what else pyarrow opens."""
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pyarrow.fs.LocalFileSystem(), uri)


_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def url_key(url: str | None) -> str:
    """The URL with its host reversed and without scheme, www and fragment: com,example)/path?query.

    URLs that can't be parted are taken whole. All are in lower case, without control characters.
    """
    url = _CONTROL.sub("", url or "").strip()
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page}')}>"


def _clean(url: str) -> str:
    """The URL as a header can carry it: control characters as percent signs and two digits."""
    return _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has the payload's digest and length, not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Page-Id: {'' if page is None else page}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to and payload (null for a revisit) of a record's gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], binascii.hexlify(base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))).decode()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload doesn't match its record")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return {"page_id": number("X-Page-Id"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page"), "payload": payload if kind == "response" else None}


def decided(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html (null: empty), refers_to and revisit of each page.

    Of pages with equal payloads of at least `least` bytes, the one with the
    largest page_id is a response and the others revisit it. Digests are
    counted with partial sums; only those that occur again are joined back.
    """
    pages = distinct_names(pages)
    rows = pages.select(column(pages, "page_id", "long").alias("page_id"), column(pages, "url", "string").alias("url"), F.coalesce(column(pages, "html", "string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary"))))
    again = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1")
    again = written(again.select(F.col("digest").alias("_d"), "top"), "again")
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(again) if few else again, F.col("digest") == F.col("_d"), "left")
    revisit = F.col("_d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return found.select("page_id", "url", "html", F.when(revisit, F.col("top")).alias("refers_to"), revisit.alias("revisit"))


def _write(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        name, out, at = None, None, 0
        for part in slices(batches, text="html"):
            rows = []
            for page, url, html, refers_to, revisit in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0  # a lost task's file stays unnamed by any capture
                    out = system.open_output_stream(posixpath.join(path, name), compression=None)
                member = record(page, url, html.encode("utf-8", "surrogatepass"), refers_to, revisit)
                out.write(member)
                rows.append((url_key(url), page, name, at, len(member)))
                at += len(member)
            c = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(x, k) for x, k in zip(c, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


_INDEX = "kind int, id long, first string, last string, captures long, data binary"


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted captures as blocks (kind 0: compressed lines) and pages of the directory (kind 1: compressed ends of their blocks), numbered in order of keys."""
    held: list[tuple] = []
    ends: list[tuple] = []
    at = TaskContext.get().partitionId() << 32

    def row(kind: int, number: int, first: str, last: str, captures: int, lines: list) -> pa.RecordBatch:
        data = zlib.compress("\n".join(json.dumps(x, separators=(",", ":")) for x in lines).encode())
        values = (kind, number, first[:CUT], last[:CUT], captures, data)
        return pa.record_batch([pa.array([x], t) for x, t in zip(values, (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=["kind", "id", "first", "last", "captures", "data"])

    def block() -> Iterator[pa.RecordBatch]:
        nonlocal at
        yield row(0, at, held[0][0], held[-1][0], len(held), held)
        ends.append((at, held[0][0][:CUT], held[-1][0][:CUT], len(held)))
        held.clear()
        at += 1
        if len(ends) == PAGE:
            yield from page()

    def page() -> Iterator[pa.RecordBatch]:
        yield row(1, ends[0][0], ends[0][1], ends[-1][2], sum(e[3] for e in ends), [e[:3] for e in ends])
        ends.clear()

    for batch in batches:
        for capture in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True):
            held.append(capture)
            if len(held) == BLOCK:
                yield from block()
    if held:
        yield from block()
    if ends:
        yield from page()


def read_lines(data: bytes) -> list[tuple]:
    """A block's captures (key, page_id, file, offset, length), or a page's blocks (id, first, last), in order."""
    return [tuple(json.loads(line)) for line in zlib.decompress(data).decode().split("\n")]


def _capture_batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) or [()] * 5
    return pa.record_batch([pa.array(x, k) for x, k in zip(c, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])


def _captures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data").to_pylist():
            yield _capture_batch(read_lines(data))


_KINDS = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]


def _read(folder: str, payload: bool):
    """Range reads of captures; those of one file in order read it from front to back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        name, source, rows, held = None, None, [], 0

        def ready() -> pa.RecordBatch:
            return pa.record_batch({k: pa.array([r[k] for r in rows], t) for k, t in _KINDS if payload or k != "payload"})

        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, system.open_input_file(posixpath.join(path, file))
                source.seek(offset)
                row = parse(source.read(length))
                held += row["payload_bytes"] * payload
                rows.append(row)
                if len(rows) >= 2048 or held > 8 << 20:
                    yield ready()
                    rows.clear()
                    held = 0
        if source is not None:
            source.close()
        if rows:
            yield ready()

    return run


class Archive:
    """Archive files in `folder` and the index over them: blocks of captures and pages of their directory, in order of keys."""

    def __init__(self, spark: SparkSession, folder: str, index: DataFrame):
        self.spark, self.folder = spark, folder
        self.blocks, self.pages = index.where("kind = 0").drop("kind"), index.where("kind = 1").drop("kind")

    def captures(self) -> DataFrame:
        """All captures of the index."""
        return self.blocks.select("data").mapInArrow(_captures, _CAPTURES)

    def _records(self, captures: DataFrame, payload: bool) -> DataFrame:
        kinds = _RECORD if payload else _RECORD.removesuffix(", payload binary")
        ordered = captures.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
        return ordered.mapInArrow(_read(self.folder, payload), kinds)

    def records(self, payload: bool = False) -> DataFrame:
        """All records, found by unpacking the whole index and read by file and offset."""
        return self._records(self.captures(), payload)

    def find(self, urls: DataFrame) -> DataFrame:
        """The captures whose key is that of one of urls (url string), each once.

        The keys search the broadcast ends of the directory's pages, meet the
        pages that may hold them, and then the blocks that may; a page or block
        is unpacked once for all keys that come to it, and a key that runs over
        several blocks goes to each of them. Null urls have the empty url's key;
        urls that were never captured find nothing.
        """
        ends = sorted((r.id, r.first, r.last) for r in self.pages.select("id", "first", "last").collect())
        top = self.spark.sparkContext.broadcast(ends)
        urls = distinct_names(urls)
        keys = urls.select(column(urls, "url", "string").alias("url")).distinct().mapInArrow(_keys, "key string").distinct()
        to_pages = keys.mapInArrow(_search(top), "id long, key string")
        to_blocks = self._met(to_pages, self.pages).mapInArrow(_in_page, "id long, key string")
        return self._met(to_blocks, self.blocks).mapInArrow(_in_block, _CAPTURES)

    @staticmethod
    def _met(keys: DataFrame, level: DataFrame) -> DataFrame:
        """Each page or block, followed by the keys that come to it in their order."""
        both = level.select("id", F.lit(None).cast("string").alias("key"), "data").union(keys.select("id", "key", F.lit(None).cast("binary").alias("data")))
        return both.repartition("id").sortWithinPartitions("id", F.col("key").asc_nulls_first())

    def lookup(self, urls: DataFrame, payload: bool = True) -> DataFrame:
        """Records of the captures that find() finds, read by file and offset. An empty archive or no urls: no rows."""
        return self._records(self.find(urls), payload)


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"key": pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())})


def within(first: list[str], last: list[str], key: str) -> range:
    """Of spans in order of keys, ends cut, those that may hold the key: a bisection on either side."""
    return range(bisect.bisect_left(last, key[:CUT]), bisect.bisect_right(first, key[:CUT]))


def _routed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch({"id": pa.array([r[0] for r in rows], pa.int64()), "key": pa.array([r[1] for r in rows], pa.string())})


def _search(top):
    """The directory's pages that may hold each key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, first, last = ([e[i] for e in top.value] for i in range(3))
        for batch in batches:
            yield _routed([(ids[i], k) for k in batch.column("key").to_pylist() for i in within(first, last, k)])

    return run


def _by_id(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[tuple] | None, str]]:
    """(lines, key) for each key; the lines are unpacked when their first key comes."""
    data = lines = None
    for batch in batches:
        for key, own in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if own is not None:
                data, lines = own, None
                continue
            if lines is None:
                lines = read_lines(data)
            yield lines, key


def _in_page(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a page that may hold each key."""
    rows, page, first, last = [], None, [], []
    for lines, key in _by_id(batches):
        if lines is not page:
            page, first, last = lines, [x[1] for x in lines], [x[2] for x in lines]
        rows += [(page[i][0], key) for i in within(first, last, key)]
        if len(rows) >= 4096:
            yield _routed(rows)
            rows = []
    yield _routed(rows)


def _in_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key's captures in a block."""
    rows, block, keys = [], None, []
    for lines, key in _by_id(batches):
        if lines is not block:
            block, keys = lines, [x[0] for x in lines]
        rows += block[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
        if len(rows) >= 4096:
            yield _capture_batch(rows)
            rows = []
    yield _capture_batch(rows)


def write_archive(pages: DataFrame, folder: str | None = None, least: int = 1000) -> Archive:
    """Write each page as a WARC record, and the index of its captures.

    The tasks write files of their own into `folder` (in the shared folder
    unless given); captures of tasks that end are kept, so a lost task's file is
    never read. Captures are sorted by key and file place and cut into blocks of
    BLOCK lines.

    Null html is an empty payload; null urls have an empty key; a null page_id
    stays null, and is the response only where all its payload's ids are null;
    repeated rows get a record each; empty tables give an empty archive.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or new_dir(spark, "warc")
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    captures = written(decided(pages, least).mapInArrow(_write(folder), _CAPTURES), "captures")
    ordered = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return Archive(spark, folder, written(ordered.mapInArrow(_blocks, _INDEX), "index"))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back by looking up every page's URL; see write_archive() and Archive.find()."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return write_archive(pages).lookup(pages, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
