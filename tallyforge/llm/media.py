"""Media columns: Netpbm and BMP to numpy arrays, area-resized by integral images, as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, prepare, slices, tidy, written

_HEADER = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)")
#: Rows of an image that are summed at a time.
_ROWS = 65_536


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width, channels) samples of 8 bits, or 16 if the largest value is over 255. Bitmaps: 1 is 0, 0 is 255."""
    kind = data[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm image")
    n, at, values = int(kind[1:]), 2, []
    while len(values) < (2 if n in (1, 4) else 3):
        found = _HEADER.match(data, at)
        if not found:
            raise ValueError("incomplete Netpbm header")
        values.append(int(found[1]))
        at = found.end()
    width, height, top = (*values, 1)[:3]
    channels = 3 if n in (3, 6) else 1
    if n == 1:
        flat = np.frombuffer(re.sub(rb"[^01]", b"", re.sub(rb"#[^\n]*", b"", data[at:])), np.uint8)[: width * height] - 48
    elif n in (2, 3):
        flat = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: width * height * channels], dtype=np.uint32)
    elif n == 4:
        row = (width + 7) // 8
        flat = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row), axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, width * height * channels, at + 1)
    if flat.size != width * height * channels:
        raise ValueError("incomplete Netpbm samples")
    if n in (1, 4):
        flat = (1 - flat) * 255
    return flat.astype(np.uint16 if top > 255 else np.uint8, copy=False).reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as (height, width, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, header, width, height = struct.unpack_from("<IIii", data, 10)
    bits, packed = struct.unpack_from("<HI", data, 28)
    if bits not in (8, 24, 32) or packed not in (0, 3):
        raise ValueError(f"BMP of {bits} bits, compression {packed}")
    step = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, step * abs(height), start).reshape(abs(height), step)
    if height > 0:
        rows = rows[::-1]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + header).reshape(-1, 4)[:, 2::-1]
        return palette[rows[:, :width]]
    return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _areas(integral: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Differences along axis 0 of an integral (with its leading zero) read at fractional places."""
    low = np.minimum(cuts.astype(np.int64), len(integral) - 1)
    high = np.minimum(low + 1, len(integral) - 1)
    part = (cuts - low).reshape(-1, *[1] * (integral.ndim - 1))
    return np.diff(integral[low] * (1 - part) + integral[high] * part, axis=0)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the areas that the new pixels cover, from integral images along both axes; float64.

    The integral along x is taken some rows at a time and read at the new
    columns' edges, so that memory is a small multiple of the image's own.
    """
    h, w, channels = image.shape
    if not h or not w:
        return np.zeros((height, width, channels))
    across = np.empty((h + 1, width, channels))
    across[0] = 0
    edges = np.linspace(0, w, width + 1)
    for at in range(0, h, _ROWS):
        rows = image[at : at + _ROWS].astype(np.float64).transpose(1, 0, 2)
        integral = np.concatenate([np.zeros((1, *rows.shape[1:])), np.cumsum(rows, axis=0)])
        across[at + 1 : at + 1 + rows.shape[1]] = _areas(integral, edges).transpose(1, 0, 2)
    np.cumsum(across, axis=0, out=across)
    return _areas(across, np.linspace(0, h, height + 1)) / (h / height * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 by 9 area means is larger than its left neighbour."""
    grey = area_resize(image.mean(axis=2, keepdims=True) if image.shape[2] > 1 else image, 8, 9)[:, :, 0]
    return np.packbits(np.diff(grey, axis=1) > 1e-9).tobytes().hex()


def tile(image: np.ndarray, height: int, width: int) -> bytes:
    """The resized image, rounded to the samples' type, as an NPY file's bytes."""
    out = io.BytesIO()
    np.save(out, np.floor(area_resize(image, height, width) + 0.5).astype(image.dtype), allow_pickle=False)
    return out.getvalue()


def _tiles(height: int, width: int, keep: list[str], payload: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text="media"):
            rows = []
            for data in part.column("media").to_pylist():
                try:
                    image = decode(data)
                    row = [image.shape[0], image.shape[1], image.shape[2], tile(image, height, width), difference_hash(image), None]
                    if payload:
                        own = np.ascontiguousarray(image).tobytes()
                        row += [len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:])]
                except (ValueError, TypeError, IndexError, struct.error) as e:
                    row = [None] * 5 + [str(e) or "unreadable"] + [None] * (3 * payload)
                rows.append(row)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["height", "width", "channels", "tile", "difference_hash", "error", "payload_bytes", "payload_sha256", "tail_crc32"]
            made = {n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=False)}
            yield pa.record_batch({c: part.column(c) for c in keep} | made)

    return tidy(run)


def tiles(media: DataFrame, height: int = 32, width: int = 32, payload: bool = False) -> DataFrame:
    """media's own columns but `media`, with height, width, channels, tile (NPY bytes), difference_hash and error.

    With payload, also the length, SHA-256 and the last 64 bytes' CRC-32 of the
    decoded samples. A null or unreadable image has nulls and its error's text.
    Columns of media that bear one of the new names are left out.
    """
    prepare(media.sparkSession)
    new = "height int, width int, channels int, tile binary, difference_hash string, error string" + ", payload_bytes long, payload_sha256 string, tail_crc32 long" * payload
    taken = {x.split()[0] for x in new.split(", ")}
    keep = [f for f in media.schema.fields if f.name != "media" and f.name not in taken]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), new])
    return media.select(*(f"`{f.name}`" for f in keep), "media").mapInArrow(_tiles(height, width, [f.name for f in keep], payload), schema)


def as_pgm(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes, with bytes 0 up to a positive multiple of 64, as a grey image 64 wide.

    Null and empty texts are one row of 64 zeros. Repeated rows stay.
    """
    docs = documents(docs)
    n = F.octet_length("text")
    rows = F.greatest(F.lit(1), F.ceil(n / 64)).cast("int")
    zeros = F.unhex(F.repeat(F.lit("00"), rows * 64 - n))
    header = F.concat(F.lit("P5\n64 "), rows.cast("string"), F.lit("\n255\n"))
    return docs.select("doc_id", n.cast("long").alias("n_bytes"), F.concat(header.cast("binary"), F.encode("text", "UTF-8"), zeros).alias("media"))


def op6_media(spark, sf_dir: str) -> DataFrame:
    """All documents as stored images, read back, decoded and written as NPY tiles with their hashes; see as_pgm() and tiles()."""
    stored = written(as_pgm(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    read = stored.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    tiled = written(tiles(read, payload=True).drop("height", "width", "channels", "error"), "tiles")
    return tiled.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("difference_hash").alias("feature"))
