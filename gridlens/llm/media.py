"""Media columns: 8-bit greyscale PNG written and read with zlib and numpy, and cosine-transform hashes.

Cases: a null or empty text becomes one padded unit of blanks; texts of any length are stored whole, one image each;
repeated rows give equal values; an empty table gives no rows; other columns than the id and the text are ignored. A
damaged image (bad signature, length, checksum or filter) raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import encode, table, tidy

WIDTH = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(pixels: np.ndarray, level: int = 1) -> bytes:
    """Greyscale rows to PNG; each row takes whichever of the filters none, sub and up leaves the least residue."""
    height, width = pixels.shape
    above = np.vstack((np.zeros((1, width), np.uint8), pixels[:-1]))
    left = np.hstack((np.zeros((height, 1), np.uint8), pixels[:, :-1]))
    kinds = np.stack((pixels, pixels - left, pixels - above))
    residue = np.abs(kinds.view(np.int8).astype(np.int16)).sum(axis=2)
    best = residue.argmin(axis=0).astype(np.uint8)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = kinds[best, np.arange(height)]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a PNG chunk is cut short")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack_from(">I", data[at + 8 + size : at + 12 + size].ljust(4, b"\0"))[0] != zlib.crc32(kind + body):
            raise ValueError(f"the checksum of a {kind!r} chunk is wrong")
        yield kind, body
        at += 12 + size


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    distance = ((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))
    return min(distance)[2]


def _unfilter(rows: np.ndarray) -> np.ndarray:
    """All five row filters for one byte a pixel."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    sub = kinds == 1
    out[sub] = np.add.accumulate(out[sub], axis=1, dtype=np.uint8)
    zero = np.zeros(out.shape[1], np.uint8)
    for y in np.flatnonzero(kinds > 1):
        above = out[y - 1] if y else zero
        if kinds[y] == 2:
            out[y] += above
            continue
        up, line, left, corner = above.tolist(), out[y].tolist(), 0, 0
        for x, b in enumerate(up):
            left = (line[x] + ((left + b) >> 1 if kinds[y] == 3 else _paeth(left, b, corner))) & 255
            line[x], corner = left, b
        out[y] = line
    return out


def read_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit greyscale PNG; every chunk's checksum is tested."""
    parts: list[bytes] = []
    size, ended = None, False
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only plain 8-bit greyscale is read")
            size = (height, width)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
    if size is None or not ended:
        raise ValueError("the PNG lacks its header or its end")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if raw.size != size[0] * (size[1] + 1):
        raise ValueError("the PNG holds another number of samples than its header says")
    return _unfilter(raw.reshape(size[0], size[1] + 1))


_COSINES = np.cos(np.pi * (2 * np.arange(32) + 1)[None, :] * np.arange(8)[:, None] / 64)


def _shrink(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of n nearly equal groups of rows; with fewer rows they repeat."""
    if len(x) < n:
        return x[np.arange(n) * len(x) // n].astype(np.float64)
    edges = np.arange(n) * len(x) // n
    widths = np.diff(np.append(edges, len(x)))
    return np.add.reduceat(x.astype(np.float64), edges, axis=0) / widths[:, None]


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients lie above their median."""
    small = _shrink(_shrink(pixels, 32).T, 32).T
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def to_png(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_bytes and media (binary): the text's bytes, padded by blanks to whole rows, as an image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                sizes, media = [], []
                for text in part["text"]:
                    raw = encode(text)
                    padded = raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH)
                    sizes.append(len(raw))
                    media.append(write_png(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)))
                yield pd.DataFrame({"id": part["id"], "n_bytes": sizes, "media": media})

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(tidy(run), f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def png_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the stored images back: payload digests, stored digests and the hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, n, m in zip(b["id"], b["n_bytes"], b["media"], strict=True):
                m = bytes(m)
                pixels = read_png(m)
                payload = pixels.tobytes()
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(pixels)))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"])

    rows = media.select(media[id_col].alias("id"), "n_bytes", "media")
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary"
    return rows.mapInPandas(tidy(run), out).withColumnRenamed("id", id_col)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = png_features(to_png(table(spark, sf_dir, "documents")))
    return found.selectExpr(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "lower(hex(hash)) AS feature"
    )
