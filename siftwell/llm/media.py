"""Media columns: PNG files in binary columns, written and read with zlib and numpy, and cosine-transform hashes of them.

A PNG is its signature and chunks, each with a CRC-32 that reading tests; IDAT chunks inflate to filtered rows, which numpy
unfilters: runs of rows with one filter at once for None, Sub and Up, by diagonals for Average and Paeth (a pixel waits for those to
its left, above and between them, so all of a diagonal are ready together). A file may claim any size: no more is inflated than its
header says. Reading takes 8-bit grey,
grey with alpha, RGB and RGBA without interlace; writing makes the same. A broken file raises ``MediaError`` in :func:`decode_png`; the
column functions give it a null feature and the message.

Null texts count as empty and hold one row of zeros. Equal texts give equal bytes and features. Repeated rows stay rows; an empty
table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, LEVEL, SIDE, LOW, IDAT = 64, 6, 32, 8, 1 << 20
CHANNELS = {0: 1, 4: 2, 2: 3, 6: 4}


class MediaError(ValueError):
    pass


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def _filtered(rows: np.ndarray, bpp: int, kind: int) -> np.ndarray:
    left = np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp]
    if kind == 0:
        return rows
    if kind == 1:
        return rows - left
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    if kind == 2:
        return rows - up
    if kind == 3:
        return rows - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    corner = np.zeros_like(rows)
    corner[1:, bpp:] = rows[:-1, :-bpp]
    return rows - _paeth(left, up, corner)


def encode_png(pixels: np.ndarray, filters: tuple[int, ...] = (0,), level: int = LEVEL) -> bytes:
    """A PNG of (height, width) or (height, width, channels) 8-bit samples; of ``filters`` each row takes the one whose bytes,
    read as signed, have the least sum of magnitudes."""
    pixels = np.ascontiguousarray(pixels, np.uint8)
    channels = 1 if pixels.ndim == 2 else pixels.shape[2]
    color = {n: c for c, n in CHANNELS.items()}[channels]
    height, width = pixels.shape[:2]
    rows = pixels.reshape(height, width * channels)
    made = [_filtered(rows, channels, k) for k in filters]
    if len(made) == 1:
        best, body = np.full(height, filters[0], np.uint8), made[0]
    else:
        cost = np.stack([np.minimum(m, 0 - m).sum(axis=1, dtype=np.int64) for m in made])
        pick = cost.argmin(axis=0)
        best, body = np.array(filters, np.uint8)[pick], np.stack(made)[pick, np.arange(height)]
    data = zlib.compress(np.concatenate((best[:, None], body), axis=1).tobytes(), level)
    head = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", data[i : i + IDAT]) for i in range(0, len(data), IDAT)) + _chunk(b"IEND", b"")


def _diagonals(kind: int, rows: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """Rows of one filter, Average (3) or Paeth (4), unfiltered."""
    height, width = len(rows), rows.shape[1] // bpp
    grid = np.zeros((height + 1, width + 1, bpp), np.uint8)  # with the row above and a column of zeros to the left
    grid[0, 1:] = above.reshape(width, bpp)
    grid[1:, 1:] = rows.reshape(height, width, bpp)
    for d in range(height + width - 1):
        r = np.arange(max(0, d - width + 1), min(d, height - 1) + 1)
        c = d - r
        left, up, corner = grid[r + 1, c], grid[r, c + 1], grid[r, c]
        grid[r + 1, c + 1] += ((left.astype(np.uint16) + up) >> 1).astype(np.uint8) if kind == 3 else _paeth(left, up, corner)
    return grid[1:, 1:].reshape(height, width * bpp)


def _unfiltered(kinds: np.ndarray, body: np.ndarray, bpp: int) -> np.ndarray:
    height, stride = body.shape
    out = np.empty_like(body)
    above = np.zeros(stride, np.uint8)
    starts = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist()]
    for start, stop in zip(starts, [*starts[1:], height]):
        kind, rows = int(kinds[start]), body[start:stop]
        if kind == 0:
            out[start:stop] = rows
        elif kind == 1:
            out[start:stop] = rows.reshape(stop - start, -1, bpp).cumsum(axis=1, dtype=np.uint8).reshape(stop - start, stride)
        elif kind == 2:
            out[start:stop] = rows.cumsum(axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            out[start:stop] = _diagonals(kind, rows, above, bpp)
        else:
            raise MediaError(f"filter {kind}")
        above = out[stop - 1]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples as (height, width) or (height, width, channels)."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body, crc = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(crc) != 4 or zlib.crc32(body, zlib.crc32(kind)) != int.from_bytes(crc, "big"):
            raise MediaError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            if size != 13:
                raise MediaError(f"a header of {size} bytes")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise MediaError(f"critical chunk {kind!r}")
        at += 12 + size
    if not ended or head is None:
        raise MediaError("the file ends early")
    width, height, depth, color, method, filtering, interlace = head
    if depth != 8 or color not in CHANNELS or method or filtering or interlace or not width or not height:
        raise MediaError(f"header {head}")
    channels = CHANNELS[color]
    stride, inflate = width * channels, zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(parts), height * (stride + 1) + 1)
    except zlib.error as error:
        raise MediaError(str(error)) from error
    if len(raw) != height * (stride + 1) or not inflate.eof:
        raise MediaError("the image data has another size")
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = _unfiltered(rows[:, 0], rows[:, 1:], channels)
    return out if channels == 1 else out.reshape(height, width, channels)


_k = np.arange(SIDE)
_DCT = np.cos(np.pi * (_k[None, :] + 0.5) * _k[:, None] / SIDE)[:LOW]


def _bins(size: int) -> np.ndarray:
    return np.arange(SIDE) * size // SIDE


def _shrunk(grey: np.ndarray) -> np.ndarray:
    """Means over a SIDE x SIDE grid; a shorter axis repeats its samples."""
    for axis in (0, 1):
        size = grey.shape[axis]
        if size < SIDE:
            grey = np.take(grey, _bins(size), axis=axis)
        else:
            bounds = _bins(size)
            shape = [1, 1]
            shape[axis] = SIDE
            grey = np.add.reduceat(grey, bounds, axis=axis, dtype=np.int64 if grey.dtype.kind in "ui" else None) / np.diff(np.append(bounds, size)).reshape(shape)
    return grey


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the 64 lowest cosine-transform terms of the shrunk grey image exceed their median."""
    grey = pixels if pixels.ndim == 2 else pixels[..., :3].mean(axis=2) if pixels.shape[2] > 2 else pixels[..., 0]
    low = np.round(_DCT @ _shrunk(grey) @ _DCT.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload_of(text: str) -> bytes:
    """The text's UTF-8 bytes and zeros up to a positive multiple of 64."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\0" * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL, filters: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as an 8-bit grey PNG of 64 columns, in a binary column. Each row of it is
    stored as it is, or as differences to the left or up, by the choice of :func:`encode_png` among ``filters``."""
    shared.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            media = [encode_png(np.frombuffer(payload_of(t), np.uint8).reshape(-1, WIDTH), filters, level) for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def features(media: DataFrame) -> DataFrame:
    """What :func:`stored` wrote, read back from the stored bytes. Bytes that are no such PNG, and null, give null features and
    the reason in ``error``."""
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def row(i: int | None, n: int | None, data: bytes | None) -> dict:
        out = dict.fromkeys(names) | {"doc_id": i, "n_bytes": n}
        if data is None:
            return out | {"error": "null"}
        out |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        try:
            pixels = decode_png(data)
        except MediaError as error:
            return out | {"error": str(error)}
        payload = pixels.tobytes()
        return out | {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-WIDTH:]), "feature": cosine_hash(pixels)}

    kinds = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in FEATURES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([row(*x) for x in zip(*(c.to_pylist() for c in batch.columns))], kinds)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
