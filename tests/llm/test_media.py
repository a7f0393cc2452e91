"""The stored images use the row filters."""

import hashlib
import math
import struct
import zlib

import numpy as np

from pyspark.sql import functions as F

from siftwell.llm import media, queries


def kinds_of(png):
    """The filter of each row, read apart from the module."""
    at, data = 8, b""
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        data += png[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += n + 12
    return list(zlib.decompress(data)[:: media.WIDTH + 1])


def test_stored_rows_are_filtered_and_lossless(spark, sf_dir):
    docs = queries.documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, "a" * 640), (-2, "".join(chr(33 + i // 64) for i in range(640))), (-3, "ab" * 500)], docs.schema))
    stored = media.stored(docs)
    used = {k for r in stored.select("media").collect() for k in kinds_of(bytes(r["media"]))}
    assert used == {0, 1, 2}
    got = {r["doc_id"]: r["payload_sha256"] for r in media.features(stored).where(F.col("error").isNull()).collect()}
    assert got == {r["doc_id"]: hashlib.sha256(media.payload_of(r["text"] or "")).hexdigest() for r in docs.collect()}


def slow_hash(pixels):
    """The feature by plain loops."""
    height, width = pixels.shape
    cut = lambda n: [i * n // 32 for i in range(32)] + [n]
    rows, cols = cut(height), cut(width)
    spot = lambda c, i: range(c[i], max(c[i] + 1, c[i + 1]))
    means = lambda cells: sum(cells) / len(cells)
    tall = [[means([float(pixels[y, x]) for y in spot(rows, i)]) for x in range(width)] for i in range(32)]
    grid = [[means([tall[i][x] for x in spot(cols, j)]) for j in range(32)] for i in range(32)]
    wave = [[math.cos(math.pi * (x + 0.5) * u / 32) for x in range(32)] for u in range(8)]
    low = [round(sum(wave[u][i] * wave[v][j] * grid[i][j] for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    bits = "".join("1" if x > middle else "0" for x in low)
    return f"{int(bits, 2):016x}"


def test_feature_against_loops(spark, sf_dir):
    docs = queries.documents(spark, sf_dir).select("doc_id", "text").orderBy("doc_id").limit(12)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, "a"), (-3, "ab" * 5000), (-4, "\x00~" * 31)], docs.schema))
    got = {r["doc_id"]: r["feature"] for r in media.features(media.stored(docs)).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == slow_hash(np.frombuffer(media.payload_of(r["text"] or ""), np.uint8).reshape(-1, 64))
