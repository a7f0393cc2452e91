"""SimHash near-duplicates: 64-bit fingerprints linked at few differing bits through Golay-code keys.

A fingerprint is cut into three segments (22, 21, 21 bits). With at most two differing bits one segment is free of errors and
the next one (cyclically) has at most two. The binary Golay code (23, 12) is perfect, so the codewords within distance 4 of a
word are one (word within 2 of a codeword) or six (word at 3), and any two words within distance 2 share one of them (proved
exhaustively in the tests). A key is therefore (segment, its exact bits, index of a codeword near the next segment): 3 to 18
keys a fingerprint, each of 33 or more bits. Keys join and candidates are verified by a bit count.

A key with more than ``HOT`` different fingerprints is not expanded into pairs. Its members emit the 65 words within one bit
of themselves instead: two fingerprints differ in at most two bits exactly when they share such a word, and all that share one
are linked, so a star to the smallest member keeps every link with work linear in the members.

Null and empty texts have the fingerprint zero, which links like any other. Repeated rows keep their rows; equal doc_ids have
one component each by fingerprint. An empty table gives an empty table. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

HOT = 64
SEGMENTS = ((42, 22), (21, 21), (0, 21))
GENERATOR = 0b101011100011


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of each single bit, error patterns by syndrome as 2048 x 6, how many of the 6 count)."""

    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    single = np.array([remainder(1 << i) for i in range(23)], np.int64)
    by: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= int(single[b])
            if weight < 4 or (by[s] and bin(by[s][0]).count("1") == 3):
                by[s].append(sum(1 << b for b in bits))
    count = np.array([len(x) for x in by])
    return single, np.array([x + x[:1] * (6 - len(x)) for x in by], np.int64), count


SINGLE, PATTERNS, COUNTS = _golay()


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """12-bit indices (n x 6) of the codewords within distance 4 of each 23-bit word, and how many of the six count."""
    syndrome = np.zeros(len(words), np.int64)
    for i in range(23):
        syndrome ^= (words >> i & 1) * SINGLE[i]
    return (words[:, None] ^ PATTERNS[syndrome]) >> 11, COUNTS[syndrome]


def keys_of(fingerprints: np.ndarray) -> list[np.ndarray]:
    """The distinct join keys of each uint64 fingerprint."""
    parts = [(fingerprints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    keys, live = [], []
    for i in range(3):
        index, count = codewords(parts[(i + 1) % 3])
        keys.append((np.int64(i) << 36 | parts[i][:, None] << 12) | index)
        live.append(np.arange(6) < count[:, None])
    table, mask = np.hstack(keys), np.hstack(live)
    return [row[m] for row, m in zip(table, mask)]


_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(b" ".join(words), 42)
    digests = [h(x, 42) for x in map(b" ".join, zip(*(words[i:] for i in range(width))))]
    n = len(digests)
    octets = np.array(digests, np.uint64).view(np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 255 * 64):  # a byte counts to 255
        rows = _SPREAD[octets[i : i + 255 * 64]]
        for j in range(0, len(rows), 255):
            counts += rows[j : j + 255].sum(axis=0).view(np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, th, fp): th is a hash of the text, fp the fingerprint as a signed long."""
    shared.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(t.as_py(), width) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "th", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v) edges that connect all of ``nodes`` (fp distinct, rep) which differ in two bits or fewer."""
    n = shared.partitions(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            if not len(fp):
                continue
            keys = keys_of(fp.view(np.uint64))
            times = [len(k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(fp, times)), pa.array(np.repeat(rep, times))], names=["key", "fp", "rep"])

    keyed = nodes.select("fp", "rep").mapInArrow(run, "key long, fp long, rep long")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared_keys = shared.materialize(keyed.join(sizes, "key"), "keys")
    few = shared_keys.where(F.col("n") <= hot).repartition(n, "key")
    a, b = few.select("key", F.col("fp").alias("fa"), F.col("rep").alias("u")), few.select("key", F.col("fp").alias("fb"), F.col("rep").alias("v"))
    near = a.join(b, "key").where((F.col("fa") < F.col("fb")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= 2)).select("u", "v").distinct()
    crowd = shared_keys.where(F.col("n") > hot).select("fp", "rep").distinct()
    ball = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    words = shared.materialize(crowd.select("rep", F.explode(ball).alias("word")), "words")
    least = words.groupBy("word").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    star = words.join(least, "word").where("rep <> v").select(F.col("rep").alias("u"), "v")
    return near.union(star)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, th, fp, component_id) for every row; component_id is the smallest doc_id reachable over links, its own included."""
    prints = shared.materialize(fingerprints(docs, id_col, text_col, width), "prints")
    nodes = shared.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    several = prints.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    tied = prints.join(several, "doc_id").join(nodes, "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))  # rows of one doc_id are one document
    found = shared.components(links(nodes.where("rep IS NOT NULL")).union(tied), "u", "v")
    label = nodes.join(found, nodes["rep"] == found["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(label, "fp").select("doc_id", "th", "fp", "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept: of each component one row of the document with the smallest id (of its
    texts the one with the smallest hash). Rows without doc_id stay once for each fingerprint that no document with an id reaches."""
    found = near_duplicates(docs, id_col, text_col).where("component_id IS NULL OR doc_id = component_id")
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"))
    nobody = F.lit(-(1 << 63))
    k1, k2 = shared.fresh(docs, "kept_id"), shared.fresh(docs, "kept_th")
    keep = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.coalesce("doc_id", nobody).alias("i"), "th")).alias("k")).select(F.col("k.i").alias(k1), F.col("k.th").alias(k2))
    marked = docs.withColumn(k1, F.coalesce(docs[id_col].cast("long"), nobody)).withColumn(k2, F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    return marked.join(keep, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*[marked[c] for c in docs.columns])
