"""Document fingerprints: MinHash signatures over word shingles, banded and joined in Spark, Jaccard verified.

Words are runs of anything but ASCII white space. A shingle is ``width`` words (fewer words: the whole sequence; none: no
shingle, and the signature is all ones). Each word hashes once (xxhash), a polynomial in numpy makes the shingle hashes, and
each of the ``PERMUTATIONS`` universal permutations ``a*h + b mod 2^32`` (a odd) keeps its minimum, of which 16 bits are stored.

Near duplicates are found exactly among all pairs that share a band, also in crowds: see :func:`classes`. On demand pairs whose
SimHash fingerprints differ in two bits or fewer are candidates as well, found by Golay keys.

Null texts count as empty. Empty texts are alike. Repeated rows stay rows; rows of one doc_id are one document, and a row without
doc_id is a document of its own. An empty table gives an empty table. Other columns of the input are not looked at. Texts of any
length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, simhash

WIDTH, PERMUTATIONS, BANDS, ROWS, THRESHOLD = 5, 128, 25, 5, 0.8
#: Sets that a task holds at once to compare others with; rows that are compared with them in one task.
BLOCK, STREAM = 64, 1024
CHUNK = 1 << 15
#: Ranges of documents at most, and how many of their bounds form a group: a row looks for its group, then for its range in it.
RANGES, GROUP = 16_384, 128
_rng = np.random.Generator(np.random.PCG64(20240601))
_A = (_rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)


class _Words(dict):
    """Hash of a word; bounded."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 7)
        if len(word) <= 32:
            if len(self) > 200_000:
                self.clear()
            self[word] = found
        return found


_WORDS = _Words()


def mixed(words: list[bytes], width: int) -> np.ndarray:
    """64-bit hashes of the shingles of ``words``, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    w = min(width, len(words))
    n = len(words) - w + 1
    out = np.full(n, w, np.uint64)
    for k in range(w):
        out += h[k : k + n] * _POWERS[k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def shingles(text: str, width: int = WIDTH, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the text's shingles, repeats included; ``lower``: ASCII letters in lower case."""
    data = text.encode("utf-8", "surrogatepass")
    return mixed((data.lower() if lower else data).split(), width)


def signatures(texts: list[str], width: int = WIDTH, lower: bool = False) -> np.ndarray:
    """uint16 signatures, a row for each text."""
    out = np.full((len(texts), PERMUTATIONS), 0xFFFFFFFF, np.uint32)

    def flush(rows: list[int], parts: list[np.ndarray]) -> None:
        if not rows:
            return
        h = np.concatenate(parts)
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        buffer = np.empty_like(h)
        found = np.empty((len(rows), PERMUTATIONS), np.uint32)
        for k in range(PERMUTATIONS):
            np.multiply(h, _A[k], out=buffer)
            np.add(buffer, _B[k], out=buffer)
            found[:, k] = np.minimum.reduceat(buffer, starts)
        np.minimum.at(out, np.array(rows), found)

    rows, parts, held = [], [], 0
    for i, text in enumerate(texts):
        h = (shingles(text, width, lower) >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(h), CHUNK):  # a very long text goes in pieces of its shingles
            piece = h[at : at + CHUNK]
            rows.append(i)
            parts.append(piece)
            held += len(piece)
            if held >= CHUNK:
                flush(rows, parts)
                rows, parts, held = [], [], 0
    flush(rows, parts)
    return (out & np.uint32(0xFFFF)).astype(np.uint16)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """uint64 keys of the bands of ``ROWS`` numbers, BANDS for each signature; only equal bands have equal keys, but for collisions."""
    parts = signature[:, : BANDS * ROWS].reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)  # a band's key depends on its number
    for k in range(ROWS):
        out = (out ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def to_text(signature: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signature]


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (floor) replaced by as many of the first code points of ``following``, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


EDIT_SCHEMA = "doc_id long, n_chars long, text_sha256 string, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and the likeness of its own to the edited and to the next one's.

    The next document is the one with the next larger doc_id, after the last the first; rows of one doc_id follow each other in the
    order of a hash of the text, then of the text. Null doc_ids come first. One shuffle by ranges of (doc_id, hash) brings neighbours
    together, so that a doc_id with many rows is many ranges; a range ends with a copy of the first document of the one after it.
    Each task streams its sorted rows.
    """
    spark = docs.sparkSession
    shared.bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("at", F.struct(F.col("doc_id").isNotNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.xxhash64("text").alias("h")))
    n = min(RANGES, shared.partitions(spark))  # a range is sorted with spills and streamed, so it may be of any size
    order = shared.materialize(shared.ranked(base.select("at.*"), ["a", "d", "h"], "rank", "mh-order"), "mh-places")
    total = order.count()
    if not total:
        return spark.createDataFrame([], EDIT_SCHEMA)
    cuts = sorted(tuple(r) for r in order.where(F.col("rank") % -(-total // n) == 0).where("rank > 0").select("a", "d", "h").distinct().collect())  # fewer than the ranges
    shared.release(order)
    point = lambda c: F.struct(F.lit(c[0]).alias("a"), F.lit(c[1]).cast("long").alias("d"), F.lit(c[2]).cast("long").alias("h"))
    behind = lambda points: F.size(F.filter(points, lambda c: c <= F.col("at")))
    part = F.lit(0)
    if cuts:
        groups = [cuts[i : i + GROUP] for i in range(0, len(cuts), GROUP)]
        group = behind(F.array(*[point(g[0]) for g in groups]))
        part = F.when(group == 0, 0).otherwise((group - 1) * GROUP + behind(F.element_at(F.array(*[F.array(*map(point, g)) for g in groups]), F.greatest(group, F.lit(1)))))
    placed = base.withColumn("part", part.cast("int"))
    # the first row of each range: its least place, then its smallest text
    firsts = placed.groupBy("part").agg(F.min("at").alias("least")).orderBy("part").collect()  # a row for each range
    turn = [(tuple(r["least"]), firsts[i - 1]["part"]) for i, r in enumerate(firsts)]  # the first of a range also goes to the range before it
    heads = spark.createDataFrame(turn, "at struct<a:boolean,d:long,h:long>, to int")
    tied = placed.join(F.broadcast(heads), "at")
    ahead = tied.withColumn("rn", F.row_number().over(Window.partitionBy("to").orderBy("text"))).where("rn = 1").select("doc_id", "text", "at", F.col("to").alias("part"), F.lit(1).alias("ahead"))
    rows = shared.packed(placed.withColumn("ahead", F.lit(0)).unionByName(ahead).select("doc_id", "text", "part", "ahead", "at"))
    rows = rows.repartition(n, "part").sortWithinPartitions("part", "ahead", "at", "text").drop("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "text_sha256", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def emit(ids: list, texts: list[str]) -> pa.RecordBatch:
            """All but the last row, whose next document may yet come."""
            changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
            own, other = signatures(texts), signatures(changed)
            body = own[:-1]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:-1], pa.int64()),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    *(pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in some], pa.string()) for some in (texts[:-1], changed)),
                    pa.array(to_text(body), pa.string()),
                    pa.array(to_text(other), pa.string()),
                    pa.array((body == other).mean(axis=1)),
                    pa.array((body == own[1:]).mean(axis=1)),
                ],
                names=names,
            )

        ids: list = []
        texts: list[str] = []
        ended = False
        for batch in batches:
            for i, t, extra in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if ended:  # the last range is over; its copy has no row of its own
                    ids, texts, ended = [], [], False
                ids.append(i)
                texts.append(shared.unpacked(t))
                if extra:
                    yield emit(ids, texts)
                    ended = True
            if len(texts) > 1 and not ended:
                yield emit(ids, texts)
                ids, texts = ids[-1:], texts[-1:]

    return rows.mapInArrow(run, EDIT_SCHEMA)


LOWEST = -(1 << 63)  # stands for a null id


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("th"), text.alias("text"))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, lower: bool = True, prints: bool = False) -> DataFrame:
    """(row, doc_id, th, keys) for every row, written to the shared folder: th is the text's SHA-256, keys are those of its bands.
    ``prints``: fp, the SimHash fingerprint of its shingles (ASCII letters in lower case), comes with them."""
    shared.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            keys = band_keys(signatures(texts, width, lower)).view(np.int64)
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            columns = [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))]
            if prints:
                columns.append(pa.array(np.array([simhash.fingerprint_of(t, width) for t in texts], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "keys", "fp"][: len(columns)])

    found = _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, th binary, keys array<long>" + (", fp long" if prints else ""))
    return shared.materialize(found.withColumn("row", F.monotonically_increasing_id()), "mh-marked")


def verified(cells: DataFrame, texts: DataFrame, threshold: float, width: int, lower: bool, kind: str) -> DataFrame:
    """(u, v): all pairs at the threshold of a row on side 1 and one on side 0 of the same cell, u and v being in different groups.

    ``cells`` has (a, b, c, side, node, grp), a cell being (a, b, c) with about ``BLOCK`` rows on side 0 at most; ``texts`` has (node, text),
    texts packed.
    A cell is sorted with side 0 first. Its sets stay in memory while side 1 streams by, so each text moves once a cell.
    """
    n = shared.partitions(cells.sparkSession)
    rows = cells.join(texts, "node").select("a", "b", "c", "side", "node", "grp", "text")
    rows = rows.repartition(n, "a", "b", "c").sortWithinPartitions("a", "b", "c", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, groups, names = None, [], [], []
        flat = owner = None
        for batch in batches:
            us, vs = [], []
            for a, b, c, side, node, grp, text in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if (a, b, c) != cell:
                    cell, held, groups, names, flat = (a, b, c), [], [], [], None
                own = np.unique(shingles(shared.unpacked(text), width, lower))
                if not side:
                    held.append(own)
                    groups.append(grp)
                    names.append(node)
                    continue
                if not held:  # no row of this block has the key
                    continue
                if flat is None:
                    flat, sizes = np.concatenate([*held, np.zeros(0, np.uint64)]), np.array([len(x) for x in held], np.int64)
                    owner, other = np.repeat(np.arange(len(held)), sizes), np.array(groups)
                if len(own):
                    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    both = np.bincount(owner, own[at] == flat, len(held))
                else:
                    both = np.zeros(len(held))
                near = (both >= threshold * (1 - 1e-12) * (len(own) + sizes - both)) & (other != grp)
                for k in np.flatnonzero(near):
                    us.append(node)
                    vs.append(names[k])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return shared.materialize(rows.mapInArrow(run, "u long, v long").distinct(), f"mh-{kind}")


def _texts(docs: DataFrame, cells: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the nodes in ``cells``, read from ``docs``: a row for each."""
    asked = shared.materialize(nodes.join(cells.select("node").distinct(), "node").select("node", "th", F.coalesce("doc_id", F.lit(LOWEST)).alias("key")), "mh-asked")
    rows = _rows(docs, id_col, text_col).select("th", F.coalesce("doc_id", F.lit(LOWEST)).alias("key"), "text")
    rows = shared.packed(shared.lookup_join(rows, asked, ["th", "key"], "inner").select("node", "text"))
    found = shared.materialize(rows.dropDuplicates(["node"]), "mh-texts")
    shared.release(asked)
    return found


def _spread(rows: DataFrame) -> DataFrame:
    """The cells in which every pair of rows of one key that have different groups is compared. ``rows`` has (key, node, grp).

    The rows of the key's largest group needn't be compared with each other: they are on side 0 only, all others on both sides. Both
    sides are cut into blocks, so that no cell has more than about ``BLOCK`` by ``STREAM`` rows.
    """
    by = rows.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("n"))
    keys = by.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "grp")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
    keys = keys.select("key", F.col("top.grp").alias("top"), F.ceil(F.col("n") / (BLOCK // 2)).alias("across"), F.ceil((F.col("n") - F.col("top.n")) / STREAM).alias("down"))
    sized = rows.join(keys, "key")
    zero = F.lit(0).cast("long")
    every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
    held = sized.select("key", F.pmod(F.xxhash64("node"), F.col("across")).alias("b"), every("down").alias("c"), F.lit(0).alias("side"), "node", "grp")
    passing = sized.where("grp <> top").select("key", every("across").alias("b"), F.pmod(F.xxhash64("node"), F.col("down")).alias("c"), F.lit(1).alias("side"), "node", "grp")
    return held.unionByName(passing).select(F.col("key").alias("a"), "b", "c", "side", "node", "grp")


def _near_prints(nodes: DataFrame) -> DataFrame:
    """(node, key) from (node, fp): nodes whose fingerprints links of two bits or fewer join have one key."""
    reps = shared.materialize(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "mh-prints")
    label = shared.components(simhash.links(reps), "u", "v")
    group = reps.join(label, reps["rep"] == label["id"], "left").select("fp", F.coalesce("component", "rep").alias("group"))
    found = shared.materialize(nodes.join(group, "fp").select("node", F.xxhash64(F.lit("simhash"), "group").alias("key")), "mh-near-prints")
    shared.release(reps, label)
    return found


def classes(found: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, lower: bool = True) -> DataFrame:
    """(row, doc_id, th, class_id, class) for every row of ``found``, which is what :func:`marked` makes of ``docs``.

    Documents whose sets of shingles have a Jaccard similarity of ``threshold`` or more link, and a class is all that links lead to;
    class_id is its smallest doc_id, null if no row of it has one. Rows with equal texts are one node.

    Nodes that share a band key are candidates, verified on whole sets, and if ``found`` has fingerprints, so are nodes that links of
    two differing bits or fewer join, which share a key of their own. First each key's smallest node is compared with all others
    of the key, and the links found are followed. Then all pairs of a key that are still in different classes are compared, in
    blocks. A pair within a class can't change the classes, so no link between classes is lost, while a crowd of near copies costs
    work linear in it. Bands are a probabilistic filter: at a similarity of 0.8 a pair is missed with a chance below 0.0001.
    """
    least = found.groupBy("th").agg(F.min("row").alias("node"))
    known = shared.materialize(found.join(least, "th"), "mh-known")
    nodes = known.where("row = node").select("node", "th", "doc_id")
    index = known.where("row = node").select("node", F.explode("keys").alias("key"))
    if "fp" in found.columns:
        index = index.unionByName(_near_prints(known.where("row = node").select("node", "fp")))
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1").select("key", "pivot")
    many = shared.materialize(index.join(sizes, "key"), "mh-shared")
    pairs = many.where("node <> pivot").select("pivot", "node").distinct()
    cell = [F.col("pivot").alias("a"), F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / STREAM)).alias("b"), F.lit(0).cast("long").alias("c")]
    fan = pairs.join(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")), "pivot")
    star = fan.select(*cell, F.lit(1).alias("side"), "node", F.lit(1).cast("long").alias("grp"))
    heads = star.select("a", "b", "c").distinct().select("a", "b", "c", F.lit(0).alias("side"), F.col("a").alias("node"), F.lit(0).cast("long").alias("grp"))
    star = shared.materialize(star.unionByName(heads), "mh-star")
    texts = _texts(docs, star, nodes, id_col, text_col)
    several = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("w")).where("u <> w").select("doc_id", "u")
    tied = known.join(several, "doc_id").select("u", F.col("node").alias("v"))  # rows of one doc_id are one document
    links = verified(star, texts, threshold, width, lower, "links")
    label = shared.components(links.union(tied), "u", "v")
    grouped = many.join(label.select(F.col("id").alias("node"), "component"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("grp"))
    rest = shared.materialize(_spread(grouped), "mh-rest")
    if rest.take(1):
        more = verified(rest, texts, threshold, width, lower, "more")
        if more.take(1):
            label = shared.components(links.union(tied).union(more), "u", "v")
    out = known.join(label.select(F.col("id").alias("node"), "component"), "node", "left").select("row", "doc_id", "th", F.coalesce("component", "node").alias("class"))
    done = shared.materialize(out.join(out.groupBy("class").agg(F.min("doc_id").alias("class_id")), "class"), "mh-classes")
    shared.release(known, many, star, texts, links, rest)
    return done


def fingerprinted(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of :func:`with_edits` with ``class_id``, the class of near-duplicates that each document is in by the bands of its
    fingerprint and verified shingles. Rows without doc_id, text for text, have the class of their text or none."""
    found = classes(marked(docs, id_col, text_col, lower=False), docs, threshold, id_col, text_col, lower=False)
    others = found.where("class_id IS NOT NULL AND NOT (doc_id <=> class_id)")
    others = others.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("key"), F.lower(F.hex("th")).alias("text_sha256"), "class_id")
    told = shared.materialize(others.groupBy("key", "text_sha256").agg(F.min("class_id").alias("class_id")), "mh-told")
    rows = with_edits(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(LOWEST)))
    return shared.lookup_join(rows, told, ["key", "text_sha256"]).drop("key").withColumn("class_id", F.coalesce("class_id", "doc_id"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, class_id): a row for every row of ``docs``; see :func:`classes`. ASCII letters count in lower case."""
    found = marked(docs, id_col, text_col, width)
    return classes(found, docs, threshold, id_col, text_col, width).select("doc_id", "class_id")


def survivors(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept: of each class one row of the document with the smallest id (of its texts the
    one with the smallest digest); of a class in which no row has an id, one row. Candidates are pairs that share a band and pairs whose
    SimHash fingerprints Golay keys find within two bits.

    What goes is looked up by (doc_id, digest), so that whole texts needn't be shuffled while the losers are few.
    """
    found = classes(marked(docs, id_col, text_col, width, prints=True), docs, threshold, id_col, text_col, width)
    key = F.coalesce("doc_id", F.lit(LOWEST))
    each = found.groupBy("class", F.col("doc_id").isNull().alias("none"), key.alias("key"), "th").agg(F.count(F.lit(1)).alias("n"))
    first = each.groupBy("class").agg(F.min(F.struct("none", "key", "th")).alias("best"))
    k1, k2, lost, n = (shared.fresh(docs, x) for x in ("kept_id", "kept_th", "lost", "times"))
    told = each.join(first, "class").select(F.col("key").alias(k1), F.col("th").alias(k2), (F.struct("none", "key", "th") != F.col("best")).alias(lost), F.col("n").alias(n))
    # a row without id may have the key that stands for none, and one with that very id too
    told = told.groupBy(k1, k2).agg(F.min(lost).alias(lost), F.sum(n).alias(n))
    told = shared.materialize(told.where(F.col(lost) | (F.col(n) > 1)), "mh-told")
    marks = docs.withColumn(k1, F.coalesce(docs[id_col].cast("long"), F.lit(LOWEST))).withColumn(k2, F.unhex(F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)))
    marks = shared.lookup_join(marks, told, [k1, k2]).where(~F.coalesce(lost, F.lit(False)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marks.where(F.coalesce(n, F.lit(1)) == 1).select(*columns).unionByName(marks.where(F.col(n) > 1).dropDuplicates([k1, k2]).select(*columns))
