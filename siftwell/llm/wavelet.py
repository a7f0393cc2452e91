"""Token ids in a wavelet matrix per shard: one compressed file gives access, counting and occurrence lookup.

A shard's ids are stored as bit-planes, the highest bit first; each plane is the order after a stable partition by the plane
before it. Planes are cut into blocks of ``BLOCK`` bits, each compressed alone, with the ones before it in the header, so a
lookup inflates only the blocks it meets; an open block has a directory of the ones before each ``SUPER`` bits, so rank counts at
most that many bits and select searches directories. Documents lie in ascending doc_id order (ties by text, null ids first), each ended by
the end id. A file is written under another name and renamed, so a task that runs twice leaves one whole file.

Null and empty texts hold the end id alone. Repeated rows stay rows. An empty table gives no shard and an empty result. Other
columns of the input are not looked at. A document longer than a shard has a shard of its own.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MAGIC, BLOCK, SUPER, SHARD_TOKENS = b"SWWM0001", 1 << 19, 512, 1 << 20
CACHED, CACHED_CHARS = 800_000, 48
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def build(ids: np.ndarray, bits: int, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of one shard."""
    current = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    planes, zeros = [], []
    for level in range(bits - 1, -1, -1):
        ones = (current & current.dtype.type(1 << level)) != 0
        planes.append(np.packbits(ones, bitorder="little"))
        low = current[~ones]
        zeros.append(len(low))
        current = np.concatenate((low, current[ones]))
    blocks, before, body = [], [], []
    step = BLOCK // 8
    for plane in planes:
        total, sizes, counts = 0, [], []
        for at in range(0, len(plane), step):
            part = plane[at : at + step]
            packed = zlib.compress(part.tobytes(), 1)
            counts.append(total)
            total += int(_POP[part].sum(dtype=np.int64))
            sizes.append(len(packed))
            body.append(packed)
        blocks.append(sizes)
        before.append(counts)
    docs = zlib.compress(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes() + bytes(d is None for d in doc_ids), 6)
    head = json.dumps({"n": len(ids), "bits": bits, "docs": len(doc_ids), "docs_size": len(docs), "zeros": zeros, "blocks": blocks, "before": before}).encode()
    return b"".join((MAGIC, len(head).to_bytes(8, "little"), head, docs, *body))


class Shard:
    """Reads a shard from its file's bytes."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("no wavelet shard")
        size = int.from_bytes(data[8:16], "little")
        h = json.loads(data[16 : 16 + size])
        self.n, self.bits, self.zeros, self.before = h["n"], h["bits"], h["zeros"], h["before"]
        at = 16 + size
        raw, k = zlib.decompress(data[at : at + h["docs_size"]]), h["docs"]
        missing = raw[16 * k :]
        self.doc_ids = [None if missing[i] else d for i, d in enumerate(np.frombuffer(raw, "<i8", k).tolist())]
        self.lengths = np.frombuffer(raw, "<i8", k, 8 * k)
        self.starts = np.concatenate(([0], self.lengths.cumsum())).astype(np.int64)
        at += h["docs_size"]
        self._data, self._where, self._open = data, [], {}
        for sizes in h["blocks"]:
            ends = at + np.cumsum([0, *sizes])
            self._where.append(ends.tolist())
            at = int(ends[-1])

    def _plain(self, level: int, k: int) -> np.ndarray:
        a, b = self._where[level][k : k + 2]
        return np.frombuffer(zlib.decompress(self._data[a:b]), np.uint8)

    def _block(self, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The block's bytes, and the ones before each of its superblocks."""
        if (level, k) not in self._open:
            data = self._plain(level, k)
            counts = np.add.reduceat(_POP[data], np.arange(0, len(data), SUPER // 8), dtype=np.int64)
            self._open[level, k] = data, np.concatenate(([0], counts.cumsum()))
        return self._open[level, k]

    def _bit(self, level: int, i: int) -> int:
        return int(self._block(level, i // BLOCK)[0][i % BLOCK >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones of the plane before position i."""
        if i == 0:
            return 0
        k, rest = divmod(i, BLOCK)
        if k == len(self.before[level]):
            k, rest = k - 1, BLOCK
        block, ones = self._block(level, k)
        at = rest // SUPER
        found = self.before[level][k] + int(ones[at]) + int(_POP[block[at * SUPER // 8 : rest >> 3]].sum(dtype=np.int64))
        return found + (int(_POP[block[rest >> 3] & ((1 << (rest & 7)) - 1)]) if rest & 7 else 0)

    def _select(self, level: int, one: int, k: int) -> int:
        """The position of the k-th (from 0) one or zero of the plane."""
        before = self.before[level]
        at = bisect_right(range(len(before)), k, key=lambda b: before[b] if one else b * BLOCK - before[b]) - 1
        k -= before[at] if one else at * BLOCK - before[at]
        block, ones = self._block(level, at)
        counts = ones if one else np.arange(len(ones)) * SUPER - ones
        part = int(np.searchsorted(counts[:-1], k, side="right")) - 1
        bits = np.unpackbits(block[part * SUPER // 8 : (part + 1) * SUPER // 8], bitorder="little")
        return at * BLOCK + part * SUPER + int(np.flatnonzero(bits == one)[k - int(counts[part])])

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, i), self._ones(level, j)
            if token >> (self.bits - 1 - level) & 1:
                i, j = self.zeros[level] + a, self.zeros[level] + b
            else:
                i, j = i - a, j - b
        return i, j

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often the id occurs in positions start to stop."""
        if not 0 <= token < 1 << self.bits:
            return 0
        i, j = self._range(token, start, self.n if stop is None else stop)
        return j - i

    def find(self, token: int, k: int) -> int | None:
        """The position of the id's k-th occurrence (from 0), None beyond the last."""
        if not 0 <= k < self.count(token):
            return None
        at = self._range(token, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids, in order."""
        dtype = np.uint16 if self.bits <= 16 else np.uint32
        current = np.zeros(self.n, dtype)
        for level in range(self.bits - 1, -1, -1):
            plane = np.concatenate([self._plain(level, k) for k in range(len(self.before[level]))]) if self.n else np.zeros(0, np.uint8)
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(np.bool_)
            z = self.zeros[level]
            above = np.empty(self.n, dtype)
            above[~ones] = current[:z]
            above[ones] = current[z:] | dtype(1 << (self.bits - 1 - level))
            current = above
        return current


#: Words of precomposed Latin letters are one pre-token each.
WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Such a word between ASCII marks; an apostrophe may belong to a word, and added tokens hold "<". Each part is one pre-token.
MARKED = re.compile("([!-&(-/:;=-@\\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\\[-`{-~]*)")
#: A full stop or comma that ends a chunk but follows no such letter.
ODD = re.compile("[.,](?<![A-Za-zÀ-ÖØ-öø-ÿ].)(?: |\\Z)")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ChunkTokenizer:
    """A tokenizers file with word ends whose pre-tokens hold no white space. Chunks between spaces and line ends encode alone,
    and are remembered. In plain Latin texts marks after a word are cut off first, and case is dropped as the file does. New words
    go to the library joined by spaces, many in a call, in lower case and without the rules that leave them as they are, and the ids are
    cut after those of a word end; words between marks are put together of their parts. A file whose rules are not
    these encodes whole texts."""

    #: The rules under which chunks encode alone: white space only separates, and no word goes beyond it.
    RULES = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
        "</w>",
    )

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bits = max(1, max(vocab.values()).bit_length())
        self.kind = "<u2" if self.bits <= 16 else "<u4"
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {"": b""}
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.chunks = (rules.get("normalizer"), rules.get("pre_tokenizer"), rules["model"].get("end_of_word_suffix")) == self.RULES
        if self.chunks:
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.bare.encode_batch_fast([" ".join(words).lower()], add_special_tokens=False)[0].ids, self.kind)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
        if len(cuts) != len(words):
            return self._alone(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16- or 32-bit integers."""
        if not self.chunks:
            return self._alone(texts)
        if len(self.memo) > CACHED:
            self.memo = {"": b""}
        cut = []
        for t in texts:
            t = t.replace("\n", " ")
            if _latin(t) and "<|" not in t and not ODD.search(t):
                t = t.lower().replace(", ", " , ").replace(". ", " . ")
            cut.append(t.split(" "))
        new = list(set().union(*cut).difference(self.memo)) if cut else []
        plain, other, marked = [], [], []
        for x in new:
            found = MARKED.fullmatch(x)
            if not found:
                other.append(x)
            elif len(found[2]) == len(x):
                plain.append(x)
            else:
                marked.append((x, found.groups()))
        if marked:
            words = {w for _, (_, w, _) in marked}.difference(self.memo, plain)
            marks = {m for _, (a, _, b) in marked for m in (a, b)}.difference(self.memo, other)
            plain += words
            other += marks
            new += [*words, *marks]
        for some in (plain[i : i + 500] for i in range(0, len(plain), 500)):
            self.memo.update(zip(some, self._joined(some)))
        for some in (other[i : i + 1000] for i in range(0, len(other), 1000)):
            self.memo.update(zip(some, self._alone(some)))
        get = self.memo.__getitem__
        self.memo.update((x, b"".join(map(get, parts))) for x, parts in marked)
        out = [b"".join(map(get, parts)) for parts in cut]
        for chunk in new:
            if len(chunk) > CACHED_CHARS:
                del self.memo[chunk]
        return out


def tokenizer(path: str) -> ChunkTokenizer:
    return shared.kept(("wavelet", path), lambda: ChunkTokenizer(path))


def _store(folder: str, name: str, data: bytes) -> str:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder.removeprefix("file:"))
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{root}/{name}")
    return f"{folder}/{name}"


def load(path: str) -> Shard:
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))
    with fs.open_input_stream(at) as f:
        return Shard(f.read())


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards of ``docs`` under ``folder``; the manifest (part, k, path, n_tokens, start) has a row for each, start
    being the ids of all shards before it."""
    spark = docs.sparkSession
    shared.bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shared.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, k = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        kind = "<u2" if t.bits <= 16 else "<u4"
        end = np.array([end_id], kind).tobytes()
        ids: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = [len(x) // len(end) for x in held]
            path = _store(folder, f"{part:06d}-{k:06d}.wm", build(np.frombuffer(b"".join(held), kind), t.bits, ids, lengths))
            return pa.RecordBatch.from_pylist([{"part": part, "k": k, "path": path, "n_tokens": sum(lengths)}], pa.schema([("part", pa.int32()), ("k", pa.int32()), ("path", pa.string()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), t.encode_batch(batch.column(1).to_pylist())):
                x += end
                if held and size + len(x) > shard_tokens * len(end):
                    yield flush()
                    ids, held, size, k = [], [], 0, k + 1
                ids.append(i)
                held.append(x)
                size += len(x)
        if held:
            yield flush()

    manifest = shared.materialize(rows.mapInArrow(run, "part int, k int, path string, n_tokens long"), "shards")
    return shared.running_total(manifest, ["part", "k"], "n_tokens", "start", "manifest").withColumn("start", F.col("start") - F.col("n_tokens"))


def read(manifest: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = load(path)
                raw = shard.ids().astype("<u4").tobytes()
                at = (shard.starts * 4).tolist()
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(base + shard.starts[:-1]), pa.array(shard.lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = shared.partitions(manifest.sparkSession)
    return manifest.repartition(n, "path").select("path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
