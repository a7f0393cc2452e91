"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of the pre-tokens that a batch of texts brings anew form linked lists (arrays of next and previous positions). For
every rank there is a bucket of positions whose pair (the piece at the position and the next piece) has that rank; three levels
of 64-bit words mark the ranks with a bucket, so find-first-set gives the lowest rank. A bucket's pairs merge together in numpy,
leftmost first where they overlap. Entries that a merge has made stale stay in their bucket and are skipped when popped. The work
is linear in the merges, so a very long pre-token takes no more time a byte than short ones. Pre-tokens seen are remembered, in
a bounded cache.

Null texts count as empty; empty texts give no ids. Repeated rows stay rows; an empty table gives an empty table; other columns
are not looked at. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: A piece is white space, then what is none: no match of a pre-token pattern crosses its ends, so pieces can be remembered.
_SPACE = "\t-\r \x85\xa0  -     　"
PIECE = rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+"
#: Where a text has no white space around a lone space, cutting before each space gives such ends too, and faster.
UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: Pieces and pre-tokens remembered at a time, and the longest.
CACHED, CACHED_CHARS = 250_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class RankQueue:
    """Buckets of positions by rank under three levels of 64-bit words; a bucket is a list of position arrays."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self, ranks: int) -> None:
        words = (ranks >> 6) + 1
        self.low, self.mid, self.top = [0] * words, [0] * ((words >> 6) + 1), 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        i = rank >> 6
        j = i >> 6
        self.low[i] |= 1 << (rank & 63)
        self.mid[j] |= 1 << (i & 63)
        self.top |= 1 << j

    def pop(self) -> tuple[int, list[np.ndarray]] | None:
        """The lowest rank that has a bucket, and the bucket."""
        top = self.top
        if not top:
            return None
        j = (top & -top).bit_length() - 1
        m = self.mid[j]
        i = j << 6 | (m & -m).bit_length() - 1
        w = self.low[i]
        rank = i << 6 | (w & -w).bit_length() - 1
        self.low[i] = w = w & w - 1
        if not w:
            self.mid[j] = m = m & m - 1
            if not m:
                self.top = top & top - 1
        return rank, self.buckets.pop(rank)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for start, stop, rank in zip(starts, [*starts[1:], len(ranks)], ranks[starts].tolist()):
            self.push(rank, positions[start:stop])


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        size = max(ranks.values(), default=-1) + 1
        self.queue = RankQueue(size)
        self.table: list[bytes] = [b""] * size
        for piece, rank in ranks.items():
            self.table[rank] = piece
        self.octets = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        # every way to make a token of two, as left * size + right
        made = sorted((ranks[t[:i]] * size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.size, self.pairs, self.made = size, np.array([p for p, _ in made] + [1 << 62], np.int64), np.array([r for _, r in made] + [-1], np.int64)
        first = self.rank_of(self.octets.repeat(256), np.tile(self.octets, 256))
        self.first = first.reshape(256, 256)
        self.find = regex.compile(pattern).findall
        self.pieces = re.compile(PIECE).findall
        self.words: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """The rank of each pair of ids, -1 if it is none."""
        pair = left * self.size + right
        at = self.pairs.searchsorted(pair)
        return np.where(self.pairs[at] == pair, self.made[at], -1)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token (none is empty) as little-endian unsigned 32-bit integers. All run through one queue: words
        don't touch, so the lowest rank of all is the lowest of its words, and a bucket merges at once, leftmost first where its
        pairs overlap. Should a merge make a pair of lower rank, its word is encoded anew, one merge at a time."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], lengths.cumsum()[:-1]))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        edge = np.zeros(n + 1, bool)  # a word begins here
        edge[starts] = edge[n] = True
        ids = self.octets[raw]
        end, before = np.arange(1, n + 2), np.arange(-1, n)
        alive = np.ones(n, bool)
        wanted = np.full(n, -1)
        wanted[:-1] = self.first[raw[:-1], raw[1:]]
        wanted[edge[1:]] = -1
        queue, odd = self.queue, []
        if (live := np.flatnonzero(wanted >= 0)).size:
            queue.push_all(wanted[live], live)
        while (found := queue.pop()) is not None:
            rank, bucket = found
            at = bucket[0] if len(bucket) == 1 else np.concatenate(bucket)
            at = at[wanted[at] == rank]  # the others are stale
            if at.size > 1:
                at = np.unique(at)
            if not at.size:
                continue
            right = end[at]
            if at.size > 1 and (touching := at[1:] == right[:-1]).any():  # of pairs in a chain every second one, from the left
                k = np.arange(at.size)
                begins = np.where(np.concatenate(([True], ~touching)), k, 0)
                keep = (k - np.maximum.accumulate(begins)) % 2 == 0
                at, right = at[keep], right[keep]
            stop = end[right]
            if at.size > 1 and (next_to := (stop[:-1] == at[1:]) & ~edge[at[1:]]).any():
                passing = self.rank_of(rank, ids[at[1:][next_to]])  # a pair that is there between two merges
                if ((passing >= 0) & (passing < rank)).any():
                    odd.extend(at[1:][next_to][(passing >= 0) & (passing < rank)].tolist())
            ids[at], end[at], before[stop] = rank, stop, at
            alive[right], wanted[right] = False, -1
            inner = ~edge[stop]
            wanted[at] = -1
            p = at[inner]
            after = self.rank_of(rank, ids[stop[inner]]) if p.size else p
            wanted[p] = after
            q = before[at[~edge[at]]]
            ahead = self.rank_of(ids[q], rank) if q.size else q
            wanted[q] = ahead
            where, ranks = np.concatenate((p, q)), np.concatenate((after, ahead))
            good = ranks >= 0
            if good.any():
                where, ranks = where[good], ranks[good]
                if (low := ranks < rank).any():
                    odd.extend(where[low].tolist())
                if where.size == 1:
                    queue.push(int(ranks[0]), where)
                else:
                    order = np.argsort(where, kind="stable")
                    queue.push_all(ranks[order], where[order])
        out = ids[alive].astype("<u4").tobytes()
        ends = (np.add.reduceat(alive, starts, dtype=np.int64).cumsum() * 4).tolist()
        result = [out[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        for i in set((np.searchsorted(starts, np.array(odd, np.int64), "right") - 1).tolist()) if odd else ():
            result[i] = np.array(self.merge_one(words[i]), "<u4").tobytes()
        return result

    def merge_one(self, data: bytes) -> list[int]:
        """The ids of one pre-token by the same queue, one merge at a time."""
        get, n, queue = self.ranks.get, len(data), self.queue
        end, before, wanted = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        heaps: dict[int, list[int]] = {}

        def want(at: int, rank: int | None) -> None:
            if rank is None:
                wanted[at] = -1
            elif wanted[at] != rank:
                wanted[at] = rank
                if rank in heaps:
                    heappush(heaps[rank], at)
                else:
                    heaps[rank] = [at]
                    queue.push(rank, _NONE)

        for i in range(n - 1):
            want(i, get(data[i : i + 2]))
        while (found := queue.pop()) is not None:
            rank = found[0]
            at = heappop(heaps[rank])
            if heaps[rank]:
                queue.push(rank, _NONE)
            else:
                del heaps[rank]
            if wanted[at] != rank:
                continue
            wanted[at] = -1
            right = end[at]
            stop = end[at] = end[right]
            wanted[right] = -1
            if stop < n:
                before[stop] = at
                want(at, get(data[at : end[stop]]))
            if before[at] >= 0:
                want(before[at], get(data[before[at] : stop]))
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[data[at : end[at]]])
            at = end[at]
        return ids

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for memo in (self.words, self.plain, self.spaced):
            if len(memo) > CACHED:
                memo.clear()
        cut: list[tuple[list[str], list[str]]] = []  # a text's pieces as they are, and those after a space
        new_plain, new_spaced = set(), set()
        for text in texts:
            parts = (self.pieces(text), []) if UNSAFE.search(text) else ((p := text.split(" "))[:1], p[1:])
            cut.append(parts)
            new_plain.update(parts[0])
            new_spaced.update(parts[1])
        new_plain.difference_update(self.plain)
        new_spaced.difference_update(self.spaced)
        asked = [(self.plain, piece, self.find(piece)) for piece in new_plain] + [(self.spaced, piece, self.find(" " + piece)) for piece in new_spaced]
        words, unknown = self.words, list({m for _, _, found in asked for m in found}.difference(self.words))
        for i in range(0, len(unknown), 200_000):
            some = unknown[i : i + 200_000]
            words.update(zip(some, self.merge_many([m.encode("utf-8", "surrogatepass") for m in some])))
        for memo, piece, found in asked:
            memo[piece] = b"".join([words[m] for m in found])
        plain, spaced = self.plain.__getitem__, self.spaced.__getitem__
        out = [b"".join([*map(plain, a), *map(spaced, b)]) for a, b in cut]
        for m in unknown:
            if len(m) > CACHED_CHARS:
                del words[m]
        for memo, piece, _ in asked:
            if len(piece) > CACHED_CHARS:
                del memo[piece]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_NONE = np.zeros(0, np.int64)


def encoder(path: str, pattern: str) -> Encoder:
    """This process's encoder for a rank file, which every worker has at ``path``, with all it remembers."""
    return shared.kept(("byte_bpe", path, pattern), lambda: Encoder(load_ranks(path), pattern))


def digest_schema(id_col: str = "doc_id") -> str:
    return "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, round_trip boolean"


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    return _run(docs, path, pattern, id_col, text_col, lambda e, i, t, x: (i, np.frombuffer(x, "<u4").tolist()), [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))], "doc_id long, ids array<int>")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_tokens, sha256 of the ids as little-endian unsigned 32-bit integers, sha256 of the decoded bytes, the text's
    bytes, and whether decoding gives them back."""

    def row(e: Encoder, i: int | None, text: str, ids: bytes) -> tuple:
        data, back = text.encode("utf-8", "surrogatepass"), e.decode(ids)
        return i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), len(data), back == data

    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64()), ("round_trip", pa.bool_())]
    return _run(docs, path, pattern, id_col, text_col, row, fields, digest_schema())


def _run(docs, path, pattern, id_col, text_col, row, fields, schema) -> DataFrame:
    shared.bounded_batches(docs.sparkSession)
    names, kinds = zip(*fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [row(e, *x) for x in zip(batch.column(0).to_pylist(), texts, e.encode_batch(texts))]
            columns = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def decoded(ids: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids): bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            texts = [b"".join(map(e.table.__getitem__, chain(x or ()))).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
