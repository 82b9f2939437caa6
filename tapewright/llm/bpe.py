"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, held
from .pretokens import PATTERN, UnitMemo, compiled


class RankQueue:
    """Positions by merge rank; two levels of 256-bit masks lead to the lowest rank that has any.

    A bucket is a position or, where several wait, a heap of them.
    """

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 256 + 1)
        self.top = 0
        self.buckets: dict[int, int | list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        waiting = self.buckets.get(rank)
        if waiting is None:
            self.buckets[rank] = position
            word = rank >> 8
            if not self.low[word]:
                self.top |= 1 << word
            self.low[word] |= 1 << (rank & 255)
        elif type(waiting) is list:
            heapq.heappush(waiting, position)
        else:
            self.buckets[rank] = [waiting, position] if waiting < position else [position, waiting]

    def pop(self) -> tuple[int, int] | None:
        """The leftmost position of the lowest rank."""
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        mask = self.low[word]
        bit = mask & -mask
        rank = word << 8 | bit.bit_length() - 1
        waiting = self.buckets[rank]
        if type(waiting) is list:
            position = heapq.heappop(waiting)
            if waiting:
                return rank, position
        else:
            position = waiting
        del self.buckets[rank]
        self.low[word] = mask ^ bit
        if mask == bit:
            self.top = top & (top - 1)
        return rank, position


class Bpe:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.vocabulary = {i: t for t, i in ranks.items()}
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.findall = compiled(pattern).findall
        self.pretokens = Recent(self._bytes_of, 400_000)
        self.memo = UnitMemo(lambda unit: b"".join([self.pretokens[p] for p in self.findall(unit)]))

    @classmethod
    def from_file(cls, path: str, pattern: str = PATTERN) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _bytes_of(self, pretoken: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.merge(pretoken.encode("utf-8", "replace"))])

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pretoken: the lowest rank first, of equal ones the leftmost, until no pair is in the vocabulary."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        n = len(data)
        after = list(range(1, n + 1))  # where each part ends; parts form a linked list
        before = list(range(-1, n))
        due: list[int | None] = [None] * (n + 1)  # the rank of the pair that begins here; other entries are stale
        push, pop = self.queue.push, self.queue.pop
        for i in range(n - 1):
            if (r := ranks.get(data[i : i + 2])) is not None:
                due[i] = r
                push(r, i)
        while (found := pop()) is not None:
            rank, i = found
            if due[i] != rank:
                continue
            j = after[i]  # the right part goes into the left one
            end = after[j]
            after[i], due[j] = end, None
            if end < n:
                before[end] = i
                due[i] = r = ranks.get(data[i : after[end]])
                if r is not None:
                    push(r, i)
            else:
                due[i] = None
            if i:
                k = before[i]
                due[k] = r = ranks.get(data[k:end])
                if r is not None:
                    push(r, k)
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.memo(text or ""))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, memoryview(ids).cast("I"))) if ids else b""


def coder(path: str, pattern: str) -> Bpe:
    """One for each Python worker and file."""
    return held(f"coder {path} {pattern}", lambda: Bpe.from_file(path, pattern))


def bpe_encode(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text, little-endian unsigned 32-bit integers in one binary.

    No special tokens. Null and empty texts have no ids; repeated rows and null doc_ids are carried; other columns are
    ignored; an empty table gives no rows. Each task works through its rows by itself, without a shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path, pattern).encode
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.record_batch([part["doc_id"], pa.array([encode(t.as_py()) for t in part["text"]], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids``, to (doc_id, ids)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = coder(path, PATTERN).decode
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = part["ids"]
                yield pa.record_batch([part["doc_id"], ids, pa.array([decode(x.as_py() or b"") for x in ids], pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def bpe_digests(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the bytes decoded from them."""
    both = bpe_decode(bpe_encode(docs, path, pattern), path)
    return both.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
