"""Packing of tokenised documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, in_parts, unused, work_dir, written

WINDOW, END_ID = 4096, 2
#: Pieces that one task packs together; a window is left part empty about once for so many pieces.
PIECES_PER_SHARD = 50_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

# Fixed values of the tokenizer's format: what a file must ask for, so that the short cuts below hold.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
#: The tokenizer's own split pattern, written out for lower-case Latin-1.
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
#: Chunks that normalise to their own lower case; all others go through the library whole.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]+")


def check_format(spec: dict) -> None:
    """An error unless a tokenizers file normalises, splits and marks words as ``ChunkEncoder`` takes for granted."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split, letters = (steps[0], steps[1]) if len(steps) == 2 else ({}, {})
    fits = (
        (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and split.get("pattern") == {"Regex": SPLIT}
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and letters.get("type") == "ByteLevel"
        and not letters.get("add_prefix_space")
        and not letters.get("use_regex")
        and spec["model"].get("end_of_word_suffix") == "</w>"
        and not any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word", "normalized"))
    )
    if not fits:
        raise ValueError("this tokenizer normalises or splits in another way than the packing operator knows")


class ChunkEncoder:
    """Ids of the library's tokenizer for one that drops white space and marks word ends (``</w>``).

    Nothing that such a tokenizer does reaches across white space, so each distinct chunk between white space is
    encoded once and its ids are kept. Chunks of plain Latin-1 are split here, and their distinct words are encoded
    by the library's model in bulk; all other chunks go through the whole tokenizer.
    """

    def __init__(self, path: str, chunks_kept: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            check_format(json.load(f))
        self.whole = Tokenizer.from_file(path)
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marked = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.kept = chunks_kept

    def _learn_words(self, words: list[str]) -> None:
        for i in range(0, len(words), 400):
            part = words[i : i + 400]
            ids = np.array(self.model.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("the tokenizer doesn't mark the end of each word")
            raw, stops = ids.tobytes(), (stops * 4).tolist()
            for word, a, b in zip(part, [0, *stops], stops):
                self.words[word] = raw[a:b]

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.words) > self.kept:
            self.words = {}
        split = {}
        for raw in chunks:
            chunk = raw.decode()
            if _PLAIN.fullmatch(chunk) and not any(m in chunk for m in self.marked):
                split[raw] = _LATIN.findall(chunk.lower())
            else:
                self.chunks[raw] = np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        self._learn_words(list({w for ws in split.values() for w in ws}.difference(self.words)))
        words = self.words
        for raw, ws in split.items():
            self.chunks[raw] = b"".join([words[w] for w in ws])

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers."""
        for i in range(0, len(texts), 64):
            split = [(t or "").encode("utf-8", "replace").split() for t in texts[i : i + 64]]
            needed = set().union(*split)
            missing = needed.difference(self.chunks)
            if len(self.chunks) + len(missing) > self.kept:
                self.chunks, missing = {}, needed
            self.learn(missing)
            for chunks in split:
                yield b"".join(map(self.chunks.__getitem__, chunks))


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker and file; its memo serves the worker's later tasks too."""
    return held(f"encoder {path}", lambda: ChunkEncoder(path))


def tokenised_pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Per piece of a document: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, its ids as bytes.

    A document is cut into full windows and one remainder. Null text counts as empty: its one id is ``end_id``.
    """
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)
        for batch in batches:
            out = []
            for doc, raw in zip(batch["doc_id"].to_pylist(), chain.from_iterable(map(encode, in_parts(batch["text"])))):
                raw += end
                n = len(raw) // 4
                for at in range(0, n, window):
                    piece = raw[at * 4 : (at + window) * 4]
                    out.append((doc, at, len(piece) // 4, zlib.crc32(piece), n, *([piece] if with_ids else [])))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE + ", ids binary" * with_ids)


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over the capacities finds the tightest that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, which: int) -> None:
        self.held[capacity].append(which)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the least capacity that is not below ``least``."""
        count, node = self.count, least + self.leaves
        while not count[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1  # the next subtree on the right
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.held[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) of each length; ``lengths`` must fall and none may exceed ``window``."""
    tree, out, opened = OpenWindows(window), [], 0
    for n in lengths:
        if found := tree.take(n):
            capacity, which = found
        else:
            capacity, which, opened = window, opened, opened + 1
        out.append((which, window - capacity))
        if capacity > n:
            tree.put(capacity - n, which)
    return out


def pack(pieces: DataFrame, window: int = WINDOW, per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (doc_id, start, length, ...), which must be cheap to read twice.

    Full windows are sequences of their own. The rest is dealt out by the hash of a row's place to shards of about ``per_shard`` pieces, as
    many as the count asks for; each is packed by best-fit decreasing, longest first, ties by doc_id and start. A shard
    holds a few numbers for each piece, so it fits a task whatever the documents' lengths. sequence_id is the shard
    times 2**32 plus the window's number there; full windows have negative ones, by their place in the input.
    """
    place = unused(pieces, "place")
    part = pieces.withColumn(place, F.monotonically_increasing_id()).where(F.col("length") < window)
    shards = max(1, -(-part.count() // per_shard))
    names = pieces.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def fill(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.select(names).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        at = np.array(best_fit_decreasing(rows["length"].to_pylist(), window), dtype=np.int64).reshape(-1, 2)
        return rows.append_column("sequence_id", pa.array(at[:, 0] + (key[0].as_py() << 32))).append_column("offset", pa.array(at[:, 1]))

    shard = F.pmod(F.xxhash64(place), F.lit(shards))
    packed = part.groupBy(shard.alias("shard")).applyInArrow(fill, schema)
    full = pieces.where(F.col("length") >= window)
    number = -F.monotonically_increasing_id() - F.lit(1)
    return packed.unionByName(full.withColumns({"sequence_id": number, "offset": F.lit(0).cast("long")}))


def packed_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document is in exactly one piece. Null and empty texts are one piece of length 1. Repeated rows
    are packed once each. Null ids are carried. An empty table gives no rows. Other columns are ignored. Tokens are
    written once and read for counting and for packing.
    """
    pieces = written(tokenised_pieces(docs, path, window, end_id), f"{work_dir(docs.sparkSession)}/pieces")
    return pack(pieces, window)
