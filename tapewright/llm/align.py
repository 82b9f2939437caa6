"""Alignment of two tokenizers' tokens: overlapping tokens form groups, found by pointer jumping; links are counted corpus-wide."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, in_parts, unused, work_dir, written
from .tokencount import byte_letters

#: White space (here with the ASCII separators) never stands before a cut, so no token of either file reaches over one.
_CUT = re.compile(r"(?<=\S)(?= )")
_UNEVEN = re.compile(r"\s ")
#: Units and id pairs after which a worker's memo is emptied, and how many new units are encoded in one call.
UNITS, PAIRS, TOGETHER = 500_000, 4_000_000, 2000
#: Pairs of ids that are broadcast with their counts: 8 MB. The others, which are rarer, are joined.
FREQUENT = 1 << 19


class Alignment(NamedTuple):
    """The alignment of a text; ``keys`` are its different id pairs, ``times`` the links of each."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    digest: str
    keys: np.ndarray
    times: np.ndarray


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each A token, then each B token, the last A token of its component; ``ends`` are rising byte offsets.

    Each token points to the token that reaches farthest right among those that share a byte with it, itself included
    (of two that end together, the A token). Successors are doubled until nothing changes.
    """
    n = len(ends_a)
    over = np.searchsorted(ends_b, ends_a, side="left")
    to = np.concatenate((np.where(ends_b[over] > ends_a, n + over, np.arange(n)), np.searchsorted(ends_a, ends_b, side="left")))
    while True:
        twice = to[to]
        if np.array_equal(twice, to):
            return to
        to = twice


def _distinct(group: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times) of the different ids of each wanted group, by group."""
    there = wanted[group]
    both, times = np.unique((group[there].astype(np.int64) << 32) | ids[there], return_counts=True)
    return both >> 32, both & 0xFFFFFFFF, times


def _put(kept: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """``kept`` with ``new`` from ``at`` on; its length is doubled when it's full."""
    end = at + new.shape[-1]
    if end > kept.shape[-1]:
        kept = np.concatenate((kept, np.zeros((*kept.shape[:-1], max(end, 2 * kept.shape[-1]) - kept.shape[-1]), kept.dtype)), axis=-1)
    kept[..., at:end] = new
    return kept


class Aligner:
    """Aligns a byte-level BPE file of the tokenizers library (A) with a sentencepiece file (B), unit by unit.

    A text is cut before every space that follows something else than white space. Both files' tokens always end there:
    A's pattern starts a new match, and B has no piece with a space behind other characters (checked when loaded). So
    units are aligned on their own, many in one call, and kept in a bounded memo.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("A has to be a byte-level file with the usual pattern, without prefix space and normaliser")
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any(b" " in x.lstrip(b" ") for x in self.b_bytes) or b"".join(map(self.b_bytes.__getitem__, self.b.encode(" x  y "))) != b"  x  y ":
            raise ValueError("B has pieces that reach from text to a space, or drops white space")
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        self.space = self.b.piece_to_id("▁")
        self._forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def units(self, text: str) -> list[str]:
        """The units of space + text."""
        spaced = " " + text
        if _UNEVEN.search(spaced):
            return _CUT.split(spaced)
        return [" " + x for x in text.split(" ")]

    def _encoded(self, units: list[str]) -> Iterator[tuple[list[str], list[int], list[int]]]:
        """Units with A's and B's ids of all of them in a row; units whose bytes don't come back are left out."""
        text = "".join(units)
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = [self.space] if text == " " else self.b.encode(text[1:])
        want = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want:
            yield units, a, b
        elif len(units) > 1:
            yield from self._encoded(units[: len(units) // 2])
            yield from self._encoded(units[len(units) // 2 :])

    def _learn(self, units: list[str]) -> None:
        """Adds the alignment of new units to the memo; all are aligned at once."""
        plain, odd = [u for u in units if not u[-1].isspace()], [[u] for u in units if u[-1].isspace()]
        parts = [x for part in [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)] + odd for x in self._encoded(part)]
        names = [u for part in parts for u in part[0]]
        if not names:
            return
        a, b = (np.concatenate([np.array(part[k], np.int64) for part in parts]) for k in (1, 2))
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends_unit = np.cumsum(list(map(len, map(str.encode, names))))
        last, label = np.unique(terminals(ends_a, ends_b), return_inverse=True)  # groups in the order of the text, by their last A token
        group_a, group_b = label[: len(a)], label[len(a) :]
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        stop_a, stop_b, wide = np.cumsum(size_a), np.cumsum(size_b), (size_a > 1) | (size_b > 1)
        end_b = b[stop_b - 1]
        # in groups of more than two tokens the different ids, A's each with B's each
        (of_a, id_a, times_a), (of_b, id_b, times_b) = _distinct(group_a, a, wide), _distinct(group_b, b, wide)
        begin_b = np.searchsorted(of_b, np.arange(len(last) + 1))
        width = np.diff(begin_b)[of_a]
        pick = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width - begin_b[of_a], width)
        pairs = np.where(wide, np.bincount(of_a, width, len(last)), 1).astype(np.int64)
        stop_pairs, many = np.cumsum(pairs), np.repeat(wide, pairs)
        keys, times = np.empty(len(many), np.int64), np.ones(len(many), np.int64)
        keys[~many], keys[many] = (a[last[~wide]] << 32) | end_b[~wide], np.repeat(id_a << 32, width) | id_b[pick]
        times[many] = np.repeat(times_a, width) * times_b[pick]
        until = np.searchsorted(ends_a[last], ends_unit, "right")  # groups of all units up to each
        shown = [f"{x}|{y}" for x, y in zip(a[last].tolist(), end_b.tolist())]
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        spans = (x[wide].tolist() for x in (stop_a - size_a, stop_a, stop_b - size_b, stop_b))
        for g, i, j, k, m in zip(np.flatnonzero(wide).tolist(), *spans):
            shown[g] = ",".join(text_a[i:j]) + "|" + ",".join(text_b[k:m])
        first = len(self.shown)
        self.number.update(zip(names, range(first, first + len(names))))
        text, ends = ";".join(shown), np.cumsum(list(map(len, shown))) + np.arange(len(shown))
        stops = ends[until - 1].tolist()
        self.shown += [text[i:j] for i, j in zip([0, *(n + 1 for n in stops)], stops)]
        links = np.append(0, np.cumsum(size_a * size_b))[until]
        sums = np.stack([stop_a[until - 1], stop_b[until - 1], until, links])
        self.counts = _put(self.counts, first, np.diff(sums, axis=1, prepend=0))
        before = self.stops[first]
        self.stops = _put(self.stops, first + 1, before + stop_pairs[until - 1])
        self.keys, self.times = _put(self.keys, before, keys), _put(self.times, before, times)

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[str] = []
        self.counts, self.stops, self.keys, self.times = np.zeros((4, 0), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def documents(self, texts: list[str | None]) -> list[Alignment]:
        """The alignment of each whole text, with the digest of its groups, '' without tokens."""
        split = [self.units(t) if t and "▁" not in t else [] for t in texts]  # B takes that letter for a space: bytes differ
        self._learn(list(set().union(*split).difference(self.number)))
        seen = [list(map(self.number.get, units)) for units in split]
        seen = [[] if None in row else row for row in seen]
        unit, doc = np.fromiter(chain.from_iterable(seen), np.int64), np.repeat(np.arange(len(texts)), list(map(len, seen)))
        begin = np.searchsorted(doc, np.arange(len(texts) + 1))
        sums = np.concatenate((np.zeros((4, 1), np.int64), np.cumsum(self.counts[:, unit], axis=1)), axis=1)
        totals = (sums[:, begin[1:]] - sums[:, begin[:-1]]).T.tolist()
        width = self.stops[unit + 1] - self.stops[unit]
        pick = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width - self.stops[unit], width)
        keys, key = np.unique(self.keys[pick], return_inverse=True)
        both, back = np.unique(np.repeat(doc, width) * max(1, len(keys)) + key, return_inverse=True)
        times = np.bincount(back, self.times[pick], len(both)).astype(np.int64)
        doc, key = np.divmod(both, max(1, len(keys)))
        begin, key = np.searchsorted(doc, np.arange(len(texts) + 1)), keys[key]
        out = []
        for row, total, low, high in zip(seen, totals, begin.tolist(), begin[1:].tolist()):
            digest = hashlib.sha256(";".join(map(self.shown.__getitem__, row)).encode()).hexdigest() if row else ""
            out.append(Alignment(*total, digest, key[low:high], times[low:high]))
        if len(self.shown) > UNITS or self.stops[len(self.shown)] > PAIRS:
            self._forget()
        return out


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_FIELDS = [pa.field(n, pa.int64()) for n in COUNTS] + [pa.field("groups_sha256", pa.string()), pa.field("keys", pa.list_(pa.int64())), pa.field("times", pa.list_(pa.int64()))]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def aligned_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times) of each row of ``docs``, no shuffle.

    ``keys`` has the different linked id pairs as A id * 2**32 + B id, ``times`` the links of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(f"align {a_path} {b_path}", lambda: Aligner(a_path, b_path))
        for batch in batches:
            done = 0
            for part in in_parts(batch["text"], 128):
                found = aligner.documents(part)
                columns = [pa.array([u[i] for u in found], pa.int64()) for i in range(4)]
                columns += [pa.array([u.digest for u in found], pa.string()), _lists([u.keys for u in found]), _lists([u.times for u in found])]
                yield pa.record_batch([batch["doc_id"].slice(done, len(part)), *columns], schema=pa.schema([pa.field("doc_id", pa.int64()), *_FIELDS]))
                done += len(part)

    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, shape)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(key, n): in how many rows of ``aligned_documents`` each id pair is linked; combined before the shuffle."""
    return aligned.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _frequent_bound(counts: DataFrame, at_most: int) -> int:
    """The least power of two such that no more than ``at_most`` pairs have counts from there on."""
    sizes = {r["p"]: r["m"] for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("m")).collect()}  # 63 rows at most
    least, total = max(sizes, default=0) + 1, 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > at_most:
            break
        least = p
    return 1 << least


def align_tokens(docs: DataFrame, a_path: str, b_path: str, at_most: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``docs`` (doc_id, text).

    A encodes a space and the text, B the text, which gets a space from it. Where byte offsets end tokens of both,
    groups end; every A token of a group is linked to every B token of it. A pair's count is the number of rows that
    hold it linked; ``n_best`` are the links whose count is the highest of their A id, ``count_sum`` is over all links.
    Null and empty texts, and texts that the tokens don't give back byte by byte, have zeros and ''. Each row counts,
    also where ids or whole rows repeat or ids are null. Other columns are ignored; an empty table gives no rows.

    The ``at_most`` most frequent pairs are broadcast with their counts; they hold nearly all links and all hot keys.
    The other pairs are joined with theirs by a shuffle.
    """
    spark, path = docs.sparkSession, work_dir(docs.sparkSession)
    place = unused(docs.select("doc_id"), "place")
    rows = written(aligned_documents(docs, a_path, b_path).withColumn(place, F.monotonically_increasing_id()), f"{path}/rows")
    counts = written(pair_counts(rows), f"{path}/counts")
    best = counts.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("n")).toArrow()  # A's vocabulary at most
    highest = np.zeros(max([0, *best["a"].to_pylist()]) + 1, np.int64)
    highest[best["a"].to_numpy()] = best["n"].to_numpy()
    least = _frequent_bound(counts, at_most)
    often = counts.where(F.col("n") >= least).toArrow()  # at_most rows
    order = np.argsort(often["key"].to_numpy())
    shared = spark.sparkContext.broadcast((often["key"].to_numpy()[order], often["n"].to_numpy()[order], highest))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, number, top = shared.value
        for batch in batches:
            keys, times = (batch[c].flatten().to_numpy() for c in ("keys", "times"))
            row = np.repeat(np.arange(batch.num_rows), batch["keys"].value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(frequent, keys), max(0, len(frequent) - 1))
            there = frequent[at] == keys if len(frequent) else np.zeros(len(keys), bool)
            n = number[at[there]]
            begin = np.searchsorted(row[there], np.arange(batch.num_rows + 1))
            sums = (np.append(0, np.cumsum(x))[begin] for x in (times[there] * n, times[there] * (n == top[keys[there] >> 32])))
            total, right = (np.diff(x) for x in sums)
            left = np.bincount(row[~there], minlength=batch.num_rows)
            offsets = pa.array(np.append(0, np.cumsum(left)).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (keys[~there], times[~there], top[keys[~there] >> 32])]
            yield pa.record_batch([*(batch[c] for c in kept), pa.array(right), pa.array(total), *rest], names=[*kept, "n_best", "count_sum", "keys", "times", "tops"])

    kept = ["doc_id", *COUNTS, "groups_sha256", place]
    shape = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {place} long, n_best long, count_sum long, keys array<long>, times array<long>, tops array<long>"
    done = written(rows.mapInArrow(known, shape), f"{path}/known")
    rest = done.select(place, F.explode(F.arrays_zip("keys", "times", "tops")).alias("x")).select(place, "x.*").withColumnRenamed("keys", "key")
    rest = rest.join(counts.where(F.col("n") < least), "key")
    rest = rest.groupBy(place).agg(F.sum(F.when(F.col("n") == F.col("tops"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    both = done.drop("keys", "times", "tops").join(rest, place, "left")
    more = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}
    return both.withColumns(more).select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")
