"""Ranked lexical search of many items over all documents by dual trees: maxima of node pairs bound whole batches of scores."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import unused, work_dir, written

#: Terms in UTF-8: ASCII letters and digits and all that isn't ASCII.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Terms of the items that one pass over the documents looks for; with more terms there are more passes.
TERMS = 1 << 16
#: Documents of a shard (one tree) and of a leaf, children of a document node, items of a leaf of the other tree.
SHARD, LEAF, FAN, ITEMS = 8192, 32, 8, 4
#: One of so many documents is searched first, for thresholds that the others have to reach.
SEED = 16
#: Stands for a null doc_id, behind all others.
NO_ID = (1 << 63) - 1


@dataclass
class Items:
    """A tree over items: ``order`` has their ids, leaf by leaf; a node is (first, end, terms, children)."""

    order: list
    terms: list[np.ndarray]
    root: tuple

    @classmethod
    def grown(cls, items: dict[object, np.ndarray]) -> Items:
        """Splits items by the term that most nearly half of them have, down to ITEMS or until no term tells them apart."""
        order: list = []

        def node(ids: list) -> tuple:
            every = np.concatenate([items[i] for i in ids])
            terms, often = np.unique(every, return_counts=True)
            telling = np.flatnonzero(often < len(ids))
            if len(ids) <= ITEMS or not len(telling):
                first = len(order)
                order.extend(ids)
                return first, len(order), terms, ()
            by = terms[telling[np.argmin(np.abs(2 * often[telling] - len(ids)))]]
            there = [by in set(items[i].tolist()) for i in ids]
            pair = (node([i for i, x in zip(ids, there) if x == side]) for side in (True, False))
            left, right = pair
            return left[0], right[1], terms, (left, right)

        root = node(sorted(items, key=lambda i: (i is None, i)))
        return cls(order, [items[i] for i in order], root)


def spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    width = end - begin
    return np.arange(width.sum()) + np.repeat(begin - np.cumsum(width) + width, width)


class Level:
    """Nodes of one level of a document tree: per term the nodes that have it, with the greatest value below each."""

    def __init__(self, node: np.ndarray, term: np.ndarray, value: np.ndarray, terms: int, count: int):
        key = term.astype(np.int64) * count + node
        order = np.argsort(key, kind="stable")
        names, first = np.unique(key[order], return_index=True)
        self.count, self.value = count, np.maximum.reduceat(value[order], first) if len(first) else value
        self.term, self.node = np.divmod(names, count)
        self.begin = np.searchsorted(self.term, np.arange(terms + 1))

    def bounds(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of each node an upper bound for all pairs of an item with no more than these terms and a document below it."""
        low, high = self.begin[terms], self.begin[terms + 1]
        at = spans(low, high)
        # whole numbers below 2**53, so sums are exact
        return np.bincount(self.node[at], np.repeat(weight[terms], high - low) * self.value[at], self.count)


class Shard:
    """A tree over some documents and its search.

    ``ids``, ``begin``, ``term`` and ``value`` are the documents' ids and their terms with values, document by document.
    Documents that share their two weightiest terms are put side by side; LEAF of them make a leaf, FAN nodes a parent.
    """

    def __init__(self, ids: np.ndarray, begin: np.ndarray, term: np.ndarray, value: np.ndarray, weight: np.ndarray):
        row = np.repeat(np.arange(len(ids)), np.diff(begin))
        order = np.lexsort((term, -weight[term] * value, row))
        width = np.diff(begin)
        top = [np.where(width > k, term[order[np.minimum(begin[:-1] + k, len(order) - 1)]], -1) for k in (0, 1)]
        place = np.lexsort((ids, top[1], top[0]))
        pick = spans(begin[:-1][place], begin[1:][place])
        self.ids, self.term, self.value, self.weight = ids[place], term[pick], value[pick].astype(np.float64), weight
        self.begin = np.append(0, np.cumsum(width[place]))
        node = np.repeat(np.arange(len(ids)) // LEAF, width[place])
        self.levels = [Level(node, self.term, self.value, len(weight), -(-len(ids) // LEAF))]
        while (last := self.levels[-1]).count > 1:
            self.levels.append(Level(last.node // FAN, last.term, last.value, len(weight), -(-last.count // FAN)))

    def search(self, items: Items, k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each item's k best (ids, scores) that reach its ``least``; ties to the smaller id."""
        self.k, self.least = k, least.copy()
        none = (np.zeros(0, np.int64), np.zeros(0))
        self.found = [none] * len(items.order)
        self._visit(items, items.root, len(self.levels) - 1, np.arange(self.levels[-1].count))
        return self.found

    def _visit(self, items: Items, node: tuple, depth: int, docs: np.ndarray) -> None:
        """Looks below a node of the items and some of the documents of a level, where a bound reaches the weakest item's least."""
        first, end, terms, children = node
        bounds = self.levels[depth].bounds(terms, self.weight)[docs]
        docs = docs[bounds >= self.least[first:end].min()]
        if not len(docs):
            return
        if depth:
            below = spans(docs * FAN, np.minimum((docs + 1) * FAN, self.levels[depth - 1].count))
            for child in children or (node,):
                self._visit(items, child, depth - 1, below)
        elif children:
            for child in children:
                self._visit(items, child, 0, docs)
        else:
            for item in range(first, end):
                self._score(items, item, docs)

    def _score(self, items: Items, item: int, leaves: np.ndarray) -> None:
        """Scores documents of leaves, best bound first, until the bounds fall below the item's least."""
        terms = items.terms[item]
        bounds = self.levels[0].bounds(terms, self.weight)[leaves]
        order = np.argsort(-bounds, kind="stable")
        leaves, bounds = leaves[order], bounds[order]
        dense = np.zeros(len(self.weight))
        dense[terms] = self.weight[terms]
        at, step = 0, 4
        while at < len(leaves) and bounds[at] >= self.least[item]:
            some = np.sort(leaves[at : at + step])
            at, step = at + step, min(2 * step, 64)
            docs = spans(some * LEAF, np.minimum((some + 1) * LEAF, len(self.ids)))
            low, high = self.begin[docs], self.begin[docs + 1]
            pick = spans(low, high)
            score = np.bincount(np.repeat(np.arange(len(docs)), high - low), dense[self.term[pick]] * self.value[pick], len(docs))
            good = score >= self.least[item]
            if not good.any():
                continue
            ids, score = np.append(self.found[item][0], self.ids[docs[good]]), np.append(self.found[item][1], score[good])
            best = np.lexsort((ids, -score))[: self.k]
            self.found[item] = (ids[best], score[best])
            if len(best) == self.k:
                self.least[item] = max(self.least[item], score[best[-1]])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the different terms of each item over all its rows, terms in UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(set(TERM.findall(t.lower()))) if t else [] for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch["item_id"], pa.array(lists, pa.list_(pa.binary()))], names=["item_id", "terms"])

    kind = dict(items.dtypes)["item_id"]
    found = items.select("item_id", F.col("text").cast("string")).mapInArrow(run, f"item_id {kind}, terms array<binary>")
    return found.select("item_id", F.explode("terms").alias("term")).distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times) of each document that has a term: how many it has, and those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # TERMS, or one item's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, n, terms, times = [], [], [], []
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                    words = TERM.findall(text.lower()) if text else []  # bytes: only A-Z are lowered
                    if not words:
                        continue
                    often = Counter(words)
                    own = sorted((known[t], often[t]) for t in often.keys() & known.keys())
                    ids.append(doc)
                    n.append(len(words))
                    terms.append([t for t, _ in own])
                    times.append([x for _, x in own])
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def _flat(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """Where each row's list begins, and the values of the lists."""
    begin = np.append(0, np.cumsum(batch[names[0]].value_lengths().to_numpy()))
    return begin, *(batch[c].flatten().to_numpy() for c in names)


def valued(rows: DataFrame, documents: int, tokens: int, weight: np.ndarray) -> DataFrame:
    """(doc_id, terms, parts, lead): each term's part of a score without the weight, and the weightiest term."""
    shared = rows.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            begin, term, times = _flat(batch, "terms", "times")
            n, width = batch["n"].to_numpy(), np.diff(begin)
            if len(n) and max(50 * int(n.max()) * documents, 10**9 * int(times.max(initial=0))) >= 1 << 63:
                raise OverflowError("a document is too long for 64-bit scores")
            m = 50 + (50 * n * documents) // tokens
            part = (1_000_000_000 * times) // (1000 * times + 20 * np.repeat(m, width))
            row = np.repeat(np.arange(len(n)), width)
            first = np.lexsort((term, -weights[term] * part, row))[begin[:-1][width > 0]]
            lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(part.astype(np.int32)))
            some = batch.filter(pa.array(width > 0))
            yield pa.record_batch([some["doc_id"], some["terms"], lists.filter(pa.array(width > 0)), pa.array(term[first], pa.int32())], names=["doc_id", "terms", "parts", "lead"])

    return rows.mapInArrow(run, "doc_id long, terms array<int>, parts array<int>, lead int")


def searched(rows: DataFrame, items: Items, weight: np.ndarray, k: int, least: np.ndarray) -> DataFrame:
    """(item, doc_id, score): each item's k best of every shard of ``rows`` that reach its ``least``."""
    shared = rows.sparkSession.sparkContext.broadcast((items, weight, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, weights, lowest = shared.value

        def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            begin, term, value = _flat(whole, "terms", "parts")
            found = Shard(whole["doc_id"].fill_null(NO_ID).to_numpy(), begin, term, value, weights).search(tree, k, lowest)
            item = np.repeat(np.arange(len(found), dtype=np.int32), [len(x[0]) for x in found])
            ids, scores = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]).astype(np.int64)
            return pa.record_batch([pa.array(item), pa.array(ids), pa.array(scores)], names=["item", "doc_id", "score"])

        parts, size = [], 0
        for batch in batches:
            while size + batch.num_rows >= SHARD:
                yield shard([*parts, batch.slice(0, SHARD - size)])
                parts, batch, size = [], batch.slice(SHARD - size), 0
            if batch.num_rows:
                parts.append(batch)
                size += batch.num_rows
        if parts:
            yield shard(parts)

    return rows.select("doc_id", "terms", "parts").mapInArrow(run, "item int, doc_id long, score long")


def rank_documents(items: DataFrame, docs: DataFrame, k: int = 50, terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, best first, ties to the smaller doc_id.

    ``items`` has item_id and text, ``docs`` doc_id and text. A score sums, over the item's different terms, the term's
    weight times a part that grows with its occurrences and falls with the document's length; N, L and df are counted
    over all documents. Items whose rows share an id are one item; a null item_id is an item of its own. Every row of
    ``docs`` is a document, also with a repeated or null doc_id (null comes last among equal scores). Null texts have no
    terms; items without terms or matches have no rows. Other columns are ignored; empty tables give no rows.

    Items are taken in groups of about ``terms`` terms, each with a pass over the documents, so that what is broadcast
    has a bound. Documents are dealt by their weightiest term, so a shard's documents are alike. Each task grows a tree
    over its shard's documents and searches it together with the tree over the items; the thresholds that it begins with
    are the k-th best scores among one SEED-th of the documents.
    """
    spark, path = docs.sparkSession, work_dir(docs.sparkSession)
    kind = dict(items.dtypes)["item_id"]
    wanted = written(item_terms(items), f"{path}/wanted")
    groups = -(-wanted.count() // terms)
    out = None
    for g in range(groups):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toArrow().to_pydict()  # about ``terms`` rows
        if not own["term"]:
            continue
        number = {t: i for i, t in enumerate(sorted(set(own["term"])))}
        lists: dict[object, list[int]] = {}
        for item, term in zip(own["item_id"], own["term"]):
            lists.setdefault(item, []).append(number[term])
        tree = Items.grown({i: np.array(sorted(x)) for i, x in lists.items()})
        rows = written(postings(docs, number), f"{path}/{g}/postings")
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        df = np.zeros(len(number), np.int64)
        counted = rows.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # a row for each term
        df[counted["t"].to_numpy()] = counted["count"].to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        parts = valued(rows, total["n"], total["l"] or 1, weight)
        place = unused(parts, "place")
        parts = parts.withColumn(place, F.xxhash64(F.monotonically_increasing_id()))
        shards = max(spark.sparkContext.defaultParallelism, -(-total["n"] // SHARD))
        parts = written(parts.repartitionByRange(shards, "lead", place), f"{path}/{g}/parts")
        least = np.ones(len(tree.order))
        seed = written(searched(parts.where(F.pmod(place, F.lit(SEED)) == 0), tree, weight, k, least), f"{path}/{g}/seed")
        nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
        reached = seed.withColumn("nth", nth).where(F.col("nth") == k).select("item", "score").toArrow()  # a row for each item
        least[reached["item"].to_numpy()] = reached["score"].to_numpy()
        found = seed.unionByName(searched(parts.where(F.pmod(place, F.lit(SEED)) != 0), tree, weight, k, least))
        names = spark.createDataFrame([(i, x) for i, x in enumerate(tree.order)], f"item int, item_id {kind}")  # a row for each item
        best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
