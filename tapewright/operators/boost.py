"""Boosted trees of second order as Spark jobs: gradients are summed per node, column and bin, one aggregation for each level."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import Trees
from ..sources.work import drop, kept_at

#: Trees after which rows are written again with the margins so far; those since then are walked in each job.
MERGE = 24
LOSS, WEIGHT = -1, -2


@dataclass(frozen=True)
class Boosting:
    """How trees are grown: shrinkage ``step``, least hessian of a child, least ``gamma`` gain of a split, shares of rows
    and columns of a tree, L1 and L2 on leaf values, ``most`` a leaf's value before shrinking (0: no limit), bins of a
    column, rounds without a better loss on held-out rows after which growing stops (0: never)."""

    rounds: int = 100
    step: float = 0.1
    depth: int = 3
    child: float = 8.0
    gamma: float = 0.5
    rows: float = 0.8
    columns: float = 0.8
    l1: float = 0.5
    l2: float = 2.0
    most: float = 1.0
    bins: int = 64
    patience: int = 0
    seed: int = 100


def uniform(place: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each row's place and tree, the same wherever and whenever it is drawn."""
    with np.errstate(over="ignore"):
        z = place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(tree + 1) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def drawn_columns(count: int, tree: int, options: Boosting) -> np.ndarray:
    """The columns that a tree may split by."""
    n = max(1, int(options.columns * count))
    return np.sort(np.random.default_rng([options.seed, tree]).choice(count, n, replace=False))


def leaf_value(g: np.ndarray, h: np.ndarray, options: Boosting) -> np.ndarray:
    """The value that makes g * v + (h + l2) * v**2 / 2 + l1 * |v| least, within ``most``."""
    v = -np.sign(g) * np.maximum(np.abs(g) - options.l1, 0) / (h + options.l2)
    return np.clip(v, -options.most, options.most) if options.most > 0 else v


def gain(g: np.ndarray, h: np.ndarray, options: Boosting) -> np.ndarray:
    """Twice what the objective falls by at the best value of a leaf."""
    v = leaf_value(g, h, options)
    return -(2 * g * v + (h + options.l2) * v * v + 2 * options.l1 * np.abs(v))


@dataclass
class Tree:
    """A full binary tree in bins: inner nodes by level, then the leaves. Nodes that aren't split send all rows left."""

    depth: int
    column: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    missing_left: np.ndarray = field(init=False)
    leaf: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        inner = (1 << self.depth) - 1
        self.column, self.bin, self.missing_left = np.full(inner, -1), np.zeros(inner, np.int64), np.ones(inner, bool)
        self.leaf = np.zeros(inner + 1)

    def nodes(self, bins: np.ndarray, level: int) -> np.ndarray:
        """Where each row is at a level, from 0; bin 0 holds missing values."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(level):
            c = self.column[at]
            b = np.where(c < 0, 0, bins[np.arange(len(bins)), np.maximum(c, 0)])
            left = np.where(b == 0, self.missing_left[at] | (c < 0), b <= self.bin[at])
            at = 2 * at + np.where(left, 1, 2)
        return at - ((1 << level) - 1)

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.leaf[self.nodes(bins, self.depth)]


def split_level(tree: Tree, level: int, sums: np.ndarray, chosen: np.ndarray, options: Boosting) -> bool:
    """Splits the nodes of a level by their sums (node, column, bin, gradient and hessian); whether any was split.

    A node's leaf value is set for all leaves below its left edge, which is where its rows go until it's split. A split
    needs more than ``gamma`` gain and ``child`` hessian on both sides; ties go to the lower column, then bin, then to
    missing values on the right.
    """
    first, any_split = (1 << level) - 1, False
    span = 1 << (tree.depth - level)
    for n in range(1 << level):
        g, h = sums[n, chosen, :, 0], sums[n, chosen, :, 1]
        total_g, total_h = g[0].sum(), h[0].sum()
        if total_h <= 0:
            continue
        left_g, left_h = np.cumsum(g[:, 1:-1], axis=1), np.cumsum(h[:, 1:-1], axis=1)
        sides_g, sides_h = (np.stack([x, x + y[:, :1]], axis=2) for x, y in ((left_g, g), (left_h, h)))
        won = gain(sides_g, sides_h, options) + gain(total_g - sides_g, total_h - sides_h, options) - gain(total_g, total_h, options)
        fits = (sides_h >= options.child) & (total_h - sides_h >= options.child)
        won = np.where(fits, won, -np.inf)
        c, b, side = np.unravel_index(int(np.argmax(won)), won.shape) if won.size else (0, 0, 0)
        if not won.size or not won[c, b, side] > options.gamma:
            tree.leaf[n * span] = options.step * leaf_value(total_g, total_h, options)
            continue
        tree.column[first + n], tree.bin[first + n], tree.missing_left[first + n], any_split = chosen[c], b + 1, bool(side), True
        low = (sides_g[c, b, side], sides_h[c, b, side])
        for child, (x, y) in enumerate((low, (total_g - low[0], total_h - low[1]))):
            tree.leaf[n * span + child * (span >> 1)] = options.step * leaf_value(x, y, options)
    return any_split


def bin_edges(df: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """Upper edges of each column's bins but the last, from a sketch of its values that aren't missing."""
    shares = F.array(*[F.lit(i / (bins - 1)) for i in range(1, bins - 1)])
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(known(c), shares, 100 * bins).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return [sorted(set(x or [])) for x in row]


def binned(df: DataFrame, columns: list[str], edges: list[list[float]], target: str, weight: str) -> DataFrame:
    """(place, bins, y, w, held, margin): a row's bin in each column, 0 where the value is missing. ``df`` has _held."""
    cuts = [np.array(e) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(cuts)), np.int32)
            for i, cut in enumerate(cuts):
                x = batch[f"_{i}"].to_numpy(zero_copy_only=False).astype(float)
                out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(cut, x, side="left") + 1)
            lists = pa.FixedSizeListArray.from_arrays(out.ravel(), len(cuts)).cast(pa.list_(pa.int32()))
            yield pa.record_batch([batch["place"], lists, batch["y"], batch["w"], batch["held"], pa.array(np.zeros(batch.num_rows))], names=["place", "bins", "y", "w", "held", "margin"])

    rows = df.select(F.monotonically_increasing_id().alias("place"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)], F.col(target).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), F.col("_held").alias("held"))
    return rows.mapInArrow(run, "place long, bins array<int>, y double, w double, held boolean, margin double")


def _level_sums(rows: DataFrame, trees: list[Tree], tree: Tree, level: int, number: int, size: int, columns: int, options: Boosting) -> tuple[np.ndarray, float]:
    """(sums by node, column and bin; the loss of the trees so far on held-out rows), summed by key over all tasks."""
    cells = (1 << level) * columns * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, loss = np.zeros((cells, 2)), np.zeros(2)
        for batch in batches:
            bins = batch["bins"].flatten().to_numpy().reshape(-1, columns)
            y, w, held, margin = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "w", "held", "margin"))
            margin = margin + sum((t.values(bins) for t in trees), np.zeros(len(bins)))
            if level == 0 and held.any():
                loss += ((w * np.logaddexp(0, np.where(y > 0, -margin, margin)))[held].sum(), w[held].sum())
            use = ~held & (uniform(batch["place"].to_numpy(), number, options.seed) < options.rows)
            bins, y, w, margin = bins[use], y[use], w[use], margin[use]
            p = 1 / (1 + np.exp(-margin))
            key = (tree.nodes(bins, level)[:, None] * columns + np.arange(columns)) * size + bins
            for i, value in enumerate((w * (p - y), w * p * (1 - p))):
                sums[:, i] += np.bincount(key.ravel(), np.repeat(value, columns), cells)
        key = np.flatnonzero(sums.any(axis=1))
        parts = [np.append(key, [LOSS, WEIGHT]), np.append(sums[key, 0], loss), np.append(sums[key, 1], [0, 0])]
        yield pa.record_batch([pa.array(x) for x in parts], names=["key", "g", "h"])

    found = rows.mapInArrow(run, "key long, g double, h double").groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()  # cells + 2 rows
    key, both = found["key"].to_numpy(), np.stack([found["g"].to_numpy(), found["h"].to_numpy()], axis=1)
    sums = np.zeros((cells, 2))
    sums[key[key >= 0]] = both[key >= 0]
    total, weight = (float(both[key == k, 0].sum()) for k in (LOSS, WEIGHT))
    return sums.reshape(1 << level, columns, size, 2), total / weight if weight else float("nan")


def _with_margins(rows: DataFrame, trees: list[Tree], columns: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = batch["bins"].flatten().to_numpy().reshape(-1, columns)
            margin = batch["margin"].to_numpy() + sum((t.values(bins) for t in trees), np.zeros(len(bins)))
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

    return rows.mapInArrow(run, rows.schema)


def fit_boosted(train: DataFrame, columns: list[str], target: str, weight: str, options: Boosting, held: DataFrame | None = None) -> Trees:
    """Trees whose sum of leaf values is the log odds of ``target`` being 1, grown on ``train``.

    Both tables have ``columns``, ``target`` (0 or 1) and ``weight``. Values are put into bins once; null and NaN are a
    bin of their own, which each split sends to its better side. A level of a tree is one job: every task sums gradients
    and hessians of its rows by node, column and bin, the sums are added by key, and only they reach the driver, whatever
    the rows. ``held`` rows are scored along in the same jobs; with ``patience`` growing stops once so many trees
    haven't lowered their log loss, and the trees up to the best one are returned, with no second fit. Growing also stops
    when a tree finds no split. An empty ``train`` gives no trees.
    """
    rows = train.select(*columns, target, weight, F.lit(False).alias("_held"))
    edges = bin_edges(rows, columns, options.bins)
    if held is not None:
        rows = rows.unionByName(held.select(*columns, target, weight, F.lit(True).alias("_held")))
    size = max(map(len, edges)) + 3  # missing, all bins, and one beyond: a split there parts missing values from all others
    rows, path = kept_at(binned(rows, columns, edges, target, weight))
    trees: list[Tree] = []
    merged, best, best_loss, stopped = 0, 0, float("inf"), False
    for number in range(options.rounds):
        tree, chosen = Tree(options.depth), drawn_columns(len(columns), number, options)
        sums, loss = _level_sums(rows, trees[merged:], tree, 0, number, size, len(columns), options)
        if held is not None and options.patience and loss == loss:
            if loss < best_loss:
                best, best_loss = len(trees), loss
            elif len(trees) - best >= options.patience:
                stopped = True
                break
        grown = split_level(tree, 0, sums, chosen, options)
        for level in range(1, options.depth):
            if not (tree.column[(1 << (level - 1)) - 1 : (1 << level) - 1] >= 0).any():
                break
            sums, _ = _level_sums(rows, trees[merged:], tree, level, number, size, len(columns), options)
            split_level(tree, level, sums, chosen, options)
        if not grown:
            break
        trees.append(tree)
        if len(trees) - merged >= MERGE:
            before = path
            rows, path = kept_at(_with_margins(rows, trees[merged:], len(columns)))
            merged = len(trees)
            drop(train.sparkSession, before)
    if held is not None and options.patience and not stopped and len(trees) > best:
        _, loss = _level_sums(rows, trees[merged:], Tree(options.depth), 0, options.rounds, size, len(columns), options)
        best = len(trees) if loss < best_loss else best
    drop(train.sparkSession, path)
    kept = trees[:best] if held is not None and options.patience and best_loss < float("inf") else trees
    return Trees(tuple(columns), options.depth, tuple(_unbinned(t, edges) for t in kept), "log_odds")


def _unbinned(tree: Tree, edges: list[list[float]]) -> dict:
    """The tree with values for bins."""
    top = sys.float_info.max  # of the last bin: all but missing values
    limit = [0.0 if c < 0 else float(edges[c][b - 1]) if b <= len(edges[c]) else top for c, b in zip(tree.column.tolist(), tree.bin.tolist())]
    return {"f": tree.column.tolist(), "t": limit, "m": tree.missing_left.tolist(), "v": tree.leaf.tolist()}
