"""Exact top-k search by inner product over a pivot-distance index: annuli around pivots, skipped by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import work_dir, written

#: Vectors that pivots are chosen from, pivots at most, and steps of their improvement (the index fits on no more).
SAMPLE, PIVOTS, STEPS, SEED = 4096, 512, 4, 11
#: Rings of equal width that a pivot's distances are counted in, and rows that an annulus has at least before it ends.
RINGS, ANNULUS = 4096, 1024
#: Annuli in all, at most about; they grow with the rows beyond that. Their bounds are broadcast.
ANNULI = 1 << 16
#: Bytes of vectors that one task holds together, and queries that it answers together.
CELL_BYTES, QUERIES = 32 << 20, 4096
#: Annuli of each query that are searched first and second; the third round takes all that bounds leave.
FIRST, SECOND = 1, 8


def finite(embedding: Column) -> Column:
    """Not null, without null or non-finite components."""
    return embedding.isNotNull() & ~F.coalesce(F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Pivots:
    """Pivots on the sphere that vectors are lifted to: one more coordinate makes all of them as long as the longest.

    There the vector of the greatest inner product with a query is the nearest one to it: with the query's last
    coordinate 0, distance squared is query squared plus radius squared less twice the product.
    """

    def __init__(self, sample: np.ndarray, square: float, count: int):
        self.square = square
        points = self.lifted(sample)
        rng = np.random.default_rng(SEED)
        self.points = points[rng.choice(len(points), min(count, len(points)), replace=False)]
        for _ in range(STEPS):
            near = self.distances(points).argmin(axis=1)
            sums, n = np.zeros_like(self.points), np.bincount(near, minlength=len(self.points))
            np.add.at(sums, near, points)
            self.points = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.points)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.square - (vectors**2).sum(axis=1), 0))
        return np.concatenate((vectors, last[:, None]), axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        squares = (points**2).sum(axis=1)[:, None] + (self.points**2).sum(axis=1)[None] - 2 * points @ self.points.T
        return np.sqrt(np.maximum(squares, 0))

    def bounds(self, queries: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(queries, annuli): no vector of an annulus has a greater inner product with the query.

        By the triangle inequality a vector between ``low`` and ``high`` from its pivot is at least as far from the
        query as the query is from that ring. A margin stands for rounding.
        """
        points = np.concatenate((queries, np.zeros((len(queries), 1))), axis=1)
        squares = (queries**2).sum(axis=1)[:, None]
        far = self.distances(points)[:, pivot]
        gap = np.maximum(np.maximum(far - high, low - far) - 1e-6 * (1 + np.sqrt(squares + self.square)), 0)
        return (squares + self.square - gap**2) / 2 + 1e-9 * (squares + self.square) + 1e-3


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best ids, each id once with its best score; ties to the smaller id."""
    order = np.lexsort((-scores, ids, query))
    once = np.ones(len(order), bool)
    once[1:] = (query[order][1:] != query[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[once]
    order = order[np.lexsort((ids[order], -scores[order], query[order]))]
    first = np.searchsorted(query[order], query[order], side="left")
    return order[np.arange(len(order)) - first < k]


class Cell:
    """Some annuli, searched ring by ring: each query takes its annuli by falling bound until that is below its k-th best."""

    def __init__(self, ids: np.ndarray, annulus: np.ndarray, vectors: np.ndarray, whole: bool):
        order = np.lexsort((ids, annulus))
        self.ids, self.vectors = ids[order], vectors[order]
        self.names, begin = np.unique(annulus[order], return_index=True)
        self.spans = dict(zip(self.names.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(ids)])))
        self.kind = np.float64 if whole else np.int64  # doubles hold all scores exactly, else 64-bit integers do

    def search(self, own: np.ndarray, queries: np.ndarray, least: np.ndarray, lists: list[np.ndarray], bounds: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of the k best of each query that reach its ``least``; ``own`` ids are left out."""
        queries, least = queries.astype(self.kind), least.copy()
        place, found, scores = (np.zeros(0, t) for t in (np.int64, np.int64, self.kind))
        for turn in range(max(map(len, lists), default=0)):
            by: dict[int, list[int]] = {}
            for q, (names, most) in enumerate(zip(lists, bounds)):
                if turn < len(names) and most[turn] >= least[q]:
                    by.setdefault(int(names[turn]), []).append(q)
            for name, asking in by.items():
                low, high = self.spans.get(name, (0, 0))
                if low == high:
                    continue
                asked = np.array(asking)
                ids, product = self.ids[low:high], queries[asked] @ self.vectors[low:high].astype(self.kind).T
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                if len(first) < len(ids):  # an id with several vectors counts with its best
                    ids, product = ids[first], np.maximum.reduceat(product, first, axis=1)
                floor = least[asked]
                if len(ids) > k + 1:
                    floor = np.maximum(floor, np.partition(product, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1])  # the own id may be among them
                row, column = np.nonzero((product >= floor[:, None]) & (ids[None] != own[asked][:, None]))
                place, found, scores = np.append(place, asked[row]), np.append(found, ids[column]), np.append(scores, product[row, column])
            pick = best_of(place, found, scores, k)
            place, found, scores = place[pick], found[pick], scores[pick]
            ends = np.flatnonzero(np.append(place[1:] != place[:-1], True)) if len(place) else np.zeros(0, np.int64)
            full = ends[np.diff(ends, prepend=-1) == k]
            least[place[full]] = np.maximum(least[place[full]], scores[full])
        return place, found, scores.astype(np.int64)


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row with all other rows.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. A component x counts as
    floor(scale * x). Ties go to the smaller vec_id; with fewer candidates than k all are returned. Vectors that are
    null or have null or non-finite components take no part, nor do rows without vec_id and vectors of another length
    than most have. A row that repeats an id and a vector counts once. Where an id has several vectors, a pair of ids
    has the highest score of theirs; an id is never its own candidate. Vectors too large for 64-bit scores are an
    error. Other columns are ignored; an empty table gives no rows.

    The index keys each vector by its nearest pivot and its distance from it; a pivot's rows are cut into annuli of
    about equal numbers of rows, from counts per ring. Of equal vectors the k + 1 smallest ids are kept, enough for any
    answer. Each query is sent to its nearest annulus, then to the next ones, then to all that the triangle inequality
    can't exclude by the k-th best score so far, once for each cell of annuli that lie together.
    """
    spark, path = vectors.sparkSession, work_dir(vectors.sparkSession)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"), F.array_max(F.transform("embedding", lambda x: F.abs(x * F.lit(scale)))).alias("most"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    common = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max("most").alias("most"), F.max(square).alias("square")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return empty
    dim, most = common["dim"], common["most"] + 1
    if dim * most * most >= 2.0**63:
        raise OverflowError("vectors are too large for 64-bit scores")
    whole = dim * most * most < 2.0**53
    kind, arrow_kind = ("int", pa.int32()) if most < 1 << 31 else ("long", pa.int64())
    rows = rows.where(F.size("v") == dim).select("vec_id", F.col("v").cast(f"array<{kind}>").alias("v"))
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")).dropDuplicates(["vec_id", "h1", "h2"])
    rows = written(rows, f"{path}/rows")
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    kept = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("vec_id", "v")
    sample = rows.orderBy("h1", "h2", "vec_id").limit(SAMPLE).select("v").collect()
    pivots = Pivots(np.array([r["v"] for r in sample], float).reshape(-1, dim), common["square"], max(1, min(PIVOTS, int(common["n"] ** 0.5))))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                far = pivots.distances(pivots.lifted(_matrix(part["v"], dim)))
                near = far.argmin(axis=1)
                yield pa.record_batch([*part.columns, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])], names=["vec_id", "v", "pivot", "far"])

    index = written(kept.mapInArrow(keyed, f"vec_id long, v array<{kind}>, pivot int, far double"), f"{path}/index")
    # annuli: rings in order, cut where the rows so far pass another multiple of the size; a ring isn't cut, see blocks
    widest = 2 * float(common["square"]) ** 0.5 / RINGS + 1e-9
    ring = F.floor(F.col("far") / widest).cast("int")
    counts = index.groupBy("pivot", ring.alias("ring")).agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))  # pivots * rings at most
    counts = written(counts, f"{path}/rings")
    total = counts.agg(F.sum("n")).first()[0]
    size = max(ANNULUS, -(-total // ANNULI))
    before = F.sum("n").over(Window.partitionBy("pivot").orderBy("ring")) - F.col("n")
    rings = counts.withColumn("part", F.floor(before / size).cast("int"))
    annuli = rings.groupBy("pivot", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("pivot", "part").toArrow()
    pivot, part, low, high, n = (annuli[c].to_numpy() for c in annuli.column_names)
    per_cell = max(size, CELL_BYTES // (8 * dim), 1)
    per_cell = max(size, min(per_cell, -(-total // spark.sparkContext.defaultParallelism)))
    cell, load = np.zeros(len(n), np.int32), 0
    for i, rows_there in enumerate(n.tolist()):  # ANNULI + PIVOTS numbers
        load += rows_there
        cell[i] = (cell[i - 1] if i else 0) + (i > 0 and load > per_cell)
        load = rows_there if i and cell[i] > cell[i - 1] else load
    blocks = -(-np.bincount(cell, n).astype(np.int64) // (4 * per_cell))  # of a ring with very many rows
    named = spark.createDataFrame(pa.table([pivot, part, np.arange(len(n), dtype=np.int32), cell, blocks[cell]], names=["pivot", "part", "annulus", "cell", "blocks"]))
    placed = index.withColumn("ring", ring).join(rings.select("pivot", "ring", "part"), ["pivot", "ring"]).join(F.broadcast(named), ["pivot", "part"])
    placed = placed.select("vec_id", "v", "annulus", "cell", F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int").alias("block"))
    placed = written(placed, f"{path}/annuli")
    asked = written(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v"), f"{path}/queries")
    parts = -(-asked.count() // QUERIES)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id", "v"), F.lit(max(1, parts))).cast("int"))
    if not parts:
        return empty
    shared = spark.sparkContext.broadcast((pivots, pivot, low, high, cell, blocks))

    def plan(first: int, end: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, pivot, low, high, cell, blocks = shared.value
            for whole_batch in batches:
                for i in range(0, whole_batch.num_rows, max(1, (1 << 21) // len(cell))):
                    batch = whole_batch.slice(i, max(1, (1 << 21) // len(cell)))
                    most = index.bounds(_matrix(batch["v"], dim), pivot, low, high)
                    order = np.argsort(-most, axis=1, kind="stable")[:, first:end]
                    sorted_most = np.take_along_axis(most, order, axis=1)
                    ids, least, share, out = *(batch[c].to_pylist() for c in ("query_id", "least", "part")), []
                    for q, v in enumerate(batch["v"].to_pylist()):
                        names, bound = order[q][sorted_most[q] >= least[q]], sorted_most[q][sorted_most[q] >= least[q]]
                        for c in np.unique(cell[names]).tolist():
                            there = cell[names] == c
                            for b in range(int(blocks[c])):
                                out.append((c, b, share[q], ids[q], v, least[q], names[there].tolist(), bound[there].tolist()))
                    columns = zip(*out) if out else [()] * 8
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names_out)

        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(arrow_kind), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64())]
        names_out = ["cell", "block", "part", "query_id", "v", "least", "annuli", "bounds"]
        return run

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])
        if not left.num_rows or not right.num_rows:
            return none
        there = Cell(left["vec_id"].to_numpy(), left["annulus"].to_numpy(), _exact(left["v"], dim, whole), whole)
        ids, least = right["query_id"].to_numpy(), right["least"].to_numpy()
        lists, bounds = ([np.array(x) for x in right[c].to_pylist()] for c in ("annuli", "bounds"))
        place, near, score = there.search(ids, _exact(right["v"], dim, whole), least if not whole else least.astype(np.float64), lists, bounds, k)
        return pa.table([pa.array(ids[place]), pa.array(near), pa.array(score)], names=["query_id", "vec_id", "score"])

    dealt = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("cell", "block", "part")
    found, lowest = None, -(1 << 62)
    for number, (first, end) in enumerate(((0, FIRST), (FIRST, FIRST + SECOND), (FIRST + SECOND, len(n)))):
        if first >= len(n):
            break
        if found is None:
            open_now = asked.withColumn("least", F.lit(lowest))
        else:
            kth = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            open_now = asked.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(lowest)))
        asking = open_now.mapInArrow(plan(first, end), f"cell int, block int, part int, query_id long, v array<{kind}>, least long, annuli array<int>, bounds array<double>")
        new = dealt.cogroup(asking.groupBy("cell", "block", "part")).applyInArrow(search, "query_id long, vec_id long, score long")
        if found is not None:
            new = new.unionByName(found.drop("rank"))
        new = new.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = written(new.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), f"{path}/found{number}")
    return found.select("query_id", "rank", "vec_id", "score")


def _exact(column: pa.ChunkedArray, dim: int, whole: bool) -> np.ndarray:
    """Vectors as doubles where these hold all scores exactly, else as 64-bit integers."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64 if whole else np.int64).reshape(-1, dim)
