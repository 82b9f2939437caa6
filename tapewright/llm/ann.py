"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import work_dir, written

TABLES, SEED = 16, 7
#: Share of the sampled queries' true neighbours that the probes must reach.
TARGET = 0.95
#: Vectors that the centre is taken from, and queries that the number of probes is fitted on.
CENTRE_ROWS, FITTED_QUERIES = 1000, 300
#: Probes of a table that are looked at first; doubled until TARGET is reached.
FIRST_PROBES = 512
#: Bytes of vectors that one task holds together.
CELL_BYTES = 64 << 20


def axes_for(dim: int, rows: int) -> tuple[int, ...]:
    """Axes of each rotation of a table: about as many buckets as rows, so that a bucket's size doesn't follow theirs.

    A rotation of ``m`` axes tells 2 * m signed axes apart. All but the last one use the whole (padded) dimension.
    """
    size, out = 1 << max(1, (dim - 1).bit_length()), []
    left = max(2, rows)
    while left >= 4 * size and len(out) < 5:
        out.append(size)
        left //= 2 * size
    return (*out, min(size, 1 << max(0, left.bit_length() - 2)))


def leading(axes: tuple[int, ...], most: int) -> np.ndarray:
    """Combinations of places in the levels' orders that can be among the ``most`` best: (i + 1)(j + 1)... <= most.

    A combination has at least so many others, less one, that are no worse at any level.
    """
    out, used = np.zeros((1, 0), np.int64), np.ones(1, np.int64)
    for m in axes:
        room = np.minimum(2 * m, most // used)
        at = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        out = np.concatenate((np.repeat(out, room, axis=0), at[:, None]), axis=1)
        used = np.repeat(used, room) * (at + 1)
    return out


class CrossPolytope:
    """Per table one pseudo-rotation (three rounds of random signs and a Hadamard transform) for each level.

    A level gives the nearest signed axis of a vector, seen from the centre; the levels together are its bucket.
    """

    def __init__(self, dim: int, axes: tuple[int, ...], centre: np.ndarray | None = None, tables: int = TABLES, seed: int = SEED):
        self.dim, self.axes, self.tables = dim, axes, tables
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.centre = np.zeros(dim) if centre is None else centre
        self.width = prod(2 * m for m in axes)
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, len(axes), 3, self.size))

    def _rotated(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            x = x * s
            h = 1
            while h < self.size:
                y = x.reshape(len(x), -1, 2, h)
                x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(len(x), self.size)
                h *= 2
            x /= np.sqrt(self.size)
        return x

    def levels(self, vectors: np.ndarray) -> Iterator[list[np.ndarray]]:
        """Per table and level, the nearness of each vector's direction to the signed axes."""
        moved = vectors - self.centre
        moved = moved / np.maximum(np.abs(moved).max(axis=1, keepdims=True), 1e-300)
        unit = np.zeros((len(vectors), self.size))
        unit[:, : self.dim] = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-300)
        for signs in self.signs:
            near = [self._rotated(unit, s)[:, :m] for s, m in zip(signs, self.axes)]
            yield [np.concatenate((a, -a), axis=1) for a in near]

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each vector, numbered throughout the tables."""
        out = np.empty((len(vectors), self.tables), np.int64)
        for t, near in enumerate(self.levels(vectors)):
            out[:, t] = t
            for a in near:
                out[:, t] = out[:, t] * a.shape[1] + a.argmax(axis=1)
        return out

    def probes(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """(rows, tables, probes): the buckets of greatest nearness over the levels, best first; as many as there are."""
        count = min(count, self.width)
        pick = leading(self.axes, count)
        out = np.empty((len(vectors), self.tables, count), np.int64)
        for t, near in enumerate(self.levels(vectors)):
            total, name = np.zeros((len(vectors), len(pick))), np.full((len(vectors), len(pick)), t, np.int64)
            for level, a in enumerate(near):
                order = np.argsort(-a, axis=1, kind="stable")[:, pick[:, level]]
                total += np.take_along_axis(a, order, axis=1)
                name = name * a.shape[1] + order
            best = np.argpartition(-total, count - 1, axis=1)[:, :count]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(total, best, axis=1), axis=1, kind="stable"), axis=1)
            out[:, t] = np.take_along_axis(name, best, axis=1)
        return out


def probes_needed(index: CrossPolytope, queries: np.ndarray, of: np.ndarray, buckets: np.ndarray, target: float = TARGET) -> int:
    """Probes of each table that reach ``target`` of the true neighbours; ``of`` says whose each row of ``buckets`` is."""
    if not len(of):
        return 1
    most = min(FIRST_PROBES, index.width)
    while True:
        rank = np.full(len(of), most)
        for q in np.unique(of):
            own = np.flatnonzero(of == q)
            for t, found in enumerate(index.probes(queries[q : q + 1], most)[0]):
                order = np.argsort(found)
                at = np.minimum(np.searchsorted(found, buckets[own, t], sorter=order), len(found) - 1)
                there = found[order[at]] == buckets[own, t]
                rank[own] = np.where(there, np.minimum(rank[own], order[at]), rank[own])
        enough = int(np.sort(rank)[max(0, int(np.ceil(target * len(rank))) - 1)])
        if enough < most or most == index.width:
            return min(enough + 1, index.width)
        most = min(2 * most, index.width)


def usable(embedding: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _closest(query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, several: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest ids, measured exactly, ties to the smaller id.

    An id that occurs again counts once; with ``several``, where its vectors may differ, with its least distance.
    """
    d = np.sqrt(((vectors - query) ** 2).sum(axis=1))
    if several:
        order = np.lexsort((d, ids))
        near = order[np.unique(ids[order], return_index=True)[1]]
    else:
        near = np.unique(ids, return_index=True)[1]
    if len(near) > k:
        near = near[d[near] <= np.partition(d[near], k - 1)[k - 1]]
    near = near[np.lexsort((ids[near], d[near]))][:k]
    return near, d[near]


def _true_neighbours(hashed: DataFrame, own: np.ndarray, queries: np.ndarray, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each sampled query's k nearest other rows the query's place and their buckets, found by comparing with all."""
    shared = hashed.sparkSession.sparkContext.broadcast((own, queries))
    fields = [("q", pa.int32()), ("d", pa.float64()), ("vec_id", pa.int64()), ("buckets", pa.list_(pa.int64()))]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = shared.value
        kept = None
        for batch in batches:
            x = _matrix(batch["embedding"], dim)
            if not len(x):
                continue
            ids, names = batch["vec_id"].to_numpy(), batch["buckets"].flatten().to_numpy().reshape(len(x), -1)
            far = np.sqrt(np.maximum((asked**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * asked @ x.T, 0))
            far[own[:, None] == ids[None]] = np.inf
            place = np.argpartition(far, k - 1, axis=1)[:, :k] if far.shape[1] > k else np.broadcast_to(np.arange(len(x)), far.shape)
            now = (np.take_along_axis(far, place, axis=1), ids[place], names[place])
            if kept is not None:
                now = tuple(np.concatenate(pair, axis=1) for pair in zip(kept, now))
                order = np.argsort(now[0], axis=1)[:, :k]
                now = (np.take_along_axis(now[0], order, axis=1), np.take_along_axis(now[1], order, axis=1), np.take_along_axis(now[2], order[:, :, None], axis=1))
            kept = now
        if kept is not None:
            each = kept[0].shape[1]
            lists = pa.FixedSizeListArray.from_arrays(kept[2].ravel(), kept[2].shape[2]).cast(pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(np.repeat(np.arange(len(asked), dtype=np.int32), each)), pa.array(kept[0].ravel()), pa.array(kept[1].ravel()), lists], schema=pa.schema(fields))

    found = hashed.select("embedding", "vec_id", "buckets").mapInArrow(best, "q int, d double, vec_id long, buckets array<long>").where(F.col("d") < float("inf"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))
    rows = found.withColumn("nth", nth).where(F.col("nth") <= k).select("q", "buckets").collect()  # sampled queries * k
    return np.array([r["q"] for r in rows], np.int64), np.array([r["buckets"] for r in rows], np.int64).reshape(len(rows), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row among all other rows, by distance.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. score is the Euclidean distance in
    double precision; ties go to the smaller vec_id. Vectors that are null, zero or have null or non-finite components
    take no part, nor do rows without vec_id and vectors of another length than most have. With fewer candidates than
    k all are returned. A row that repeats an id and a vector counts once. Where an id has several vectors, a pair of
    ids has the least distance of theirs, and there is one row for a pair; an id is never its own candidate. Other
    columns are ignored; an empty table gives no rows.

    The number of buckets follows the number of rows. How many of a table's buckets are probed is fitted: a bounded
    sample of the queries is compared with all rows once, and the least number that reaches ``target`` of their
    true neighbours (their own row isn't one) is taken, so recall holds for other data and sizes.

    Of equal vectors the k + 1 smallest ids are indexed, enough for any answer; vectors are told apart by 128-bit hashes.
    Each table sends a row to one cell of work and a query vector once to each cell that has buckets it probes. Buckets
    that share their leading axes share a cell, up to CELL_BYTES of vectors; beyond that a cell is divided by bucket,
    and a bucket that is larger still by row. Each task returns its k + 1 best for a query vector. Queries that found
    fewer than k that way are compared with all rows, block by block.
    """
    spark = vectors.sparkSession
    path = work_dir(spark)
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding") if single else F.col("embedding").cast("array<double>"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, kind = common["n"], "float" if single else "double"
    per_cell = max(1, CELL_BYTES // (8 * dim))
    block_rows = max(1, per_cell // 4)
    rows = rows.where(F.size("embedding") == dim).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    rows = written(rows.dropDuplicates(["vec_id", "h1", "h2"]), f"{path}/rows")

    def some(df: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
        found = df.orderBy(F.xxhash64("vec_id"), "vec_id", "h1", "h2").limit(n).select("vec_id", "embedding").collect()
        return np.array([r["vec_id"] for r in found], np.int64), np.array([r["embedding"] for r in found], float).reshape(len(found), dim)

    axes = axes_for(dim, common["count"])
    index = CrossPolytope(dim, axes, some(rows, CENTRE_ROWS)[1].mean(axis=0), tables)
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("vec_id", "h1", "embedding")

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                found = index.buckets(_matrix(part["embedding"], dim))
                yield part.append_column("buckets", pa.FixedSizeListArray.from_arrays(found.ravel(), tables).cast(pa.list_(pa.int64())))

    hashed = first.mapInArrow(hash_all, f"vec_id long, h1 long, embedding array<{kind}>, buckets array<long>")
    hashed = written(hashed, f"{path}/entries")
    asked = rows.where(is_query)
    # equal query vectors are asked for once
    alone = written(asked.dropDuplicates(["h1", "h2"]).select("h1", "h2", "embedding", F.monotonically_increasing_id().alias("asker")), f"{path}/alone")
    queries = written(asked.join(alone.select("h1", "h2", "asker"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "asker"), f"{path}/queries")
    own, sample = some(asked, FITTED_QUERIES)
    probes = probes_needed(index, sample, *_true_neighbours(hashed, own, sample, dim, k), target) if len(sample) else 1

    total = hashed.count()
    cells = max(spark.sparkContext.defaultParallelism, -(-total * tables // per_cell))
    low = index.width  # buckets that share all leading axes
    for m in axes[:-1]:
        if low * total // index.width <= per_cell // 2:
            break
        low //= 2 * m
    prefix = F.expr(f"bucket div {low}")
    sizes = hashed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes, f"{path}/sizes")
    wide = sizes.groupBy(prefix.alias("prefix")).agg(F.ceil(F.sum("n") / per_cell).cast("int").alias("parts")).where("parts > 1")
    # the few buckets that aren't one piece of their prefix's cell; Spark broadcasts them only if their table is small
    uneven = sizes.withColumn("prefix", prefix).join(wide, "prefix", "left")
    uneven = uneven.select("bucket", F.coalesce("parts", F.lit(1)).alias("parts"), F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    uneven = written(uneven.where("parts > 1 OR blocks > 1"), f"{path}/uneven")

    def placed(df: DataFrame, blocks: Column) -> DataFrame:
        """Adds cell: by leading axes, by part of the prefix and by block of the bucket."""
        both = df.join(uneven, "bucket", "left").withColumns({"parts": F.coalesce("parts", F.lit(1)), "blocks": F.coalesce("blocks", F.lit(1))})
        both = both.withColumn("block", blocks)
        return both.withColumn("cell", F.pmod(F.xxhash64(prefix, F.pmod(F.xxhash64("bucket"), F.col("parts")), "block"), F.lit(cells)))

    there = placed(hashed.select("vec_id", "h1", "embedding", F.explode("buckets").alias("bucket")), F.pmod(F.xxhash64("vec_id", "h1"), F.col("blocks")).cast("int"))

    def probe_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 21) // (probes * 8))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                found = index.probes(_matrix(part["embedding"], dim), probes).reshape(part.num_rows, -1)
                lists = pa.FixedSizeListArray.from_arrays(found.ravel(), found.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.record_batch([part["asker"], lists], names=["asker", "buckets"])

    asking = alone.mapInArrow(probe_all, "asker long, buckets array<long>").select("asker", F.explode("buckets").alias("bucket"))
    asking = placed(asking, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).groupBy("cell", "asker").agg(F.collect_list("bucket").alias("buckets"))
    asking = asking.join(alone.select("asker", "embedding"), "asker")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            ids, bucket, h1 = (left[c].to_numpy() for c in ("vec_id", "bucket", "h1"))
            vecs = _matrix(left["embedding"].combine_chunks(), dim)
            several = len(np.unique(ids)) < len(np.unique(ids * 0x9E3779B1 ^ h1))
            order = np.argsort(bucket, kind="stable")
            ids, vecs = ids[order], vecs[order]
            names, begins = np.unique(bucket[order], return_index=True)
            ends = np.append(begins[1:], len(ids))
            lists, wanted = right["buckets"].combine_chunks(), _matrix(right["embedding"].combine_chunks(), dim)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for query, v, (lo, hi) in zip(right["asker"].to_pylist(), wanted, pairwise(offsets.tolist())):
                at = np.searchsorted(names, flat[lo:hi])
                at = at[at < len(names)] if len(names) else at
                at = np.unique(at[np.isin(names[at], flat[lo:hi])])
                long = ends[at] - begins[at]
                pick = np.arange(long.sum()) + np.repeat(begins[at] - np.cumsum(long) + long, long)
                near, far = _closest(v, ids[pick], vecs[pick], k + 1, several)
                out += [(query, n, d) for n, d in zip(ids[pick[near]].tolist(), far.tolist())]
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, types)], names=["asker", "vec_id", "score"])

    def ranked(there: DataFrame, asking: DataFrame, queries: DataFrame) -> DataFrame:
        there = there.select("cell", "bucket", "vec_id", "h1", "embedding").groupBy("cell")
        asking = asking.select("cell", "asker", "embedding", "buckets").groupBy("cell")
        found = there.cogroup(asking).applyInArrow(search, "asker long, vec_id long, score double")
        found = found.groupBy("asker", "vec_id").agg(F.min("score").alias("score"))
        best = Window.partitionBy("asker").orderBy("score", "vec_id")
        found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
        answers = queries.join(found, "asker").where(F.col("vec_id") != F.col("query_id"))
        answers = answers.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        answers = answers.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score")
        return answers.where(F.col("rank") <= k)

    probed = written(ranked(there, asking, queries), f"{path}/probed")
    full = probed.where(F.col("rank") == k).select("query_id")
    short = written(queries.join(full, "query_id", "left_anti"), f"{path}/short")
    missing = short.count()
    if not missing:
        return probed
    blocks, parts = max(spark.sparkContext.defaultParallelism, -(-total // block_rows)), -(-missing // block_rows)

    def dealt(n: int, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(n))

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    there = hashed.select("vec_id", "h1", "embedding", dealt(blocks, "vec_id", "h1").alias("block"), each(parts).alias("part"))
    there = there.select((F.col("block") * parts + F.col("part")).alias("cell"), F.lit(0).cast("long").alias("bucket"), "vec_id", "h1", "embedding")
    asking = alone.join(short.select("asker").distinct(), "asker").select("asker", "embedding", dealt(parts, "asker").alias("part"), each(blocks).alias("block"))
    asking = asking.select((F.col("block") * parts + F.col("part")).alias("cell"), "asker", "embedding", F.array(F.lit(0).cast("long")).alias("buckets"))
    rest = probed.join(short.select("query_id").distinct(), "query_id", "left_anti")
    return rest.unionByName(ranked(there, asking, short))
