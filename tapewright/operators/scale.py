"""Windows over long series of one key, in many tasks.

A symbol can hold years of bars, so a window over the symbol alone would be one task. These helpers cut a series into
buckets of time or blocks of rows, work inside them and carry over what crosses their edges. Tests hold each of them
against the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.work import kept

#: Seconds of a bucket, unless a caller gives other ones.
DAY = 86_400
#: Rows of a block of the recurrence at most, blocks of a group, and doublings over the last level's groups.
BLOCK, GROUP, TOP = 4096, 256, 16
#: Rows of a piece of an order.
RANGE_ROWS = 500_000


def time_bucket(order: str, seconds: int = DAY) -> Column:
    return F.floor(F.unix_timestamp(F.col(order).cast("timestamp")) / seconds)


def with_row_index(df: DataFrame, key: str, order: str, seconds: int = DAY, carry: dict[str, Column] | None = None, ties: list[str] = ()) -> DataFrame:
    """Adds idx, the row's place in its key's order from 0, and key_rows, the rows of its key.

    ``order`` is a time; where it isn't unique ``ties`` are columns that decide.

    ``carry`` names columns and nullable expressions; each such column gets the expression's last value that isn't
    null up to the row. Counts and last values of a bucket are joined back from one small row per key and bucket.
    """
    carry = carry or {}
    rows = df.withColumn("_bucket", time_bucket(order, seconds))
    last = [F.max_by(F.when(e.isNotNull(), e), F.when(e.isNotNull(), F.col(order))).alias(f"_last_{n}") for n, e in carry.items()]
    sums = rows.groupBy(F.col(key).alias("_k"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"), *last)
    buckets = Window.partitionBy("_k").orderBy("_b")
    before = buckets.rowsBetween(Window.unboundedPreceding, -1)
    held = sums.select(
        "_k",
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_k")).alias("key_rows"),
        *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_from_{n}") for n in carry],
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(order, *ties)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(held, (F.col(key) == F.col("_k")) & (F.col("_bucket") == F.col("_b")))
    out = joined.withColumn("idx", F.col("_before") + F.row_number().over(inside) - 1)
    for n, e in carry.items():
        out = out.withColumn(n, F.coalesce(F.last(e, ignorenulls=True).over(upto), F.col(f"_from_{n}")))
    return out.drop("_bucket", "_k", "_b", "_before", *[f"_from_{n}" for n in carry])


def halo_window(df: DataFrame, key: str, before: int, after: int, columns: Callable[[WindowSpec], dict[str, Column]], chunk: int = 10_352) -> DataFrame:
    """Adds ``columns(w)``, where w orders the rows of a key by idx, for frames of ``before`` to ``after`` rows.

    Rows near a chunk's edge are copied into the neighbouring chunk and leave again once the window is done.
    """
    if chunk < before + after:
        raise ValueError("a chunk must hold as many rows as the frame")
    own, place = F.expr(f"idx div {chunk}"), F.col("idx") % chunk
    to = F.array(own, F.when((place < after) & (own > 0), own - 1), F.when(place >= chunk - before, own + 1))
    copies = df.withColumn("_chunk", F.explode(F.array_compact(to)))
    w = Window.partitionBy(key, "_chunk").orderBy("idx")
    return copies.withColumns(columns(w)).where(F.col("_chunk") == own).drop("_chunk")


def block_rows(lam: float) -> int:
    """Rows after which lambda's powers have fallen by e**-40: all that is older than two blocks is below rounding."""
    return max(1, math.ceil(40 / -math.log(lam)))


def affine_carry(blocks: DataFrame, levels: int = 2) -> DataFrame:
    """(_key, _b, _come): what comes into each block, where block _b turns what comes in, c, into _f * c + _s.

    Pairs (_f, _s) are composed by doubling inside groups of GROUP blocks; the groups' own pairs are carried the same
    way, level by level. The last level is one small row for GROUP**levels blocks of a key, up to 2**TOP of them.
    """
    rows, steps = blocks.withColumns({"_g": F.expr(f"_b div {GROUP}") if levels else F.lit(0).cast("long")}), (GROUP - 1).bit_length() if levels else TOP
    w = Window.partitionBy("_key", "_g").orderBy("_b")
    for i in range(steps):
        before = (F.coalesce(F.lag(c, 1 << i).over(w), F.lit(none)) for c, none in (("_f", 1.0), ("_s", 0.0)))
        f, s = before
        rows = rows.withColumns({"_s": F.col("_s") + F.col("_f") * s, "_f": F.col("_f") * f})
    inner = rows.select("_key", "_g", "_b", F.coalesce(F.lag("_f").over(w), F.lit(1.0)).alias("_ef"), F.coalesce(F.lag("_s").over(w), F.lit(0.0)).alias("_es"))
    if not levels:
        return inner.select("_key", "_b", F.col("_es").alias("_come"))
    totals = rows.groupBy("_key", F.col("_g").alias("_b")).agg(F.max_by("_f", "_b").alias("_f"), F.max_by("_s", "_b").alias("_s"))
    above = affine_carry(totals, levels - 1).select(F.col("_key").alias("_k2"), F.col("_b").alias("_g2"), F.col("_come").alias("_from"))
    joined = inner.join(above, F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_g") == F.col("_g2")))
    return joined.select("_key", "_b", (F.col("_es") + F.col("_ef") * F.col("_from")).alias("_come"))


def ewma(df: DataFrame, key: str, value: Column, lam: float, name: str) -> DataFrame:
    """Adds s with s = value for idx 0 and lam * s_before + (1 - lam) * value from there, by idx.

    Inside a block of rows, of BLOCK at most for every lambda, it is a weighted running sum. Where lambda's powers vanish
    within a block, what comes in from earlier blocks is their sums at their ends; else see ``affine_carry``.
    """
    if not 0 < lam < 1:
        raise ValueError("lambda must lie between 0 and 1")
    size = min(BLOCK, block_rows(lam))
    rows = df.withColumn("_block", F.expr(f"idx div {size}")).withColumn("_k", F.col("idx") % size + 1)
    weight = F.when(F.col("idx") == 0, 1.0).otherwise(1 - lam)
    term = weight * value * F.pow(F.lit(1 / lam), F.col("_k"))
    w = Window.partitionBy(key, "_block").orderBy("idx")
    rows = rows.withColumn("_p", F.sum(term).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_b")).agg(F.max(F.struct("_k", "_p")).alias("_end"))
    ends = ends.select("_key", "_b", F.pow(F.lit(lam), F.col("_end._k")).alias("_f"), (F.pow(F.lit(lam), F.col("_end._k")) * F.col("_end._p")).alias("_s"))
    if size == block_rows(lam):
        blocks = Window.partitionBy("_key").orderBy("_b")
        come = F.coalesce(F.lag("_s", 1).over(blocks), F.lit(0.0)) + lam**size * F.coalesce(F.lag("_s", 2).over(blocks), F.lit(0.0))
        ends = ends.select("_key", "_b", come.alias("_come"))
    else:
        ends = affine_carry(ends)
    joined = rows.join(ends, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn(name, F.pow(F.lit(lam), F.col("_k")) * (F.col("_come") + F.col("_p"))).drop("_block", "_k", "_p", "_key", "_b", "_come")


def in_ranges(written: DataFrame, by: list[str], rows: int | None = None) -> DataFrame:
    """Adds _range, the number of the piece of about ``rows`` rows in the order of ``by`` that a row lies in.

    Pieces are cut by counts, not by values, so rows that lie close together are spread as others are; only rows equal
    in all of ``by`` share a piece in any case. ``written`` must be cheap to read again; with several pieces the result
    is written, since a piece's number is only known while rows are dealt out.
    """
    parts = -(-written.count() // (rows or RANGE_ROWS))
    if parts <= 1:
        return written.withColumn("_range", F.lit(0))
    return kept(written.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()))


def indexed_in_order(df: DataFrame, order: list[str], rows: int | None = None) -> DataFrame:
    """Adds idx, the place of each row in the order of all, from 0, and key_rows, their number; see ``in_ranges``."""
    ranged = in_ranges(kept(df), order, rows)
    counts = ranged.groupBy(F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each piece
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("key_rows"))
    inside = Window.partitionBy("_range").orderBy(*order)
    joined = ranged.join(counts, F.col("_range") == F.col("_r"))
    return joined.withColumn("idx", F.col("_before") + F.row_number().over(inside) - 1).drop("_range", "_r", "_before")


def running_sums(ranged: DataFrame, score: str, sums: list[str], keys: list[str] = ()) -> DataFrame:
    """Turns each of ``sums`` into its sum over rows of at least this row's ``score``, for each key.

    ``ranged`` has one row per key and score, and _range from ``in_ranges`` by keys and score. The totals of the pieces
    are carried over; running sums go on inside a piece.
    """
    keys = list(keys)
    per = ranged.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_piece")).agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    above = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[f"_{k}" for k in keys], "_piece", *[F.coalesce(F.sum(f"_{s}").over(above), F.lit(0)).alias(f"_{s}") for s in sums])
    on = F.col("_range") == F.col("_piece")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(per, on)
    return joined.select(*[c for c in ranged.columns if c not in sums], *[(F.sum(s).over(inside) + F.col(f"_{s}")).alias(s) for s in sums])
