"""Chronological splits without look-ahead: a gap of rows is left out before each later part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import indexed_in_order


def indexed(df: DataFrame, order: str, ties: list[str] = (), rows: int | None = None) -> DataFrame:
    """Adds idx and key_rows over all rows by ``order`` and ``ties``, in pieces of about ``rows`` rows however times lie."""
    return indexed_in_order(df, [order, *ties], rows)


def two_way(df: DataFrame, share: float = 0.2, gap: int = 30) -> DataFrame:
    """Adds part: train or val; rows in the gap are dropped. ``df`` has idx and key_rows.

    The validation share begins at row n * (1 - share), at least at 1 and at most at n - 1; training ends ``gap`` rows
    before, but has one row at least.
    """
    n = F.col("key_rows")
    split = F.greatest(F.least(F.floor(n * (1.0 - share)), n - 1), F.lit(1))
    train_end = F.greatest(split - gap, F.lit(1))
    part = F.when(F.col("idx") < train_end, "train").when(F.col("idx") >= split, "val")
    return df.withColumn("part", part).where(F.col("part").isNotNull())


def require_split(df: DataFrame) -> None:
    """An error unless there are more than one training and at least two validation rows."""
    n = {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}
    if n.get("train", 0) <= 1 or n.get("val", 0) < 2:
        raise ValueError(f"too few rows to split: {n}")


def three_way(df: DataFrame, gap: int = 30, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Adds part: train, val or test by whole rows of the shares, with ``gap`` rows left out before val and test."""
    n, idx = F.col("key_rows"), F.col("idx")
    a = F.floor(n * train)
    b = a + gap + F.floor(n * val)
    part = F.when(idx < a, "train").when((idx >= a + gap) & (idx < b), "val").when(idx >= b + gap, "test")
    return df.withColumn("part", part).where(F.col("part").isNotNull())
