"""Mergeable sketches of a measure, one small row for each group and period, for percentiles over any span of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; a rank is off by less than about 2.3 / K**0.97 of the rows.
K = 2000


def rank_error(k: int) -> float:
    """A share of the rows that a sketch's ranks stay within, three times the usual error."""
    return 3 * 2.296 / k**0.9723


def period_sketches(df: DataFrame, keys: list[str], column: str, time: str, period: str = "1 day", k: int = K, deadline: float | None = None) -> DataFrame:
    """(keys, period, n, total, missed, least, most, sketch) of ``column``, for batches and, with a watermark, for streams.

    Only new data is read: rows of later periods are appended to the table, and tables merge with each other. Nulls and
    NaN don't count.
    """
    value = F.col(column).cast("double")
    rows = df.where(value.isNotNull() & ~F.isnan(value)).groupBy(*keys, F.window(F.col(time).cast("timestamp"), period).alias("_w"))
    late = F.lit(0).cast("long") if deadline is None else F.count_if(value > deadline)
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), late.alias("missed"), F.min(value).alias("least"), F.max(value).alias("most"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))
    return sums.select(*keys, F.col("_w.start").alias("period"), "n", "total", "missed", "least", "most", "sketch")


def merged(table: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """(keys, n, mean, miss_rate, least, most, sketch) over all rows of a table of ``period_sketches``."""
    n = F.sum("n")
    return table.groupBy(*keys).agg(
        n.alias("n"), (F.sum("total") / n).alias("mean"), (F.sum("missed") / n).alias("miss_rate"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", k).alias("sketch")
    )


def _quantiles(shares: list[float]) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(min(1.0, max(0.0, s))) for s in shares]))


def sketched_summary(table: DataFrame, keys: list[str], shares: list[float] = (0.5, 0.9, 0.95, 0.99), k: int = K) -> DataFrame:
    """(keys, n, mean, miss_rate, p50, ...) from the sketches alone; percentiles are values within ``rank_error``."""
    rows = merged(table, keys, k).withColumn("_q", _quantiles(list(shares)))
    return rows.select(*keys, "n", "mean", "miss_rate", *[F.col("_q")[i].alias(f"p{int(100 * s)}") for i, s in enumerate(shares)])


def brackets(table: DataFrame, keys: list[str], column: str, shares: list[float], k: int = K) -> DataFrame:
    """Bounds for ``quantile.exact_percentiles``, which then reads the values themselves only once."""
    shares, margin = sorted({float(s) for s in shares}), rank_error(k)
    low, high = (_quantiles([s + side * margin for s in shares]) for side in (-1, 1))
    rows = merged(table, keys, k).where("n > 0")
    # ends of the range are known exactly
    low = F.transform(low, lambda x, i: F.when(F.get(F.array(*[F.lit(s <= margin) for s in shares]), i), F.col("least")).otherwise(x))
    high = F.transform(high, lambda x, i: F.when(F.get(F.array(*[F.lit(s >= 1 - margin) for s in shares]), i), F.col("most")).otherwise(x))
    return rows.select(*[F.col(c).alias(f"_{c}") for c in keys], F.lit(column).alias("_column"), F.col("n").alias("_n"), low.alias("_low"), high.alias("_high"))
