"""Exact percentiles of any number of rows, without gathering all values in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A sketch of this accuracy brackets each percentile; about 4 in ACCURACY of a group's values lie in the bracket.
ACCURACY = 10_000


def _sketched_bounds(df: DataFrame, columns: list[str], shares: list[float], keys: list[str], accuracy: int) -> DataFrame:
    """(_keys, _column, _n, _low, _high): brackets of each group's percentiles by a pass over its values."""
    margin = 2 / accuracy
    sides = [max(0.0, s - margin) for s in shares] + [min(1.0, s + margin) for s in shares]
    firsts = []
    for i, c in enumerate(columns):
        few = F.count(c) <= 2 * accuracy
        sketch = F.percentile_approx(F.col(c).cast("double"), F.array(*[F.lit(s) for s in sides]), accuracy)
        least, most = (F.array_repeat(f(F.col(c).cast("double")), len(shares)) for f in (F.min, F.max))
        low, high = F.when(few, least).otherwise(F.slice(sketch, 1, len(shares))), F.when(few, most).otherwise(F.slice(sketch, len(shares) + 1, len(shares)))
        firsts.append(F.struct(F.lit(c).alias("_column"), F.count(c).alias("_n"), low.alias("_low"), high.alias("_high")).alias(f"_{i}"))
    return df.groupBy(*keys).agg(*firsts).select(*[F.col(k).alias(f"_{k}") for k in keys], F.inline(F.array(*[f"_{i}" for i in range(len(columns))]))).where("_n > 0")


def exact_percentiles(df: DataFrame, columns: list[str], shares: list[float], keys: list[str] = (), accuracy: int = ACCURACY, bounds: DataFrame | None = None) -> DataFrame:
    """(keys, column, share, n, value): percentiles interpolated between neighbours; nulls don't count.

    A first pass sketches values that surely lie below and above each percentile, its bracket. The second counts each
    distinct value inside a bracket and, as one number, all values between two brackets, combined before the shuffle; a
    value is emitted once, however many shares there are. So the values that are put in order are a small share of the
    rows, and results are exact. Groups of few rows are their own bracket. Columns without values give no rows.
    ``bounds`` may come from sketches that are kept (``sketches.brackets``), which spares the first pass.
    """
    keys, shares = list(keys), sorted({float(s) for s in shares})
    if bounds is None:
        bounds = _sketched_bounds(df, columns, shares, keys, accuracy)
    values = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))).where("v IS NOT NULL")
    on = F.col("column") == F.col("_column")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = values.join(bounds, on)
    # brackets before the value's place: all between two brackets count as one number in front of the second one
    passed = sum((F.when(F.col("_high")[j] < F.col("v"), 1).otherwise(0) for j in range(len(shares))), F.lit(0))
    held = F.coalesce(F.get("_low", passed) <= F.col("v"), F.lit(False))
    front = F.coalesce(F.get("_low", passed), F.lit(float("inf")))
    names = [*keys, "column"]
    cells = both.select(*names, F.col("_n").alias("n"), F.when(held, F.col("v")).otherwise(front).alias("at"), held.alias("held"))
    counts = cells.groupBy(*names, "n", "at", "held").agg(F.count(F.lit(1)).alias("c"))
    placed = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*names).orderBy("at", "held")))
    picks = []
    for j, s in enumerate(shares):
        rank = F.lit(s) * (F.col("n") - 1)
        first = lambda r: F.min(F.when(F.col("upto") > r, F.struct("upto", F.col("held"), F.col("at").alias("v"))))
        picks.append(F.struct(F.lit(s).alias("share"), first(F.floor(rank)).alias("a"), first(F.ceil(rank)).alias("b"), F.max(rank).alias("rank")).alias(f"_{j}"))
    out = placed.groupBy(*names, "n").agg(*picks).select(*names, "n", F.inline(F.array(*[f"_{j}" for j in range(len(shares))])))
    found = F.assert_true(F.col("a.held") & F.col("b.held"), F.lit("a percentile lies outside its bracket")).isNull()
    value = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("rank") - F.floor("rank"))
    return out.where(found).select(*names, "share", "n", value.alias("value"))


def percentile_columns(df: DataFrame, column: str, shares: list[float], keys: list[str], bounds: DataFrame | None = None) -> DataFrame:
    """(keys, p50, p90, ...): the exact percentiles of one column as columns."""
    long = exact_percentiles(df, [column], shares, keys, bounds=bounds)
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(f"p{int(100 * s)}") for s in shares])
