"""Bars to features: one row in, one row out, in the order of each symbol's bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import imbalance, log_return, order_flow, volume_spike
from ..schema import BASELINE_ROWS, EPS, FEATURES, FLUSH_ROWS, LAMBDA, LOOKBACK
from .scale import BLOCK, DAY, block_rows, ewma, halo_window, with_row_index

OUT = ["sec", "total_vol", "vwap", "buy_vol", "sell_vol", "msg_count", "r_t", "sigma_hat", "OFI_t", "Imbalance_t", "VolSpike_t", "idx", "key_rows"]


def with_vwap(bars: DataFrame, seconds: int = DAY, key: str = "symbol") -> DataFrame:
    """Adds vwap, idx and key_rows; a bar without quantity takes the last price before it, 0 if there is none."""
    raw = F.when(F.col("sum_q") > 0, F.col("sum_pq") / F.col("sum_q"))
    return with_row_index(bars, key, "sec", seconds, {"vwap": raw}).withColumn("vwap", F.coalesce("vwap", F.lit(0.0)))


def features(bars: DataFrame, lam: float = LAMBDA, seconds: int = DAY, chunk: int | None = None, reset: str | None = None) -> DataFrame:
    """All features of each bar. ``reset`` names a column (a chunk's id) at whose values the recurrences start anew.

    Shuffles by symbol and time bucket, then by symbol and chunk of rows, then by block of rows; never by symbol alone.
    """
    key = "symbol"
    if reset:
        bars, key = bars.withColumn("_series", F.struct("symbol", reset)), "_series"
    priced = with_vwap(bars, seconds, key)
    previous = lambda w: F.lag("vwap").over(w)
    rows = halo_window(
        priced,
        key,
        BASELINE_ROWS - 1,
        0,
        lambda w: {"r_t": log_return(F.col("vwap"), previous(w)), "_base": F.avg("total_vol").over(w.rowsBetween(1 - BASELINE_ROWS, 0))},
        chunk or 16 * min(BLOCK, block_rows(lam)),
    )
    rows = ewma(rows, key, F.col("r_t") * F.col("r_t"), lam, "_s")
    rows = rows.withColumns(
        {
            "sigma_hat": F.sqrt(F.col("_s") + EPS),
            "OFI_t": order_flow(F.col("buy_vol"), F.col("sell_vol")),
            "Imbalance_t": imbalance(F.col("buy_vol"), F.col("sell_vol")),
            "VolSpike_t": volume_spike(F.col("total_vol"), F.col("_base")),
            "baseline": F.col("_base"),
        }
    )
    return rows.select("symbol", *([reset] if reset else []), *OUT, "baseline")


def flush_index(df: DataFrame, rows: int = FLUSH_ROWS) -> DataFrame:
    """Adds flush_idx, the number from 1 of the file that the row belongs to."""
    return df.withColumn("flush_idx", F.expr(f"idx div {int(rows)}") + 1)


def lookback(df: DataFrame, w: int = LOOKBACK, chunk: int = 10_352) -> DataFrame:
    """Adds window: the last ``w`` feature vectors up to the row, oldest first, fewer at a symbol's start."""
    vector = F.array(*[F.col(c).cast("double") for c in FEATURES])
    return halo_window(df, "symbol", w - 1, 0, lambda o: {"window": F.collect_list(vector).over(o.rowsBetween(1 - w, 0))}, max(chunk, w))


def rolling_zscore(df: DataFrame, column: str, w: int = LOOKBACK, chunk: int = 10_352) -> DataFrame:
    """Adds <column>_z: the distance from the mean of the last ``w`` rows in their (population) deviations."""

    def z(o):
        frame = o.rowsBetween(1 - w, 0)
        return {f"{column}_z": (F.col(column) - F.avg(column).over(frame)) / (F.stddev_pop(column).over(frame) + EPS)}

    return halo_window(df, "symbol", w - 1, 0, z, max(chunk, w))


def first_difference(df: DataFrame, column: str, chunk: int = 10_352) -> DataFrame:
    """Adds <column>_d: the change since the row before; null for the first."""
    return halo_window(df, "symbol", 1, 0, lambda o: {f"{column}_d": F.col(column) - F.lag(column).over(o)}, chunk)


def last_w(df: DataFrame, keys: list[str], order: str, w: int = LOOKBACK) -> DataFrame:
    """The newest ``w`` rows of each key; the limit is applied in every task before rows are shuffled."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= w)


def tail_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows by ``order``."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
