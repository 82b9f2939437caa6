"""Trades to bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bar_start, buy_qty, notional, sell_qty

def bar_sums() -> list:
    """The aggregates of a bar; a sum without any value is 0, and rows without quantity count as messages."""
    zero = F.lit(0.0)
    return [
        F.coalesce(F.sum(notional(F.col("price"), F.col("qty"))), zero).alias("sum_pq"),
        F.coalesce(F.sum("qty"), zero).alias("sum_q"),
        F.coalesce(F.sum("qty"), zero).alias("total_vol"),
        F.coalesce(F.sum(buy_qty(F.col("qty"), F.col("is_buyer_maker"))), zero).alias("buy_vol"),
        F.coalesce(F.sum(sell_qty(F.col("qty"), F.col("is_buyer_maker"))), zero).alias("sell_vol"),
        F.count(F.lit(1)).alias("msg_count"),
    ]


def bars(trades: DataFrame, unit: str = "second") -> DataFrame:
    """One row per symbol and bar that has trades; trades without a time are dropped. Sums are combined before the shuffle."""
    timed = trades.where(F.col("ts").isNotNull())
    return timed.groupBy("symbol", bar_start(F.col("ts"), unit).alias("sec")).agg(*bar_sums())
