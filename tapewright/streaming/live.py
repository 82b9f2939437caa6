"""Live bars, scores and sinks; features with bounded state per symbol are in ``ring``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import bar_sums
from ..operators.features import last_w
from ..operators.score import gate
from ..schema import GATE, LOOKBACK, SECOND_GATE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_bars(trades: DataFrame, width: str = "1 second", late: str = "5 seconds") -> DataFrame:
    """One row per symbol and bar, put out once no trade for it can come; later trades are dropped."""
    timed = trades.where("ts IS NOT NULL").withWatermark("ts", late)
    rows = timed.groupBy("symbol", F.window("ts", width).alias("w")).agg(*bar_sums())
    return rows.select("symbol", F.col("w.start").alias("sec"), F.col("w").alias("window"), "sum_pq", "sum_q", "total_vol", "buy_vol", "sell_vol", "msg_count")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_scores(features: DataFrame, first: Callable[[DataFrame], DataFrame], tau: float = GATE, tau2: float = SECOND_GATE) -> DataFrame:
    """Gated predictions for a stream of features; ``first`` adds p1 and p2."""
    return gate(first(features), tau, tau2)


def write_hot_and_cold(features: DataFrame, path: str, checkpoint: str, rows: int = LOOKBACK):
    """Starts a query that keeps all features in ``path``/cold and the last ``rows`` per symbol in ``path``/hot.

    A batch that is tried again replaces its own part of the cold table. The hot table has two folders that take turns,
    so the one that is read is never the one that is written.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/cold")
        new = batch.drop("window_rows")
        if number:
            new = new.unionByName(spark.read.parquet(f"{path}/hot/{(number - 1) % 2}").drop("batch"))
        last_w(new, ["symbol"], "sec", rows).drop("nth").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/hot/{number % 2}")

    return features.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hot_rows(spark: SparkSession, path: str) -> DataFrame:
    """The hot table that ``write_hot_and_cold`` wrote last."""
    both = spark.read.parquet(f"{path}/hot/*")
    newest = both.agg(F.max("batch").alias("newest"))  # one row
    return both.crossJoin(F.broadcast(newest)).where("batch = newest").drop("batch", "newest")


def write_rejects(rest: DataFrame, path: str, checkpoint: str):
    """Starts a query that keeps the lines that are no trades, with the time they were seen, in a table of files."""
    seen = rest.withColumn("seen", F.current_timestamp())
    return seen.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all that is there now into a table of files and reads it; ``path`` must be new."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def batch_latencies(query, deadline_ms: float = 10.0) -> list[dict]:
    """Of each recent batch: total_ms, rows, state rows and memory, and whether it missed the deadline."""
    out = []
    for p in query.recentProgress:
        ms, state = p["durationMs"].get("triggerExecution", 0), p["stateOperators"]
        out.append({"batch": p["batchId"], "total_ms": float(ms), "rows": p["numInputRows"], "state_rows": sum(s["numRowsTotal"] for s in state), "state_bytes": sum(s["memoryUsedBytes"] for s in state), "missed": ms > deadline_ms})
    return out
