"""Progress of streams as a table that grows while they run: time, rows, state and own measures of every batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = (
    "run_id string, name string, batch long, at timestamp, total_ms double, rows long, state_rows long, state_bytes long, "
    "dropped_late long, measures map<string,double>"
)


def measured(stream: DataFrame, **measures) -> DataFrame:
    """``stream`` with aggregates (name=column) that each batch computes on its way and ``ProgressTable`` keeps."""
    return stream.observe("measures", *[c.cast("double").alias(n) for n, c in measures.items()])


class ProgressTable(StreamingQueryListener):
    """Appends a row for each batch of every stream of the session to the table at ``path``, ``every`` batches a file.

    A stream's last rows are written when it ends. Only rows that aren't written yet are held.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 100):
        self.spark, self.path, self.every, self.rows = spark, path, every, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        state = p.get("stateOperators", [])
        sums = [sum(int(s.get(n, 0)) for s in state) for n in ("numRowsTotal", "memoryUsedBytes", "numRowsDroppedByWatermark")]
        own = {k: float(v) for k, v in (p.get("observedMetrics", {}).get("measures") or {}).items() if v is not None}
        self.rows.append((p["runId"], p.get("name"), int(p["batchId"]), p["timestamp"], float(p["durationMs"].get("triggerExecution", 0)), int(p["numInputRows"]), *sums, own))
        if len(self.rows) >= self.every:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            kinds = PROGRESS.replace("at timestamp", "at string")
            table = self.spark.createDataFrame(rows, kinds).withColumn("at", F.to_timestamp("at"))
            table.coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """The table so far; a batch that was tried again has its last row only."""
        return self.spark.read.schema(PROGRESS).parquet(self.path)


def run_with_progress(stream: DataFrame, path: str, every: int = 100) -> tuple[DataFrame, DataFrame]:
    """Runs a stream over all that is there now, see ``live.run_to_table``; (its rows, the progress of its batches)."""
    from .live import run_to_table

    spark = stream.sparkSession
    listener = ProgressTable(spark, f"{path}/progress", every)
    spark.streams.addListener(listener)
    try:
        out = run_to_table(stream, path)
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    listener.flush()
    return out, listener.read()
