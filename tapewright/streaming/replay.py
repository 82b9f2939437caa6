"""Replayed ticks scored as a stream, measured batch by batch, with and without the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import TwoStage
from ..operators.metrics import latency_summary
from .progress import measured, run_with_progress


def replay_scores(ticks: DataFrame, model: TwoStage, tau: float, tau2: float, path: str, batches: int = 20, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scored ticks, progress of the batches): ``ticks``, see ``sources.trades.replay``, in the order of t as a stream.

    They are dealt out to ``batches`` files by ranges of t, one file a batch; ``path`` must be new. Each batch counts its
    ticks, those that pass the gate and those that the second stage saw.
    """
    ticks.repartitionByRange(batches, "t").sortWithinPartitions("t").write.parquet(f"{path}/ticks")
    stream = ticks.sparkSession.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/ticks")
    scored = model.gated(stream, tau, tau2, force)
    own = {"ticks": F.count(F.lit(1)), "passed": F.count_if(F.col("p1") >= tau), "second": F.count("p2")}
    return run_with_progress(measured(scored, **own), f"{path}/run")


def replay_summary(progress: DataFrame, deadline: float = 10.0) -> DataFrame:
    """One row: ticks, hit_rate and second_rate (shares that passed the gate and that the second stage saw), ticks_per_s, and
    n, mean, p50, p90, p95, p99 and miss_rate of the batches' milliseconds."""
    full = progress.where("rows > 0").withColumn("_all", F.lit(0))
    own = lambda n: F.sum(F.col("measures")[n])
    sums = full.groupBy("_all").agg(F.sum("rows").alias("ticks"), (own("passed") / own("ticks")).alias("hit_rate"), (own("second") / own("ticks")).alias("second_rate"), (1000 * F.sum("rows") / F.sum("total_ms")).alias("ticks_per_s"))
    return sums.join(latency_summary(full, ["_all"], deadline=deadline), "_all").drop("_all")


def gate_ablation(ticks: DataFrame, model: TwoStage, tau: float, tau2: float, path: str, batches: int = 20) -> tuple[DataFrame, DataFrame]:
    """(scores of both runs by mode, summaries by mode): the same replay with the gate and with the second stage for all."""
    scores, sums = None, None
    for mode in ("gated", "forced"):
        out, progress = replay_scores(ticks, model, tau, tau2, f"{path}/{mode}", batches, mode == "forced")
        pair = [df.withColumn("mode", F.lit(mode)) for df in (out, replay_summary(progress))]
        scores, sums = pair if scores is None else (a.unionByName(b) for a, b in zip((scores, sums), pair))
    return scores, sums
