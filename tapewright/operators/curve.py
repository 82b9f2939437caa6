"""Precision/recall curves, average precision and the choice of thresholds, for any number of curves at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import f_beta
from ..sources.work import kept
from .scale import in_ranges, running_sums

#: Fewer scored rows than this are too few to choose a threshold.
LEAST_ROWS = 5


def pr_curve(scored: DataFrame, score: str = "p", target: str = "y", keys: list[str] = ()) -> DataFrame:
    """One row per key and distinct score: thr, tp, fp, positives, precision, recall for predicting p >= thr.

    Scores are counted before they are shuffled, and the counts, one row per key and score, are written once; running
    sums go over pieces of about equal numbers of scores (_range), wherever scores lie. Without positives recall is 1.
    """
    keys = list(keys)
    hit = F.col(target).cast("long")
    counts = scored.groupBy(*keys, F.col(score).alias("thr")).agg(F.sum(hit).alias("tp"), F.sum(1 - hit).alias("fp"))
    counts = in_ranges(kept(counts), [*keys, "thr"])
    points = running_sums(counts, "thr", ["tp", "fp"], keys)
    total = counts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("tp").alias("positives"), F.sum(F.col("tp") + F.col("fp")).alias("n"))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    joined = points.join(total, on).drop(*[f"_{k}" for k in keys]) if keys else points.crossJoin(F.broadcast(total))  # one row
    rec = F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(F.lit(1.0))
    return joined.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": rec})


def _neighbour(keys: list[str], value: Column, out: str, curve: DataFrame) -> DataFrame:
    """Adds ``value`` at the next higher threshold of the curve, null at the highest; inside pieces of its thresholds."""
    rows = curve if "_range" in curve.columns else in_ranges(kept(curve), [*keys, "thr"])
    inside = Window.partitionBy(*keys, "_range").orderBy("thr")
    rows = rows.withColumn("_in", F.lead(value).over(inside))
    first = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_piece")).agg(F.min_by(value, "thr").alias("_first"))
    order = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_piece")
    first = first.withColumn("_next", F.lead("_first").over(order)).drop("_first")
    on = F.col("_range") == F.col("_piece")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(first, on).withColumn(out, F.coalesce("_in", "_next")).drop("_in", "_piece", "_next", *[f"_{k}" for k in keys])


def average_precision(curve: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, ap): the sum of recall steps times precision over distinct scores; 0 without positives."""
    keys = list(keys)
    stepped = _neighbour(keys, F.col("recall"), "_above", curve)
    part = F.when(F.col("positives") > 0, (F.col("recall") - F.coalesce("_above", F.lit(0.0))) * F.col("precision")).otherwise(F.lit(0.0))
    return stepped.groupBy(*keys).agg(F.sum(part).alias("ap"))


def choose_threshold(
    curve: DataFrame,
    keys: list[str] = (),
    policy: str = "f1",
    beta: float = 1.0,
    min_precision: float | None = None,
    min_recall: float | None = None,
    pairing: str = "reference",
) -> DataFrame:
    """Per key: thr, precision, recall, f1, fbeta, ap of the best threshold under a policy.

    Policies are f1, fbeta, recall_at_precision and precision_at_recall. Thresholds below a required precision or recall
    are left out unless that leaves none. Thresholds whose score is within 1e-12 + 1e-5 * best count as equal; of them
    precision, then recall, then threshold decide, the larger first. With pairing ``reference`` a threshold is judged by
    the curve's point at the next higher score (precision 1 and recall 0 at the highest), with ``aligned`` by its own.
    An error if a curve has fewer than LEAST_ROWS rows.
    """
    keys = list(keys)
    if policy not in ("f1", "fbeta", "recall_at_precision", "precision_at_recall"):
        raise ValueError(f"unknown policy {policy}")
    if pairing not in ("reference", "aligned"):
        raise ValueError(f"unknown pairing {pairing}")
    rows = _neighbour(keys, F.struct("precision", "recall"), "_p", curve)
    above = F.coalesce("_p.recall", F.lit(0.0))
    rows = rows.withColumn("_step", F.when(F.col("positives") > 0, (F.col("recall") - above) * F.col("precision")).otherwise(F.lit(0.0)))
    if pairing == "reference":
        rows = rows.withColumns({"precision": F.coalesce("_p.precision", F.lit(1.0)), "recall": above})
    rows = rows.withColumns({"f1": f_beta(F.col("precision"), F.col("recall")), "fbeta": f_beta(F.col("precision"), F.col("recall"), beta)})
    allowed = F.lit(True)
    if min_precision is not None:
        allowed &= F.col("precision") >= float(min_precision)
    if min_recall is not None:
        allowed &= F.col("recall") >= float(min_recall)
    value = F.col({"f1": "f1", "fbeta": "fbeta", "recall_at_precision": "recall", "precision_at_recall": "precision"}[policy])
    rows = kept(rows.withColumns({"_ok": allowed, "_value": value}).drop("_p"))
    enough = F.assert_true(F.min("n") >= LEAST_ROWS, F.lit("too few samples to choose a threshold"))
    best = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.max(F.when(F.col("_ok"), F.col("_value"))).alias("_best_ok"), F.max("_value").alias("_best_all"), F.sum("_step").alias("_ap"), enough.alias("_enough")
    )
    on = F.col("_enough").isNull()
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    rows = rows.join(best, on) if keys else rows.crossJoin(F.broadcast(best)).where(on)  # one row
    top = F.coalesce("_best_ok", "_best_all")
    rows = rows.where((F.col("_best_ok").isNull() | F.col("_ok")) & (F.abs(F.col("_value") - top) <= 1e-12 + 1e-5 * F.abs(top)))
    pick = F.max(F.struct("precision", "recall", "thr", "f1", "fbeta", F.col("_ap").alias("ap"))).alias("_pick")
    return rows.groupBy(*keys).agg(pick).select(*keys, "_pick.thr", "_pick.precision", "_pick.recall", "_pick.f1", "_pick.fbeta", "_pick.ap")
