"""Horizon labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shock_label, shock_threshold
from ..schema import ALPHA, HORIZON
from ..sources.work import kept
from .quantile import percentile_columns
from .scale import halo_window


def forward_return(feats: DataFrame, horizon: int = HORIZON, chunk: int = 10_352) -> DataFrame:
    """Adds future_r: the sum of the next ``horizon`` returns of the symbol, null where there are fewer."""

    def ahead(w):
        frame = w.rowsBetween(1, horizon)
        return {"future_r": F.when(F.count("r_t").over(frame) == horizon, F.sum("r_t").over(frame))}

    return halo_window(feats, "symbol", 0, horizon, ahead, max(chunk, horizon))


def shock_labels(feats: DataFrame, horizon: int = HORIZON, alpha: float = ALPHA) -> DataFrame:
    """Rows that have a full horizon, with future_r and y: 1 a fall, 2 a rise beyond alpha deviations, 0 neither."""
    rows = forward_return(feats, horizon).where(F.col("future_r").isNotNull())
    return rows.withColumn("y", shock_label(F.col("future_r"), shock_threshold(F.col("sigma_hat"), alpha, horizon)))


def stage_targets(labelled: DataFrame) -> DataFrame:
    """Adds y1 (a shock or not) and y2 (a rise or a fall; null where there is no shock)."""
    return labelled.withColumn("y1", (F.col("y") != 0).cast("int")).withColumn("y2", F.when(F.col("y") != 0, (F.col("y") == 2).cast("int")))


def require_shocks(labelled: DataFrame) -> DataFrame:
    """The stage-2 rows; an error if there are none."""
    shocks = labelled.where(F.col("y") != 0)
    if shocks.isEmpty():
        raise ValueError("no shock among the labelled rows: stage 2 can't be fitted")
    return shocks


def alpha_sweep(feats: DataFrame, alphas: list[float], horizon: int = HORIZON) -> DataFrame:
    """Per alpha: labelled rows, shocks by side with rates, and percentiles of the shocks' absolute future return.

    ``alphas`` are a handful of numbers, unrolled in each row; the two columns that they apply to are written once.
    """
    rows = kept(forward_return(feats, horizon).where(F.col("future_r").isNotNull()).select("future_r", "sigma_hat"))
    rows = rows.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    y = shock_label(F.col("future_r"), shock_threshold(F.col("sigma_hat"), F.col("alpha"), horizon))
    rows = rows.withColumn("y", y).withColumn("size", F.when(y != 0, F.abs("future_r")))
    out = rows.groupBy("alpha").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("y") != 0).alias("shocks"),
        F.count_if(F.col("y") == 1).alias("neg"),
        F.count_if(F.col("y") == 2).alias("pos"),
    ).join(percentile_columns(rows, "size", [0.5, 0.9, 0.99], ["alpha"]), "alpha", "left")
    share = lambda c: F.col(c) / F.col("n")
    return out.withColumns({"shock_rate": share("shocks"), "neg_rate": share("neg"), "pos_rate": share("pos"), "pos_neg_ratio": F.try_divide("pos", "neg")})
