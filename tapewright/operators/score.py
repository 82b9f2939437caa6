"""Scaling, weights and two-stage scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gated
from ..schema import FEATURES, GATE, SECOND_GATE


def fit_scaler(train: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """One row (feature, mu, sd) per column: mean and population deviation plus 1e-8."""
    stats = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mu"), (F.stddev_pop(c) + 1e-8).alias("sd")) for c in columns]
    return train.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def scale(df: DataFrame, scaler: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """``df``, which may be a stream, with each column standardised by the scaler's row for it; no job runs for that."""
    one = scaler.agg(*[F.max(F.when(F.col("feature") == c, F.struct("mu", "sd"))).alias(f"_of_{c}") for c in columns])
    both = df.crossJoin(F.broadcast(one))  # one row
    return both.withColumns({c: (F.col(c) - F.col(f"_of_{c}.mu")) / F.col(f"_of_{c}.sd") for c in columns}).drop(*one.columns)


def feature_vector(values: Column, size: int = len(FEATURES)) -> Column:
    """The first ``size`` entries of an array; an error where it is shorter."""
    return F.when(F.assert_true(F.size(values) >= size, F.lit("feature vector too short")).isNull(), F.slice(values, 1, size))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """One row: n, pos, neg, prior_pos, prior_neg, scale_pos_weight, weight_pos, weight_neg (balanced). Error without positives."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == 1).alias("pos"))
    checked = counts.where(F.assert_true(F.col("pos") > 0, F.lit("no positive rows")).isNull())
    neg = F.col("n") - F.col("pos")
    return checked.select(
        "n",
        "pos",
        neg.alias("neg"),
        (F.col("pos") / F.col("n")).alias("prior_pos"),
        (neg / F.col("n")).alias("prior_neg"),
        (neg / F.col("pos")).alias("scale_pos_weight"),
        (F.col("n") / (2 * F.col("pos"))).alias("weight_pos"),
        F.try_divide(F.col("n"), 2 * neg).alias("weight_neg"),
    )


def gate(df: DataFrame, tau: float | Column = GATE, tau2: float | Column = SECOND_GATE, force: bool = False) -> DataFrame:
    """Adds yhat and, below the gate and unless forced, empties p2."""
    p2, label = gated(F.col("p1"), F.col("p2"), tau, tau2, force)
    return df.withColumns({"p2": p2, "yhat": label})


def gated_transform(df: DataFrame, second: Callable[[DataFrame], DataFrame], tau: float = GATE, tau2: float = SECOND_GATE) -> DataFrame:
    """The gate with a second model that only sees the rows that pass; ``second`` adds p2."""
    stay = df.where(F.coalesce(F.col("p1") < tau, F.lit(True))).withColumns({"p2": F.lit(None).cast("double"), "yhat": F.lit(0)})
    go = second(df.where(F.col("p1") >= tau))
    return stay.unionByName(go.withColumn("yhat", F.when(F.col("p2") >= tau2, 2).otherwise(1)).select(*stay.columns))


def threshold(argument: float | None, tuned: Column, default: float) -> Column:
    """An explicit threshold before a tuned one before the default."""
    return F.coalesce(F.lit(argument).cast("double"), tuned, F.lit(float(default)))
