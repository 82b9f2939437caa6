"""Which columns of a table are label, features and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES

# Names that are looked for, in this order.
LABELS = ["y", "label", "labels", "y_true", "target", "class"]
TIMES = ["sec", "timestamp", "ts", "time", "t"]


def infer_label_col(df: DataFrame) -> str:
    """The first known name whose values, apart from nulls, are all 0, 1 or 2; one pass over the candidates.

    A column of nulls alone is no label.
    """
    named = [c for c in LABELS if c in df.columns]
    if named:
        known = {c: F.coalesce(F.col(c).try_cast("double").isin(0.0, 1.0, 2.0), F.lit(False)) for c in named}
        fits = df.agg(*[F.bool_and(F.when(F.col(c).isNotNull(), ok)).alias(c) for c, ok in known.items()]).first()
        for c in named:
            if fits[c]:
                return c
    raise ValueError(f"no label column among {df.columns}")


def infer_feature_cols(df: DataFrame, explicit: list[str] | None = None) -> list[str]:
    """The given columns or else the six configured ones; an error if any is missing."""
    wanted = explicit or FEATURES
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns {missing}")
    return list(wanted)


def infer_time_col(df: DataFrame) -> str | None:
    return next((c for c in TIMES if c in df.columns), None)
