"""Evaluation tables: classification reports, gate rates, latency and throughput summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import f1, precision, recall, tail_ratio
from .quantile import percentile_columns


def binary_prf(df: DataFrame, truth: Column, predicted: Column, keys: list[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of a yes/no prediction; 0 where undefined."""
    rows = df.select(*keys, truth.alias("_t"), predicted.alias("_p"))
    out = rows.groupBy(*keys).agg(
        F.count_if(F.col("_t") & F.col("_p")).alias("tp"), F.count_if(~F.col("_t") & F.col("_p")).alias("fp"), F.count_if(F.col("_t") & ~F.col("_p")).alias("fn")
    )
    p, r = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    return out.withColumns({"precision": p, "recall": r, "f1": f1(p, r)})


def two_stage_prf(scored: DataFrame, tau: float | Column, tau2: float | Column, population: str = "predicted", keys: list[str] = ()) -> DataFrame:
    """Per key both stages' precision, recall and F1. Stage 2 is measured over ``predicted`` shocks or over ``true`` ones."""
    if population not in ("predicted", "true"):
        raise ValueError(f"unknown population {population}")
    first = binary_prf(scored, F.col("y") != 0, F.col("p1") >= tau, keys).withColumn("stage", F.lit(1))
    rows = scored.where(F.col("p1") >= tau) if population == "predicted" else scored.where(F.col("y") != 0)
    second = binary_prf(rows, F.col("y") == 2, F.col("p2") >= tau2, keys).withColumn("stage", F.lit(2))
    return first.unionByName(second)


def classification_report(df: DataFrame, classes: list[int], truth: str = "y", predicted: str = "yhat") -> DataFrame:
    """Per class and for accuracy, macro and weighted averages: precision, recall, f1, support. Empty classes stay."""
    confusion = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).count()
    sums = []
    for c in classes:
        for name, rule in (("tp", (F.col("t") == c) & (F.col("p") == c)), ("pp", F.col("p") == c), ("support", F.col("t") == c)):
            sums.append(F.coalesce(F.sum(F.when(rule, F.col("count"))), F.lit(0)).alias(f"{name}{c}"))
    one = confusion.agg(*sums, F.coalesce(F.sum(F.when(F.col("t") == F.col("p"), F.col("count"))), F.lit(0)).alias("right"), F.coalesce(F.sum("count"), F.lit(0)).alias("all"))
    per = []
    for c in classes:
        p, r = F.coalesce(F.try_divide(F.col(f"tp{c}"), F.col(f"pp{c}")), F.lit(0.0)), F.coalesce(F.try_divide(F.col(f"tp{c}"), F.col(f"support{c}")), F.lit(0.0))
        per.append((p, r, f1(p, r), F.col(f"support{c}")))
    n = len(classes)
    total = F.col("all")
    mean = [sum((x[i] for x in per), F.lit(0.0)) / n for i in range(3)]
    weighted = [F.coalesce(F.try_divide(sum((x[i] * x[3] for x in per), F.lit(0.0)), total), F.lit(0.0)) for i in range(3)]
    accuracy = F.coalesce(F.try_divide(F.col("right"), total), F.lit(0.0))
    lines = [(str(c), *x) for c, x in zip(classes, per)] + [("accuracy", accuracy, accuracy, accuracy, total), ("macro avg", *mean, total), ("weighted avg", *weighted, total)]
    cells = [F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support")) for name, p, r, f, s in lines]
    return one.select(F.inline(F.array(*cells)))


def normalised_latency(df: DataFrame) -> DataFrame:
    """Fills A_ms from its two parts, absent stages with 0 and an absent total with the sum."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    zero = F.lit(0.0)
    a = F.coalesce(has("A_ms"), F.coalesce(has("A_update_ms"), zero) + F.coalesce(has("A_fetch_ms"), zero))
    out = df.withColumns({"A_ms": a, "B1_ms": F.coalesce(has("B1_ms"), zero), "B2_ms": F.coalesce(has("B2_ms"), zero)})
    return out.withColumn("total_ms", F.coalesce(has("total_ms"), F.col("A_ms") + F.col("B1_ms") + F.col("B2_ms")))


def latency_summary(df: DataFrame, keys: list[str], ms: str = "total_ms", deadline: float = 10.0, exact: bool = True) -> DataFrame:
    """n, mean, p50, p90, p95, p99 and the share beyond the deadline; ``exact=False`` sketches the percentiles."""
    shares = [0.5, 0.9, 0.95, 0.99]
    sketched = [] if exact else [F.percentile_approx(ms, s).alias(f"p{int(100 * s)}") for s in shares]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(ms).alias("mean"), *sketched, F.avg((F.col(ms) > deadline).cast("double")).alias("miss_rate"))
    return out.join(percentile_columns(df, ms, shares, keys), keys, "left") if exact else out


def tail_comparison(summary: DataFrame, keys: list[str], side: str, fast: str, slow: str) -> DataFrame:
    """Per key the two sides' p99 and mean, their ratio (gain), difference and whether the fast side was slower."""
    a = summary.where(F.col(side) == fast).select(*keys, F.col("p99").alias("fast_p99"), F.col("mean").alias("fast_mean"))
    b = summary.where(F.col(side) == slow).select(*keys, F.col("p99").alias("slow_p99"), F.col("mean").alias("slow_mean"))
    diff = F.col("fast_mean") - F.col("slow_mean")
    return a.join(b, keys).withColumns({"gain": tail_ratio(F.col("slow_p99"), F.col("fast_p99")), "diff": diff, "fast_is_slower": diff > 0})


def gate_rate(scored: DataFrame, taus: list[float], keys: list[str] = ()) -> DataFrame:
    """Per key and tau the share of rows that go on to stage 2; the few taus are unrolled in each row."""
    rows = scored.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    return rows.groupBy(*keys, "tau").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p1") >= F.col("tau")).cast("double")).alias("inv_rate"))


def throughput(df: DataFrame, keys: list[str], start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Operations per second over the time from the first start to the last end."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.count(F.lit(1)), F.max(end) - F.min(start)).alias("ops_per_s"))


def trial_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Over repeated trials: trials, mean, least and largest p50 and p99."""
    aggs = [f(c).alias(f"{c}_{n}") for c in ("p50", "p99") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), *aggs)
