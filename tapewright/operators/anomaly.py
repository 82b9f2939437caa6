"""Unsupervised anomaly flags and how far they agree with shock labels."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.models import Trees
from ..schema import FEATURES
from ..sources.work import kept
from .quantile import exact_percentiles


def _values(df: DataFrame, columns: list[str], share: float) -> dict[str, float | None]:
    """One exact percentile of each column; null without values."""
    return dict.fromkeys(columns) | {r["column"]: r["value"] for r in exact_percentiles(df, columns, [share]).collect()}


def robust_z(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_z for each: the distance from the median in median absolute deviations.

    ``df`` should be cheap to read again: medians and deviations take two passes each and one row for each column.
    """
    m = _values(df, columns, 0.5)
    d = _values(df.select(*[F.abs(F.col(c) - F.lit(m[c])).alias(c) for c in columns]), columns, 0.5)
    return df.withColumns({f"{c}_z": (F.col(c) - F.lit(m[c])) / (F.lit(d[c]) + 1e-12) for c in columns})


def top_share_flags(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """Adds <column>_flag for each: whether the value is at or above the (1 - share) percentile. Reads ``df`` twice more."""
    cut = _values(df, columns, 1 - share)
    return df.withColumns({f"{c}_flag": F.col(c) >= F.lit(cut[c]) for c in columns})


def robust_z_flags(labelled: DataFrame) -> DataFrame:
    """Adds is_shock and four flags, each set for as large a share of rows as there are shocks.

    The rows are written once with their three scores, so the passes for medians and cuts don't compute them again.
    """
    rows = labelled.withColumns(
        {"is_shock": F.col("y") != 0, "abs_return": F.abs("r_t"), "return_over_sigma": F.abs("r_t") / F.col("sigma_hat"), "volspike": F.col("VolSpike_t")}
    )
    rows = kept(rows)
    share = rows.agg(F.avg(F.col("is_shock").cast("double")).alias("s")).first()["s"] or 0.0
    names = ["abs_return", "return_over_sigma", "volspike"]
    flagged = top_share_flags(robust_z(rows, names), [f"{n}_z" for n in names], share)
    flagged = flagged.withColumnsRenamed({f"{n}_z_flag": f"{n}_flag" for n in names})
    return flagged.withColumn("return_or_volspike_flag", F.col("abs_return_flag") | F.col("volspike_flag"))


def proxy_overlap(flagged: DataFrame, flags: list[str], truth: str = "is_shock") -> DataFrame:
    """Per flag: tp, fp, fn, tn, precision, recall, jaccard, agreement and both rates; all flags in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("method"), F.col(f).alias("flag")) for f in flags])
    rows = flagged.select(F.col(truth).alias("t"), F.inline(pairs))
    out = rows.groupBy("method").agg(
        F.count_if(F.col("t") & F.col("flag")).alias("tp"),
        F.count_if(~F.col("t") & F.col("flag")).alias("fp"),
        F.count_if(F.col("t") & ~F.col("flag")).alias("fn"),
        F.count_if(~F.col("t") & ~F.col("flag")).alias("tn"),
    )
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.withColumns(
        {
            "precision": share(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": share(F.col("tp"), F.col("tp") + F.col("fn")),
            "jaccard": share(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")),
            "agreement": share(F.col("tp") + F.col("tn"), n),
            "anomaly_rate": share(F.col("tp") + F.col("fp"), n),
            "proxy_rate": share(F.col("tp") + F.col("fn"), n),
        }
    )


def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> dict:
    """A tree of random cuts as arrays, see ``functions.models.Trees``; a leaf's value is the path length it stands for."""
    tree = {"f": [-1] * ((1 << depth) - 1), "t": [0.0] * ((1 << depth) - 1), "m": [True] * ((1 << depth) - 1), "v": [0.0] * (1 << depth)}
    todo = [(0, 0, np.arange(len(x)))]
    while todo:
        at, level, rows = todo.pop()
        lo, hi = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        if level == depth or len(rows) <= 1 or (lo == hi).all():
            tree["v"][(at + 1) * (1 << (depth - level)) - (1 << depth)] = float(level + _mean_path(len(rows)))
            continue
        f = int(rng.choice(np.flatnonzero(hi > lo)))
        cut = float(min(rng.uniform(lo[f], hi[f]), np.nextafter(hi[f], lo[f])))
        tree["f"][at], tree["t"][at] = f, cut
        left = x[rows, f] <= cut
        todo += [(2 * at + 2, level + 1, rows[~left]), (2 * at + 1, level + 1, rows[left])]
    return tree


def path_lengths(trees: list[dict], depth: int, x: np.ndarray) -> np.ndarray:
    """The mean leaf value of each row, walked level by level for all rows at once; missing values go left."""
    total = np.zeros(len(x))
    for tree in trees:
        f, t, v = np.array(tree["f"]), np.array(tree["t"]), np.array(tree["v"])
        at = np.zeros(len(x), np.int64)
        for _ in range(depth):
            value = x[np.arange(len(x)), np.maximum(f[at], 0)]
            at = 2 * at + np.where((f[at] < 0) | np.isnan(value) | (value <= t[at]), 1, 2)
        total += v[at - ((1 << depth) - 1)]
    return total / max(len(trees), 1)


def _mean_path(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def _largest_hash(n: int, sample: int) -> int:
    """The 64-bit hash up to which more than ``sample`` of ``n`` rows lie, all but surely."""
    return min(2**63 - 1, (2**64 * (2 * sample + 64)) // max(n, 1) - 2**63)


def isolation_forest(df: DataFrame, columns: list[str] = FEATURES, trees: int = 50, sample: int = 256, seed: int = 7, key: list[str] | None = None) -> tuple[Trees, float]:
    """(trees of mean path lengths, the usual path length), each tree grown from ``sample`` random rows.

    One hash of a row's ``key`` (all columns by default) decides whether it is in a pool of about 2 * trees * sample
    rows, or all if there are fewer. Only the pool is dealt out to trees, which draw their rows from it by a hash of row
    and tree, limited in every task first; trees grow in parallel. Rows equal in ``key`` are drawn together. All trees
    together are trees * 2 * sample nodes at most, which is what reaches the driver.
    """
    depth = int(np.ceil(np.log2(max(sample, 2))))
    pool = df.select(F.xxhash64(*(key or df.columns)).alias("row_hash"), *columns).where(F.xxhash64("row_hash", F.lit(seed)) <= _largest_hash(df.count(), trees * sample))
    each = pool.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "row_hash", *columns)
    least = Window.partitionBy("tree").orderBy(F.xxhash64("row_hash", "tree", F.lit(seed)), *columns)
    picked = each.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= sample).select("tree", *columns)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["tree"].iloc[0])
        x = np.nan_to_num(pdf.sort_values(columns)[columns].to_numpy(float))
        return pd.DataFrame({"tree": [number], "body": [json.dumps(_grow(x, depth, np.random.default_rng(seed + number)))], "n": [len(x)]})

    found = picked.groupBy("tree").applyInPandas(fit, "tree int, body string, n long").orderBy("tree").collect()  # a row for each tree
    usual = float(np.mean([_mean_path(r["n"]) for r in found])) if found else 1.0
    return Trees(tuple(columns), depth, tuple(json.loads(r["body"]) for r in found), "shares"), max(usual, 1e-9)


def isolation_scores(df: DataFrame, columns: list[str] = FEATURES, trees: int = 50, sample: int = 256, seed: int = 7, key: list[str] | None = None) -> DataFrame:
    """Adds score, from 0 to 1, higher where few random cuts isolate a row; see ``isolation_forest``."""
    forest, usual = isolation_forest(df, columns, trees, sample, seed, key)
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = path_lengths(shared.value.trees, shared.value.depth, pdf[columns].to_numpy(float))
            yield pdf.assign(score=2.0 ** (-lengths / usual))

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", score double"
    return df.mapInPandas(score, schema)
