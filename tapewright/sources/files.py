"""Flush files, labelled rows, thresholds, results, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import artifact_tag
from ..operators.features import flush_index
from ..operators.score import threshold
from ..schema import FEATURES, FLUSH_ROWS, GATE, SECOND_GATE, THRESHOLDS


def write_flush(df: DataFrame, path: str, rows: int = FLUSH_ROWS) -> None:
    """Writes features with idx by symbol, in files of ``rows`` rows in bar order, and a manifest of the files.

    A task holds whole flushes of a symbol in their order, so files are cut just where flushes end. The manifest, a
    table beside them, has a row for each file: symbol, flush_idx, file (below ``path``), rows, first and last sec.
    """
    numbered = flush_index(df, rows)
    numbered = numbered.repartitionByRange("symbol", "flush_idx").sortWithinPartitions("symbol", "flush_idx", "idx")
    numbered.write.mode("overwrite").partitionBy("symbol").option("maxRecordsPerFile", rows).parquet(f"{path}/flush")
    spark = df.sparkSession
    written = spark.read.schema(numbered.schema).parquet(f"{path}/flush")
    place = F.expr("concat('flush/', substring_index(_metadata.file_path, '/flush/', -1))")
    each = written.select("symbol", "flush_idx", "sec", place.alias("file")).groupBy("symbol", "file")
    manifest = each.agg(F.min("flush_idx").alias("flush_idx"), F.count(F.lit(1)).alias("rows"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"), (F.min("flush_idx") == F.max("flush_idx")).alias("whole"))
    manifest.write.mode("overwrite").partitionBy("symbol").parquet(f"{path}/manifest")


def flush_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_flush`` keeps of its files."""
    return spark.read.schema("file string, flush_idx long, rows long, first_sec timestamp, last_sec timestamp, whole boolean, symbol string").parquet(f"{path}/manifest")


def _newest(listed: DataFrame, n: int) -> list[str]:
    """Files (file, _idx, rows), the newest first, that hold ``n`` rows; fewer if all don't."""
    top = listed.where("rows > 0").orderBy(F.desc("_idx"), F.desc("file")).limit(n).collect()  # n rows lie in n files at most
    out, held = [], 0
    for r in top:
        if held >= n:
            break
        out.append(r["file"])
        held += r["rows"]
    return out if held >= n else []


def read_tail(spark: SparkSession, path: str, symbol: str, n: int, cols: list[str] | None = None, time_sort: bool = False, time_col: str = "sec") -> DataFrame:
    """The last ``n`` rows of a symbol's flush files, oldest first; only the newest files that hold them are opened.

    Which these are the manifest tells; a folder without one, of files from elsewhere, is listed, and rows of all its
    files are counted (from their footers). Errors: n below 1, no file, a missing column, fewer than n rows. Files are
    ordered by the number in their path or manifest; paths without one come last. ``time_sort`` orders the rows that
    were read by ``time_col``.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    base, number = path.rstrip("/"), F.expr(r"try_cast(nullif(regexp_extract(file, 'flush_(?:idx=)?([0-9]+)', 1), '') AS BIGINT)")
    last = F.lit((1 << 63) - 1)
    if _exists(spark, f"{base}/manifest"):
        listed = flush_manifest(spark, base).where(F.col("symbol") == symbol).withColumn("_idx", F.col("flush_idx"))
        listed, found = listed.withColumn("file", F.concat(F.lit(f"{base}/"), "file")), not listed.isEmpty()
    else:
        root = f"{base}/symbol={symbol}"
        found = _exists(spark, root)
        if found:
            every = spark.read.option("recursiveFileLookup", "true").parquet(root)
            listed = every.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows")).withColumn("_idx", F.coalesce(number, last))
    if not found:
        raise FileNotFoundError(f"no flush files of {symbol} in {path}")
    wanted = _newest(listed, n)
    if not wanted:
        raise ValueError(f"fewer than {n} rows of {symbol} in {path}")
    df = spark.read.parquet(*wanted)
    cols = cols or [c for c in FEATURES if c in df.columns]
    missing = [c for c in [*cols, *([time_col] if time_sort else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    rows = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("_row"))
    nth = F.col("flush_idx") if "flush_idx" in df.columns else F.coalesce(number, last)
    tail = rows.withColumn("_idx", nth).orderBy(F.desc("_idx"), F.desc("file"), F.desc("_row")).limit(n)
    order = [time_col, "_idx", "_row"] if time_sort else ["_idx", "file", "_row"]
    return tail.orderBy(*order).select(*cols)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_labeled(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_labeled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows from Parquet or, by the path's ending, CSV with a header."""
    if path.rstrip("/").endswith(".csv"):
        kinds = "symbol string, sec timestamp, " + ", ".join(f"{c} double" for c in FEATURES) + ", future_r double, y int"
        return spark.read.option("header", True).option("enforceSchema", False).schema(kinds).csv(path)
    return spark.read.parquet(path)


def write_results(parts: dict[str, DataFrame], path: str) -> None:
    """CSV per name and, as FULL, all together, from the written parts; each part is computed once."""
    full = None
    for name, df in parts.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        kinds = ", ".join(f"`{c}` string" for c in df.columns)
        again = df.sparkSession.read.option("header", True).schema(kinds).csv(f"{path}/{name}")
        full = again if full is None else full.unionByName(again, allowMissingColumns=True)
    if full is not None:
        full.write.mode("overwrite").option("header", True).csv(f"{path}/FULL")


def write_thresholds(
    rows: DataFrame,
    path: str,
    tag: str,
    policy: str = "f1",
    beta: float = 1.0,
    min_precision: float | None = None,
    min_recall: float | None = None,
    use_logit_adjust: bool = False,
    la_tau: float = 1.0,
) -> None:
    """One JSON document from rows (model, stage, thr, precision, recall, f1, fbeta, ap); a handful of rows.

    The policy and its limits stand once for the document and with each threshold; absent limits are left out.
    """
    limits = [F.lit(min_precision).cast("double").alias("min_precision"), F.lit(min_recall).cast("double").alias("min_recall")]
    value = F.struct("thr", "precision", "recall", "f1", "fbeta", "ap", F.lit(policy).alias("policy"), F.lit(beta).alias("beta"), *limits)
    stages = rows.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("stage", value))).alias("stages"))
    models = stages.agg(F.map_from_entries(F.collect_list(F.struct("model", "stages"))).alias("models"))
    doc = models.select(F.to_json(F.struct(F.lit(tag).alias("tag"), F.lit(policy).alias("thr_policy"), F.lit(beta).alias("beta"), *limits, F.lit(use_logit_adjust).alias("use_logit_adjust"), F.lit(la_tau).alias("la_tau"), "models")).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(tag, model, stage, thr, ...) of a thresholds document."""
    doc = spark.read.schema(THRESHOLDS).option("multiLine", True).json(path)
    per = doc.select("tag", F.explode("models").alias("model", "stages")).select("tag", "model", F.explode("stages").alias("stage", "t"))
    return per.select("tag", "model", "stage", "t.*")


def gates_by_model(thresholds: DataFrame, tau: float | None = None, tau2: float | None = None) -> DataFrame:
    """(model, tau, tau2) from rows (model, stage, thr): an argument before a tuned threshold before the default."""
    tuned = thresholds.groupBy("model").agg(F.max(F.when(F.col("stage") == "s1", F.col("thr"))).alias("a"), F.max(F.when(F.col("stage") == "s2", F.col("thr"))).alias("b"))
    return tuned.select("model", threshold(tau, F.col("a"), GATE).alias("tau"), threshold(tau2, F.col("b"), SECOND_GATE).alias("tau2"))


def tuned_gates(spark: SparkSession, path: str, model: str) -> tuple[float, float]:
    """(tau, tau2) of a model; the defaults where the document is absent, is no such document or lacks them.

    Other errors, such as a missing permission, aren't taken for an absent file.
    """
    found = {}
    if _exists(spark, path):
        found = {r["stage"]: r["thr"] for r in read_thresholds(spark, path).where(F.col("model") == model).collect()}
    return found.get("s1") or GATE, found.get("s2") or SECOND_GATE


def tag_expr(horizon: int, alpha: float, lam: float):
    """The artifact tag as a column."""
    return artifact_tag(F.lit(horizon), F.lit(float(alpha)), F.lit(float(lam)))


def save_model(model: PipelineModel, scaler: DataFrame, path: str, tag: str) -> None:
    model.write().overwrite().save(f"{path}/{tag}/model")
    scaler.write.mode("overwrite").parquet(f"{path}/{tag}/scaler")


def load_model(spark: SparkSession, path: str, tag: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/{tag}/model"), spark.read.parquet(f"{path}/{tag}/scaler")
