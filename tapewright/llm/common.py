"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space and the ASCII controls from tab to carriage return.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark only, so any Hadoop path works.

    A table of fewer splits than the cluster has cores is dealt out to them; large tables are left as they are.
    """
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent in local mode (tests) a temporary folder takes its place; on a cluster that is an
    error. ``clear_work`` deletes the folders again.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tapewright-{uuid.uuid4().hex}"
    _WORK.append(path)
    return path


_WORK: list[str] = []


def clear_work(spark: SparkSession, first: int = 0, end: int | None = None) -> None:
    """Deletes this session's work folders, or those from ``first`` to ``end``. Results read from them must be used up."""
    for path in _WORK[first:end]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _WORK[first:end]


def work_count() -> int:
    """How many work folders there are, for ``clear_work``."""
    return len(_WORK)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends there and lost executors cost no recomputation."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an id and one or two small values that a broadcast may hold: some MB.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, path: str) -> DataFrame:
    """``df``, short rows, written and counted; broadcast if it is small enough, else left to a shuffle."""
    df = written(df, path)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def unused(df: DataFrame, name: str) -> str:
    """``name`` or, where ``df`` has such a column, the name with underscores."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, at_most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``at_most`` labelled documents outside the held-out fold.

    The sample is the rows of least hashed id, the same whatever the partitioning. Null ids, null
    labels and labels other than 0 and 1 take no part; of several labels of one id the largest holds. Of several texts
    of one id the one of least hash is taken, so that repeated ids don't grow the sample.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
        .groupBy(F.col("doc_id").alias("s_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("s_id"), "s_id")
        .limit(at_most)
    )
    # at_most rows of two numbers: a bound that doesn't depend on the data
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), F.col("doc_id") == F.col("s_id"))
    # keeps one text for each id and task, so a repeated id isn't gathered before it is reduced
    one = found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("y").alias("y"))
    return one.select("doc_id", "text", "y")


def in_parts(texts: pa.Array, rows: int = 256) -> Iterator[list[str | None]]:
    """The texts of a batch as lists of so many, so that no more of them are held as Python strings at once."""
    for i in range(0, len(texts), rows):
        yield texts.slice(i, rows).to_pylist()


def keep_by_text(docs: DataFrame, keep: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, with all columns, for which ``keep(texts)`` is true; no shuffle.

    ``keep`` gets null texts as None, some at a time. Repeated rows are asked for one by one; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(np.concatenate([keep(part) for part in in_parts(batch["text"])]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """One object for each Python worker, kept from task to task; one of another name takes its place.

    Workers outlive jobs, so without that the memos of one job would stay in memory during the next.
    """
    if name not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[name] = make()
    return _HELD[name]


class Recent(dict):
    """A bounded memo: two generations, the older one dropped when the younger one is full.

    ``make(key)`` fills what is missing; ``self[key]`` is a plain C-level lookup for what is there. Values of keys
    longer than ``longest``, if given, are made each time.
    """

    def __init__(self, make, at_most: int, longest: int | None = None):
        super().__init__()
        self.make, self.at_most, self.longest, self.old = make, at_most, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.at_most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
