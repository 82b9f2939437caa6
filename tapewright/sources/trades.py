"""Trades from chunk files, from live messages and from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import epoch_ms, parse_ts
from ..schema import MESSAGE

CHUNK_COLUMNS = ["ts", "price", "qty", "is_buyer_maker"]


def read_trades(spark: SparkSession, path: str, symbol: str | None = None, pattern: str = "chunk_*.parquet") -> DataFrame:
    """The files of a folder with names like ``pattern``; an error if there are none or a column is missing. Rows without a time go."""
    df = spark.read.option("pathGlobFilter", pattern).parquet(path)
    missing = [c for c in CHUNK_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit(symbol or ""))
    kind = dict(df.dtypes)["ts"]
    ts = F.col("ts").cast("timestamp") if kind.startswith("timestamp") else parse_ts(F.col("ts"))
    return df.select("symbol", ts.alias("ts"), F.col("price").cast("double"), F.col("qty").cast("double"), F.col("is_buyer_maker").cast("boolean")).where("ts IS NOT NULL")


def parse_messages(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(trades, rest) from JSON messages in a string column; what has no time or no number for a price is the rest."""
    m = lines.select(column, F.from_json(column, MESSAGE, {"mode": "PERMISSIVE"}).alias("m"))
    price, qty = F.expr("try_cast(m.p AS DOUBLE)"), F.expr("try_cast(m.q AS DOUBLE)")
    good = F.col("m.T").isNotNull() & price.isNotNull() & qty.isNotNull()
    rows = m.where(good).select(F.lower("m.s").alias("symbol"), epoch_ms(F.col("m.T")).alias("ts"), price.alias("price"), qty.alias("qty"), F.coalesce("m.m", F.lit(False)).alias("is_buyer_maker"))
    return rows, m.where(~F.coalesce(good, F.lit(False))).select(column)


def read_messages_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> tuple[DataFrame, DataFrame]:
    """Two streams from files of JSON lines: trades, and the lines that are none, for a table of their own."""
    return parse_messages(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def read_trades_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The trades of ``read_messages_stream``."""
    return read_messages_stream(spark, path, files_per_batch)[0]


def trades_of_events(events: DataFrame) -> DataFrame:
    """The events table read as trades: type as symbol, value as price, the number in props as quantity."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)").alias("qty"),
        (F.col("user_id") % 2 == 1).alias("is_buyer_maker"),
    )


def trades_of_lineitem(lineitem: DataFrame) -> DataFrame:
    """The lineitem table read as trades: return flag as symbol, unit price, ship date."""
    return lineitem.select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_linestatus") == "F").alias("is_buyer_maker"),
    )


def replay(features: DataFrame, copies: int, ticks: int | None = None, stride: int = 50, warmup: int = 0, bases: list[str] | None = None) -> DataFrame:
    """A round-robin replay of ``copies`` shifted copies of series: (t, sym, base, idx) with the features at idx.

    Tick t belongs to copy t % copies, which reads row stride * copy + warmup + t div copies of its base symbol's
    series; the base symbols take turns, all of them in order if ``bases`` doesn't name some. So each row of a series
    says by itself which ticks read it, and the whole table is replayed unless ``ticks`` ends it. ``features`` has
    symbol and idx.
    """
    spark = features.sparkSession
    if bases:
        places = spark.createDataFrame([(b, i, len(bases)) for i, b in enumerate(bases)], "base string, place int, turns int")
    else:
        names = features.select(F.col("symbol").alias("base")).distinct()  # a row for each symbol
        places = names.withColumns({"place": F.row_number().over(Window.orderBy("base")) - 1, "turns": F.count(F.lit(1)).over(Window.partitionBy())})
    places = F.broadcast(places.where(F.col("place") < copies))  # a row for each copy, at most
    rows = features.join(places, F.col("symbol") == F.col("base"))
    of = F.when(F.col("place") < copies, F.sequence("place", F.lit(copies - 1), "turns"))
    rows = rows.withColumn("sym", F.explode(of)).withColumn("_row", F.col("idx") - F.col("sym") * stride - warmup)
    rows = rows.where("_row >= 0").withColumn("t", F.col("_row") * copies + F.col("sym"))
    if ticks is not None:
        rows = rows.where(F.col("t") < ticks)
    return rows.select("t", "sym", "base", *[c for c in features.columns if c != "symbol"])
