import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.operators import features, labels, scale, split
from tapewright.operators.bars import bars

from .helpers import plain_features, series

BARS = "symbol string, t long, sum_pq double, sum_q double, total_vol double, buy_vol double, sell_vol double, msg_count long"


def frame(spark, rows):
    return spark.createDataFrame(rows, BARS).withColumn("sec", F.timestamp_seconds("t"))


@pytest.mark.parametrize("lam", [0.5, 0.94, 0.999])
def test_features_equal_a_sequential_loop(spark, lam):
    rows = series(np.random.default_rng(1))
    got = features.features(frame(spark, rows), lam, seconds=1000, chunk=64).collect()
    want = plain_features(rows, lam)
    assert len(got) == len(want)
    for r in got:
        v, ret, sigma, base = want[r["symbol"], int(r["sec"].timestamp())]
        assert math.isclose(r["vwap"], v) and math.isclose(r["r_t"], ret, abs_tol=1e-12)
        assert math.isclose(r["sigma_hat"], sigma, rel_tol=1e-9) and math.isclose(r["baseline"], base)


@pytest.mark.parametrize("lam", [0.9999, 0.97, 0.2])
def test_a_slow_recurrence_is_carried_over_levels_of_small_blocks(spark, monkeypatch, lam):
    """Blocks of 5 rows, groups of 4 blocks and of 4 groups, so that every level carries; the size doesn't follow lambda."""
    for name, n in (("BLOCK", 5), ("GROUP", 4)):
        monkeypatch.setattr(scale, name, n)
    rows = series(np.random.default_rng(5), rows=333)
    want = plain_features(rows, lam)
    for r in features.features(frame(spark, rows), lam, seconds=1000, chunk=64).collect():
        assert math.isclose(r["sigma_hat"], want[r["symbol"], int(r["sec"].timestamp())][2], rel_tol=1e-9)


def test_all_rows_of_one_moment_are_numbered_in_pieces(spark):
    df = spark.range(1000).select(F.timestamp_seconds(F.when(F.col("id") < 900, 5).otherwise(F.col("id"))).alias("ts"), F.col("id").alias("tie"))
    ranged = scale.in_ranges(df, ["ts", "tie"], 100)
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200
    got = split.indexed(df, "ts", ["tie"], rows=100)
    assert got.where("idx <> tie OR key_rows <> 1000").count() == 0 and got.count() == 1000


def test_first_bars_without_quantity_and_a_single_bar(spark):
    rows = [("a", 10, 0.0, 0.0, 0.0, 0.0, 0.0, 1), ("a", 11, 50.0, 5.0, 5.0, 5.0, 0.0, 1), ("b", 5, 9.0, 3.0, 3.0, 0.0, 3.0, 2)]
    got = {(r["symbol"], r["idx"]): r for r in features.features(frame(spark, rows)).collect()}
    assert got["a", 0]["vwap"] == 0 and got["a", 1]["vwap"] == 10 and got["a", 1]["r_t"] == 0
    one = got["b", 0]
    assert one["r_t"] == 0 and math.isclose(one["sigma_hat"], math.sqrt(1e-9)) and one["baseline"] == 3


def test_index_and_halo_equal_plain_windows(spark):
    rows = frame(spark, series(np.random.default_rng(2), rows=300))
    indexed = scale.with_row_index(rows, "symbol", "sec", 700)
    w = Window.partitionBy("symbol").orderBy("sec")
    both = indexed.withColumn("plain", F.row_number().over(w) - 1)
    assert both.where("idx != plain").count() == 0 and both.where("key_rows != 300").count() == 0
    cols = lambda o: {"a": F.sum("sum_q").over(o.rowsBetween(-29, 0)), "b": F.count("sum_q").over(o.rowsBetween(1, 30)), "c": F.lag("sum_q").over(o)}
    got = scale.halo_window(indexed, "symbol", 29, 30, cols, chunk=60)
    want = indexed.withColumns(cols(Window.partitionBy("symbol").orderBy("idx")))
    columns = ["symbol", "idx", "a", "b", "c"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)
    with pytest.raises(ValueError):
        scale.halo_window(indexed, "symbol", 29, 30, cols, chunk=10)


def test_forward_return_edges(spark):
    rows = [("a", i, float(i + 1), 1.0, 1.0, 1.0, 0.0, 1) for i in range(6)]
    feats = features.features(frame(spark, rows))
    assert labels.forward_return(feats, 6).where("future_r IS NOT NULL").count() == 0
    assert labels.forward_return(feats, 5).where("future_r IS NOT NULL").count() == 1
    zero = feats.withColumns({"r_t": F.lit(0.0)})
    assert {r["y"] for r in labels.shock_labels(zero, 2, 0.0).collect()} == {1}
    with pytest.raises(ValueError):
        labels.require_shocks(labels.shock_labels(feats, 2, 1e12))


def test_bars_drop_trades_without_time_and_count_null_quantities(spark):
    rows = [("a", 1000, 2.0, 3.0, True), ("a", 1000, 2.0, None, None), ("a", None, 1.0, 1.0, False)]
    t = spark.createDataFrame(rows, "symbol string, t long, price double, qty double, is_buyer_maker boolean").withColumn("ts", F.timestamp_millis("t"))
    (r,) = bars(t).collect()
    assert (r["msg_count"], r["sum_pq"], r["buy_vol"], r["sell_vol"]) == (2, 6.0, 0.0, 3.0)


def test_splits_leave_the_gap_out(spark):
    df = spark.range(100).select(F.timestamp_seconds("id").alias("ts"))
    two = {r["idx"]: r["part"] for r in split.two_way(split.indexed(df, "ts", rows=7), 0.2, 10).collect()}
    assert two == {i: "train" for i in range(70)} | {i: "val" for i in range(80, 100)}
    three = {r["idx"]: r["part"] for r in split.three_way(split.indexed(df, "ts", rows=7), 3).collect()}
    assert three == {i: "train" for i in range(70)} | {i: "val" for i in range(73, 88)} | {i: "test" for i in range(91, 100)}
    with pytest.raises(ValueError):
        split.require_split(split.two_way(split.indexed(df.limit(3), "ts"), 0.2, 10))
