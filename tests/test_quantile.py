import numpy as np
from pyspark.sql import functions as F

from tapewright.operators import sketches
from tapewright.operators.quantile import exact_percentiles, percentile_columns


def test_percentiles_equal_those_of_all_values(spark):
    """Brackets of a coarse sketch, ties, groups of few rows and nulls."""
    rng = np.random.default_rng(1)
    data = [(k, float(v), float(w)) for k, n in (("a", 6000), ("b", 700), ("c", 3)) for v, w in zip(rng.standard_normal(n), rng.integers(0, 9, n))]
    data += [("a", None, 1.0), ("d", None, 4.0), (None, 2.0, None)]
    df = spark.createDataFrame(data, "k string, v double, w double").repartition(5)
    shares = [0.0, 0.01, 0.5, 0.937, 1.0]
    for accuracy in (20, 300, 10_000):
        got = {(r["k"], r["column"], r["share"]): r["value"] for r in exact_percentiles(df, ["v", "w"], shares, ["k"], accuracy).collect()}
        want = {}
        for k in ("a", "b", "c", "d", None):
            for i, c in ((1, "v"), (2, "w")):
                values = [r[i] for r in data if r[0] == k and r[i] is not None]
                want |= {(k, c, s): float(np.quantile(values, s)) for s in shares if values}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want), accuracy


def test_percentiles_as_columns_and_of_nothing(spark):
    df = spark.range(101).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    assert percentile_columns(df, "v", [0.5, 0.99], ["k"]).collect() == [(1, 50.0, 99.0)]
    assert exact_percentiles(df.limit(0), ["v"], [0.5]).collect() == []


def test_sketches_of_periods_merge_and_bracket_the_exact_pass(spark):
    """Rows of later days are sketched on their own and appended; percentiles over all are within the sketch's error, exact ones equal."""
    rng = np.random.default_rng(2)
    data = [(k, day * 86_400 + i, float(v)) for k, n in (("a", 4000), ("b", 30)) for day in range(3) for i, v in enumerate(rng.exponential(size=n))]
    df = spark.createDataFrame([*data, ("a", 5, None), ("a", 6, float("nan")), ("c", 7, None)], "k string, s long, v double").withColumn("at", F.timestamp_seconds("s"))
    parts = [sketches.period_sketches(df.where(F.expr("s div 86400") == day), ["k"], "v", "at", k=200, deadline=1.0) for day in range(3)]
    table = parts[0].unionByName(parts[1]).unionByName(parts[2]).cache()
    assert table.count() == 6
    shares = [0.0, 0.5, 0.99, 1.0]
    real = df.where("v IS NOT NULL AND NOT isnan(v)")
    got = {(r["k"], r["share"]): r["value"] for r in exact_percentiles(real, ["v"], shares, ["k"], bounds=sketches.brackets(table, ["k"], "v", shares, k=200)).collect()}
    near = {r["k"]: r for r in sketches.sketched_summary(table, ["k"], [0.5, 0.99], k=200).collect()}
    for k in ("a", "b"):
        values = np.sort([v for g, _, v in data if g == k])
        assert all(abs(got[k, s] - np.quantile(values, s)) < 1e-12 for s in shares)
        r = near[k]
        assert r["n"] == len(values) and abs(r["mean"] - values.mean()) < 1e-9 and abs(r["miss_rate"] - (values > 1).mean()) < 1e-12
        assert all(abs(np.searchsorted(values, r[f"p{int(100 * s)}"]) / len(values) - s) <= sketches.rank_error(200) for s in (0.5, 0.99))
    assert len(got) == 8
