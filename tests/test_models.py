import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import anomaly, metrics, score
from tapewright.operators.infer import infer_feature_cols, infer_label_col, infer_time_col
from tapewright.plans import queries, training
from tapewright.schema import FEATURES


def rows(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 6))
    z = x[:, 0] * 1.5 + rng.standard_normal(n) * 0.5
    y = np.where(np.abs(z) < 1, 0, np.where(z > 0, 2, 1))
    return spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], ", ".join(f"{c} double" for c in FEATURES) + ", y int")


def test_logistic_regression_equals_newton(spark):
    df = rows(spark).withColumns({"y1": (F.col("y") == 2).cast("int"), "y2": F.lit(0)})
    model = training.fit_stage(df, "lr", 1).stages[-1]
    data = np.array(df.select(*FEATURES, "y1").collect(), float)
    x, t = np.c_[np.ones(len(data)), data[:, :6]], data[:, 6]
    weight = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (len(t) - t.sum())))
    b = np.zeros(7)
    keep = np.r_[0, np.ones(6)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (p - t)) + keep * b)
    assert np.allclose(model.coefficients.toArray(), b[1:], atol=1e-4) and abs(model.intercept - b[0]) < 1e-4


@pytest.mark.parametrize("kind", ["lr", "rf", "gbt"])
def test_two_stages_beat_chance_and_tune(spark, kind):
    train, val = rows(spark), rows(spark, seed=5)
    scored = training.two_stage(train, val, kind, 8).select("y", "p1", "p2").cache()
    means = {r["y"]: r for r in scored.groupBy("y").agg(F.avg("p1").alias("p1"), F.avg("p2").alias("p2")).collect()}
    few = 0.3 if kind == "gbt" else 1  # eight of fifty rounds have moved scores by so much
    assert means[2]["p2"] > means[1]["p2"] + 0.3 * few
    if kind != "lr":  # shocks lie on both sides, which no straight line separates
        assert means[1]["p1"] > means[0]["p1"] + 0.1 * few
    tuned = {r["stage"]: r["thr"] for r in training.tune(scored.withColumn("model", F.lit(kind))).collect()}
    assert tuned.keys() == {"s1", "s2"}
    prf, report = training.evaluate(scored, tuned["s1"], tuned["s2"], "true")
    assert {r["stage"] for r in prf.collect()} == {1, 2} and report.count() == 6


def test_early_stop_of_the_second_stage(spark):
    train = rows(spark, 300).where("y != 0").withColumns({"y1": F.lit(1), "y2": (F.col("y") == 2).cast("int")}).cache()
    n = lambda m: len(m.trees)
    assert n(training.fit_stage(train, "gbt", 2, 6)) == 6 == n(training.fit_stage(train, "gbt", 2, 6, train))
    wrong = train.withColumn("y2", 1 - F.col("y2"))
    assert n(training.fit_stage(train, "gbt", 2, 6, wrong)) == 0


@pytest.mark.parametrize("kind", ["lr", "rf", "gbt"])
def test_queries_fit_the_rounds_of_the_operator(spark, monkeypatch, kind):
    seen = []

    def fitted(train, val, kind, rounds=training.ROUNDS, validation=None):
        seen.append((rounds, validation is val))
        return val.withColumns({"p1": F.lit(0.5), "p2": F.lit(0.5)})

    part = spark.createDataFrame([("a", 1, "val", 0, *[0.5] * 6)], "symbol string, sec int, part string, y int, " + ", ".join(f"{c} double" for c in FEATURES))
    monkeypatch.setattr(queries, "_split", lambda spark, sf: part)
    monkeypatch.setattr(queries.split, "two_way", lambda df, *a: df)
    monkeypatch.setattr(queries.training, "two_stage", fitted)
    assert queries._two_stage(spark, "", kind).count() == 1 and seen == [(training.ROUNDS, True)]


def test_gate_runs_the_second_model_on_passing_rows_only(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.5), (4, None)], "id int, p1 double")
    seen = []

    def second(part):
        seen.append({r["id"] for r in part.collect()})
        return part.withColumn("p2", F.lit(0.8))

    got = {r["id"]: (r["yhat"], r["p2"]) for r in score.gated_transform(df, second, 0.5, 0.5).collect()}
    assert seen == [{2, 3}] and got == {1: (0, None), 2: (2, 0.8), 3: (2, 0.8), 4: (0, None)}


def test_report_keeps_empty_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "y int, yhat int")
    got = {r["label"]: r for r in metrics.classification_report(df, [0, 1, 2]).collect()}
    assert got["2"]["support"] == 0 and got["2"]["f1"] == 0 and abs(got["accuracy"]["f1"] - 2 / 3) < 1e-9


def test_hold_out_evaluation_end_to_end(spark):
    """Metrics on the test rows by SQL over the saved scores and thresholds; a given gate before the tuned one."""
    import duckdb

    df = rows(spark, 900, 8).coalesce(1).withColumns({"symbol": F.lit("a"), "sec": F.timestamp_seconds(F.monotonically_increasing_id())})
    scores, thresholds, got = training.hold_out(df, 5, rounds=3)
    s, t = scores.toPandas(), thresholds.toPandas()  # noqa: F841, read by the SQL below
    sql = """WITH g AS (SELECT model, {tau} AS tau, max(thr) FILTER (stage = 's2') AS tau2 FROM t GROUP BY 1), r AS (SELECT * FROM s JOIN g USING (model) WHERE part = 'test'),
        o AS (SELECT *, unnest(['predicted', 'true']) AS population FROM r)
        SELECT model, population, 1 AS stage, count(*) FILTER (y <> 0 AND p1 >= tau) AS tp, count(*) FILTER (y = 0 AND p1 >= tau) AS fp, count(*) FILTER (y <> 0 AND p1 < tau) AS fn FROM o GROUP BY 1, 2
        UNION ALL SELECT model, population, 2, count(*) FILTER (y = 2 AND p2 >= tau2), count(*) FILTER (y <> 2 AND p2 >= tau2), count(*) FILTER (y = 2 AND p2 < tau2)
        FROM o WHERE CASE WHEN population = 'true' THEN y <> 0 ELSE p1 >= tau END GROUP BY 1, 2"""
    names = ["model", "population", "stage", "tp", "fp", "fn"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(duckdb.sql(sql.format(tau="max(thr) FILTER (stage = 's1')")).fetchall())
    again = training.held_out_metrics(scores, thresholds, tau=0.4)
    assert sorted(map(tuple, again.select(names).collect())) == sorted(duckdb.sql(sql.format(tau="0.4")).fetchall())
    assert set(s["part"]) == {"val", "test"} and set(s["model"]) == set(training.KINDS) and len(s) == 3 * (135 + 125)


def test_class_weights_need_positives(spark):
    with pytest.raises(Exception, match="no positive"):
        score.class_weights(spark.createDataFrame([(0,)], "t int"), "t").collect()


def test_isolation_forest_ranks_outliers_first_and_repeats(spark):
    rng = np.random.default_rng(6)
    data = [tuple(map(float, v)) for v in rng.standard_normal((400, 6))] + [tuple([9.0 + i] * 6) for i in range(5)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in FEATURES)).repartition(3)
    a = anomaly.isolation_scores(df, trees=20).orderBy(F.desc("score")).limit(5).collect()
    assert all(r["r_t"] >= 9 for r in a)
    assert [r["score"] for r in anomaly.isolation_scores(df, trees=20).orderBy(F.desc("score")).limit(5).collect()] == [r["score"] for r in a]


def test_isolation_forest_draws_copies_of_a_hot_vector_one_by_one(spark):
    rng = np.random.default_rng(9)
    data = [tuple(map(float, v)) for v in rng.standard_normal((2000, 6))] + [(3.0,) * 6] * 1000
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(data)], "id long, " + ", ".join(f"{c} double" for c in FEATURES))
    got = {r["id"]: r["score"] for r in anomaly.isolation_scores(df, trees=20).collect()}
    others = sorted(got[i] for i in range(2000))
    assert len(got) == 3000 and got[2000] == got[2999] < others[1000]
    assert anomaly._largest_hash(300, 256) == 2**63 - 1 and anomaly._largest_hash(10**12, 256) > -(2**63) + 10**9


def test_forest_draws_from_a_bounded_pool_and_walks_like_its_expression(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.standard_normal((3000, 6)))], "id long, " + ", ".join(f"{c} double" for c in FEATURES))
    pools = []
    bound = anomaly._largest_hash
    monkeypatch.setattr(anomaly, "_largest_hash", lambda n, k: pools.append((n, k)) or bound(n, k))
    forest, usual = anomaly.isolation_forest(df, trees=5, sample=32, key=["id"])
    assert pools == [(3000, 160)] and bound(3000, 160) < 2**63 - 1  # one draw a row, less than all rows are dealt out
    assert forest.depth == 5 and len(forest.trees) == 5 and abs(usual - anomaly._mean_path(32)) < 1e-12
    odd = df.withColumn("r_t", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, float("nan")).otherwise(F.col("r_t")))
    x = odd.orderBy("id").toPandas()[FEATURES].to_numpy(float)
    walked = anomaly.path_lengths(forest.trees, forest.depth, x)
    assert np.allclose(walked, [r["p"] for r in odd.orderBy("id").select(forest.probability().alias("p")).collect()])


def test_columns_are_inferred(spark):
    df = spark.createDataFrame([(0.5, 1, 2.0, "t")], "y double, label int, r_t double, ts string")
    assert infer_label_col(df) == "label" and infer_time_col(df) == "ts" and infer_feature_cols(df, ["r_t"]) == ["r_t"]
    some = spark.createDataFrame([(None, None, "1"), (2, None, "x"), (0, None, "2")], "target int, y int, label string")
    assert infer_label_col(some) == "target"  # nulls don't count, a column of nulls is none, nor is one with other values
    with pytest.raises(ValueError):
        infer_label_col(some.drop("target"))
    with pytest.raises(ValueError):
        infer_feature_cols(df)
    with pytest.raises(ValueError):
        infer_label_col(df.drop("label"))
