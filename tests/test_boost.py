"""Boosted trees against a plain version, and fitted models as expressions against the libraries and in streams."""

import math
import sys
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tapewright.functions.models import Linear, Trees, TwoStage
from tapewright.operators import boost
from tapewright.operators.boost import Boosting, fit_boosted
from tapewright.operators.score import fit_scaler, scale
from tapewright.operators.labels import stage_targets
from tapewright.plans import training
from tapewright.schema import FEATURES

COLUMNS = ["a", "b", "c"]


def plain_value(g, h, o):
    """The best leaf value and its objective, by trying all points where the minimum can be."""
    points = [0.0, -(g + o.l1) / (h + o.l2), -(g - o.l1) / (h + o.l2)]
    points = [max(-o.most, min(o.most, v)) if o.most else v for v in points]
    cost = lambda v: g * v + (h + o.l2) * v * v / 2 + o.l1 * abs(v)
    return min(((cost(v), v) for v in points), key=lambda p: p[0])


def plain_boosting(x, y, w, place, edges, o):
    """Margins after all rounds, by loops over rows, columns and edges."""
    margin, shapes = np.zeros(len(y)), []
    for t in range(o.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        used = boost.uniform(place, t, o.seed) < o.rows
        chosen, add, shape = boost.drawn_columns(x.shape[1], t, o), np.zeros(len(y)), []

        def grow(rows, level, t=t):
            mine = rows & used
            cost, value = plain_value(g[mine].sum(), h[mine].sum(), o)
            best = None
            if level < o.depth:
                for c in chosen:
                    for e in [*edges[c], sys.float_info.max]:
                        for left_missing in (False, True):
                            left = (x[:, c] <= e) | (np.isnan(x[:, c]) & left_missing)
                            a, b = mine & left, mine & ~left
                            if h[a].sum() < o.child or h[b].sum() < o.child:
                                continue
                            won = 2 * (cost - plain_value(g[a].sum(), h[a].sum(), o)[0] - plain_value(g[b].sum(), h[b].sum(), o)[0])
                            if won > o.gamma and (best is None or won > best[0] + 1e-9):
                                best = (won, c, e, left)
            if best is None:
                add[rows] = o.step * value
                return
            shape.append((level, int(best[1]), best[2]))
            grow(rows & best[3], level + 1)
            grow(rows & ~best[3], level + 1)

        grow(np.ones(len(y), bool), 0)
        shapes.append(shape)
        margin = margin + add
    return margin, shapes


def table(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[rng.random((n, 3)) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) - np.abs(np.nan_to_num(x[:, 1])) + rng.normal(size=n) * 0.5 > 0).astype(float)
    return x, y, np.where(y > 0, 1.5, 1.0)


def frame(spark, x, y, w):
    return spark.createDataFrame([(i, *(None if math.isnan(v) and i % 2 else float(v) for v in r), int(t), float(u)) for i, (r, t, u) in enumerate(zip(x, y, w))], "i long, a double, b double, c double, y int, w double")


def test_trees_equal_a_plain_version(spark):
    x, y, w = table()
    df = frame(spark, x, y, w).coalesce(1)  # places are row numbers then
    o = Boosting(rounds=6, child=3.0, gamma=0.3, l1=0.2, l2=1.0, most=0.8, rows=0.7, columns=0.7, bins=12, step=0.5, seed=5)
    got = fit_boosted(df, COLUMNS, "y", "w", o)
    edges = boost.bin_edges(df, COLUMNS, o.bins)
    margin, shapes = plain_boosting(x, y, w, np.arange(len(y)), edges, o)
    assert len(got.trees) == 6 and any(len(s) > 3 for s in shapes)
    for tree, shape in zip(got.trees, shapes):
        assert sorted((int(math.log2(k + 1)), f, t) for k, (f, t) in enumerate(zip(tree["f"], tree["t"])) if f >= 0) == sorted(shape)
    p = {r["i"]: r["p"] for r in df.select("i", got.probability().alias("p")).collect()}
    assert np.allclose([p[i] for i in range(len(y))], 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_partitions_and_merged_margins_do_not_change_the_trees(spark, monkeypatch):
    x, y, w = table(300, 2)
    o = Boosting(rounds=5, child=2.0, gamma=0.1, rows=1.0, bins=10)
    one = fit_boosted(frame(spark, x, y, w).coalesce(1), COLUMNS, "y", "w", o)
    monkeypatch.setattr(boost, "MERGE", 2)
    many = fit_boosted(frame(spark, x, y, w).repartition(7), COLUMNS, "y", "w", o)
    for a, b in zip(one.trees, many.trees, strict=True):
        assert a["f"] == b["f"] and a["t"] == b["t"] and a["m"] == b["m"] and np.allclose(a["v"], b["v"], atol=1e-9)


def test_limits_hold_and_odd_tables_are_taken(spark):
    x, y, w = table(200, 3)
    df = frame(spark, x, y, w)
    assert fit_boosted(df, COLUMNS, "y", "w", Boosting(rounds=3, gamma=1e9)).trees == ()  # no split is worth it
    assert fit_boosted(df, COLUMNS, "y", "w", Boosting(rounds=3, child=1e9)).trees == ()
    small = fit_boosted(df, COLUMNS, "y", "w", Boosting(rounds=4, most=0.01, step=1.0, child=1.0, gamma=0.0))
    assert max(abs(v) for t in small.trees for v in t["v"]) <= 0.01
    empty = fit_boosted(df.limit(0), COLUMNS, "y", "w", Boosting(rounds=2))
    assert empty.trees == () and {r["p"] for r in df.select(empty.probability().alias("p")).collect()} == {0.5}
    blank = df.withColumn("a", F.lit(None).cast("double"))
    assert all(0 not in t["f"] for t in fit_boosted(blank, COLUMNS, "y", "w", Boosting(rounds=3, child=1.0, gamma=0.0, columns=1.0)).trees)


def test_growing_stops_early_in_the_one_fit(spark):
    x, y, w = table(300, 4)
    df, o = frame(spark, x, y, w), Boosting(rounds=12, child=2.0, gamma=0.0, step=0.5, patience=2)
    wrong = df.withColumn("y", 1 - F.col("y"))
    assert fit_boosted(df, COLUMNS, "y", "w", o, wrong).trees == ()  # each tree makes them worse
    other = frame(spark, *table(300, 9))
    full, stopped = fit_boosted(df, COLUMNS, "y", "w", replace(o, patience=0)).trees, fit_boosted(df, COLUMNS, "y", "w", o, other).trees
    assert 0 < len(stopped) < len(full) == 12
    assert [t["f"] for t in stopped] == [t["f"] for t in full[: len(stopped)]]  # the same fit, cut at its best round
    loss = lambda n: other.select(F.avg(-F.col("w") * F.ln(F.when(F.col("y") == 1, (p := Trees(tuple(COLUMNS), 3, full[:n], "log_odds").probability())).otherwise(1 - p)))).first()[0]
    losses = [loss(n) for n in range(len(stopped) + o.patience + 1)]
    assert int(np.argmin(losses)) == len(stopped)


def labelled(spark, n=500, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 6))
    z = x[:, 0] * 1.5 + rng.standard_normal(n) * 0.4
    y = np.where(np.abs(z) < 1, 0, np.where(z > 0, 2, 1))
    return spark.createDataFrame([(*map(float, a), int(b), i) for i, (a, b) in enumerate(zip(x, y))], ", ".join(f"{c} double" for c in FEATURES) + ", y int, id int")


@pytest.mark.parametrize("kind", ["lr", "rf"])
def test_expressions_equal_the_fitted_pipelines(spark, kind):
    df = labelled(spark)
    rows = scale(stage_targets(df), fit_scaler(df)).cache()
    model = training.fit_stage(rows, kind, 1)
    both = model.transform(rows).withColumn("own", training.as_expression(model, kind).probability()).select(vector_to_array("probability")[1].alias("p"), "own").collect()
    assert max(abs(r["p"] - r["own"]) for r in both) < 1e-12 and len({r["p"] for r in both}) > 5


@pytest.mark.parametrize("kind", ["lr", "rf", "gbt"])
def test_a_stream_scores_like_the_batch(spark, tmp_path, kind):
    df, gate = labelled(spark), 0.5
    model = training.fit_two_stage(df, kind, rounds=6, validation=df)
    model.save(spark, f"file://{tmp_path}/model")
    again = TwoStage.load(spark, f"file://{tmp_path}/model")
    assert again == model
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = again.gated(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), gate, 0.5)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    names = ["id", "p1", "p2", "yhat"]
    batch = {r["id"]: r for r in model.gated(df, gate, 0.5).select(names).collect()}
    live = {r["id"]: r for r in spark.read.parquet(f"{tmp_path}/out").select(names).collect()}
    assert live == batch and {r["yhat"] for r in batch.values()} == {0, 1, 2}
    assert all((r["p2"] is None) == (r["p1"] < gate) for r in batch.values())



def test_trees_send_missing_values_where_they_say(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.1), (2, None), (3, float("nan"))], "id int, a double")
    for side, want in ((False, [0.1, 0.9, 0.9, 0.9]), (True, [0.1, 0.9, 0.1, 0.1])):
        trees = Trees(("a",), 1, ({"f": [0], "t": [1.0], "m": [side], "v": [0.1, 0.9]},), "shares")
        assert [r["p"] for r in df.orderBy("id").select(trees.probability().alias("p")).collect()] == want
    linear = TwoStage(Linear(("a",), (1.0,), 0.0), Linear(("a",), (-1.0,), 0.0), {"a": (0.0, 1.0)})
    got = {r["id"]: (r["p1"], r["yhat"]) for r in linear.gated(df.where("id <> 3"), 0.5, 0.5).collect()}
    assert got[2] == (None, 0) and got[0][1] == 1
