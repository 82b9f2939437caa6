import math

import numpy as np
import pytest

from tapewright.operators import curve, scale

from .helpers import plain_threshold


def scored(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")


CASES = [
    {"policy": "f1"},
    {"policy": "f1", "pairing": "aligned"},
    {"policy": "fbeta", "beta": 2.0},
    {"policy": "recall_at_precision", "min_precision": 0.5},
    {"policy": "precision_at_recall", "min_recall": 0.5},
    {"policy": "f1", "min_precision": 1.01},
]


@pytest.mark.parametrize("case", CASES)
def test_threshold_equals_a_plain_search(spark, case):
    rng = np.random.default_rng(3)
    p = np.round(rng.uniform(0, 1, 300), 2)
    y = (rng.uniform(0, 1, 300) < p * 0.6).astype(int)
    got = curve.choose_threshold(curve.pr_curve(scored(spark, y, p)), **case).first()
    thr, precision, recall = plain_threshold(y, p, **case)
    assert got["thr"] == thr and math.isclose(got["precision"], precision) and math.isclose(got["recall"], recall)


def test_average_precision_by_steps_and_without_positives(spark):
    y, p = [1, 0, 1, 1, 0, 0], [0.9, 0.9, 0.8, 0.3, 0.3, 0.1]
    want = (1 / 3) * (1 / 2) + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5)
    assert math.isclose(curve.average_precision(curve.pr_curve(scored(spark, y, p))).first()["ap"], want)
    none = curve.pr_curve(scored(spark, [0] * 6, p))
    assert {r["recall"] for r in none.collect()} == {1.0} and curve.average_precision(none).first()["ap"] == 0


def test_several_curves_in_one_job(spark):
    rows = [(k, int(i % 3 == 0), round((i * 7 % 50) / 50, 2)) for k in ("a", "b") for i in range(60 if k == "a" else 90)]
    df = spark.createDataFrame(rows, "k string, y int, p double")
    got = {r["k"]: r["thr"] for r in curve.choose_threshold(curve.pr_curve(df, keys=["k"]), ["k"]).collect()}
    for k in ("a", "b"):
        assert got[k] == plain_threshold([y for a, y, _ in rows if a == k], [p for a, _, p in rows if a == k])[0]


def test_too_few_rows_are_an_error(spark):
    with pytest.raises(Exception, match="too few"):
        curve.choose_threshold(curve.pr_curve(scored(spark, [1, 0, 1, 0], [0.1, 0.2, 0.3, 0.4]))).collect()


def test_scores_close_together_are_spread_over_pieces(spark, monkeypatch):
    """All scores within one thousandth, as of rare events: pieces are cut by counts, and the curve is the same."""
    rng = np.random.default_rng(8)
    p = np.round(0.01 + rng.uniform(0, 0.001, 400), 7)
    y = (rng.uniform(0, 1, 400) < 0.4).astype(int)
    whole = curve.pr_curve(scored(spark, y, p)).drop("_range").collect()
    monkeypatch.setattr(scale, "RANGE_ROWS", 40)
    pieces = curve.pr_curve(scored(spark, y, p))
    sizes = [r["count"] for r in pieces.groupBy("_range").count().collect()]
    assert len(sizes) >= 9 and max(sizes) <= 100
    assert sorted(map(tuple, pieces.drop("_range").collect())) == sorted(map(tuple, whole))
    got = curve.choose_threshold(pieces).first()
    thr, precision, recall = plain_threshold(y, p)
    assert got["thr"] == thr and math.isclose(got["precision"], precision) and math.isclose(got["recall"], recall)
