import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tapewright.operators.features import features
from tapewright.schema import FEATURES, GATE, SECOND_GATE
from tapewright.sources import files, trades

from .helpers import series
from .test_features import frame


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def test_flush_files_and_their_tail(spark, folder):
    import numpy as np

    feats = features(frame(spark, series(np.random.default_rng(7), rows=250)))
    files.write_flush(feats, f"{folder}/flush", 100)
    want = [r["vwap"] for r in feats.where("symbol = 'a'").orderBy("sec").collect()]
    for n in (1, 50, 120, 250):
        got = files.read_tail(spark, f"{folder}/flush", "a", n, ["vwap"])
        assert [r["vwap"] for r in got.collect()] == want[-n:]
    got = files.read_tail(spark, f"{folder}/flush", "a", 30, ["sec", "vwap"], time_sort=True)
    assert [r["vwap"] for r in got.collect()] == want[-30:]
    for n, symbol, cols, error in ((0, "a", None, ValueError), (5, "zz", None, FileNotFoundError), (5, "a", ["nope"], ValueError), (251, "a", None, ValueError)):
        with pytest.raises(error):
            files.read_tail(spark, f"{folder}/flush", symbol, n, cols).collect()


def test_only_the_files_that_hold_the_tail_are_opened(spark, folder):
    import numpy as np

    files.write_flush(features(frame(spark, series(np.random.default_rng(7), rows=1050))), folder, 100)
    manifest = files.flush_manifest(spark, folder)
    rows = manifest.where("symbol = 'a'").orderBy("flush_idx").collect()
    assert [r["rows"] for r in rows] == [100] * 10 + [50] and [r["flush_idx"] for r in rows] == list(range(1, 12)) and all(r["whole"] for r in rows)
    assert all(a["last_sec"] < b["first_sec"] for a, b in zip(rows, rows[1:]))
    for n, opened in ((1, 1), (50, 1), (51, 2), (150, 2), (151, 3), (1050, 11)):
        tail = files.read_tail(spark, folder, "a", n, ["sec"])
        assert len(tail.inputFiles()) == opened and tail.count() == n


def test_flush_files_from_elsewhere_are_ordered_by_their_number(spark, folder):
    for k in (10, 9, 1):
        spark.createDataFrame([(k, float(i)) for i in range(3)], "k int, r_t double").toPandas().to_parquet(f"{folder}/symbol=a_flush_{k}.parquet")
    from pathlib import Path

    (Path(folder) / "symbol=a").mkdir()
    for f in Path(folder).glob("*_flush_*"):
        f.rename(Path(folder) / "symbol=a" / f.name.removeprefix("symbol=a_"))
    got = files.read_tail(spark, folder, "a", 4, ["k", "r_t"])
    assert [tuple(r) for r in got.collect()] == [(9, 2.0), (10, 0.0), (10, 1.0), (10, 2.0)] and len(got.inputFiles()) == 2


def test_work_folders_are_deleted(spark):
    from tapewright.sources import work

    first = work.work_count()
    df, path = work.kept_at(spark.range(3))
    work.kept(spark.range(4))
    assert df.count() == 3 and work.work_count() == first + 2
    work.clear_work(spark, first)
    assert work.work_count() == first and not files._exists(spark, path)


def test_chunks_of_trades(spark, folder):
    df = spark.createDataFrame([("2024-01-01 00:00:01", 1.0, 2.0, True), ("not a time", 1.0, 2.0, True)], "ts string, price double, qty double, is_buyer_maker boolean")
    df.toPandas().to_parquet(f"{folder}/chunk_1.parquet")
    df.toPandas().to_parquet(f"{folder}/other.parquet")
    assert trades.read_trades(spark, folder, "x").select("symbol", "qty").collect() == [("x", 2.0)]
    bad = tempfile.mkdtemp(prefix="spark-")
    df.drop("qty").toPandas().to_parquet(f"{bad}/chunk_1.parquet")
    with pytest.raises(ValueError):
        trades.read_trades(spark, bad)


def test_messages_and_what_is_no_message(spark):
    lines = ['{"s":"BTCUSDT","T":1704067200005,"p":"42000.10","q":"0.015","m":true}', "nonsense", '{"s":"X","T":1,"p":"zz","q":"1","m":false}']
    good, rest = trades.parse_messages(spark.createDataFrame([(x,) for x in lines], "value string"))
    (r,) = good.collect()
    assert (r["symbol"], r["price"], r["qty"], r["is_buyer_maker"], r["ts"].timestamp()) == ("btcusdt", 42000.10, 0.015, True, 1704067200.005)
    assert {x["value"] for x in rest.collect()} == set(lines[1:])


def test_thresholds_round_trip_and_fall_back(spark, folder):
    rows = spark.createDataFrame([("xgb", "s1", 0.4, 0.1, 0.2, 0.3, 0.3, 0.5), ("xgb", "s2", 0.6, 0.1, 0.2, 0.3, 0.3, 0.5)], "model string, stage string, thr double, precision double, recall double, f1 double, fbeta double, ap double")
    files.write_thresholds(rows, f"{folder}/t", "H30_a2_L94")
    got = {(r["model"], r["stage"]): r["thr"] for r in files.read_thresholds(spark, f"{folder}/t").collect()}
    assert got == {("xgb", "s1"): 0.4, ("xgb", "s2"): 0.6}
    assert files.tuned_gates(spark, f"{folder}/t", "xgb") == (0.4, 0.6)
    files.write_thresholds(rows, f"{folder}/u", "H30_a2_L94", "recall_at_precision", 2.0, min_precision=0.3, use_logit_adjust=True, la_tau=0.5)
    doc = json.loads(spark.read.text(f"{folder}/u").first()[0])
    assert {k: doc.get(k) for k in ("tag", "thr_policy", "beta", "min_precision", "min_recall", "use_logit_adjust", "la_tau")} == {
        "tag": "H30_a2_L94", "thr_policy": "recall_at_precision", "beta": 2.0, "min_precision": 0.3, "min_recall": None, "use_logit_adjust": True, "la_tau": 0.5}
    assert {r["min_precision"] for r in files.read_thresholds(spark, f"{folder}/u").collect()} == {0.3}
    gates = files.gates_by_model(rows.where("stage = 's1'"), tau2=0.9).first()
    assert (gates["tau"], gates["tau2"]) == (0.4, 0.9) and files.gates_by_model(rows.where("stage = 's1'")).first()["tau2"] == SECOND_GATE
    assert files.tuned_gates(spark, f"{folder}/t", "rf") == files.tuned_gates(spark, f"{folder}/none", "rf") == (GATE, SECOND_GATE)


def test_results_labels_and_tags(spark, folder):
    a, b = spark.createDataFrame([(1, 2.0)], "k int, p50 double"), spark.createDataFrame([(2, 3.0)], "k int, p50 double")
    files.write_results({"A": a, "B": b}, f"{folder}/r")
    assert spark.read.option("header", True).csv(f"{folder}/r/FULL").count() == 2
    labelled = spark.createDataFrame([(*[1.0] * 6, 2)], ", ".join(f"{c} double" for c in FEATURES) + ", y int")
    files.write_labeled(labelled, f"{folder}/l")
    assert files.read_labeled(spark, f"{folder}/l").collect() == labelled.collect()
    tags = [(30, 2.0, 0.94, "H30_a2_L94"), (5, 0.5, 0.05, "H5_a0.5_L05")]
    for h, alpha, lam, want in tags:
        assert spark.range(1).select(files.tag_expr(h, alpha, lam)).first()[0] == want


def test_models_are_saved_and_loaded(spark, folder):
    from tapewright.operators.score import fit_scaler
    from tapewright.plans import training

    from .test_models import rows

    df = rows(spark, 200).withColumns({"y1": (F.col("y") != 0).cast("int"), "y2": F.lit(0)})
    model, scaler = training.fit_stage(df, "rf", 1), fit_scaler(df)
    files.save_model(model, scaler, folder, "H5_a0.5_L94")
    again, mu = files.load_model(spark, folder, "H5_a0.5_L94")
    take = lambda m: [r["p"] for r in training.probability(m, df, "p").select("p").collect()]
    assert take(model) == take(again) and sorted(mu.collect()) == sorted(scaler.collect())
    assert json.dumps([r["feature"] for r in scaler.collect()]) == json.dumps(FEATURES)
