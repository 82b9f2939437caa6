import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tapewright.operators import metrics
from tapewright.operators.bars import bars
from tapewright.operators.features import features
from tapewright.schema import MESSAGE
from tapewright.sources.trades import parse_messages, read_messages_stream, read_trades_stream
from tapewright.streaming import live, progress, ring


def message(symbol, ms, price, qty, maker):
    return json.dumps({"s": symbol, "T": ms, "p": str(price), "q": str(qty), "m": maker})


def put(folder, name, lines):
    Path(folder).mkdir(exist_ok=True, parents=True)
    (Path(folder) / name).write_text("\n".join(lines))


def lines(symbol, start, n):
    return [message(symbol, 1_704_067_200_000 + 400 * i, 100 + (i * 7 % 11), i % 5, i % 2 == 0) for i in range(start, start + n)]


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def test_stream_equals_batch_and_late_trades_make_no_second_bar(spark, folder):
    assert MESSAGE["T"].name == "T"
    first, second = lines("a", 0, 60) + lines("b", 0, 60), lines("a", 60, 60) + lines("b", 60, 60)
    late = [message("a", 1_704_067_200_100, 1, 1000, True)]
    put(f"{folder}/in", "1.json", first)
    put(f"{folder}/in", "2.json", second)
    live.use_rocksdb(spark)
    stream = ring.live_features(read_trades_stream(spark, f"{folder}/in", 1), late="2 seconds", rows=10)
    out = live.run_to_table(stream, f"{folder}/t")
    put(f"{folder}/in", "3.json", late + lines("a", 120, 30) + lines("b", 120, 30))
    out = live.run_to_table(stream, f"{folder}/t")  # goes on where it stopped
    got = {(r["symbol"], r["sec"]): r for r in out.collect()}
    assert len(got) == out.count()
    text = spark.createDataFrame([(x,) for x in first + second + lines("a", 120, 30) + lines("b", 120, 30)], "value string")
    want = {(r["symbol"], r["sec"]): r for r in features(bars(parse_messages(text)[0])).collect()}
    newest = max(s for _, s in got)
    assert {k for k in want if k[1] <= newest} == got.keys() and len(got) > 80
    for k, r in got.items():
        for c in ("vwap", "r_t", "sigma_hat", "OFI_t", "Imbalance_t", "VolSpike_t"):
            assert abs(r[c] - want[k][c]) < 1e-9, (k, c)
        assert r["window_rows"] == min(10, want[k]["idx"] + 1)


def test_hot_and_cold_tables(spark, folder):
    live.use_rocksdb(spark)
    for k in range(2):
        put(f"{folder}/in", f"{k}.json", lines("a", 60 * k, 60))
        stream = ring.live_features(read_trades_stream(spark, f"{folder}/in", 1), late="1 second")
        live.write_hot_and_cold(stream, f"{folder}/sink", f"{folder}/c", 5).awaitTermination()
    cold = spark.read.parquet(f"{folder}/sink/cold")
    assert cold.count() == cold.select("symbol", "sec").distinct().count() > 30
    newest = [r["sec"] for r in cold.select("sec").orderBy("sec").collect()][-5:]
    assert sorted(r["sec"] for r in live.hot_rows(spark, f"{folder}/sink").collect()) == newest
    hots = [sorted(r["sec"] for r in spark.read.parquet(f"{folder}/sink/hot/{i}").collect()) for i in (0, 1)]
    assert newest in hots


def test_rejected_lines_have_their_own_table_and_batches_are_measured(spark, folder):
    """What is no trade is kept; progress tells rows, state and missed deadlines, and the state doesn't grow with the stream."""
    live.use_rocksdb(spark)
    for k in range(4):
        put(f"{folder}/in", f"{k}.json", [*lines("a", 60 * k, 60), "nonsense", '{"s":"a","T":1,"p":"x","q":"1"}'])
    trades, rest = read_messages_stream(spark, f"{folder}/in", 1)
    live.write_rejects(rest, f"{folder}/bad", f"{folder}/c0").awaitTermination()
    bad = spark.read.parquet(f"{folder}/bad")
    assert bad.count() == 8 and bad.where("seen IS NULL").count() == 0 and {r["value"] for r in bad.collect()} == {"nonsense", '{"s":"a","T":1,"p":"x","q":"1"}'}
    run = live.write_hot_and_cold(ring.live_features(trades, late="1 second"), f"{folder}/sink", f"{folder}/c", 5)
    run.awaitTermination()
    seen = live.batch_latencies(run, deadline_ms=1e9)
    assert sum(b["rows"] for b in seen) == 4 * 62 and not any(b["missed"] for b in seen) and all(b["total_ms"] > 0 for b in seen)
    assert all(b["missed"] for b in live.batch_latencies(run, deadline_ms=0))
    grown = [b["state_rows"] for b in seen if b["rows"]]
    assert grown[-1] <= 2 * (60 + 30) + 2 * 60  # both rings and the bars that are open
    assert live.hot_rows(spark, f"{folder}/sink").count() == 5


START = 1_704_067_200_000


def steady(symbol, first, n):
    """One trade a second."""
    return [message(symbol, START + 1000 * i, 100 + i % 7, 1 + i % 3, i % 2 == 0) for i in range(first, first + n)]


def test_a_silent_symbol_s_last_bar_comes_out_once(spark, folder):
    """Event-time timers close it when the trades of others move the watermark; nothing of it is put out again."""
    live.use_rocksdb(spark)
    put(f"{folder}/in", "1.json", steady("quiet", 0, 3) + steady("busy", 0, 3))
    flow = lambda: ring.live_features(read_trades_stream(spark, f"{folder}/in", 1), late="1 second", rows=4)
    quiet = lambda df: sorted(int(r["sec"].timestamp()) - START // 1000 for r in df.where("symbol = 'quiet'").collect())
    assert quiet(live.run_to_table(flow(), f"{folder}/t")) == [0]  # the newest trade is at 2: the watermark stands at 1
    put(f"{folder}/in", "2.json", steady("busy", 3, 10))
    assert quiet(live.run_to_table(flow(), f"{folder}/t")) == [0, 1, 2]
    put(f"{folder}/in", "3.json", [message("quiet", START + 2000, 1, 1, True), *steady("busy", 13, 10)])  # late, for a bar that is out
    out = live.run_to_table(flow(), f"{folder}/t")
    assert quiet(out) == [0, 1, 2] and out.count() == out.select("symbol", "sec").distinct().count()


def test_state_does_not_grow_with_the_stream_and_dead_symbols_leave_it(spark, folder):
    """Rows of state after 1,000 to 20,000 bars of a symbol, from the table of progress; then the symbol falls silent."""
    live.use_rocksdb(spark)
    ends = [1000, 5000, 10_000, 20_000]
    flow = lambda: ring.live_features(read_trades_stream(spark, f"{folder}/in", 1), late="1 second", rows=30, idle=5000)
    kept = []
    for k, (first, end) in enumerate(zip([0, *ends], ends)):
        put(f"{folder}/in", f"{k}.json", steady("a", first, end - first))
        out, table = progress.run_with_progress(progress.measured(flow(), bars=F.count(F.lit(1))), f"{folder}/t", every=2)
        kept.append(table.orderBy("batch").collect()[-1]["state_rows"])
    assert len(set(kept)) == 1 and kept[0] < 2 * (60 + 30) + 20
    rows = table.collect()
    assert out.count() == sum(r["measures"]["bars"] for r in rows) and ends[-1] - 3 <= out.count() < ends[-1]
    assert sum(r["rows"] for r in rows) == ends[-1] and all(r["total_ms"] > 0 for r in rows)
    summary = metrics.latency_summary(table.withColumn("stream", F.lit("t")), ["stream"], deadline=1.0).first()
    assert summary["n"] == len(rows) and summary["miss_rate"] == 1.0 and summary["p50"] <= summary["p99"]
    for k in (4, 5):  # another symbol goes on until a has been silent for long
        put(f"{folder}/in", f"{k}.json", steady("b", 20_000 + 4000 * (k - 4), 4000))
    _, table = progress.run_with_progress(flow(), f"{folder}/t")
    assert table.orderBy("batch").collect()[-1]["state_rows"] == kept[0]  # b's alone


def test_a_bar_writes_one_slot_of_each_ring(spark):
    class Slots(dict):
        def iterator(self):
            return iter(list(self.items()))

        def updateValue(self, key, value):
            self.written = getattr(self, "written", 0) + 1
            self[key] = value

    class Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, value):
            self.kept = value

    class Handle:
        def getValueState(self, *a):
            return Value()

        def getMapState(self, *a):
            return Slots()

    for rows in (5, 500):
        r = ring.Ring(Handle(), 0.94, rows)
        for k in range(1200):
            before = (getattr(r.volume_slots, "written", 0), getattr(r.vector_slots, "written", 0))
            r.open()
            r.add(float(k % 7), 100.0, 1.0, 1.0, 0.0, 2)
            r.close(1)
            assert (r.volume_slots.written, r.vector_slots.written) == (before[0] + 1, before[1] + 1)
        assert len(r.volume_slots) == 60 and len(r.vector_slots) == rows


def test_the_gate_saves_work_and_changes_no_prediction(spark, folder):
    """Both runs score every tick once; forced, the second stage sees all of them. Run times are measured."""
    from tapewright.functions.models import TwoStage
    from tapewright.plans import saved
    from tapewright.schema import FEATURES
    from tapewright.streaming import replay

    rows = [(i, *(((i * k) % 17 - 8) / 3 for k in range(1, 6)), i % 5) for i in range(600)]
    ticks = spark.createDataFrame(rows, "t int, " + ", ".join(f"{c} {'long' if c == 'msg_count' else 'double'}" for c in FEATURES))
    scores, sums = replay.gate_ablation(ticks, TwoStage.from_json(saved.LINEAR), 0.5, 0.5, folder, 5)
    by = {m: {r["t"]: r for r in scores.where(F.col("mode") == m).collect()} for m in ("gated", "forced")}
    assert len(by["gated"]) == len(by["forced"]) == 600 and all(by["gated"][t]["yhat"] == by["forced"][t]["yhat"] for t in by["gated"])
    got = {r["mode"]: r for r in sums.collect()}
    assert got["forced"]["second_rate"] == 1.0 and got["gated"]["second_rate"] == got["gated"]["hit_rate"] == got["forced"]["hit_rate"] < 1.0
    assert all(r["ticks"] == 600 and r["n"] == 5 and r["ticks_per_s"] > 0 and r["p50"] <= r["p99"] for r in got.values())
