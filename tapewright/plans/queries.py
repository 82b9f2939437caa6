"""The registered queries: one for each operator, over the given tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import artifact_tag, logit_adjusted, side
from ..functions.models import Trees, TwoStage
from ..operators import anomaly, curve, features, infer, labels, metrics, quantile, score, sketches, split
from ..operators.bars import bars
from ..schema import FEATURES
from ..sources import files
from ..sources.trades import parse_messages, read_trades, replay, trades_of_events, trades_of_lineitem
from ..sources.work import kept, work_dir
from ..streaming import live, progress, ring
from ..streaming import replay as replaying
from . import saved, training

#: Hourly bars of the events table; horizon and alpha that give enough shocks on them.
UNIT, BUCKET, HORIZON, ALPHA, W = "hour", 30 * 86_400, 5, 0.5, 30
TAU, TAU2 = 0.5, 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_of_events(table(spark, sf_dir, "events"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(trades(spark, sf_dir), UNIT)


def feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.features(hourly(spark, sf_dir), seconds=BUCKET)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.shock_labels(feats(spark, sf_dir), HORIZON, ALPHA)


def with_formulas(df: DataFrame) -> DataFrame:
    """Adds probabilities by formulas that any SQL engine computes alike, rounded so that some tie."""
    p1 = F.round(1 / (1 + F.exp(-(F.abs("r_t") - 1))), 4)
    p2 = F.round(1 / (1 + F.exp(-F.col("Imbalance_t"))), 4)
    return df.withColumns({"p1": p1, "p2": p2})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_formulas(labelled(spark, sf_dir))


def out(df: DataFrame, *columns: str) -> DataFrame:
    """Chosen columns; times as epoch seconds, doubles to 6 places."""
    cols = []
    for c, kind in df.select(*(columns or df.columns)).dtypes:
        if kind.startswith("timestamp"):
            cols.append(F.unix_timestamp(F.col(c).cast("timestamp")).alias(c))
        elif kind == "double":
            cols.append((F.floor(F.col(c) * 1e6 + 0.501) / 1e6).alias(c))  # halves, which sums reach from either side, go up
        elif kind in ("int", "smallint"):
            cols.append(F.col(c).cast("long").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = f
    return f


@query
def trade_side_split(spark, sf):
    t = trades(spark, sf)
    s = side(F.col("is_buyer_maker"))
    rows = t.select("symbol", s.alias("side"), "qty", (F.col("price") * F.col("qty")).alias("notional"))
    agg = rows.groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.sum("notional").alias("notional"))
    return out(agg)


@query
def bars_hourly(spark, sf):
    return out(hourly(spark, sf), "symbol", "sec", "sum_pq", "sum_q", "total_vol", "buy_vol", "sell_vol", "msg_count")


@query
def bars_daily_lineitem(spark, sf):
    return out(bars(trades_of_lineitem(table(spark, sf, "lineitem")), "day"), "symbol", "sec", "sum_pq", "total_vol", "buy_vol", "sell_vol", "msg_count")


@query
def bars_zero_qty_fallback(spark, sf):
    return out(features.with_vwap(hourly(spark, sf), BUCKET).where("sum_q = 0"), "symbol", "sec", "vwap", "msg_count")


@query
def log_return(spark, sf):
    return out(feats(spark, sf), "symbol", "sec", "vwap", "r_t")


@query
def ewma_sigma(spark, sf):
    return out(feats(spark, sf), "symbol", "sec", "sigma_hat")


@query
def rolling_vol_baseline(spark, sf):
    return out(feats(spark, sf), "symbol", "sec", "baseline", "VolSpike_t")


@query
def feature_rows(spark, sf):
    return out(feats(spark, sf), "symbol", "sec", "total_vol", "vwap", "buy_vol", "sell_vol", *FEATURES)


@query
def feature_rows_per_chunk(spark, sf):
    b = hourly(spark, sf).withColumn("chunk_id", F.dayofmonth("sec") % 3)
    return out(features.features(b, seconds=BUCKET, reset="chunk_id"), "symbol", "chunk_id", "sec", "vwap", "r_t", "sigma_hat", "VolSpike_t")


@query
def forward_return(spark, sf):
    return out(labels.forward_return(feats(spark, sf), HORIZON), "symbol", "sec", "future_r")


@query
def shock_labels(spark, sf):
    return out(labelled(spark, sf), "symbol", "sec", "future_r", "y")


@query
def label_alpha_sweep(spark, sf):
    return out(labels.alpha_sweep(feats(spark, sf), [0.25, 0.5, 1.0], HORIZON))


@query
def stage_targets(spark, sf):
    return out(labels.stage_targets(labelled(spark, sf)).fillna(-1, ["y2"]).groupBy("symbol", "y1", "y2").agg(F.count(F.lit(1)).alias("n")))


def _split(spark, sf):
    return split.indexed(labelled(spark, sf).drop("idx", "key_rows"), "sec", ["symbol"])


@query
def split_gap_2way(spark, sf):
    return out(split.two_way(_split(spark, sf), 0.2, HORIZON), "symbol", "sec", "idx", "part")


@query
def split_gap_3way(spark, sf):
    return out(split.three_way(_split(spark, sf), HORIZON), "symbol", "sec", "idx", "part")


@query
def scaler_fit(spark, sf):
    return out(score.fit_scaler(split.two_way(_split(spark, sf), 0.2, HORIZON).where("part = 'train'")))


@query
def scaled_features(spark, sf):
    rows = kept(split.two_way(_split(spark, sf), 0.2, HORIZON).select("symbol", "sec", "part", *FEATURES))
    scaler = score.fit_scaler(rows.where("part = 'train'"))
    return out(score.scale(rows.where("part = 'val'"), scaler), "symbol", "sec", *FEATURES)


@query
def class_weights(spark, sf):
    return out(score.class_weights(labels.stage_targets(labelled(spark, sf)), "y1"))


@query
def last_w_window(spark, sf):
    rows = features.lookback(feats(spark, sf), W)
    first = F.element_at("window", 1)
    return out(rows.select("symbol", "sec", F.size("window").alias("n"), first[0].alias("first_r"), first[5].alias("first_count"), F.aggregate("window", F.lit(0.0), lambda s, x: s + x[4]).alias("spikes")))


@query
def last_w_state(spark, sf):
    return out(features.last_w(feats(spark, sf), ["symbol"], "sec", W), "symbol", "sec", "nth", *FEATURES)


@query
def rolling_zscore(spark, sf):
    return out(features.rolling_zscore(feats(spark, sf), "total_vol", W), "symbol", "sec", "total_vol_z")


@query
def first_diff(spark, sf):
    return out(features.first_difference(feats(spark, sf), "total_vol"), "symbol", "sec", "total_vol_d")


@query
def flush_index(spark, sf):
    return out(features.flush_index(feats(spark, sf), 100).groupBy("symbol", "flush_idx").agg(F.count(F.lit(1)).alias("n"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec")))


@query
def tail_n(spark, sf):
    return out(features.tail_n(feats(spark, sf), ["sec", "symbol"], 500), "symbol", "sec", "vwap")


def _curve(spark, sf):
    rows = scored(spark, sf).select(F.col("p1").alias("p"), (F.col("y") != 0).cast("int").alias("t"))
    return curve.pr_curve(rows, "p", "t")


@query
def pr_curve(spark, sf):
    return out(_curve(spark, sf), "thr", "tp", "fp", "precision", "recall")


@query
def average_precision(spark, sf):
    return out(curve.average_precision(_curve(spark, sf)))


@query
def threshold_f1_reference(spark, sf):
    return out(curve.choose_threshold(_curve(spark, sf)))


@query
def thresholds_document(spark, sf):
    """Tuned thresholds written as one JSON document and read back."""
    best = curve.choose_threshold(_curve(spark, sf)).select(F.lit("formula").alias("model"), F.lit("s1").alias("stage"), "thr", "precision", "recall", "f1", "fbeta", "ap")
    path = work_dir(spark)
    files.write_thresholds(best, path, "H5_a0.5_L94")
    return out(files.read_thresholds(spark, path), "tag", "model", "stage", "thr", "precision", "recall", "f1", "fbeta", "ap", "policy")


@query
def inferred_columns(spark, sf):
    """Which columns are taken for label and time, in tables that are made of the labelled rows."""
    rows = kept(labelled(spark, sf).select("symbol", "sec", "y", *FEATURES))
    tables = {
        "plain": rows,
        "doubled": rows.select("sec", (2 * F.col("y")).alias("y"), F.col("y").alias("label"), F.col("sec").alias("ts")),
        "partly": rows.select(F.when(F.col("y") == 0, 0).when(F.col("r_t") > 0, 3).alias("label"), F.when(F.col("y") > 0, F.col("y")).alias("target"), F.col("sec").alias("t")),
    }
    found = [(name, infer.infer_label_col(df), infer.infer_time_col(df)) for name, df in tables.items()]
    return spark.createDataFrame(found, "name string, label string, time string")


@query
def threshold_f1_aligned(spark, sf):
    return out(curve.choose_threshold(_curve(spark, sf), pairing="aligned"))


@query
def threshold_fbeta(spark, sf):
    return out(curve.choose_threshold(_curve(spark, sf), policy="fbeta", beta=2.0))


@query
def threshold_recall_at_precision(spark, sf):
    return out(curve.choose_threshold(_curve(spark, sf), policy="recall_at_precision", min_precision=0.28))


@query
def threshold_precision_at_recall(spark, sf):
    return out(curve.choose_threshold(_curve(spark, sf), policy="precision_at_recall", min_recall=0.5))


@query
def logit_adjust(spark, sf):
    rows = scored(spark, sf)
    w = score.class_weights(labels.stage_targets(rows), "y1").select("prior_pos", "prior_neg")
    both = rows.crossJoin(F.broadcast(w))  # one row
    return out(both.select("symbol", "sec", logit_adjusted(F.col("p1"), F.col("prior_pos"), F.col("prior_neg"), 1.0).alias("p1_adjusted")))


@query
def gated_predict(spark, sf):
    return out(score.gate(scored(spark, sf), TAU, TAU2), "symbol", "sec", "p1", "p2", "yhat")


@query
def forced_predict(spark, sf):
    return out(score.gate(scored(spark, sf), TAU, TAU2, force=True), "symbol", "sec", "p1", "p2", "yhat")


@query
def e2e_report(spark, sf):
    return out(metrics.classification_report(score.gate(scored(spark, sf), TAU, TAU2, force=True), [0, 1, 2]))


@query
def binary_prf_predicted(spark, sf):
    return out(metrics.two_stage_prf(scored(spark, sf), TAU, TAU2, "predicted"))


@query
def binary_prf_true(spark, sf):
    return out(metrics.two_stage_prf(scored(spark, sf), TAU, TAU2, "true"))


@query
def tau_sweep(spark, sf):
    return out(metrics.gate_rate(scored(spark, sf), [0.3, 0.4, 0.5, 0.6], ["symbol"]))


def _latencies(spark, sf):
    """Latency records made from the events: two engines, parts of the time absent now and then."""
    e = table(spark, sf, "events").select("event_id", "value", "ts")
    ms = F.abs("value") % 10
    return e.select(
        "ts",
        F.when(F.col("event_id") % 2 == 0, "A").otherwise("B1").alias("engine"),
        (F.col("event_id") % 3).alias("k"),
        (F.col("event_id") % 5).alias("trial"),
        F.when(F.col("event_id") % 2 == 0, ms).alias("A_update_ms"),
        F.when(F.col("event_id") % 2 == 1, ms * 1.5).alias("A_ms"),
        (ms / 4).alias("B1_ms"),
        F.when(F.col("event_id") % 7 == 0, ms / 2).alias("B2_ms"),
    )


@query
def latency_normalize(spark, sf):
    rows = metrics.normalised_latency(_latencies(spark, sf))
    return out(rows.groupBy("engine", "k").agg(*[F.sum(c).alias(c) for c in ("A_ms", "B1_ms", "B2_ms", "total_ms")]))


@query
def latency_summary(spark, sf):
    return out(metrics.latency_summary(metrics.normalised_latency(_latencies(spark, sf)), ["engine", "k"], deadline=8.0))


@query
def latency_sketches(spark, sf):
    """The same summary from sketches that are kept for each day: counts and brackets from them, exact percentiles by one pass."""
    keys, shares, rows = ["engine", "k"], [0.5, 0.9, 0.95, 0.99], metrics.normalised_latency(_latencies(spark, sf))
    days = kept(sketches.period_sketches(rows, keys, "total_ms", "ts", deadline=8.0))
    exact = quantile.percentile_columns(rows, "total_ms", shares, keys, sketches.brackets(days, keys, "total_ms", shares))
    sums = sketches.merged(days, keys).select(*keys, "n", "mean", "miss_rate")
    return out(sums.join(exact, keys), *keys, "n", "mean", "p50", "p90", "p95", "p99", "miss_rate")


@query
def tail_ratio(spark, sf):
    summary = metrics.latency_summary(metrics.normalised_latency(_latencies(spark, sf)), ["engine", "k"])
    return out(metrics.tail_comparison(summary, ["k"], "engine", "A", "B1"))


@query
def trial_summary(spark, sf):
    per = metrics.latency_summary(metrics.normalised_latency(_latencies(spark, sf)), ["k", "trial"])
    return out(metrics.trial_summary(per, ["k"]))


@query
def throughput(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("start_s"))
    return out(metrics.throughput(e.withColumn("end_s", F.col("start_s") + 1), ["event_type"]))


@query
def robust_z_flags(spark, sf):
    rows = anomaly.robust_z_flags(labelled(spark, sf))
    return out(rows, "symbol", "sec", "is_shock", "abs_return_flag", "return_over_sigma_flag", "volspike_flag", "return_or_volspike_flag")


@query
def proxy_overlap(spark, sf):
    rows = anomaly.robust_z_flags(labelled(spark, sf))
    return out(anomaly.proxy_overlap(rows, ["abs_return_flag", "return_over_sigma_flag", "volspike_flag", "return_or_volspike_flag"]))


@query
def replay_k(spark, sf):
    return out(replay(feats(spark, sf), 8, stride=50, warmup=20), "t", "sym", "base", "idx", "r_t")


def _ticks(spark, sf, copies=8):
    return kept(replay(feats(spark, sf), copies, stride=50, warmup=20).select("t", "sym", "base", *FEATURES))


@query
def replay_scored(spark, sf):
    """Replayed ticks of the whole table through saved boosted trees behind the gate, as a measured stream."""
    scores, batches = replaying.replay_scores(_ticks(spark, sf), TwoStage.from_json(saved.BOOSTED), TAU, TAU2, _stream_dir(spark), 8)
    summary = replaying.replay_summary(batches).select("ticks", "hit_rate", "second_rate", F.when(F.col("ticks_per_s") > 0, 0).otherwise(1).alias("odd"))
    counts = scores.agg(F.count_if(F.col("yhat") == 1).alias("down"), F.count_if(F.col("yhat") == 2).alias("up"))
    return out(summary.crossJoin(F.broadcast(counts)))  # one row


@query
def gate_ablation(spark, sf):
    """The same replay with the gate and with the second stage for all ticks: equal predictions, other work."""
    scores, sums = replaying.gate_ablation(_ticks(spark, sf), TwoStage.from_json(saved.LINEAR), TAU, TAU2, _stream_dir(spark), 4)
    counts = scores.groupBy("mode").agg(F.count("p2").alias("second"), F.count_if(F.col("yhat") == 1).alias("down"), F.count_if(F.col("yhat") == 2).alias("up"))
    return out(counts.join(sums.select("mode", "ticks", "hit_rate"), "mode"))


@query
def artifact_tag_rows(spark, sf):
    e = table(spark, sf, "events").where("event_id IS NOT NULL AND user_id IS NOT NULL")
    alpha, lam = F.pmod("user_id", F.lit(40)) / 4, F.pmod("event_id", F.lit(64)) / 64
    tag = artifact_tag(F.pmod("event_id", F.lit(60)) + 1, alpha, lam)
    return e.groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def _two_stage(spark, sf, kind):
    rows = split.two_way(_split(spark, sf), 0.2, HORIZON).select("symbol", "sec", "part", "y", *FEATURES)
    rows = kept(rows)
    val = rows.where("part = 'val'")
    both = training.two_stage(rows.where("part = 'train'"), val, kind, validation=val)
    return score.gate(both, TAU, TAU2).select("symbol", "sec", "y", "p1", "p2", "yhat")


@query
def lr_scores(spark, sf):
    return _two_stage(spark, sf, "lr")


@query
def rf_scores(spark, sf):
    return _two_stage(spark, sf, "rf")


@query
def gbt_scores(spark, sf):
    return _two_stage(spark, sf, "gbt")


@query
def isolation_forest_flags(spark, sf):
    rows = anomaly.isolation_scores(labelled(spark, sf).select("symbol", "sec", "y", *FEATURES), key=["symbol", "sec"])
    return anomaly.top_share_flags(rows, ["score"], 0.2).select("symbol", "sec", "y", "score", "score_flag")


@query
def isolation_saved_scores(spark, sf):
    """Scores by a saved isolation forest, as an expression."""
    doc = json.loads(saved.FOREST)
    forest = Trees(tuple(doc["columns"]), doc["depth"], tuple(doc["trees"]), "shares")
    return out(feats(spark, sf).select("symbol", "sec", F.pow(F.lit(2.0), -forest.probability() / doc["usual"]).alias("score")))


@query
def holdout_metrics(spark, sf):
    _, _, metrics_rows = training.hold_out(labelled(spark, sf), HORIZON)
    return metrics_rows.select("model", "population", "stage", "tp", "fp", "fn", "precision", "recall", "f1")


@query
def gated_second_model(spark, sf):
    rows = scored(spark, sf)
    second = lambda part: part.withColumn("p2", F.round(1 / (1 + F.exp(-F.col("Imbalance_t"))), 4))
    return out(score.gated_transform(rows.drop("p2"), second, TAU, TAU2), "symbol", "sec", "p1", "p2", "yhat")


@query
def threshold_join(spark, sf):
    """A gate tuned for each symbol of many shocks, the default for others, joined to the scores."""
    rows = scored(spark, sf)
    tuned = rows.groupBy(F.col("symbol").alias("of")).agg(F.when(F.count_if(F.col("y") != 0) % 2 == 0, F.avg("p1")).alias("thr"))
    both = rows.join(tuned, F.col("symbol") == F.col("of"))
    both = both.withColumn("tau", score.threshold(None, F.round("thr", 3), TAU))
    return out(score.gate(both, F.col("tau"), TAU2).groupBy("symbol", "tau", "yhat").agg(F.count(F.lit(1)).alias("n")))


@query
def feature_vector(spark, sf):
    values = F.array(*[F.col(c).cast("double") for c in FEATURES], F.col("vwap"))
    rows = feats(spark, sf).withColumn("x", score.feature_vector(values))
    return out(rows.select("symbol", "sec", F.size("x").alias("size"), F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("total")))


@query
def message_parse(spark, sf):
    """The events as JSON messages, every tenth of them broken, parsed again."""
    t = trades_of_events(table(spark, sf, "events").where("event_id % 10 != 0"))
    message = F.struct(F.upper("symbol").alias("s"), F.unix_millis("ts").alias("T"), F.col("price").cast("string").alias("p"), F.col("qty").cast("string").alias("q"), F.col("is_buyer_maker").alias("m"))
    broken = table(spark, sf, "events").where("event_id % 10 = 0").select(F.concat(F.lit('{"s":"'), "event_id").alias("value"))
    good, rest = parse_messages(t.select(F.to_json(message).alias("value")).unionByName(broken))
    sums = good.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"), F.sum("qty").alias("qty"), F.count_if("is_buyer_maker").alias("makers"))
    zero = F.lit(0.0)
    return out(sums.unionByName(rest.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("symbol"), "n", zero.alias("price"), zero.alias("qty"), F.lit(0).cast("long").alias("makers"))))


@query
def chunk_scan(spark, sf):
    """Trades written as files with times as strings, some of which are none, and scanned."""
    e = table(spark, sf, "events").withColumn("at", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    t = trades_of_events(e.withColumn("ts", F.col("ts").cast("timestamp")))
    lines = e.select("event_id", "at", "event_type", "value", "props", "user_id").withColumn("ts", F.when(F.col("event_id") % 10 == 0, "not a time").otherwise(F.col("at")))
    lines = lines.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)").alias("qty"), (F.col("user_id") % 2 == 1).alias("is_buyer_maker"))
    path = work_dir(spark)
    lines.write.parquet(path)
    rows = read_trades(spark, path, pattern="part-*.parquet")
    assert rows.columns == t.columns
    return out(rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.min("ts").alias("first_sec"), F.max("ts").alias("last_sec")))


@query
def flush_tail(spark, sf):
    """Features flushed to numbered files, and the newest rows of the first symbol read back."""
    rows, path = kept(feats(spark, sf)), work_dir(spark)
    files.write_flush(rows, path, 50)
    symbol = rows.agg(F.min("symbol")).first()[0]
    return out(files.read_tail(spark, path, symbol, 100, ["sec", "vwap", "r_t"], time_sort=True))


@query
def results_union(spark, sf):
    """Two result tables as CSV, read back from the one that has all."""
    rows, path = metrics.normalised_latency(_latencies(spark, sf)), work_dir(spark)
    sums = [F.count(F.lit(1)).alias("n"), F.max("total_ms").alias("most")]
    files.write_results({"by_engine": rows.groupBy("engine").agg(*sums), "by_k": rows.groupBy("k").agg(*sums)}, path)
    full = spark.read.option("header", True).csv(f"{path}/FULL")
    return out(full.select("engine", F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"), F.col("most").cast("double").alias("most")))


@query
def labelled_files(spark, sf):
    """Labelled rows written as Parquet and as CSV and read back."""
    rows, path = kept(labelled(spark, sf).select("symbol", "sec", *[F.col(c).cast("double") for c in FEATURES], "future_r", "y")), work_dir(spark)
    files.write_labeled(rows, f"{path}/rows")
    rows.write.option("header", True).csv(f"{path}/rows.csv")
    parts = [files.read_labeled(spark, f"{path}/rows{end}").withColumn("kind", F.lit(kind)) for end, kind in (("", "parquet"), (".csv", "csv"))]
    both = parts[0].unionByName(parts[1])
    return out(both.groupBy("kind", "symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") != 0).alias("shocks"), F.sum("future_r").alias("future_r"), F.max("sec").alias("last_sec")))


def _stream_dir(spark: SparkSession) -> str:
    return work_dir(spark, "stream")


def _live_trades(spark, sf):
    # a stream takes a folder or a pattern, and the table may be one file
    schema = table(spark, sf, "events").schema
    return trades_of_events(spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"))


def _live_bars(spark, sf):
    return live.stream_bars(_live_trades(spark, sf), "1 hour", "1 hour")


@query
def stream_bars(spark, sf):
    rows = live.run_to_table(_live_bars(spark, sf).drop("window"), _stream_dir(spark))
    return out(rows, "symbol", "sec", "sum_pq", "sum_q", "total_vol", "buy_vol", "sell_vol", "msg_count")


def _live_features(spark, sf):
    live.use_rocksdb(spark)
    return ring.live_features(_live_trades(spark, sf), 3600, "1 hour", idle=40 * 86_400)


@query
def stream_features(spark, sf):
    rows = live.run_to_table(_live_features(spark, sf), _stream_dir(spark))
    return out(rows, "symbol", "sec", "total_vol", "vwap", "buy_vol", "sell_vol", *FEATURES, "window_rows")


@query
def stream_restart(spark, sf):
    """The stream of features, stopped after the first half of the time and started again when the rest is there."""
    live.use_rocksdb(spark)
    path, events = _stream_dir(spark), table(spark, sf, "events")
    half = events.agg(F.avg(F.unix_seconds(F.col("ts").cast("timestamp"))).cast("long")).first()[0] or 0
    for side in ("<", ">="):
        events.where(F.expr(f"unix_seconds(CAST(ts AS TIMESTAMP)) {side} {half}")).write.mode("append").parquet(f"{path}/in")
        trades_now = trades_of_events(spark.readStream.schema(events.schema).parquet(f"{path}/in"))
        rows = live.run_to_table(ring.live_features(trades_now, 3600, "1 hour", idle=40 * 86_400), f"{path}/run")
    return out(rows, "symbol", "sec", "total_vol", "vwap", "buy_vol", "sell_vol", *FEATURES, "window_rows")


@query
def stream_scores(spark, sf):
    scores = live.stream_scores(_live_features(spark, sf), with_formulas, TAU, TAU2)
    return out(live.run_to_table(scores, _stream_dir(spark)), "symbol", "sec", "p1", "p2", "yhat")


@query
def stream_linear_scores(spark, sf):
    """A saved two-stage logistic regression inside the stream."""
    scores = TwoStage.from_json(saved.LINEAR).gated(_live_features(spark, sf), TAU, TAU2)
    return out(live.run_to_table(scores, _stream_dir(spark)), "symbol", "sec", "p1", "p2", "yhat")


@query
def stream_tree_scores(spark, sf):
    """Saved boosted trees inside the stream."""
    scores = TwoStage.from_json(saved.BOOSTED).gated(_live_features(spark, sf), TAU, TAU2)
    return out(live.run_to_table(scores, _stream_dir(spark)), "symbol", "sec", "p1", "p2", "yhat")


@query
def linear_scores(spark, sf):
    """The same regression, stored and loaded, over the whole table of labelled rows, the second stage for all of them."""
    path = f"{work_dir(spark)}/H5_a0.5_L94"
    TwoStage.from_json(saved.LINEAR).save(spark, path)
    return out(TwoStage.load(spark, path).gated(labelled(spark, sf), TAU, TAU2, force=True), "symbol", "sec", "y", "p1", "p2", "yhat")


@query
def stream_progress(spark, sf):
    """What the table of progress holds of a stream: rows read, bars put out, state rows in the end."""
    live.use_rocksdb(spark)
    stream = progress.measured(_live_features(spark, sf), bars=F.count(F.lit(1)), trades=F.sum("msg_count"))
    _, table = progress.run_with_progress(stream, _stream_dir(spark))
    own = lambda n: F.sum(F.coalesce(F.col("measures")[n], F.lit(0.0))).cast("long").alias(n)
    return out(table.agg(F.sum("rows").alias("rows"), own("bars"), own("trades"), F.count_if((F.col("total_ms") <= 0) | (F.col("state_rows") < 0)).alias("odd")))


@query
def stream_hot_rows(spark, sf):
    """The newest rows of each symbol that the stream with two sinks keeps at hand."""
    path = _stream_dir(spark)
    run = live.write_hot_and_cold(_live_features(spark, sf), f"{path}/sinks", f"{path}/checkpoint")
    run.awaitTermination()
    return out(live.hot_rows(spark, f"{path}/sinks"), "symbol", "sec", "vwap", *FEATURES)


for _plain, _name in (("bars_hourly", "bars"), ("artifact_tag_rows", "artifact_tag")):
    Q[_name] = Q.pop(_plain)
