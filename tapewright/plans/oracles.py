"""DuckDB SQL with the results of the registered queries, written from plain windows and a recursive query."""

from __future__ import annotations

import json

from . import saved

TRADES = """trades AS (
    SELECT event_type AS symbol, ts, value AS price, CAST(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS DOUBLE) AS qty, user_id % 2 = 1 AS maker
    FROM events WHERE ts IS NOT NULL)"""
BARS = f"""{TRADES}, bars AS (
    SELECT symbol, date_trunc('hour', ts) AS sec, coalesce(sum(price * qty), 0) AS sum_pq, coalesce(sum(qty), 0) AS sum_q, coalesce(sum(qty), 0) AS total_vol,
        coalesce(sum(CASE WHEN maker THEN 0 ELSE qty END), 0) AS buy_vol, coalesce(sum(CASE WHEN maker THEN qty ELSE 0 END), 0) AS sell_vol, count(*) AS msg_count
    FROM trades GROUP BY 1, 2)"""


def feature_sql(series: str = "symbol", chunk: str = "0") -> str:
    """Common table expressions up to ``feats``; ``series`` is what the recurrences run along."""
    return f"""{BARS}, series AS (SELECT *, {chunk} AS chunk_id FROM bars), priced AS (
    SELECT *, coalesce(last_value(CASE WHEN sum_q > 0 THEN sum_pq / sum_q END IGNORE NULLS) OVER (PARTITION BY {series} ORDER BY sec ROWS UNBOUNDED PRECEDING), 0) AS vwap,
        row_number() OVER (PARTITION BY {series} ORDER BY sec) - 1 AS idx, count(*) OVER (PARTITION BY {series}) AS key_rows FROM series),
returned AS (
    SELECT *, CASE WHEN prev > 0 AND vwap > 0 THEN ln(vwap / (prev + 1e-9)) ELSE 0 END AS r_t FROM (
        SELECT *, lag(vwap) OVER (PARTITION BY {series} ORDER BY sec) AS prev,
            avg(total_vol) OVER (PARTITION BY {series} ORDER BY sec ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS baseline FROM priced)),
ewma AS (
    SELECT symbol, chunk_id, idx, r_t * r_t AS s FROM returned WHERE idx = 0
    UNION ALL
    SELECT r.symbol, r.chunk_id, r.idx, 0.94 * e.s + 0.06 * r.r_t * r.r_t FROM ewma e JOIN returned r ON r.symbol = e.symbol AND r.chunk_id = e.chunk_id AND r.idx = e.idx + 1),
feats AS (
    SELECT r.*, sqrt(e.s + 1e-9) AS sigma_hat, buy_vol - sell_vol AS OFI_t, (buy_vol - sell_vol) / (buy_vol + sell_vol + 1e-9) AS Imbalance_t,
        total_vol / (baseline + 1e-9) AS VolSpike_t FROM returned r JOIN ewma e USING (symbol, chunk_id, idx))"""


FEATS = feature_sql()
LABELLED = f"""{FEATS}, ahead AS (
    SELECT *, CASE WHEN count(*) OVER w = 5 THEN sum(r_t) OVER w END AS future_r FROM feats
    WINDOW w AS (PARTITION BY symbol ORDER BY sec ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
labelled AS (
    SELECT *, CASE WHEN future_r <= -0.5 * sqrt(5) * sigma_hat THEN 1 WHEN future_r >= 0.5 * sqrt(5) * sigma_hat THEN 2 ELSE 0 END AS y
    FROM ahead WHERE future_r IS NOT NULL)"""
SCORED = f"""{LABELLED}, scored AS (
    SELECT *, round(1 / (1 + exp(-(abs(r_t) - 1))), 4) AS p1, round(1 / (1 + exp(-Imbalance_t)), 4) AS p2 FROM labelled)"""
CURVE = f"""{SCORED}, counts AS (
    SELECT p1 AS thr, sum(CASE WHEN y <> 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS b FROM scored GROUP BY 1),
sums AS (SELECT thr, sum(a) OVER (ORDER BY thr DESC) AS tp, sum(b) OVER (ORDER BY thr DESC) AS fp, (SELECT sum(a) FROM counts) AS positives FROM counts),
curve AS (SELECT thr, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tp AS DOUBLE) / (tp + fp) AS prec, CASE WHEN positives > 0 THEN CAST(tp AS DOUBLE) / positives ELSE 1 END AS rec, positives FROM sums),
ap AS (SELECT sum((rec - coalesce(above, 0)) * prec) AS ap FROM (SELECT *, lead(rec) OVER (ORDER BY thr) AS above FROM curve))"""
HOUR = "CAST(epoch(sec) AS BIGINT) AS sec"
F6 = ["r_t", "sigma_hat", "OFI_t", "Imbalance_t", "VolSpike_t"]


def rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _threshold(value: str, beta: float = 1.0, allowed: str = "true", aligned: bool = False) -> str:
    point = "prec AS p, rec AS r" if aligned else "coalesce(lead(prec) OVER (ORDER BY thr), 1) AS p, coalesce(lead(rec) OVER (ORDER BY thr), 0) AS r"
    b = beta * beta
    return f"""WITH RECURSIVE {CURVE}, points AS (SELECT thr, {point} FROM curve),
    valued AS (SELECT *, 2 * p * r / (p + r + 1e-12) AS f1, {1 + b} * p * r / ({b} * p + r + 1e-12) AS fbeta FROM points),
    marked AS (SELECT *, {allowed} AS ok, {value} AS v FROM valued),
    usable AS (SELECT * FROM marked WHERE ok OR NOT EXISTS (SELECT 1 FROM marked WHERE ok)),
    best AS (SELECT * FROM usable WHERE abs(v - (SELECT max(v) FROM usable)) <= 1e-12 + 1e-5 * abs((SELECT max(v) FROM usable)))
    SELECT round(thr, 6) AS thr, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(fbeta, 6) AS fbeta, round(ap, 6) AS ap
    FROM best, ap ORDER BY best.p DESC, best.r DESC, best.thr DESC LIMIT 1"""


SPLIT = f"""{LABELLED}, placed AS (
    SELECT * EXCLUDE (idx, key_rows), row_number() OVER (ORDER BY sec, symbol) - 1 AS idx, count(*) OVER () AS n FROM labelled),
two_way AS (
    SELECT *, CASE WHEN idx < greatest(split - 5, 1) THEN 'train' WHEN idx >= split THEN 'val' END AS part
    FROM (SELECT *, greatest(least(CAST(floor(n * 0.8::DOUBLE) AS BIGINT), n - 1), 1) AS split FROM placed)),
three_way AS (
    SELECT *, CASE WHEN idx < a THEN 'train' WHEN idx >= a + 5 AND idx < a + 5 + b THEN 'val' WHEN idx >= a + 5 + b + 5 THEN 'test' END AS part
    FROM (SELECT *, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS a, CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS b FROM placed)),
scaler AS (SELECT {", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) + 1e-8 AS sd_{c}" for c in [*F6, "msg_count"])} FROM two_way WHERE part = 'train')"""
LATENCY = """raw AS (
    SELECT CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B1' END AS engine, event_id % 3 AS k, event_id % 5 AS trial,
        CASE WHEN event_id % 2 = 0 THEN abs(value) % 10 ELSE (abs(value) % 10) * 1.5 END AS A_ms, (abs(value) % 10) / 4 AS B1_ms,
        CASE WHEN event_id % 7 = 0 THEN (abs(value) % 10) / 2 ELSE 0 END AS B2_ms FROM events),
latency AS (SELECT *, A_ms + B1_ms + B2_ms AS total_ms FROM raw)"""
FLAGS = ["abs_return", "return_over_sigma", "volspike"]


def _cut(c: str) -> str:
    """SQL of the interpolated percentile that leaves the shocks' share above it."""
    at = f"(SELECT z_{c} FROM (SELECT z_{c}, row_number() OVER (ORDER BY z_{c}) - 1 AS i FROM z) WHERE i = (SELECT {{0}}(pos) FROM share))"
    lo, hi = at.format("floor"), at.format("ceil")
    return f"{lo} + ({hi} - {lo}) * (SELECT pos - floor(pos) FROM share) AS c_{c}"


FLAGGED = f"""{LABELLED}, measured AS (SELECT *, y <> 0 AS is_shock, abs(r_t) AS abs_return, abs(r_t) / sigma_hat AS return_over_sigma, VolSpike_t AS volspike FROM labelled),
medians AS (SELECT {", ".join(f"median({c}) AS m_{c}" for c in FLAGS)} FROM measured),
mads AS (SELECT {", ".join(f"median(abs({c} - m_{c})) AS d_{c}" for c in FLAGS)} FROM measured, medians),
z AS (SELECT measured.*, {", ".join(f"({c} - m_{c}) / (d_{c} + 1e-12) AS z_{c}" for c in FLAGS)} FROM measured, medians, mads),
share AS (SELECT (1 - avg(is_shock::INT)) * (count(*) - 1) AS pos FROM z),
cuts AS (SELECT {", ".join(_cut(c) for c in FLAGS)}),
flagged AS (SELECT *, abs_return_flag OR volspike_flag AS return_or_volspike_flag FROM (SELECT z.*, {", ".join(f"z_{c} >= c_{c} AS {c}_flag" for c in FLAGS)} FROM z, cuts))"""
W = "WITH RECURSIVE "
CLOSED = "sec + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)"


def _prf(t: str, p: str, rows: str, stage: int) -> str:
    """SQL of one stage's counts and rates."""
    return f"""SELECT tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, {stage}::BIGINT AS stage FROM (
        SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM (
            SELECT count(*) FILTER ({t} AND {p}) AS tp, count(*) FILTER (NOT {t} AND {p}) AS fp, count(*) FILTER ({t} AND NOT {p}) AS fn FROM scored WHERE {rows}))"""


def _report() -> str:
    per = " UNION ALL ".join(
        f"""SELECT '{c}' AS label, coalesce(tp / nullif(pp, 0), 0) AS p, coalesce(tp / nullif(s, 0), 0) AS r, s FROM (
            SELECT count(*) FILTER (y = {c} AND yhat = {c}) AS tp, count(*) FILTER (yhat = {c}) AS pp, count(*) FILTER (y = {c}) AS s FROM predicted)"""
        for c in (0, 1, 2)
    )
    return f"""{W}{SCORED}, predicted AS (SELECT y, CASE WHEN p1 < 0.5 THEN 0 WHEN p2 >= 0.5 THEN 2 ELSE 1 END AS yhat FROM scored),
    per AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM ({per})),
    n AS (SELECT count(*) AS n, avg((y = yhat)::INT) AS acc FROM predicted)
    SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s AS support FROM per
    UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM n
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM per
    UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM per"""


def _frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY sec ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def _settled(sql: str) -> str:
    """``round(x, 6)`` as the queries round: halves, which sums reach from either side, go up."""
    while (at := sql.find("round(")) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 6 : end - 1]
        assert inner.endswith((", 6", ", 4")), inner
        new = f"(floor(({inner[:-3]}) * 1e6 + 0.501) / 1e6)" if inner.endswith(", 6") else f"ROUND({inner})"
        sql = sql[:at] + new + sql[end:]
    return sql


PREDICTED = "round(p1, 6) AS p1, {p2} AS p2, CAST(CASE WHEN p1 < 0.5 THEN 0 WHEN p2 >= 0.5 THEN 2 ELSE 1 END AS BIGINT) AS yhat"

ORACLES: dict[str, str] = {
    "trade_side_split": f"WITH {TRADES} SELECT symbol, CASE WHEN maker THEN -1 ELSE 1 END::BIGINT AS side, count(*) AS n, round(sum(qty), 6) AS qty, round(sum(price * qty), 6) AS notional FROM trades GROUP BY 1, 2",
    "bars": f"WITH {BARS} SELECT symbol, {HOUR}, {rounded('sum_pq', 'sum_q', 'total_vol', 'buy_vol', 'sell_vol')}, msg_count FROM bars",
    "bars_daily_lineitem": """SELECT l_returnflag AS symbol, CAST(epoch(date_trunc('day', l_shipdate)::TIMESTAMP) AS BIGINT) AS sec,
        round(sum(l_extendedprice / nullif(l_quantity, 0) * l_quantity), 6) AS sum_pq, round(sum(l_quantity), 6) AS total_vol,
        round(sum(CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_quantity END), 6) AS buy_vol, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END), 6) AS sell_vol,
        count(*) AS msg_count FROM lineitem GROUP BY 1, 2""",
    "bars_zero_qty_fallback": f"{W}{FEATS} SELECT symbol, {HOUR}, {rounded('vwap')}, msg_count FROM feats WHERE sum_q = 0",
    "log_return": f"{W}{FEATS} SELECT symbol, {HOUR}, {rounded('vwap', 'r_t')} FROM feats",
    "ewma_sigma": f"{W}{FEATS} SELECT symbol, {HOUR}, {rounded('sigma_hat')} FROM feats",
    "rolling_vol_baseline": f"{W}{FEATS} SELECT symbol, {HOUR}, {rounded('baseline', 'VolSpike_t')} FROM feats",
    "feature_rows": f"{W}{FEATS} SELECT symbol, {HOUR}, {rounded('total_vol', 'vwap', 'buy_vol', 'sell_vol', *F6)}, msg_count FROM feats",
    "feature_rows_per_chunk": f"{W}{feature_sql('symbol, chunk_id', 'day(sec) % 3')} SELECT symbol, chunk_id, {HOUR}, {rounded('vwap', 'r_t', 'sigma_hat', 'VolSpike_t')} FROM feats",
    "forward_return": f"{W}{LABELLED} SELECT symbol, {HOUR}, {rounded('future_r')} FROM ahead",
    "shock_labels": f"{W}{LABELLED} SELECT symbol, {HOUR}, {rounded('future_r')}, y::BIGINT AS y FROM labelled",
    "label_alpha_sweep": f"""{W}{LABELLED}, swept AS (
        SELECT alpha, future_r, CASE WHEN future_r <= -alpha * sqrt(5) * sigma_hat THEN 1 WHEN future_r >= alpha * sqrt(5) * sigma_hat THEN 2 ELSE 0 END AS y
        FROM labelled, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) AS a(alpha)),
        summed AS (SELECT alpha, count(*) AS n, count(*) FILTER (y <> 0) AS shocks, count(*) FILTER (y = 1) AS neg, count(*) FILTER (y = 2) AS pos,
            quantile_cont(abs(future_r), 0.5) FILTER (y <> 0) AS p50, quantile_cont(abs(future_r), 0.9) FILTER (y <> 0) AS p90, quantile_cont(abs(future_r), 0.99) FILTER (y <> 0) AS p99
            FROM swept GROUP BY alpha)
        SELECT alpha, n, shocks, neg, pos, {rounded('p50', 'p90', 'p99')}, round(shocks / n, 6) AS shock_rate, round(neg / n, 6) AS neg_rate, round(pos / n, 6) AS pos_rate, round(pos / nullif(neg, 0), 6) AS pos_neg_ratio FROM summed""",
    "stage_targets": f"{W}{LABELLED} SELECT symbol, (y <> 0)::BIGINT AS y1, CASE WHEN y <> 0 THEN (y = 2)::BIGINT ELSE -1 END AS y2, count(*) AS n FROM labelled GROUP BY 1, 2, 3",
    "split_gap_2way": f"{W}{SPLIT} SELECT symbol, {HOUR}, idx, part FROM two_way WHERE part IS NOT NULL",
    "split_gap_3way": f"{W}{SPLIT} SELECT symbol, {HOUR}, idx, part FROM three_way WHERE part IS NOT NULL",
    "scaler_fit": f"{W}{SPLIT} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(mu_{c}, 6) AS mu, round(sd_{c}, 6) AS sd FROM scaler" for c in [*F6, "msg_count"]),
    "scaled_features": f"{W}{SPLIT} SELECT symbol, {HOUR}, " + ", ".join(f"round(({c} - mu_{c}) / sd_{c}, 6) AS {c}" for c in [*F6, "msg_count"]) + " FROM two_way, scaler WHERE part = 'val'",
    "class_weights": f"""{W}{LABELLED}, c AS (SELECT count(*) AS n, count(*) FILTER (y <> 0) AS pos, count(*) FILTER (y = 0) AS neg FROM labelled)
        SELECT n, pos, neg, round(pos / n, 6) AS prior_pos, round(neg / n, 6) AS prior_neg, round(neg / pos, 6) AS scale_pos_weight, round(n / (2 * pos), 6) AS weight_pos, round(n / (2 * neg), 6) AS weight_neg FROM c""",
    "last_w_window": f"""{W}{FEATS} SELECT symbol, {HOUR}, count(*) OVER w AS n, round(first_value(r_t) OVER w, 6) AS first_r, round(first_value(msg_count::DOUBLE) OVER w, 6) AS first_count,
        round(sum(VolSpike_t) OVER w, 6) AS spikes FROM feats WINDOW w AS {_frame(29)}""",
    "last_w_state": f"{W}{FEATS} SELECT * FROM (SELECT symbol, {HOUR}, row_number() OVER (PARTITION BY symbol ORDER BY feats.sec DESC) AS nth, {rounded(*F6)}, msg_count FROM feats) WHERE nth <= 30",
    "rolling_zscore": f"{W}{FEATS} SELECT symbol, {HOUR}, round((total_vol - avg(total_vol) OVER w) / (stddev_pop(total_vol) OVER w + 1e-9), 6) AS total_vol_z FROM feats WINDOW w AS {_frame(29)}",
    "first_diff": f"{W}{FEATS} SELECT symbol, {HOUR}, round(total_vol - lag(total_vol) OVER (PARTITION BY symbol ORDER BY feats.sec), 6) AS total_vol_d FROM feats",
    "flush_index": f"{W}{FEATS} SELECT symbol, idx // 100 + 1 AS flush_idx, count(*) AS n, CAST(epoch(min(sec)) AS BIGINT) AS first_sec, CAST(epoch(max(sec)) AS BIGINT) AS last_sec FROM feats GROUP BY 1, 2",
    "tail_n": f"{W}{FEATS} SELECT symbol, {HOUR}, {rounded('vwap')} FROM feats ORDER BY feats.sec DESC, symbol DESC LIMIT 500",
    "pr_curve": f"{W}{CURVE} SELECT thr, tp, fp, round(prec, 6) AS precision, round(rec, 6) AS recall FROM curve",
    "average_precision": f"{W}{CURVE} SELECT {rounded('ap')} FROM ap",
    "threshold_f1_reference": _threshold("f1"),
    "threshold_f1_aligned": _threshold("f1", aligned=True),
    "threshold_fbeta": _threshold("fbeta", 2.0),
    "threshold_recall_at_precision": _threshold("r", allowed="p >= 0.28"),
    "threshold_precision_at_recall": _threshold("p", allowed="r >= 0.5"),
    "logit_adjust": f"""{W}{SCORED}, c AS (SELECT avg((y <> 0)::INT) AS pos FROM scored), q AS (SELECT symbol, sec, pos, greatest(least(p1, 1 - 1e-12), 1e-12) AS p FROM scored, c)
        SELECT symbol, {HOUR}, round(1 / (1 + exp(-(ln(p / (1 - p)) + ln(pos / (1 - pos))))), 6) AS p1_adjusted FROM q""",
    "gated_predict": f"{W}{SCORED} SELECT symbol, {HOUR}, {PREDICTED.format(p2='CASE WHEN p1 >= 0.5 THEN round(p2, 6) END')} FROM scored",
    "forced_predict": f"{W}{SCORED} SELECT symbol, {HOUR}, {PREDICTED.format(p2='round(p2, 6)')} FROM scored",
    "e2e_report": _report(),
    "binary_prf_predicted": f"{W}{SCORED} {_prf('y <> 0', 'p1 >= 0.5', 'true', 1)} UNION ALL {_prf('y = 2', 'p2 >= 0.5', 'p1 >= 0.5', 2)}",
    "binary_prf_true": f"{W}{SCORED} {_prf('y <> 0', 'p1 >= 0.5', 'true', 1)} UNION ALL {_prf('y = 2', 'p2 >= 0.5', 'y <> 0', 2)}",
    "tau_sweep": f"{W}{SCORED} SELECT symbol, tau, count(*) AS n, round(avg((p1 >= tau)::INT), 6) AS inv_rate FROM scored, (VALUES (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE)) AS t(tau) GROUP BY 1, 2",
    "latency_normalize": f"WITH {LATENCY} SELECT engine, k, " + ", ".join(f"round(sum({c}), 6) AS {c}" for c in ("A_ms", "B1_ms", "B2_ms", "total_ms")) + " FROM latency GROUP BY 1, 2",
    "latency_summary": f"""WITH {LATENCY} SELECT engine, k, count(*) AS n, round(avg(total_ms), 6) AS mean, {", ".join(f"round(quantile_cont(total_ms, {q}), 6) AS p{int(100 * q)}" for q in (0.5, 0.9, 0.95, 0.99))},
        round(avg((total_ms > 8)::INT), 6) AS miss_rate FROM latency GROUP BY 1, 2""",
    "tail_ratio": f"""WITH {LATENCY}, s AS (SELECT engine, k, avg(total_ms) AS mean, quantile_cont(total_ms, 0.99) AS p99 FROM latency GROUP BY 1, 2)
        SELECT k, round(a.p99, 6) AS fast_p99, round(a.mean, 6) AS fast_mean, round(b.p99, 6) AS slow_p99, round(b.mean, 6) AS slow_mean, round(b.p99 / greatest(a.p99, 1e-12), 6) AS gain,
            round(a.mean - b.mean, 6) AS diff, a.mean > b.mean AS fast_is_slower FROM s a JOIN s b USING (k) WHERE a.engine = 'A' AND b.engine = 'B1'""",
    "trial_summary": f"""WITH {LATENCY}, s AS (SELECT k, trial, quantile_cont(total_ms, 0.5) AS p50, quantile_cont(total_ms, 0.99) AS p99 FROM latency GROUP BY 1, 2)
        SELECT k, count(*) AS trials, {", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in ("p50", "p99") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))} FROM s GROUP BY 1""",
    "throughput": "SELECT event_type, count(*) AS n, round(count(*) / (max(floor(epoch(ts))) + 1 - min(floor(epoch(ts)))), 6) AS ops_per_s FROM events GROUP BY 1",
    "robust_z_flags": f"{W}{FLAGGED} SELECT symbol, {HOUR}, is_shock, abs_return_flag, return_over_sigma_flag, volspike_flag, return_or_volspike_flag FROM flagged",
    "proxy_overlap": f"""{W}{FLAGGED}, m AS ("""
    + " UNION ALL ".join(f"SELECT '{c}_flag' AS method, is_shock AS t, {c}_flag AS f FROM flagged" for c in [*FLAGS, "return_or_volspike"])
    + """), c AS (SELECT method, count(*) FILTER (t AND f) AS tp, count(*) FILTER (NOT t AND f) AS fp, count(*) FILTER (t AND NOT f) AS fn, count(*) FILTER (NOT t AND NOT f) AS tn, count(*) AS n FROM m GROUP BY 1)
        SELECT method, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS jaccard,
            round((tp + tn) / n, 6) AS agreement, round((tp + fp) / n, 6) AS anomaly_rate, round((tp + fn) / n, 6) AS proxy_rate FROM c""",
    "replay_k": f"""{W}{FEATS}, bases AS (SELECT symbol AS base, row_number() OVER (ORDER BY symbol) - 1 AS place, count(*) OVER () AS turns FROM (SELECT DISTINCT symbol FROM feats))
        SELECT t, t % 8 AS sym, base, idx, {rounded('r_t')} FROM (SELECT unnest(range(8 * (SELECT max(key_rows) FROM feats))) AS t) JOIN bases ON place = (t % 8) % turns
        JOIN feats ON symbol = base AND idx = 50 * (t % 8) + 20 + t // 8""",
    "artifact_tag": """SELECT 'H' || (event_id % 60 + 1) || '_a' || (CASE WHEN user_id % 4 = 0 THEN (user_id % 40 // 4)::VARCHAR ELSE (user_id % 40 / 4)::DOUBLE::VARCHAR END)
            || '_L' || lpad(round_even(event_id % 64 * 100 / 64, 0)::BIGINT::VARCHAR, 2, '0') AS tag, count(*) AS n
        FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL GROUP BY 1""",
    "gated_second_model": f"{W}{SCORED} SELECT symbol, {HOUR}, {PREDICTED.format(p2='CASE WHEN p1 >= 0.5 THEN round(p2, 6) END')} FROM scored",
    "threshold_join": f"""{W}{SCORED}, tuned AS (SELECT symbol, coalesce(CASE WHEN count(*) FILTER (y <> 0) % 2 = 0 THEN floor(avg(p1) * 1e3 + 0.5) / 1e3 END, 0.5) AS tau FROM scored GROUP BY 1)
        SELECT symbol, round(tau, 6) AS tau, CAST(CASE WHEN p1 < tau THEN 0 WHEN p2 >= 0.5 THEN 2 ELSE 1 END AS BIGINT) AS yhat, count(*) AS n FROM scored JOIN tuned USING (symbol) GROUP BY 1, 2, 3""",
    "feature_vector": f"{W}{FEATS} SELECT symbol, {HOUR}, 6::BIGINT AS size, round(r_t + sigma_hat + OFI_t + Imbalance_t + VolSpike_t + msg_count, 6) AS total FROM feats",
    "message_parse": f"""WITH {TRADES.replace("FROM events WHERE ts IS NOT NULL", "FROM events WHERE event_id % 10 <> 0")},
        good AS (SELECT * FROM trades WHERE ts IS NOT NULL AND price IS NOT NULL AND qty IS NOT NULL)
        SELECT lower(symbol) AS symbol, count(*) AS n, round(sum(price), 6) AS price, round(sum(qty), 6) AS qty, count(*) FILTER (maker) AS makers FROM good GROUP BY 1
        UNION ALL SELECT 'rejected', (SELECT count(*) FROM events) - (SELECT count(*) FROM good), 0, 0, 0""",
    "chunk_scan": """SELECT event_type AS symbol, count(*) AS n, round(sum(CAST(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS DOUBLE)), 6) AS qty,
            CAST(floor(epoch(min(ts))) AS BIGINT) AS first_sec, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_sec
        FROM events WHERE ts IS NOT NULL AND event_id % 10 <> 0 GROUP BY 1""",
    "flush_tail": f"{W}{FEATS} SELECT {HOUR}, {rounded('vwap', 'r_t')} FROM feats WHERE symbol = (SELECT min(symbol) FROM feats) ORDER BY feats.sec DESC LIMIT 100",
    "results_union": f"""WITH {LATENCY} SELECT engine, NULL::BIGINT AS k, count(*) AS n, round(max(total_ms), 6) AS most FROM latency GROUP BY 1
        UNION ALL SELECT NULL, k, count(*), round(max(total_ms), 6) FROM latency GROUP BY k""",
    "labelled_files": f"""{W}{LABELLED} SELECT kind, symbol, count(*) AS n, count(*) FILTER (y <> 0) AS shocks, round(sum(future_r), 6) AS future_r, CAST(epoch(max(sec)) AS BIGINT) AS last_sec
        FROM labelled, (VALUES ('parquet'), ('csv')) AS k(kind) GROUP BY 1, 2""",
    "stream_hot_rows": f"""{W}{FEATS} SELECT symbol, {HOUR}, {rounded('vwap', *F6)}, msg_count FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY feats.sec DESC) AS nth FROM feats WHERE {CLOSED}) WHERE nth <= 30""",
    # a stream puts out the bars that ended an hour, its watermark's delay, before the newest trade
    "stream_bars": f"WITH {BARS} SELECT symbol, {HOUR}, {rounded('sum_pq', 'sum_q', 'total_vol', 'buy_vol', 'sell_vol')}, msg_count FROM bars WHERE {CLOSED}",
    "stream_features": f"{W}{FEATS} SELECT symbol, {HOUR}, {rounded('total_vol', 'vwap', 'buy_vol', 'sell_vol', *F6)}, msg_count, least(idx + 1, 30)::BIGINT AS window_rows FROM feats WHERE {CLOSED}",
    "stream_scores": f"""{W}{FEATS}, scored AS (SELECT *, round(1 / (1 + exp(-(abs(r_t) - 1))), 4) AS p1, round(1 / (1 + exp(-Imbalance_t)), 4) AS p2 FROM feats WHERE {CLOSED})
        SELECT symbol, {HOUR}, {PREDICTED.format(p2='CASE WHEN p1 >= 0.5 THEN round(p2, 6) END')} FROM scored""",
}



def _model_sql(doc: dict, scaler: dict) -> str:
    """A saved stage's probability of class 1 as SQL, from its coefficients or its trees."""
    scaled = {c: f"(({c} - ({mu!r})) / {sd!r})" for c, (mu, sd) in scaler.items()}
    if doc["kind"] == "Linear":
        z = " + ".join([f"({doc['intercept']!r})", *(f"{scaled[c]} * ({b!r})" for c, b in zip(doc["columns"], doc["coefficients"]))])
        return f"1 / (1 + exp(-({z})))"

    def node(tree: dict, at: int) -> str:
        if at >= len(tree["f"]):
            return repr(tree["v"][at - len(tree["f"])])
        left = node(tree, 2 * at + 1)
        if tree["f"][at] < 0:
            return left
        return f"CASE WHEN {scaled[doc['columns'][tree['f'][at]]]} <= {tree['t'][at]!r} THEN {left} ELSE {node(tree, 2 * at + 2)} END"

    return f"1 / (1 + exp(-({' + '.join(f'({node(t, 0)})' for t in doc['trees'])})))"


def _saved_sql(text: str, of: str, columns: str, force: bool = False) -> str:
    doc = json.loads(text)
    p1, p2 = (_model_sql(doc[stage], doc["scaler"]) for stage in ("first", "second"))
    shown = "p2" if force else "CASE WHEN p1 >= 0.5 THEN p2 END"
    return f"""SELECT {columns}, round(p1, 6) AS p1, round({shown}, 6) AS p2, CASE WHEN p1 < 0.5 THEN 0 WHEN p2 >= 0.5 THEN 2 ELSE 1 END::BIGINT AS yhat
        FROM (SELECT *, {p1} AS p1, {p2} AS p2 FROM {of})"""


def _forest_sql(doc: dict) -> str:
    def node(tree: dict, at: int) -> str:
        if at >= len(tree["f"]):
            return repr(tree["v"][at - len(tree["f"])])
        left = node(tree, 2 * at + 1)
        return left if tree["f"][at] < 0 else f"CASE WHEN {doc['columns'][tree['f'][at]]} <= {tree['t'][at]!r} THEN {left} ELSE {node(tree, 2 * at + 2)} END"

    return f"pow(2, -({' + '.join(f'({node(t, 0)})' for t in doc['trees'])}) / {len(doc['trees'])} / {doc['usual']!r})"


ORACLES |= {
    "latency_sketches": ORACLES["latency_summary"],
    "stream_restart": ORACLES["stream_features"],
    "thresholds_document": f"SELECT 'H5_a0.5_L94' AS tag, 'formula' AS model, 's1' AS stage, *, 'f1' AS policy FROM ({ORACLES['threshold_f1_reference']})",
    "inferred_columns": f"""{W}{LABELLED} SELECT 'plain' AS name, CASE WHEN bool_and(y IN (0, 1, 2)) THEN 'y' END AS label, 'sec' AS time FROM labelled
        UNION ALL SELECT 'doubled', CASE WHEN bool_and(2 * y IN (0, 1, 2)) THEN 'y' WHEN bool_and(y IN (0, 1, 2)) THEN 'label' END, 'sec' FROM labelled
        UNION ALL SELECT 'partly', CASE WHEN bool_and(y = 0 OR r_t <= 0) THEN 'label' WHEN bool_and(y IN (0, 1, 2)) THEN 'target' END, 't' FROM labelled""",
    "isolation_saved_scores": f"{W}{FEATS} SELECT symbol, {HOUR}, round({_forest_sql(json.loads(saved.FOREST))}, 6) AS score FROM feats",
    "stream_linear_scores": f"{W}{FEATS} {_saved_sql(saved.LINEAR, f'(SELECT * FROM feats WHERE {CLOSED})', f'symbol, {HOUR}')}",
    "stream_tree_scores": f"{W}{FEATS} {_saved_sql(saved.BOOSTED, f'(SELECT * FROM feats WHERE {CLOSED})', f'symbol, {HOUR}')}",
    "linear_scores": f"{W}{LABELLED} {_saved_sql(saved.LINEAR, 'labelled', f'symbol, {HOUR}, y::BIGINT AS y', force=True)}",
    "stream_progress": f"WITH {BARS} SELECT (SELECT count(*) FROM events) AS rows, count(*) AS bars, sum(msg_count)::BIGINT AS trades, 0::BIGINT AS odd FROM bars WHERE {CLOSED}",
}

def _replayed(text: str) -> str:
    """Common table expressions up to ``ticks``: the replayed ticks with a saved model's probabilities."""
    doc = json.loads(text)
    p1, p2 = (_model_sql(doc[stage], doc["scaler"]) for stage in ("first", "second"))
    return f"""{W}{FEATS}, bases AS (SELECT symbol AS base, row_number() OVER (ORDER BY symbol) - 1 AS place, count(*) OVER () AS turns FROM (SELECT DISTINCT symbol FROM feats)),
        ticks AS (SELECT *, {p1} AS p1, {p2} AS p2 FROM (SELECT unnest(range(8 * (SELECT max(key_rows) FROM feats))) AS t) JOIN bases ON place = (t % 8) % turns
            JOIN feats ON symbol = base AND idx = 50 * (t % 8) + 20 + t // 8)"""


ORACLES |= {
    "replay_scored": f"""{_replayed(saved.BOOSTED)} SELECT count(*) AS ticks, round(avg((p1 >= 0.5)::INT), 6) AS hit_rate, round(avg((p1 >= 0.5)::INT), 6) AS second_rate, 0::BIGINT AS odd,
        count(*) FILTER (p1 >= 0.5 AND p2 < 0.5) AS down, count(*) FILTER (p1 >= 0.5 AND p2 >= 0.5) AS up FROM ticks""",
    "gate_ablation": f"""{_replayed(saved.LINEAR)} SELECT mode, count(*) FILTER (mode = 'forced' OR p1 >= 0.5) AS second, count(*) FILTER (p1 >= 0.5 AND p2 < 0.5) AS down,
        count(*) FILTER (p1 >= 0.5 AND p2 >= 0.5) AS up, count(*) AS ticks, round(avg((p1 >= 0.5)::INT), 6) AS hit_rate FROM ticks, (VALUES ('gated'), ('forced')) AS m(mode) GROUP BY 1""",
}
ORACLES = {name: _settled(sql) for name, sql in ORACLES.items()}
