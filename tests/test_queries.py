"""Queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tapewright.plans.oracles import ORACLES
from tapewright.plans.queries import Q

SF = "/root/testdata/sf0.001"
SOME = ["trade_side_split", "bars", "feature_rows", "feature_rows_per_chunk", "shock_labels", "label_alpha_sweep", "split_gap_3way", "scaled_features", "threshold_f1_reference", "e2e_report", "proxy_overlap", "tail_ratio", "replay_k", "artifact_tag", "robust_z_flags", "latency_summary", "gated_second_model", "threshold_join", "feature_vector", "message_parse", "chunk_scan", "flush_tail", "results_union", "labelled_files", "stream_hot_rows", "linear_scores", "stream_tree_scores", "stream_restart", "stream_progress", "latency_sketches", "thresholds_document", "inferred_columns", "isolation_saved_scores", "replay_scored", "gate_ablation"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def cells(rows):
    return sorted([str(round(v, 5) + 0.0 if isinstance(v, float) else v) for v in r] for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, tables, name):
    got = Q[name](spark, SF)
    columns = sorted(got.columns)
    want = tables.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert cells(map(tuple, got.select(columns).collect())) == cells(want)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
