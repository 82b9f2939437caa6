import re
import zlib

import numpy as np

import corpus_pipeline
from tapewright.llm import common, quality, toxicity
from tapewright.llm.queries import ORACLES, QUERIES

from .test_dedup import near_by_hand

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, seen, SF)
        assert now.columns == docs.columns
        ids = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in seen.select("doc_id").collect()}, name
        seen = now.cache()
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert packed == {r["doc_id"] for r in seen.select("doc_id").collect()}


def test_each_stage_equals_a_plain_version(spark):
    """Every stage over all that the one before it kept, by loops in one process."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)

    def stage(name, kept):
        ids = spark.createDataFrame([(i,) for i, _ in kept], "doc_id long")
        got = stages[name](spark, docs.join(ids, "doc_id", "left_semi"), SF)
        return sorted(r["doc_id"] for r in got.collect())

    model = toxicity.fit_toxicity(docs, labels)
    grammar = toxicity.Grammar(model.lexicon)
    want = [(i, t) for i, t in rows if model.scores(np.array([grammar.features(t)]))[0] < 0.5]
    assert stage("toxicity", rows) == sorted(i for i, _ in want)

    rows = want
    kept = docs.join(spark.createDataFrame([(i,) for i, _ in rows], "doc_id long"), "doc_id", "left_semi")
    votes = quality.fit_quality(kept, labels)
    featurise = quality.Featuriser()
    want = [(i, t) for i, t in rows if np.clip(votes.votes(featurise(t)[None])[0], 0, 1) >= 0.5]
    assert stage("quality", rows) == sorted(i for i, _ in want)

    rows, least = want, {}
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        least[norm] = min(i, least.get(norm, i))
    want = [(i, t) for i, t in rows if i in set(least.values())]
    assert stage("exact_dedup", rows) == sorted(i for i, _ in want)

    rows, first = want, near_by_hand(want)
    want = [(i, t) for i, t in rows if first[i][2]]
    assert stage("near_dedup", rows) == sorted(i for i, _ in want) and len(want) < len(rows) or len(want) == len(rows)

    import public_tokenizers
    from tokenizers import Tokenizer

    rows, whole = want, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
    pieces = stages["packing"](spark, docs.join(ids, "doc_id", "left_semi"), SF).collect()
    tokens = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    assert sum(p["length"] for p in pieces) == sum(map(len, tokens.values()))
    assert all(p["ids_crc32"] == zlib.crc32(tokens[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces)


def test_stages_leave_no_work_behind(spark):
    before = common.work_count()
    corpus_pipeline.run(spark, SF).count()
    assert common.work_count() == before + 2  # the last stage's own folder and what it reads


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
