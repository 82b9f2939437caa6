"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, fold, held, in_parts, keep_by_text, labelled_sample

FOLDS, HELD_OUT = 3, 1
#: Labelled documents that are the neighbours, at most; the space is fitted on them too.
LABELLED = 6000
#: Hashed features of words and of word shapes, then features of the whole text.
WORDS, SHAPES, WHOLE = 1024, 768, 64
SIZE = WORDS + SHAPES + WHOLE
#: What the three kinds weigh before vectors get length 1.
WORD_WEIGHT, SHAPE_WEIGHT, WHOLE_WEIGHT = 0.4, 1.0, 1.5
DIMENSIONS, ROUNDS = 48, 4
NEIGHBOURS, SHARPNESS = 25, 8
#: Documents in one block of cosine products.
BLOCK = 256

_RUN = re.compile(r"(.)\1+", re.S)
_KINDS = str.maketrans({**{chr(c): "A" for c in range(0x250) if chr(c).isupper()}, **{chr(c): "a" for c in range(0x250) if chr(c).islower()}, **{d: "0" for d in "0123456789"}})


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs as one character."""
    return _RUN.sub(r"\1", word.translate(_KINDS))


def _word(word: str) -> int:
    """Both features of a word in one number of 32 bits, and above them how many letters it has."""
    both = xxhash.xxh3_64_intdigest(word.lower()) % WORDS << 16 | WORDS + xxhash.xxh3_64_intdigest(shape(word)) % SHAPES
    return sum(map(str.isalpha, word)) << 32 | both


class Featuriser:
    """Counts of hashed words and shapes and a few facts on the whole text, damped by the logarithm."""

    def __init__(self) -> None:
        self.words = Recent(_word, 100_000)

    def __call__(self, text: str | None) -> np.ndarray:
        """A dense vector of SIZE."""
        words = (text or "").split()
        out = np.zeros(SIZE)
        n = len(words)
        whole = out[WORDS + SHAPES :]
        whole[min(15, n.bit_length())] = 1
        if not n:
            return out
        found = np.fromiter(map(self.words.__getitem__, words), np.int64, n)
        letters, both = int((found >> 32).sum()), found & 0xFFFFFFFF  # white space has no letters
        ids = np.concatenate((both >> 16, both & 0xFFFF))
        out[: WORDS + SHAPES] = np.log1p(np.bincount(ids, minlength=WORDS + SHAPES)[: WORDS + SHAPES])
        # shares in steps, so that texts alike in them share features
        same = float((both[1:] == both[:-1]).mean()) if n > 1 else 0.0
        lines = text.split("\n")
        facts = (same, len(set(words)) / n, 1 - len(set(lines)) / len(lines), letters / len(text))
        for i, share in enumerate(facts):
            whole[16 + 12 * i + min(11, int(share * 12))] = 1
        return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf
    x[:, :WORDS] *= WORD_WEIGHT
    x[:, WORDS : WORDS + SHAPES] *= SHAPE_WEIGHT
    x[:, WORDS + SHAPES :] *= WHOLE_WEIGHT
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


class NeighbourModel:
    """Latent vectors of labelled documents, of length 1, with their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.idf = np.log((len(counts) + 1) / ((counts > 0).sum(axis=0) + 1)) + 1 if len(counts) else np.ones(SIZE)
        x = _weighted(counts.astype(np.float32), self.idf.astype(np.float32))
        k = min(DIMENSIONS, len(x), SIZE)
        basis = np.random.default_rng(11).standard_normal((SIZE, min(SIZE, k + 16))).astype(np.float32)
        for _ in range(ROUNDS):  # subspace iteration on the terms' side
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        if k:
            inner = x @ basis
            _, vectors = np.linalg.eigh(inner.T @ inner)
            basis = basis @ vectors[:, ::-1][:, :k]
        self.basis = np.ascontiguousarray(basis[:, :k], np.float32)
        self.vectors = self.latent(counts) if len(counts) else np.zeros((0, k), np.float32)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        z = _weighted(counts.astype(np.float32), self.idf.astype(np.float32)) @ self.basis
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return (z / np.where(norm > 0, norm, 1)).astype(np.float32)

    def votes(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled documents, weighted by a power of the cosine."""
        if not len(self.vectors):
            return np.ones(len(counts))
        cosine = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, axis=1), 1e-3, 1).astype(np.float64) ** SHARPNESS
        return (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        featurise = held("quality words", Featuriser)
        out = [self.votes(np.stack([featurise(t) for t in texts[i : i + BLOCK]])) for i in range(0, len(texts), BLOCK)]
        return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def fit_quality(docs: DataFrame, labels: DataFrame, at_most: int = LABELLED) -> NeighbourModel:
    """The model of at most ``at_most`` labelled documents outside the held-out fold; features come sparse."""
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, at_most)
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurise = Featuriser()
        for batch in batches:
            found = [featurise(t.as_py()) for t in batch["text"]]
            at = [np.flatnonzero(x).astype(np.int32) for x in found]
            value = [x[i].astype(np.float32) for x, i in zip(found, at)]
            yield pa.record_batch([batch["doc_id"], batch["y"], pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], schema=schema)

    rows = sample.select(F.col("doc_id").cast("long"), "y", "text").mapInArrow(run, "id long, y int, at array<int>, value array<float>").toArrow()
    rows = rows.sort_by("id")
    counts = np.zeros((rows.num_rows, SIZE), np.float32)
    for i, (at, value) in enumerate(zip(rows["at"], rows["value"])):
        counts[i, at.values.to_numpy()] = value.values.to_numpy()
    return NeighbourModel(counts, np.array(rows["y"].to_pylist(), np.float32))


def score_quality(docs: DataFrame, labels: DataFrame, model: NeighbourModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; the whole text counts and nothing else does.

    Null and empty texts are scored by what they have in common with labelled ones: their length. Without labels every
    score is 1. Null doc_ids are not held out; repeated rows are scored alike; other columns are ignored; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_quality(docs, labels))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.concatenate([shared.value.scores(part) for part in in_parts(batch["text"])])
                yield pa.record_batch([batch["doc_id"], pa.array(found, pa.float64())], schema=schema)

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose quality is predicted as 1; each row is judged by its own text.

    Null and empty texts are judged by their length alone, repeated rows alike, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))
    return keep_by_text(docs, lambda texts: shared.value.scores(texts) >= 0.5)
