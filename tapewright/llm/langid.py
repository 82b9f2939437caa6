"""Language identification as mixture inference over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Hashed letter trigrams.
GRAM, BUCKETS = 3, 1 << 15
FOLDS, HELD_OUT = 4, 2
#: Added to every count of a language.
SMOOTHING = 0.5
ROUNDS, SETTLED = 25, 1e-4
#: Twice the log-likelihood that a further language must gain, in units of log(n-grams / GRAM); overlapping n-grams
#: repeat each other's evidence.
PENALTY = 3.0
UNKNOWN = "und"
#: Languages that can be told apart, at most: what is sent to the executors has 128 kB for each.
MOST_LANGUAGES = 1000


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """The hashed trigrams of a text in lower case, each run of other characters as one space; none without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(is_letter, codes, 32)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 15)).astype(np.int64)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all documents outside the held-out fold that have a language."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                found = np.bincount(grams(text.as_py()), minlength=BUCKETS)
                if lang in total:
                    total[lang] += found
                else:
                    total[lang] = found
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], schema=schema)

    known = docs.where(F.col("lang").isNotNull() & F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(False)))
    rows = known.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(count, "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Proportions of known languages in a text by expectation-maximisation."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        """``counts``: (languages, BUCKETS)."""
        self.langs = langs
        p = counts + np.float32(SMOOTHING)
        p /= p.sum(axis=1, keepdims=True, dtype=np.float64)
        self.p = p.astype(np.float32, copy=False)

    @staticmethod
    def _fit(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the rows of ``p`` for n-gram counts ``n``, and the log-likelihood."""
        share = np.full(len(p), 1 / len(p))
        total = n.sum()
        for _ in range(ROUNDS):
            mix = share @ p
            new = share * (p @ (n / mix)) / total
            moved = np.abs(new - share).max()
            share = new
            if moved < SETTLED:
                break
        return share, float(n @ np.log(share @ p))

    def __call__(self, text: str | None) -> list[tuple[str, float]]:
        """The languages of a text with their shares, largest first; empty if it has no letter.

        Sets are the languages of largest share, one more at a time; of them the one of largest penalised likelihood
        is taken. No set can beat the mixture of all, so one language is enough where that gains too little.
        """
        found = grams(text)
        if not len(found) or not self.langs:
            return []
        n = np.bincount(found, minlength=BUCKETS)
        some = np.flatnonzero(n)
        n = n[some].astype(float)
        p = self.p[:, some].astype(float)
        single = np.log(p) @ n
        best = int(single.argmax())
        cost = PENALTY * np.log(max(len(found) / GRAM, 2.0)) / 2
        share, most = self._fit(p, n)
        chosen, shares, value = [best], np.ones(1), float(single[best])
        if most - cost > value:
            order = np.argsort(-share, kind="stable")
            for k in range(2, len(order) + 1):
                part, log = self._fit(p[order[:k]], n)
                if log - cost * (k - 1) <= value:
                    break
                chosen, shares, value = order[:k].tolist(), part, log - cost * (k - 1)
        ranked = sorted(zip(shares.tolist(), chosen), key=lambda x: (-x[0], self.langs[x[1]]))
        return [(self.langs[i], s) for s, i in ranked]


def fit_mixture(docs: DataFrame) -> Mixture:
    """Collects BUCKETS numbers of four bytes for each language, whatever the number of documents.

    More than MOST_LANGUAGES values of lang are an error: then they aren't languages.
    """
    counts = ngram_counts(docs)
    if (n := docs.select("lang").distinct().limit(MOST_LANGUAGES + 2).count()) > MOST_LANGUAGES + 1:
        raise ValueError(f"{n} values of lang or more, where at most {MOST_LANGUAGES} are expected")

    def row(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        """A language's counts, BUCKETS rows at most, as one row of numbers."""
        n = np.zeros(BUCKETS, np.float32)
        n[found["bucket"].to_numpy()] = found["n"].to_numpy()
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "n": pa.array([n.tobytes()], pa.binary())})

    rows = counts.groupBy("lang").applyInArrow(row, "lang string, n binary").toArrow().sort_by("lang")
    counts = np.zeros((len(rows), BUCKETS), np.float32)
    for at, n in enumerate(rows["n"]):
        counts[at] = np.frombuffer(n.as_buffer(), np.float32)
    return Mixture(rows["lang"].to_pylist(), counts)


def detect_languages(docs: DataFrame, model: Mixture | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs, shares of every row of ``docs``.

    Learnt from text and language of all documents outside the held-out fold; a prediction sees the text alone.
    lang_pred is the language of largest share and score that share; langs and shares have the whole set. A text that
    is null or has no letter is ``und`` with score 0, as is every text if nothing could be learnt. A null doc_id is
    not held out and is not learnt from. Repeated rows are scored alike; other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or fit_mixture(docs))
    fields = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = shared.value
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                found = mixture(text.as_py()) or [(UNKNOWN, 0.0)]
                out.append((doc, found[0][0], min(1.0, found[0][1]), [x for x, _ in found], [s for _, s in found]))
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*out) if out else [()] * 5, fields)], schema=pa.schema(fields))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "lang_pred", "score", "langs", "shares")
