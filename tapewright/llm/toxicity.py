"""Toxicity by a weighted finite-state grammar over clauses; lexicon, strengths of threats and arc weights are learnt."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, fold, held, keep_by_text, labelled_sample, work_dir, written
from .inflections import inflections
from .transducers import AIMED, INSULT, MARKS, NEGATED, NEGATION, REACH, REPORT, REPORTED, STOP, TARGET, THREAT, WORD, grammar

FOLDS, HELD_OUT = 5, 0
#: Labelled documents that the lexicon and the weights are learnt from, at most.
LABELLED = 8000
#: Word beginnings of these lengths stand for all words that begin so.
STEMS = (4, 5, 6, 7)
#: A lexicon entry is in so many toxic documents at least, has so large a log odds ratio and so many deviations.
LEAST_DOCS, LEAST_ODDS, LEAST_Z, ENTRIES = 5, 1.0, 4.0, 2000

# Fixed word lists of the grammar, in English, German, French and Spanish; inflections.py has their inflected forms.
THREATS = "kill hurt destroy burn beat shoot stab punish töten verletzen zerstören schlagen tuer blesser détruire frapper matar herir destruir golpear".split()
TARGETS = "you your yours he she they them him her his their du dich dein ihr euch er sie tu te toi vous il elle ils tú usted ustedes él ella ellos".split()
NEGATIONS = "not never no nor without isn aren don doesn didn won nicht nie kein keine jamais aucun nunca jamás".split()
REPORTS = "said says told wrote called claimed reported quoted sagte schrieb behauptete dit écrit déclaré prétend dijo escribió".split()

#: What a match of each kind weighs before anything is learnt, relative to a plain insult, and what its marks make of it.
PLAIN_THREAT, AIMED_THREAT, AIMED_INSULT, IF_NEGATED, IF_REPORTED = 0.2, 2.0, 1.3, 0.1, 0.4
#: The strength of a threat before anything is learnt; an insult's is its log odds ratio.
THREAT_STRENGTH = 3.0
#: Log odds that a target near a match speaks for before anything is learnt.
TARGET_ODDS = 1.0
#: How many documents the odds before learning count as much as.
PRIOR_DOCS = 4.0
#: How strongly the weight of a kind of match is held to its relative weight.
HOLD = 2.0

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_FIXED = {w: (k, THREAT_STRENGTH) for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws} | {c: (STOP, 0.0) for c in ".!?;:\n"}
#: Kinds of marked matches: insults, then threats, each by its marks.
MATCHES = 2 * MARKS
#: Facts on the whole text behind them.
FACTS = 4
FEATURES = MATCHES + FACTS


def relative_weights() -> np.ndarray:
    """The weights of the kinds of matches before learning."""
    out = np.empty(MATCHES)
    for marks in range(MARKS):
        by = (IF_NEGATED if marks & NEGATED else 1.0) * (IF_REPORTED if marks & REPORTED else 1.0)
        out[marks] = by * (AIMED_INSULT if marks & AIMED else 1.0)
        out[MARKS + marks] = by * (AIMED_THREAT if marks & AIMED else PLAIN_THREAT)
    return out


def forms(word: str) -> list[str]:
    """What the lexicon knows a word by: itself and its beginnings, which end in ``-``; the longest first."""
    return [word] + [word[:n] + "-" for n in reversed(STEMS) if n < len(word)]


class Grammar:
    """Reads words as symbols and runs the composed transducers over them, clause by clause.

    Symbols are insults (of the learnt lexicon), threats, targets, negations, reports of speech, clause ends and other
    words. The machine puts out each insult and threat with its marks; a clause's score is the sum over kinds of marked
    matches of the kind's weight times the logarithm of one more than the strength of its matches in the clause.
    ``learnt`` has the log odds that labels gave to threats, by lemma, and to targets; a target of less than 0, say an
    article that looks like a pronoun, is a word like others.
    """

    def __init__(self, lexicon: dict[str, float], learnt: dict[str, float] | None = None):
        self.lexicon, self.learnt = lexicon, learnt or {}
        self.lemma = inflections()
        self.symbols = Recent(self._symbol, 100_000)
        self.machine = grammar()
        self.plan = relative_weights().tolist()

    def _lemma(self, word: str) -> str | None:
        """The entry of the fixed lists that a word is or is a form of."""
        if word in _FIXED:
            return word
        lemma = self.lemma(word)
        return lemma if lemma in _FIXED else None

    def _symbol(self, word: str) -> tuple[int, float] | None:
        lemma = self._lemma(word)
        if lemma is not None:
            kind, strength = _FIXED[lemma]
            if kind == THREAT:
                return kind, max(0.0, self.learnt.get(lemma, strength))
            if kind != TARGET or self.learnt.get(lemma, TARGET_ODDS) >= 0:
                return kind, strength
            return None
        weights = [self.lexicon[f] for f in forms(word) if f in self.lexicon]
        return (INSULT, max(weights)) if weights else None

    def clauses(self, text: str | None) -> tuple[list[dict[int, float]], int]:
        """Per clause with matches, the strength of each kind of marked match; and how many tokens the text has."""
        tokens = _TOKEN.findall((text or "").lower())
        step, skip = self.machine.step, self.machine.skip
        out, clause = [], {}
        waiting: list[float] = []  # strengths of the matches that the machine hasn't put out yet
        state, last = 0, -1

        def take(found) -> None:
            for kind, marks in found:
                at = marks if kind == INSULT else MARKS + marks
                clause[at] = clause.get(at, 0.0) + waiting.pop(0)

        for at, symbol in enumerate(map(self.symbols.__getitem__, tokens)):
            if symbol is None:
                continue
            kind, strength = symbol
            gap, last = at - last - 1, at
            if state and gap:
                state, found = skip[min(gap, REACH + 1)][state]
                if found:
                    take(found)
            if kind == INSULT or kind == THREAT:
                waiting.append(strength)
            state, found = step[state][kind]
            if found:
                take(found)
            if kind == STOP and clause:
                out.append(clause)
                clause = {}
        take(step[state][STOP][1])
        return [*out, clause] if clause else out, len(tokens)

    def evidence(self, text: str) -> set[str]:
        """Lemmas of the threats that are aimed, and of the targets near any match, if neither negated nor reported."""
        out: set[str] = set()
        clause: list[str] = []
        for token in [*_TOKEN.findall(text.lower()), "."]:
            if len(token) > 1 or token.isalpha():
                clause.append(token)
                continue
            symbols = [self.symbols[w] for w in clause]
            kinds = [s[0] if s else WORD for s in symbols]
            at = [i for i, k in enumerate(kinds) if k in (INSULT, THREAT)]
            for i, (kind, marks) in zip(at, self.machine.matches(kinds) if at else ()):
                if marks == AIMED:
                    near = range(max(0, i - REACH), min(len(kinds), i + REACH + 1))
                    out.update(self._lemma(clause[j]) for j in near if kinds[j] == TARGET or (j == i and kind == THREAT))
            clause = []
        return out

    def features(self, text: str | None) -> list[float]:
        """Of a whole text: what its clauses have of each kind of match, then facts on the whole.

        The facts count a match by its relative weight, so one that is negated or reported counts little there too.
        """
        found, n = self.clauses(text)
        out = [0.0] * FEATURES
        total = clauses = 0.0
        for clause in found:
            for at, strength in clause.items():
                out[at] += log1p(strength)
                total += strength * self.plan[at]
            clauses += max(map(self.plan.__getitem__, clause))
        n += 20
        out[MATCHES:] = [log1p(total), 100 * total / n, log1p(clauses), log(n)]
        return out


class ToxicityModel:
    """A lexicon, log odds of fixed words and the logistic weights: constant, marked matches, facts."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray, learnt: dict[str, float] | None = None):
        self.lexicon, self.weights, self.learnt = lexicon, weights, learnt or {}
        self.name = f"grammar {uuid.uuid4().hex}"

    def grammar(self) -> Grammar:
        """One for each Python worker, so that its memo lasts from task to task."""
        return held(self.name, lambda: Grammar(self.lexicon, self.learnt))

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, hold: np.ndarray, at: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights, the constant first, of logistic regression by Newton steps, each held to ``at`` by ``hold``.

    Steps are halved until they lose nothing, so it also settles where a straight line separates the labels.
    """
    x = np.concatenate((np.ones((len(x), 1)), x), axis=1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + (hold * (w - at) ** 2).sum() / 2)

    w = at.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * (w - at))
        size, now = 1.0, loss(w)
        while size > 1e-6 and not loss(w + size * step) <= now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """First how much the grammar's relative weights count as a whole, then each kind of match near its share of that.

    A kind that the labels say nothing on keeps its share, so what was never seen is still judged by the grammar.
    """
    plan = relative_weights()
    both = np.stack((x[:, :MATCHES] @ plan, x[:, -1]), axis=1)
    constant, scale, length = logistic(both, y, np.full(3, 0.1), np.zeros(3))
    at = np.concatenate(([constant], max(scale, 0.0) * plan, np.zeros(FACTS - 1), [length]))
    return logistic(x, y, np.concatenate(([0.1], np.full(MATCHES, HOLD), np.full(FACTS, 0.1))), at)


def _document_counts(sample: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """(form, n): in how many documents a form is, words of the fixed lists apart; ``only`` limits what is counted."""
    schema = pa.schema([("form", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        lemma = Grammar({})._lemma
        known = Recent(lambda w: [] if lemma(w) else [f for f in forms(w) if only is None or f in only], 200_000)
        for batch in batches:
            for text in batch["text"]:
                total.update({f for w in set(_TOKEN.findall(text.as_py().lower())) for f in known[w]})
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=schema)

    return sample.select("text").mapInArrow(count, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Log odds ratios of the words and beginnings that mark toxic documents of a sample (text, y)."""
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}
    common = _document_counts(sample.where("y = 1"), None).where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "form").limit(20 * ENTRIES)
    with_toxic = {r["form"]: r["n"] for r in common.collect()}
    with_clean = {r["form"]: r["n"] for r in _document_counts(sample.where("y = 0"), frozenset(with_toxic)).collect()}
    out = {}
    for form, a in with_toxic.items():
        b = with_clean.get(form, 0)
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        error = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if odds >= LEAST_ODDS and odds / error >= LEAST_Z:
            out[form] = float(odds)
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:ENTRIES])


def learn_fixed(sample: DataFrame, lexicon: dict[str, float]) -> dict[str, float]:
    """Log odds of threats that are aimed and of targets near matches, from a sample (text, y), by lemma.

    See ``drawn_odds``; words that no document has so are left out. At most two rows are collected for each entry of
    the fixed lists.
    """
    schema = pa.schema([("lemma", pa.string()), ("y", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, int]] = Counter()
        g = Grammar(lexicon)
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"].to_pylist()):
                total.update((lemma, y) for lemma in g.evidence(text.as_py()))
        lemmas, ys = zip(*total) if total else ((), ())
        yield pa.record_batch([pa.array(lemmas, pa.string()), pa.array(ys, pa.int32()), pa.array(list(total.values()), pa.int64())], schema=schema)

    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}
    found: dict[str, list[int]] = {}
    for r in sample.select("text", "y").mapInArrow(count, "lemma string, y int, n long").groupBy("lemma", "y").agg(F.sum("n").alias("n")).collect():
        found.setdefault(r["lemma"], [0, 0])[r["y"]] = r["n"]
    return {lemma: drawn_odds(a, b, n1, n0, TARGET_ODDS if _FIXED[lemma][0] == TARGET else THREAT_STRENGTH) for lemma, (b, a) in sorted(found.items())}


def drawn_odds(a: int, b: int, n1: int, n0: int, before: float) -> float:
    """Log odds that a document is toxic, of ``a`` toxic and ``b`` clean ones with a word, less those of all documents.

    Counted with them are PRIOR_DOCS made-up documents whose log odds are ``before``.
    """
    all_odds = log(n1 / n0)
    share = 1 / (1 + exp(-before - all_odds))
    return log((a + PRIOR_DOCS * share) / (b + PRIOR_DOCS * (1 - share))) - all_odds


def _features(docs: DataFrame, lexicon: dict[str, float], learnt: dict[str, float] | None = None) -> DataFrame:
    """(y, features) of a sample."""
    schema = pa.schema([("y", pa.int32()), ("features", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon, learnt)
        for batch in batches:
            yield pa.record_batch([batch["y"], pa.array([grammar.features(t.as_py()) for t in batch["text"]], pa.list_(pa.float64()))], schema=schema)

    return docs.select("y", "text").mapInArrow(run, "y int, features array<double>")


def fit_toxicity(docs: DataFrame, labels: DataFrame, at_most: int = LABELLED) -> ToxicityModel:
    """Learns lexicon and weights from at most ``at_most`` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, at_most)
    sample = written(sample.select("y", "text"), f"{work_dir(docs.sparkSession)}/sample")
    lexicon = learn_lexicon(sample)
    learnt = learn_fixed(sample, lexicon)
    rows = _features(sample, lexicon, learnt).toArrow()
    y = np.array(rows["y"].to_pylist(), float)
    x = np.array(rows["features"].to_pylist(), float).reshape(len(y), -1) if len(y) else np.zeros((0, FEATURES))
    if len(set(y)) < 2:  # nothing to tell apart
        share = float(y.mean()) if len(y) else 0.0
        weights = np.zeros(FEATURES + 1)
        weights[0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return ToxicityModel(lexicon, weights, learnt)
    return ToxicityModel(lexicon, fit_weights(x, y), learnt)


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; the whole text counts and nothing else does.

    Null and empty texts are scored as texts without words. Without labels of both kinds every score is the share of
    toxic labels, 0 if there are none. Null doc_ids are not held out; repeated rows are scored alike; other columns
    are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_toxicity(docs, labels))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value.grammar()
        for batch in batches:
            x = np.array([grammar.features(t.as_py()) for t in batch["text"]]).reshape(-1, FEATURES)
            yield pa.record_batch([batch["doc_id"], pa.array(shared.value.scores(x))], schema=schema)

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that aren't predicted toxic; each row is judged by its own text.

    Null and empty texts are judged as texts without words, repeated rows alike, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))

    def keep(texts: list[str | None]) -> np.ndarray:
        grammar = shared.value.grammar()
        return shared.value.scores(np.array([grammar.features(t) for t in texts]).reshape(-1, FEATURES)) < 0.5

    return keep_by_text(docs, keep)
