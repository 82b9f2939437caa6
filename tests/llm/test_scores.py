import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tapewright.llm import inflections, langid, quality, toxicity, transducers
from tapewright.llm.common import keep_by_text

from .helpers import documents, odd_rows

LABELS = "doc_id long, quality int, toxic int, lang string"


def corpus(n=400, seed=1):
    """Clean and insulting texts, running text and symbol noise."""
    rng = random.Random(seed)
    syllables = ["ta", "ri", "mo", "ne", "ka", "lu"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(30, 200))]
        toxic, good = rng.random() < 0.2, rng.random() < 0.7
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["blarg", "snerfling", "grubnak"]))
        if not good:
            words = [w + rng.choice(["%%%", "$$$"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic), "x"))
    return rows, labels


def held(i, folds, out):
    return zlib.crc32(str(i).encode()) % folds == out


def test_toxicity_finds_held_out_texts(spark):
    rows, labels = corpus()
    got = toxicity.score_toxicity(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: t for i, _, t, _ in labels}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"]]) > 0.95


def by_position(kinds):
    """Marked matches of a clause by their definition: what stands where."""
    out = []
    for i, k in enumerate(kinds):
        if k in (transducers.INSULT, transducers.THREAT):
            near = range(max(0, i - transducers.REACH), min(len(kinds), i + transducers.REACH + 1))
            negated = any(kinds[j] == transducers.NEGATION for j in near if j < i)
            reported = transducers.REPORT in kinds[:i]
            aimed = any(kinds[j] == transducers.TARGET for j in near)
            out.append((k, transducers.NEGATED * negated | transducers.REPORTED * reported | transducers.AIMED * aimed))
    return out


def cascade(kinds, machines):
    """The three transducers one behind the other, each over the whole tape."""
    tape = [(k, 0) for k in [*kinds, transducers.STOP]]
    for machine in machines:
        state, written = machine.start, []
        for symbol in tape:
            state, out = machine.arcs[state, symbol]
            written += out
        tape = written
    return tape


def test_composed_machine_equals_cascade_and_definition():
    rng, machine = random.Random(11), transducers.grammar()
    parts = [transducers.negation(), transducers.reported_speech(), transducers.target()]
    common = [transducers.WORD] * 3 + list(range(transducers.STOP))
    for _ in range(2000):
        kinds = [rng.choice(common) for _ in range(rng.randrange(12))]
        assert list(machine.matches(kinds)) == cascade(kinds, parts) == by_position(kinds), kinds
    for kinds in itertools.product(range(transducers.STOP), repeat=4):
        assert list(machine.matches(kinds)) == by_position(kinds), kinds


LEXICON = {"blarg": 2.0, "snerf": 1.5, "grub-": 1.0}
CLAUSE_WORDS = ["blarg", "snerfs", "grubnak", "kill", "you", "him", "not", "never", "said", "the", "a", "house", "12", "."]


def plain_features(text, lexicon, learnt={}):
    """The features by positions of words, clause by clause."""
    words = re.findall(r"[^\W\d_]+|[.!?;:\n]", (text or "").lower())
    clauses, out, total, matched, plan = [[]], np.zeros(toxicity.FEATURES), 0.0, 0, toxicity.relative_weights()
    for w in words:
        if w in ".!?;:\n":
            clauses.append([])
        else:
            clauses[-1].append(w)
    fixed = {w: k for k, ws in ((transducers.THREAT, toxicity.THREATS), (transducers.TARGET, toxicity.TARGETS), (transducers.NEGATION, toxicity.NEGATIONS), (transducers.REPORT, toxicity.REPORTS)) for w in ws}
    for clause in clauses:
        strength = [max((lexicon[f] for f in toxicity.forms(w) if f in lexicon), default=0.0) for w in clause]
        fixed = {w: k for w, k in fixed.items() if k != transducers.TARGET or learnt.get(w, 1) >= 0}
        kinds = [fixed[w] if w in fixed else transducers.INSULT if s else transducers.WORD for w, s in zip(clause, strength)]
        strength = [s if k == transducers.INSULT else max(0, learnt.get(w, toxicity.THREAT_STRENGTH)) for w, k, s in zip(clause, kinds, strength) if k in (transducers.INSULT, transducers.THREAT)]
        sums = {}
        for (k, marks), s in zip(by_position(kinds), strength):
            at = marks + transducers.MARKS * (k == transducers.THREAT)
            sums[at] = sums.get(at, 0) + s
        for at, s in sums.items():
            out[at] += np.log1p(s)
            total += s * plan[at]
        matched += max((plan[at] for at in sums), default=0)
    n = len(words) + 20
    out[toxicity.MATCHES :] = np.log1p(total), 100 * total / n, np.log1p(matched), np.log(n)
    return out


def test_features_equal_a_plain_reading():
    rng, g = random.Random(12), toxicity.Grammar(LEXICON)
    for _ in range(500):
        text = " ".join(rng.choice(CLAUSE_WORDS) for _ in range(rng.randrange(25)))
        assert np.allclose(g.features(text), plain_features(text, LEXICON)), text
    assert g.features(None) == g.features("")


def clause_corpus(n=1500, seed=13):
    """Insults and threats count only as they stand in their clause: not negated, not reported, threats only if aimed."""
    rng = random.Random(seed)
    toxic = ["you are a blarg", "such a blarg is he", "a snerf and a blarg", "i will kill you", "we hurt them now"]
    clean = ["you are not a blarg", "he said you are a blarg", "the man told them such a blarg is he", "i kill time", "we never hurt you", "beat the eggs"]
    filler = "tree lake stone road such are is the man a and will i we now that bad time eggs".split()
    rows, labels = [], []
    for i in range(n):
        y = rng.random() < 0.5
        parts = [" ".join(rng.choice(filler) for _ in range(rng.randrange(3, 12))) for _ in range(3)]
        parts += [rng.choice(toxic if y else clean) for _ in range(rng.randrange(1, 4) if y or rng.random() < 0.5 else 0)]
        rng.shuffle(parts)
        rows.append((i, ". ".join(parts)))
        labels.append((i, 1, int(y), "x"))
    return rows, labels


def test_negation_report_target_and_threat_each_matter(spark, monkeypatch):
    """Held-out accuracy falls when any part of the grammar is taken away, and the query equals a plain reading."""
    rows, labels = clause_corpus()
    truth = {i: t for i, _, t, _ in labels}
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit_toxicity(docs, labels)

    def accuracy(m):
        got = {i: m.scores(np.array([toxicity.Grammar(m.lexicon, m.learnt).features(t)]))[0] >= 0.5 for i, t in rows if held(i, 5, 0)}
        return np.mean([v == truth[i] for i, v in got.items()])

    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels, model).collect()}
    want = model.scores(np.array([plain_features(t, model.lexicon, model.learnt) for _, t in rows]))
    assert np.allclose([got[i] for i, _ in rows], want)
    whole = accuracy(model)
    assert whole > 0.97
    fixed = dict(toxicity._FIXED)
    for kind in (transducers.NEGATION, transducers.REPORT, transducers.TARGET, transducers.THREAT):
        monkeypatch.setattr(toxicity, "_FIXED", {w: x for w, x in fixed.items() if x[0] != kind})
        assert accuracy(model) < whole - 0.03, (kind, whole, accuracy(model))


def test_inflections_are_the_products_of_their_parts():
    """Every beginning, stem and ending put together gives the first such paradigm's lemma, and nothing else does."""
    want = {}
    part = lambda words: ["" if w == "-" else w for w in words.split()]
    for p in inflections.PARADIGMS:
        for b, (stem, lemma), e in itertools.product(part(p.beginnings), p.lemmas().items(), part(p.endings)):
            want.setdefault(b + stem + e, lemma)
    found = inflections.inflections()
    assert all(found(w) == lemma for w, lemma in want.items())
    near = {w[:-1] for w in want} | {w + "x" for w in want} | {"ge" + w for w in want} | {"", "here", "hero", "tu", "mate", "time"}
    assert all(found(w) == want.get(w) for w in near)
    assert set(want.values()) <= set(toxicity._FIXED)
    g = toxicity.Grammar({})
    for text in ("he kills you", "stabbing them", "er schlägt dich", "ils blessaient vous", "matando usted"):
        assert [set(c) for c in g.clauses(text)[0]] == [{transducers.MARKS + transducers.AIMED}], text
    reported = transducers.MARKS + (transducers.AIMED | transducers.REPORTED)
    assert set(g.clauses("il prétend vous tuer")[0][0]) == {reported} == set(g.clauses("sie sagten er tötet dich")[0][0])


def test_labels_weigh_threats_and_targets(spark):
    """A threat that clean texts aim too loses its strength, a target that stands near matches in clean texts is none."""
    rng, rows, labels = random.Random(21), [], []
    for i in range(1200):
        y = i % 3 == 0
        clause = rng.choice(["we will kill you", "such a blarg are you"] if y else ["we beat you at chess", "the blarg of il road"])
        rows.append((i, f"the lake and the road. {clause}. " + " ".join(rng.choice(["tree", "stone", "time", "now"]) for _ in range(6))))
        labels.append((i, 1, int(y), "x"))
    lexicon = {"blarg": 2.0}
    truth = {i: t for i, _, t, _ in labels}
    sample = spark.createDataFrame([(t, truth[i]) for i, t in rows], "text string, y int").repartition(5)
    learnt = toxicity.learn_fixed(sample, lexicon)
    counts = {w: [sum(f(t) and truth[i] == y for i, t in rows) for y in (1, 0)] for w, f in (("kill", lambda t: "kill you" in t), ("beat", lambda t: "beat you" in t), ("il", lambda t: "of il" in t), ("you", lambda t: "you" in t))}
    sizes = sum(truth.values()), len(rows) - sum(truth.values())
    before = {"kill": toxicity.THREAT_STRENGTH, "beat": toxicity.THREAT_STRENGTH}
    assert learnt == {w: pytest.approx(toxicity.drawn_odds(a, b, *sizes, before.get(w, toxicity.TARGET_ODDS))) for w, (a, b) in counts.items()}
    assert learnt["kill"] > 2 and learnt["beat"] < 0 and learnt["il"] < 0 < learnt["you"]
    g = toxicity.Grammar(lexicon, learnt)
    assert g.clauses("a blarg il saw")[0] == [{0: 2.0}] and g.clauses("beats you")[0] == [{transducers.MARKS + transducers.AIMED: 0.0}]
    assert toxicity.learn_fixed(sample.where("y = 1"), lexicon) == {} == toxicity.learn_fixed(sample.limit(0), lexicon)
    assert toxicity.drawn_odds(0, 0, 10, 90, 3.0) == pytest.approx(3.0)  # nothing seen


def test_kinds_without_labels_keep_their_share():
    rng = np.random.default_rng(14)
    x = np.zeros((400, toxicity.FEATURES))
    x[:, 0], y = rng.poisson(1, 400), rng.integers(0, 2, 400)
    x[:, 0] += 2 * y
    w, plan = toxicity.fit_weights(x, y.astype(float))[1:], toxicity.relative_weights()
    unseen = w[1 : toxicity.MATCHES] / plan[1:]
    assert np.allclose(unseen, unseen[0]) and unseen[0] > 0


def test_quality_finds_held_out_texts(spark):
    rows, labels = corpus(seed=2)
    got = quality.score_quality(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: q for i, q, _, _ in labels}
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"]]) > 0.95


def test_votes_equal_a_plain_neighbour_search():
    rng = np.random.default_rng(3)
    counts, labels = rng.poisson(0.05, (80, quality.SIZE)).astype(float), rng.integers(0, 2, 80)
    model = quality.NeighbourModel(counts, labels)
    ask = rng.poisson(0.05, (9, quality.SIZE)).astype(float)
    z = model.latent(ask)
    for got, v in zip(model.votes(ask), z):
        cosine = model.vectors @ v
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        w = np.clip(cosine[near], 1e-3, 1).astype(float) ** quality.SHARPNESS
        assert abs(got - (w * labels[near]).sum() / w.sum()) < 1e-4


def test_letter_share_is_of_the_whole_text():
    featurise = quality.Featuriser()
    share = lambda text: int(np.flatnonzero(featurise(text)[quality.WORDS + quality.SHAPES + 16 + 36 :][:12])[0])
    for text in ("gr\u00fcn x1 42 \u00df\u0416 " * 100, "a" * 2000, "ab 12\n" * 300, "%% " * 700 + "a"):
        assert share(text) == share(text * 10) == min(11, int(sum(map(str.isalpha, text)) / len(text) * 12))
    assert [share("a" * n) for n in (8191, 8192, 12_287, 20_000, 128_657)] == [11] * 5


def test_scores_of_odd_rows_and_no_labels(spark):
    docs, nothing = documents(spark, odd_rows()), spark.createDataFrame([], LABELS)
    some = spark.createDataFrame([(4, 1, 1, "x"), (5, 0, 0, None), (None, 1, 1, "x"), (6, None, None, "x"), (4, 1, 1, "x"), (7, 1, 0, "x")], LABELS)
    for labels in (nothing, some):
        for f in (toxicity.score_toxicity, quality.score_quality):
            got = f(docs, labels).collect()
            assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
            assert f(documents(spark, []), labels).collect() == []


def test_stages_keep_columns_and_clean_texts(spark):
    rows, labels = corpus(seed=5)
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    clean = toxicity.drop_toxic(docs, labels)
    good = quality.drop_low_quality(docs, labels)
    assert clean.columns == docs.columns and good.columns == docs.columns
    want = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in clean.collect()} == want
    want = {r["doc_id"] for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == want
    assert keep_by_text(docs, lambda texts: np.zeros(len(texts), bool)).count() == 0


WORDS = {"aa": "kala mina tulo vesi kana", "bb": "drogt schwint prakt stolf grump", "cc": "ouieau eaux oeui aiou uiea"}


def tongues(n=300, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(5, 60))), lang))
    return rows


def test_languages_of_held_out_texts_and_mixtures(spark):
    rows = tongues()
    mixed = [(1000, " ".join([WORDS["aa"]] * 12 + [WORDS["bb"]] * 8), None), (1001, None, "aa"), (1002, "12 !!", "aa"), (1003, "", None), (None, WORDS["cc"], None)]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.detect_languages(docs).collect()}
    assert all(r["held_out"] == held(i, 4, 2) for i, r in got.items() if i is not None)
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if got[i]["held_out"]]) == 1
    assert got[1000]["langs"] == ["aa", "bb"] and abs(got[1000]["score"] - 0.6) < 0.08
    assert [got[i]["lang_pred"] for i in (1001, 1002, 1003)] == ["und"] * 3
    assert got[None]["lang_pred"] == "cc" and got[None]["held_out"] is False
    assert langid.detect_languages(docs.limit(0)).collect() == []


def test_mixture_climbs_to_the_best_shares():
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(50), 2)
    n = rng.poisson(20, 50).astype(float)
    share, log = langid.Mixture._fit(p, n)
    grid = [float(n @ np.log(s * p[0] + (1 - s) * p[1])) for s in np.linspace(0, 1, 1001)]
    assert max(grid) - log < 0.05 and abs(share.sum() - 1) < 1e-9


def best_set(mixture, text):
    """The languages by trying every set, each fitted by many rounds."""
    found = langid.grams(text)
    n = np.bincount(found, minlength=langid.BUCKETS)
    some = np.flatnonzero(n)
    n, p = n[some].astype(float), mixture.p[:, some]
    cost = langid.PENALTY * np.log(max(len(found) / langid.GRAM, 2.0)) / 2
    values = {}
    for size in range(1, len(p) + 1):
        for chosen in itertools.combinations(range(len(p)), size):
            q, share = p[list(chosen)], np.full(size, 1 / size)
            for _ in range(400):
                share = share * (q @ (n / (share @ q))) / n.sum()
            values[chosen] = (float(n @ np.log(share @ q)) - cost * (size - 1), share)
    chosen = max(values, key=lambda c: values[c][0])
    return {mixture.langs[c]: s for c, s in zip(chosen, values[chosen][1])}


def test_language_sets_equal_trying_all_sets():
    rng = random.Random(15)
    more = WORDS | {"dd": "xelor xamin xotru xibel xunda"}
    counts = np.stack([np.bincount(langid.grams(" ".join([w] * 30)), minlength=langid.BUCKETS) for w in more.values()]).astype(float)
    mixture = langid.Mixture(list(more), counts)
    for _ in range(60):
        parts = rng.sample(list(more), rng.randrange(1, 4))
        text = " ".join(rng.choice(more[lang].split()) for lang in parts for _ in range(rng.choice([1, 4, 20, 60])))
        want, got = best_set(mixture, text), dict(mixture(text))
        assert got.keys() == want.keys(), text
        assert all(abs(got[k] - want[k]) < 0.02 for k in want)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    import pickle

    docs = spark.createDataFrame([(i, "some text", f"l{i % 5}") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.fit_mixture(docs)
    again = pickle.loads(pickle.dumps(model))
    assert again.langs == model.langs and (again.p == model.p).all()
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        langid.fit_mixture(docs)


def test_letters_beyond_the_first_planes(spark):
    docs = spark.createDataFrame([(0, "\U00032000" * 5, None), (1, "\U00020000\u4e00", "zh"), (2, "abc", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.detect_languages(docs).collect()}
    assert "und" not in got.values()
    assert all(bool(langid.letters()[c]) == chr(c).isalpha() for c in (0x31FFF, 0x32000, 0x323AF, 0x10FFFF, 65))


def test_the_labelled_sample_is_bounded_whatever_repeats(spark):
    from tapewright.llm.common import labelled_sample

    docs = spark.createDataFrame([(7, f"text {i}") for i in range(1000)] + [(i, None if i == 8 else f"other {i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(7, 1)] * 5, "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 5, 0, 40).collect()
    assert len(rows) == 40 == len({r["doc_id"] for r in rows})
    every = {r["doc_id"]: r for r in labelled_sample(docs, labels, "toxic", 5, 0, 1000).repartition(3).collect()}
    again = {r["doc_id"]: r for r in labelled_sample(docs.repartition(7), labels, "toxic", 5, 0, 1000).collect()}
    assert every == again and 60 < len(every) < 100 and all(r["text"] != "" or r["doc_id"] == 8 for r in every.values())
