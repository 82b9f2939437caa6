"""Token alignment, exact top-k search and ranked lexical search against brute force."""

import hashlib
import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import align, dualtree, pivots
from tapewright.llm.queries import tokenizer_file
from tapewright.llm.tokencount import byte_letters

from .helpers import DOCS, documents, odd_rows

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def aligned_by_hand(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters, names = byte_letters(), {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    parts, count = [], Counter()
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a, bytes_b = [bytes(letters[c] for c in names[i]) for i in ids_a], [piece(i) for i in ids_b]
        if not t or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            parts.append(None)
            continue
        ends = [set(np.cumsum([len(x) for x in bs]).tolist()) for bs in (bytes_a, bytes_b)]
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        for cut in sorted(ends[0] & ends[1]):
            group = ([], [])
            while at_a < cut:
                at_a, i = at_a + len(bytes_a[i]), i + 1
                group[0].append(ids_a[i - 1])
            while at_b < cut:
                at_b, j = at_b + len(bytes_b[j]), j + 1
                group[1].append(ids_b[j - 1])
            groups.append(group)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        count.update(links.keys())
        parts.append((len(ids_a), len(ids_b), groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for p in parts:
        if p is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = p
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        right = sum(n for pair, n in links.items() if count[pair] == best[pair[0]])
        out.append((n_a, n_b, len(groups), sum(links.values()), right, sum(n * count[pair] for pair, n in links.items()), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def strings():
    rng = random.Random(1)
    common = list("abcdef  ELT '.,;!?0123456789")
    rare = [*"\n\t\r\xa0éßüñ中文字😀▁<>|　\x1c\x85ﬁ́\x00", "<|endoftext|>", "<s>", "</s>", "<0x41>", "  ", "   ", "'s", " the", "ing"]
    out = ["".join(rng.choice(common + rare if rng.random() < 0.5 else common) for _ in range(rng.randint(0, 60))) for _ in range(1200)]
    return [*out, None, "", " ", "  ", "a" * 3000, "ab " * 50, "ababab" * 200, "x ", "▁"]


@pytest.mark.parametrize("at_most", [align.FREQUENT, 200])
def test_alignment_equals_brute_force_with_and_without_rare_pairs(spark, at_most):
    texts = strings()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in align.align_tokens(df, A, B, at_most).collect()}
    want = aligned_by_hand(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(w[0] > 0 for w in want) > 500


def test_alignment_of_odd_rows(spark):
    rows = odd_rows()
    got = Counter((r[0], *tuple(r)[1:]) for r in align.align_tokens(documents(spark, rows), A, B).collect())
    want = Counter((i, *w) for (i, _), w in zip(rows, aligned_by_hand([t for _, t in rows])))
    assert got == want
    assert align.align_tokens(spark.createDataFrame([], DOCS), A, B).collect() == []


def test_memo_can_be_emptied_at_any_time(monkeypatch):
    texts = strings()[:300]
    whole = align.Aligner(A, B).documents(texts)
    monkeypatch.setattr(align, "UNITS", 50)
    small = align.Aligner(A, B)
    again = [x for i in range(0, 300, 20) for x in small.documents(texts[i : i + 20])]
    assert [x[:5] for x in again] == [x[:5] for x in whole]
    assert all(np.array_equal(x.keys, y.keys) and np.array_equal(x.times, y.times) for x, y in zip(again, whole))


def test_pointers_reach_the_last_token_of_their_component():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(np.append(rng.integers(1, 40, 12), 40)) for _ in range(2))
        last = align.terminals(a, b)
        cuts = np.intersect1d(a, b)
        for ends, labels in ((a, last[: len(a)]), (b, last[len(a) :])):
            assert [a[x] for x in labels] == [cuts[np.searchsorted(cuts, e)] for e in ends]


VECTORS = "vec_id long, embedding array<float>, label int, pivot long, cell int, v long, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3, 4, 5) for i, v in rows], VECTORS).repartition(5)


def products_by_hand(rows, k=20, step=20):
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    if not good:
        return []
    sizes = Counter(len(v) for _, v in good)
    dim = min(sizes, key=lambda d: (-sizes[d], d))
    ids, x = np.array([i for i, v in good if len(v) == dim]), np.array([v for _, v in good if len(v) == dim])
    out = []
    for q in sorted({i for i in ids.tolist() if i % step == 0}):
        best = {}
        for i, s in zip(ids.tolist(), (x[ids == q] @ x.T).max(axis=0).tolist()):
            if i != q:
                best[i] = max(s, best.get(i, s))
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k])]
    return out


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist()


def test_top_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "ANNULUS", 32)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    near = [(i, (centres[i % 12] + rng.normal(size=6) * 0.05).tolist()) for i in range(900)]
    hot = [(i, [0.5] * 6) for i in range(300)] + list(zip(range(300, 600), unit(rng, 300, 6)))
    for rows in (near, hot, [(i, (np.array(v) * rng.exponential()).tolist()) for i, v in enumerate(unit(rng, 700, 5))]):
        got = sorted(tuple(r) for r in pivots.top_products(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect())
        assert got == products_by_hand(rows)


def test_top_products_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = list(enumerate(unit(rng, 60, 4)))
    rows += rows[:30] * 3 + [(0, v) for v in unit(rng, 40, 4)] + [(7, v) for v in unit(rng, 60, 4)]  # repeated rows, ids with several vectors
    rows += [(None, [1.0] * 4), (1000, None), (1020, [1.0, None, 0.0, 0.0]), (1040, [float("nan")] * 4), (1060, [float("inf")] * 4), (1080, [0.0] * 4), (1100, [1.0] * 3), (1120, [])]
    for some in (rows, list(enumerate(unit(rng, 8, 64))), [(0, [1.0, 2.0])], []):
        got = sorted(tuple(r) for r in pivots.top_products(vectors(spark, some), F.col("vec_id") % 20 == 0).collect())
        assert got == products_by_hand(some)
    large = [(i, [1e6 * x for x in v]) for i, v in enumerate(unit(rng, 100, 8))]  # beyond what doubles hold exactly
    got = sorted(tuple(r) for r in pivots.top_products(vectors(spark, large), F.col("vec_id") % 20 == 0).collect())
    assert got == products_by_hand(large)
    with pytest.raises(OverflowError):
        pivots.top_products(vectors(spark, [(0, [1e30, 1.0]), (1, [1.0, 1.0])]), F.col("vec_id") % 20 == 0)


def test_bounds_hold_for_every_vector():
    rng = np.random.default_rng(5)
    x = np.floor(64 * rng.normal(size=(500, 7)))
    index = pivots.Pivots(x[:200], float((x**2).sum(axis=1).max()), 9)
    far = index.distances(index.lifted(x))
    near = far.argmin(axis=1)
    low, high = (np.array([f(far[near == p, p], default=0) for p in range(9)]) for f in (lambda v, default: v.min(initial=1e9), lambda v, default: v.max(initial=0)))
    bounds = index.bounds(x[:50], np.arange(9), low, high)
    assert (x[:50] @ x.T <= bounds[:, near]).all() and (bounds < (x[:50] ** 2).sum(axis=1)[:, None] * 50).all()


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return Counter(WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))


def ranked_by_hand(items, docs, k):
    bags = [(i, c, sum(c.values())) for i, c in ((i, terms_of(t)) for i, t in docs) if c]
    n, total, df = len(bags), sum(b[2] for b in bags), Counter(t for _, c, _ in bags for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, terms in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms}
        scores = []
        for d, c, size in bags:
            m = 50 + (50 * size * n) // total
            s = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return Counter(out)


def ranked(spark, items, docs, **options):
    extra = [(i, t, "en", "s", None, "k", 1, "r", 5, 0.5, 3) for i, t in docs]
    return Counter(tuple(r) for r in dualtree.rank_documents(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(extra, DOCS).repartition(3), **options).collect())


def prose(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "Ünï", "中文", "a1", "B", "it's", "é", "x-y", "straße", *(f"w{i}" for i in range(300))]
    return [" ".join(words[min(len(words) - 1, int(rng.expovariate(0.02)))] for _ in range(rng.choice([0, 3, 20, 80, 200]))) for _ in range(n)]


def test_ranking_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dualtree, "SHARD", 150)
    monkeypatch.setattr(dualtree, "LEAF", 4)
    docs, items = list(enumerate(prose(700))), list(enumerate(prose(25, 4)))
    assert ranked(spark, items, docs, k=10) == ranked_by_hand(items, docs, 10)
    assert ranked(spark, items, docs, k=10, terms=150) == ranked_by_hand(items, docs, 10)  # several passes


def test_ranking_of_odd_rows(spark):
    docs = list(enumerate(prose(150, 5))) + [(5, "the hot copy w1 w2")] * 200 + [(None, "the w3"), (None, "w3 the"), (1, None), (2, ""), (3, "!!!"), (9, "the " * 5000)]
    items = [(1, "the w1 w2"), (1, "w3 w4"), (None, "the w3"), (2, None), (3, ""), (4, "nowhere"), (5, "THE hot"), (6, "Ünï ünï ÜNÏ")]
    assert ranked(spark, items, docs) == ranked_by_hand(items, docs, 50)
    assert ranked(spark, items, []) == Counter() == ranked(spark, [], docs)


def test_node_bounds_hold_and_prune():
    rng = np.random.default_rng(6)
    terms, docs = 40, 600
    lists = [np.sort(rng.choice(terms, rng.integers(1, 8), replace=False)) for _ in range(docs)]
    begin, term = np.append(0, np.cumsum([len(x) for x in lists])), np.concatenate(lists)
    value, weight = rng.integers(1, 1000, len(term)), rng.integers(0, 5000, terms)
    shard = dualtree.Shard(np.arange(docs), begin, term, value, weight)
    tree = dualtree.Items.grown({i: np.sort(rng.choice(terms, 5, replace=False)) for i in range(30)})
    assert sorted(tree.order) == list(range(30))
    row = np.repeat(np.arange(docs), np.diff(shard.begin))
    for own in tree.terms:
        dense = np.where(np.isin(np.arange(terms), own), weight, 0)
        score = np.bincount(row, dense[shard.term] * shard.value, docs)
        for depth, level in enumerate(shard.levels):
            node = np.arange(docs) // (dualtree.LEAF * dualtree.FAN**depth)
            for of in (own, tree.root[2]):  # an item's own bound, and that of the node of all items
                assert (score <= level.bounds(of, weight)[node]).all()
