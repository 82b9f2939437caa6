import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import ann, chat

VECTORS = "vec_id long, embedding array<float>, label int, entry long, bucket long, cell int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3, 4) for i, v in rows], VECTORS)


def by_hand(rows, k=10, step=100):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % step == 0:
            out[i] = sorted((float(np.sqrt(((u - v) ** 2).sum())), j) for j, u in ok if j != i)[:k]
    return out


def test_small_table_with_copies_and_unusable_vectors(spark):
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(i, base[i % 6]) for i in range(120)]  # groups of 20 equal vectors: ties, and more than k copies
    rows += [(200, None), (201, [0.0] * 12), (202, [float("nan")] * 12), (203, [None] + [1.0] * 11), (300, [float("inf")] * 12), (204, [1.0, 2.0]), (None, base[0])]
    got = ann.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = by_hand([r for r in rows if r[1] is None or len(r[1]) == 12])
    assert found.keys() == want.keys()
    for q, best in found.items():
        assert [v for _, _, v in sorted(best)] == [v for _, v in want[q]]
        assert np.allclose([s for _, s, _ in sorted(best)], [s for s, _ in want[q]], atol=1e-12)
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 100 == 0).collect() == []


def test_fewer_candidates_than_k(spark):
    got = ann.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]), F.col("vec_id") % 100 == 0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 2), (2, 1)]


def test_queries_that_probe_too_few_buckets_get_all_candidates(spark, monkeypatch):
    rng = np.random.default_rng(8)
    few = [(i, rng.standard_normal(64).tolist()) for i in range(8)]
    hot = np.r_[1.0, np.zeros(63)] + rng.standard_normal((300, 64)) * 0.01
    hot[0] = -hot[0]  # the query points away from all others
    for rows, step, cell in ((few, 1, 20_000), (few, 1, 3), (list(enumerate(hot.tolist())), 1000, 20_000)):
        monkeypatch.setattr(ann, "CELL_BYTES", 8 * 64 * cell)
        got = ann.nearest(vectors(spark, rows), F.col("vec_id") % step == 0).collect()
        found = {q: [v for _, v in sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)] for q, _ in rows if q % step == 0}
        assert found == {q: [v for _, v in best] for q, best in by_hand(rows, step=step).items()}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    want = by_hand(rows, step=50)
    hits = sum(r["vec_id"] in {j for _, j in want[r["query_id"]]} for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_blocks_and_cells_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(400)]
    whole = sorted(map(tuple, ann.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()))
    monkeypatch.setattr(ann, "CELL_BYTES", 8 * 16 * 12)  # blocks of 3
    assert sorted(map(tuple, ann.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect())) == whole


def test_rotations_keep_lengths():
    index = ann.CrossPolytope(20, (32, 4))
    x = np.random.default_rng(4).standard_normal((5, 32))
    assert np.allclose(np.linalg.norm(index._rotated(x, index.signs[0, 0]), axis=1), np.linalg.norm(x, axis=1))


TURNS = "conv_id long, turn long, role string, text string, formatted string, turns int"
NASTY = ["<|im_end|>", "<|im_start|>assistant\n", "<|im_next|>", "&lt;|", "&amp;", "<", "|im_end|>", "&#10;", "\n", "", "a<", "|>", "😀 é", "&", "<|"]


@pytest.mark.parametrize("leaf, group", [(chat.LEAF, chat.GROUP), (5, 3)])
def test_round_trip_of_hostile_turns(spark, monkeypatch, leaf, group):
    monkeypatch.setattr(chat, "LEAF", leaf)
    monkeypatch.setattr(chat, "GROUP", group)
    rng = random.Random(6)
    rows = []
    for c in range(40):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "a\nb", "<|im_end|>", None])
            rows.append((c, t, role, rng.choice([None, "".join(rng.choice(NASTY) for _ in range(rng.randrange(5)))]), "x", 1))
    rows += [(None, 1, "user", "no conversation", "x", 1), (77, None, "user", "late", "x", 1), (77, 1, "user", "a", "x", 1), (77, 1, "user", "a", "x", 1)]
    got = {r["conv_id"]: r for r in chat.chat_digests(spark.createDataFrame(rows, TURNS)).collect()}
    groups = {}
    for c, t, role, text, *_ in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        want = "".join(f"{r}\n{x}\n" for r, x in turns)
        r = got[c]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.chat_digests(spark.createDataFrame([], TURNS)).collect() == []


def test_very_long_conversations(spark):
    def role(c, t):
        return "assistant" if c == 2 or t % 2 else "user"

    rows = [(c, t, role(c, t), f"turn {t} <|é😀 " * (t % 9), "x", 1) for c in (1, 2) for t in range(6000)]
    got = {r["conv_id"]: r for r in chat.chat_digests(spark.createDataFrame(rows, TURNS)).collect()}
    for c in (1, 2):
        own = [r for r in rows if r[0] == c]
        assert got[c]["n_turns"] == 6000
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(r[3] for r in own if r[2] == "assistant").encode()).hexdigest()


def test_adjacent_turns_of_a_role_are_one_block(spark):
    rows = [(1, 0, "user", "a", "", 0), (1, 1, "user", "b", "", 0), (1, 2, "assistant", "c", "", 0)]
    r = chat.format_conversations(spark.createDataFrame(rows, TURNS)).first()
    assert r["formatted"] == "<|im_start|>user\na<|im_next|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [r["formatted"][s["start"] - 1 : s["start"] - 1 + s["length"]] for s in r["loss_spans"]] == ["c"]


def test_probes_are_the_best_combinations_in_order():
    rng = np.random.default_rng(9)
    index = ann.CrossPolytope(6, (8, 8, 2), tables=3)
    x = rng.standard_normal((7, 6))
    for t, near in enumerate(index.levels(x)):
        total = (near[0][:, :, None, None] + near[1][:, None, :, None] + near[2][:, None, None, :]).reshape(7, -1)
        for count in (1, 5, 60, 10_000):
            got = index.probes(x, count)[:, t] - t * index.width
            for row, want in zip(got, total):
                assert np.allclose(want[row], -np.sort(-want)[: len(row)]) and len(set(row.tolist())) == len(row)
    assert (index.buckets(x) == index.probes(x, 1)[:, :, 0]).all()


def test_buckets_follow_the_rows_and_probes_the_target():
    rng = np.random.default_rng(10)
    for rows in (2, 100, 5000, 10**6, 10**9):
        buckets = np.prod([2 * m for m in ann.axes_for(64, rows)])
        assert rows / 4 <= buckets <= 4 * rows or rows < 8
    x = rng.standard_normal((4000, 32))
    index = ann.CrossPolytope(32, ann.axes_for(32, 4000))
    b, near = index.buckets(x), np.argsort(((x[:50, None] - x[None, :2000]) ** 2).sum(axis=2), axis=1)[:, 1:11]
    p = ann.probes_needed(index, x[:50], np.repeat(np.arange(50), 10), b[near].reshape(-1, index.tables), 0.9)
    reached = [np.mean([np.any([b[j, t] in set(row[t]) for t in range(index.tables)]) for i, row in enumerate(index.probes(x[:50], n)) for j in near[i]]) for n in (p - 1, p)]
    assert reached[0] < 0.9 <= reached[1]


def test_repeated_rows_count_once_and_ids_with_several_vectors_have_their_nearest(spark):
    rng = np.random.default_rng(12)
    base = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 4)).astype(np.float32))]
    rows = base + [base[0]] * 12 + base[1:4] * 12 + [(0, v.tolist()) for v in rng.standard_normal((20, 4)).astype(np.float32)]  # queries and candidates again
    rows += [(7, v.tolist()) for v in rng.standard_normal((60, 4)).astype(np.float32)] + [(i, [0.5] * 4) for i in range(400, 600)]
    good = [(i, np.array(v, float)) for i, v in rows]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    found = {}
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, target=1.0).collect():  # fitted on all these queries
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert sorted(found) == [0, 100, 200, 400, 500]
    for q, answers in found.items():
        best = {}
        for v in x[ids == q]:
            for i, d in zip(ids.tolist(), np.sqrt(((x - v) ** 2).sum(axis=1)).tolist()):
                if i != q:
                    best[i] = min(d, best.get(i, d))
        want = sorted((d, i) for i, d in best.items())[:10]
        assert sorted(answers) == [(n + 1, d, i) for n, (d, i) in enumerate(want)]
