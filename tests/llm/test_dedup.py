import hashlib
import random
import re

from pyspark.sql import functions as F

from tapewright.llm import exact_dedup, minhash

from .helpers import documents, odd_rows


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        least = min((x for x in ids if x is not None), default=None)
        out.append((i, least, len(ids), i == least, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["a", "bee", "dad car", "c\n", "  d"]) for _ in range(rng.randrange(0, 900))) for _ in range(12)]
    return [(i, rng.choice(base) if rng.random() < 0.7 else rng.choice(base) + rng.choice(["", "x", " "])) for i in range(80)]


def test_exact_groups_equal_brute_force(spark):
    for rows in (odd_rows(), random_rows(1), []):
        got = exact_dedup.exact_groups(documents(spark, rows))
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == exact_by_hand(rows)


def test_colliding_chunk_hashes_are_told_apart(spark):
    """With a hash of two values nearly all chunks collide, and the result is the same."""
    rows = random_rows(2)
    got = exact_dedup.exact_groups(documents(spark, rows), keys=lambda c: [F.length(c).cast("long") % 2])
    assert sorted((tuple(r) for r in got.collect()), key=str) == exact_by_hand(rows)


def test_chunks_join_to_the_text(spark):
    rows = [(i, t) for i, (_, t) in enumerate([*odd_rows(), *random_rows(3), (0, "😀" * 9000), (0, "x" * 20_000)])]
    got = documents(spark, rows).select("doc_id", exact_dedup.chunks(exact_dedup.normalised(F.col("text"))).alias("c")).collect()
    assert {r["doc_id"]: "".join(r["c"]).encode("latin-1").decode() for r in got} == {i: norm(t) for i, t in rows}


def test_chunks_follow_the_content_in_every_script(spark):
    """A long passage behind different beginnings is mostly cut into the same chunks."""
    rng = random.Random(31)
    alphabets = ["etaoinshrdlu cmwfg ", "оеаинтсрвлкмдпуяы ", "αοιετσνηυρπκμλ ", "ابتثجحخدرزسشعفقكلمنهوي ", "कखगघचछजझटठडढणतथदधन ", "".join(map(chr, range(0x4E00, 0x4E00 + 500)))]
    rows = []
    for k, letters in enumerate(alphabets):
        text = lambda n: "".join(rng.choice(letters) for _ in range(n))
        passage = text(20_000)
        rows += [(2 * k, text(700) + passage), (2 * k + 1, text(1900) + passage)]
    got = documents(spark, rows).select("doc_id", exact_dedup.chunks(exact_dedup.normalised(F.col("text"))).alias("c")).collect()
    cut = {r["doc_id"]: set(r["c"]) for r in got}
    for k, letters in enumerate(alphabets):
        a, b = cut[2 * k], cut[2 * k + 1]
        assert len(a) > 15 and len(a & b) > 0.8 * len(a), (letters[:5], len(a), len(a & b))


def test_drop_exact_copies_keeps_columns(spark):
    docs = documents(spark, random_rows(4))
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, k, *_ in exact_by_hand(random_rows(4)) if i == k)


def near_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if x and y and 100 * len(x & y) >= 75 * len(x | y) and top[a] != top[b]:
                    top[a] = top[b] = min(top[a], top[b])
                    changed = True
    return {i: (len(sets[i]), top[i], top[i] == i) for i in sets}


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for g in range(8):
        base = [word() for _ in range(rng.choice([3, 5, 40, 120]))]
        for _ in range(rng.randrange(1, 9)):
            base = [w if rng.random() > 0.03 else word() for w in base]  # chains: each is near the one before
            text = rng.choice([" ", "\n"]).join(base)
            rows.append((len(rows), text.upper() if rng.random() < 0.3 else text))
    return rows


def boundary_rows():
    """Words that repeat, in texts of about as many words as a shingle has."""
    rng = random.Random(8)
    texts = [" ".join(["a"] * n) for n in range(1, 9)] + [" ".join(rng.choice("ab") for _ in range(rng.randrange(3, 8))) for _ in range(30)]
    return list(enumerate([*texts, "a b a b a b a b", "a b a b a b", "b a b a b a"]))


def test_near_groups_equal_brute_force(spark):
    for rows in (near_rows(5), near_rows(6), boundary_rows()):
        got = minhash.near_groups(documents(spark, rows)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_by_hand(rows)


def test_near_groups_of_odd_rows(spark):
    rows = odd_rows()
    got = minhash.near_groups(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    want = near_by_hand([(i, t) for i, t in rows if i is not None])
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in by.items() if i is not None} == want
    assert by[None]["component_id"] is None and by[None]["kept"] is True
    assert by[7]["component_id"] == 6 and by[1]["n_shingles"] == 0
    assert minhash.near_groups(documents(spark, [])).collect() == []


def test_blocks_find_all_links_of_one_bucket(spark, monkeypatch):
    """Tiny blocks and no star rounds: every link comes from comparing pairs of blocks."""
    for name, value in (("BLOCK", 2), ("BLOCK_BYTES", 1500), ("DEAL_FROM", 3), ("STARS", 0)):
        monkeypatch.setattr(minhash, name, value)
    rows = near_rows(7)
    got = minhash.near_groups(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_by_hand(rows)


def test_leaders_of_many_followers_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FOLLOWERS", 2)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(60)]
    rows = [(i, " ".join(base[:-1] + [word()])) for i in range(40)]
    got = minhash.near_groups(documents(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == near_by_hand(rows)


def test_ids_of_several_texts_are_one_document(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(50)) for c in "xy")
    rows = [(1, one), (2, two), (7, one), (7, two), (7, None), (8, one + " z")]
    a, b = documents(spark, rows), documents(spark, rows[::-1]).repartition(3)
    for docs in (a, b):
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_groups(docs).collect())
        of_seven = {x[2] for x in got if x[0] == 7 and x[1]}
        assert of_seven in ({1}, {2}) and (7, 0, 7, True) in got and (8, 47, 1, False) in got and len(got) == 6
    assert sorted(map(tuple, minhash.near_groups(a).collect())) == sorted(map(tuple, minhash.near_groups(b).collect()))


ODD = "doc_id long, text string, gone_id long, GONE_ID_ int, gone_texts string"


def test_drop_stages_of_odd_rows_and_clashing_names(spark):
    rows = [*odd_rows(), (9, "same words here"), (10, "a b c d e f"), (11, "A b c d e f")]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], ODD)
    exact = [(i, k, h) for i, k, _, _, h in exact_by_hand(rows)]
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    want = sorted((str(i) for i, k, _ in exact if i == k or i is None))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    near = minhash.drop_near_copies(docs)
    assert near.columns == docs.columns
    by_hand = near_by_hand([(i, t) for i, t in rows if i is not None])
    assert sorted(str(r["doc_id"]) for r in near.collect()) == sorted(str(i) for i, _ in rows if i is None or by_hand[i][2])
    assert exact_dedup.drop_exact_copies(docs.limit(0)).collect() == minhash.drop_near_copies(docs.limit(0)).collect() == []


def test_another_text_under_a_dropped_id_stays(spark):
    docs = spark.createDataFrame([(3, "a", 1, 2, "x"), (5, "a ", 1, 2, "x"), (5, "b", 1, 2, "x"), (6, "a  ", 1, 2, "x"), (3, "a ", 1, 2, "x")], ODD)
    got = sorted((r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_copies(docs).collect())
    assert (5, "b") in got and (3, "a") in got and (5, "a ") not in got and (6, "a  ") not in got


def test_lists_too_long_to_broadcast_are_shuffled(spark, monkeypatch):
    from tapewright.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = near_rows(11) + random_rows(12)
    rows = list(enumerate(t for _, t in rows))
    docs = documents(spark, rows)
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_copies(docs).collect()) == sorted(i for i, k, *_ in exact_by_hand(rows) if i == k)
    assert sorted(r["doc_id"] for r in minhash.drop_near_copies(docs).collect()) == sorted(i for i, (_, _, k) in near_by_hand(rows).items() if k)


def test_odd_sketch_estimates_high_similarity():
    rng = random.Random(3)
    for share in (0.75, 0.85, 0.95):
        errors = []
        for _ in range(20):
            common = [rng.getrandbits(64) for _ in range(int(1000 * share))]
            rest = 1000 - len(common)
            import numpy as np

            a, b = (np.unique(np.array(common + [rng.getrandbits(64) for _ in range(rest // 2)], np.uint64)) for _ in range(2))
            x, y = (np.frombuffer(minhash.odd_sketch(minhash.minhashes(s)), np.uint64) for s in (a, b))
            errors.append(minhash.estimate(int(np.bitwise_count(x ^ y).sum())) - len(common) / (len(common) + 2 * (rest // 2)))
        assert abs(sum(errors) / 20) < 0.05 and max(map(abs, errors)) < 0.2


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(600 + (7 * i) % 61, 600 + (7 * (i + 1)) % 61) for i in range(60)] + [(1, i) for i in range(2, 40)] + [(500, 400), (400, 450)]
    from tapewright.llm.common import work_dir

    got = {r["node"]: r["root"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long"), work_dir(spark)).collect()}
    assert got == {i: 100 for i in range(101, 131)} | {i: 1 for i in range(2, 40)} | {500: 400, 450: 400} | {i: 600 for i in range(601, 661)}
