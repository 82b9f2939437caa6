import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from tapewright.llm.bpe import Bpe, RankQueue, bpe_digests
from tapewright.llm.packing import OpenWindows, best_fit_decreasing, packed_documents
from tapewright.llm.pretokens import UnitMemo
from tapewright.llm.tokencount import TokenCounter, token_counts

from .helpers import documents, odd_rows

public = pytest.importorskip("public_tokenizers")
PARTS = ["a", "the", " ", "  ", "\n", "\t", "'s", "'re", "'", "é", "日本", "\x1c", "　", "\x85", "1", "²", "!!", "<|endoftext|>", "<|", "😀", "İ", "ß", "_", "\xa0", "ing", "aaaa", "'ll", "Σ", "​", "\x00"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 15))) for _ in range(n)]


@pytest.fixture(scope="module")
def bpe():
    return Bpe.from_file(public.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tiktoken_encoding(bpe):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_bpe_equals_the_library(bpe, tiktoken_encoding):
    for t in [*texts(800), "ab" * 3000, "x" * 5000]:
        ids = bpe.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == tiktoken_encoding.encode_ordinary(t), repr(t)
        assert bpe.decode(ids) == t.encode()


def test_rank_queue_gives_lowest_rank_leftmost_first():
    rng, queue, want = random.Random(2), RankQueue(60_000), []
    for _ in range(3000):
        item = (rng.randrange(60_000), rng.randrange(100))
        queue.push(*item)
        want.append(item)
    got = []
    while (x := queue.pop()) is not None:
        got.append(x)
    assert got == sorted(want)


def test_bpe_digests_of_odd_rows(spark, tiktoken_encoding):
    rows = odd_rows()
    got = bpe_digests(documents(spark, rows), public.path("byte_bpe_50k.tiktoken")).collect()
    want = []
    for i, t in rows:
        ids = tiktoken_encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe_digests(documents(spark, []), public.path("byte_bpe_50k.tiktoken")).collect() == []


def test_counts_of_all_prefixes_equal_the_library(library):
    counter = TokenCounter(public.path("byte_bpe_50k.json"))
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for t in texts(250, 3):
        want = [n(t[:k]) for k in range(len(t) + 1)]
        assert counter.prefix_counts(t) == want, repr(t)
        assert counter.count(t) == want[-1]
        for budget in (0, 1, 3):
            assert counter.longest_prefix(t, budget) == max(k for k, c in enumerate(want) if c <= budget), repr(t)


def test_counts_are_read_from_kept_arrays(library, monkeypatch):
    """Once a text was counted, its cuts and prefixes need no further dynamic programming."""
    counter = TokenCounter(public.path("byte_bpe_50k.json"))
    rows = [t for t in texts(60, 7) if "'" not in t] + ["some words<|endoftext|>and <|endoftext|>", "x" * 1500 + " y"]
    for t in rows:
        counter.prefix_counts(t)
    want = [(counter.count(t), counter.longest_prefix(t, 3), counter.prefix_counts(t)) for t in rows[:-1]]
    monkeypatch.setattr(counter, "prefixes", None)
    assert [(counter.count(t), counter.longest_prefix(t, 3), counter.prefix_counts(t)) for t in rows[:-1]] == want
    assert len(counter.arrays.plain) < 2000 and not any(len(u) > 200 for u in counter.arrays.plain)


def test_count_and_cut_come_from_one_reading(library, monkeypatch):
    counter = TokenCounter(public.path("byte_bpe_50k.json"))
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for t in [*texts(80, 9), "", None, "some words<|endoftext|>and <|endoftext|>"]:
        want = [n((t or "")[:k]) for k in range(len(t or "") + 1)]
        for budget in (0, 2, 512):
            assert counter.count_and_cut(t, budget) == (want[-1], max(k for k, c in enumerate(want) if c <= budget)), repr(t)
    read, call = [], UnitMemo.__call__
    monkeypatch.setattr(UnitMemo, "__call__", lambda memo, text: read.append(text) or call(memo, text))
    assert counter.count_and_cut("one two three four", 2) == (4, len("one two"))
    assert read == ["one two three four"]


def test_each_pretoken_is_computed_once(monkeypatch):
    counter, seen = TokenCounter(public.path("byte_bpe_50k.json")), []
    prefixes = counter.prefixes
    monkeypatch.setattr(counter, "prefixes", lambda data: seen.append(data) or prefixes(data))
    for t in ("Haanth, reoush. haanth; Reoush.\nHaanth, reoush!", "haanth, reoush. \n reoush; don't we're  haanth:"):
        counter.count(t)
    assert len(seen) == len(set(seen))


def test_a_position_tries_only_tokens_that_end_there(library, monkeypatch):
    """Stretches of text that are no tokens are not looked up: what ends where is known from the bytes read so far."""
    counter = TokenCounter(public.path("byte_bpe_50k.json"))
    words = [" vergangenheitsbew", "thendouantiing", "x" * 300, "-" * 200, " ererthwhion"]
    want = [[len(library.encode(w[:k], add_special_tokens=False).ids) for k in range(len(w) + 1)] for w in words]
    assert [counter.prefixes(w.encode()) for w in words] == want
    monkeypatch.setattr(counter, "tokens", None)
    assert [counter.prefixes(w.encode()) for w in words] == want


def test_token_counts_of_odd_rows(spark, library):
    rows = odd_rows()
    got = token_counts(documents(spark, rows), public.path("byte_bpe_50k.json"), prefixes=True).collect()
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == want
    for r in got:
        assert r["over_limit"] == (r["n_tokens"] > 512)
        assert r["prefix_counts"][-1] == r["n_tokens"] and r["prefix_counts"][r["cut_chars"]] <= 512
    assert token_counts(documents(spark, []), public.path("byte_bpe_50k.json")).collect() == []


def tightest(lengths, window):
    """Best fit by looking at every open window."""
    room = []
    for n in lengths:
        fits = [r for r in room if r >= n]
        if fits:
            at = room.index(min(fits))
        else:
            room.append(window)
            at = len(room) - 1
        room[at] -= n
    return sorted(room)


def test_best_fit_equals_a_plain_search():
    rng = random.Random(4)
    for window in (7, 64, 100):
        lengths = sorted((rng.randrange(1, window) for _ in range(300)), reverse=True)
        got = best_fit_decreasing(lengths, window)
        fill = {}
        for (w, offset), n in zip(got, lengths):
            assert fill.get(w, 0) == offset
            fill[w] = offset + n
        assert sorted(window - f for f in fill.values()) == tightest(lengths, window)


def test_open_windows_find_nothing_above_all():
    tree = OpenWindows(16)
    tree.put(3, 0)
    assert tree.take(4) is None and tree.take(2) == (3, 0) and tree.take(1) is None


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(texts(60, 5))] + [(200, "İstanbul Σς <|endoftext|> <|startoftext|>x ²½ don't")]
    got = packed_documents(documents(spark, rows), public.path("word_bpe_49k.json")).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    seen, fill = {}, {}
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["length"] <= 4096
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        seen.setdefault(r["doc_id"], []).extend(range(r["start"], r["start"] + r["length"]))
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, own in ids.items():
        copies = sum(x == i for x, _ in rows)
        assert sorted(seen[i]) == sorted(list(range(len(own))) * copies)
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packed_documents(documents(spark, []), public.path("word_bpe_49k.json")).collect() == []


def test_another_format_is_an_error():
    import json

    from tapewright.llm.packing import check_format

    with open(public.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    check_format(spec)
    changed = spec | {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFKC"}]}}
    for other in (changed, spec | {"pre_tokenizer": None}, spec | {"model": spec["model"] | {"end_of_word_suffix": None}}):
        with pytest.raises(ValueError):
            check_format(other)
    with pytest.raises(ValueError):
        check_format({"model": {}})


def test_emptied_memo_still_knows_the_batch():
    from tapewright.llm.packing import ChunkEncoder

    small, large = ChunkEncoder(public.path("word_bpe_49k.json"), 40), ChunkEncoder(public.path("word_bpe_49k.json"))
    rows = [" ".join(f"{a}{b}" for b in "abcdefg") for a in "qwertyuiop" for _ in range(20)]
    assert list(small.encode(rows)) == list(large.encode(rows))


def test_ranks_file_is_as_described(bpe):
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        first = f.readline().split()
    assert bpe.ranks[base64.b64decode(first[0])] == int(first[1])


def test_pieces_without_or_with_one_id_are_spread_over_shards(spark):
    from pyspark.sql import functions as F

    from tapewright.llm.packing import pack

    pieces = spark.range(4000).select(F.when(F.col("id") % 4 > 0, F.lit(None).cast("long")).otherwise(5).alias("doc_id"), F.lit(0).cast("long").alias("start"), (F.col("id") % 90 + 5).alias("length"))
    got = pack(pieces, 100, per_shard=500)
    sizes = [r["count"] for r in got.groupBy(F.expr("sequence_id >> 32")).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) == 8 and max(sizes) < 800
    ends = got.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.where("used > 100 OR used <> end").count() == 0
