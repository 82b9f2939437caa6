"""Near-duplicate groups: MinHash bands find candidates, odd sketches sift them, whole shingle sets confirm them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Recent, bounded, held, in_parts, unused, work_dir, written

WORDS = 5
#: Linked: SHARE_OF * intersection >= SHARE * union.
SHARE, SHARE_OF = 75, 100
#: 32 bands of 4: two sets of similarity 0.75 share no band once in 190,000 times; of 0.8, once in 30 million.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch.
SKETCH_BITS = 512
#: Sketches of a bucket in one block, at most, and bytes of texts in one block.
BLOCK, BLOCK_BYTES = 16_000, 8 << 20
#: Nodes from which a bucket is dealt out to several blocks, and how many blocks that is at most below BLOCK.
DEAL_FROM, DEAL_TO = 200, 16
#: Followers that one copy of their leader's text is sent for.
FOLLOWERS = 500
#: Rounds in which a node is compared with one leader of its buckets.
STARS = 2
#: Candidates of a lower estimate are dropped: 5 standard deviations below 0.75 for these numbers.
LEAST_ESTIMATE = 0.53

_RANDOM = np.random.default_rng(20240521)
_A = (_RANDOM.integers(1, 1 << 32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _RANDOM.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_PLACE = (_RANDOM.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = tuple(np.uint64(x) for x in _RANDOM.integers(1, 1 << 63, WORDS + 2, dtype=np.uint64) * 2 + 1)
_SPREAD = _RANDOM.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """The set of word shingles of a text as sorted distinct 64-bit hashes, one hash for a shingle wherever it stands.

    Two different shingles of a pair of texts share a hash about once in 2**64 / (sizes multiplied) pairs.
    """

    def __init__(self, words_kept: int = 100_000):
        self.words = Recent(xxhash.xxh3_64_intdigest, words_kept)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        if len(h) >= WORDS:
            n = len(h) - WORDS + 1
            got = h[:n] * _MIX[0]
            for i in range(1, WORDS):
                got += (h[i : n + i] ^ (h[i : n + i] >> np.uint64(31))) * _MIX[i]
        elif len(h):  # fewer words than a shingle has: one shingle of them all
            got = np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
        else:
            return h
        got ^= got >> np.uint64(29)
        got *= _MIX[WORDS]
        got ^= got >> np.uint64(32)
        return np.unique(got)


def set_digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def shingler() -> Shingler:
    """One for each Python worker."""
    return held("shingles", Shingler)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima of multiply-add hashes of a non-empty set."""
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 4096):
        part = (shingles[i : i + 4096] >> np.uint64(32)).astype(np.uint32)[None, :]
        hashed = _A * part
        hashed += _B
        np.minimum(low, hashed.min(axis=1), out=low)
    return low


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    mixed = (samples.reshape(BANDS, ROWS).astype(np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) * _SPREAD
    mixed ^= mixed >> np.uint64(29)
    keys = np.bitwise_xor.reduce(mixed * np.uint64(0xBF58476D1CE4E5B9), axis=1)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    """Parity bitmap of the (place, minimum) pairs: a bit is set if an odd number of them fell on it."""
    mixed = (samples.astype(np.uint64) + np.uint64(1)) * _PLACE
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x94D049BB133111EB)
    bits = np.bincount((mixed >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def estimate(differing: int) -> float:
    """Similarity for the population count of the XOR of two sketches."""
    share = 2 * differing / SKETCH_BITS
    return 1 + SKETCH_BITS / (4 * SAMPLES) * float(np.log1p(-share)) if share < 1 else -1.0


#: The largest population count that still passes.
MOST_DIFFERING = max(d for d in range(SKETCH_BITS // 2) if estimate(d) >= LEAST_ESTIMATE)


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, n_bytes, set_digest (128 bits, of the whole set), bands (64-bit keys), sketch (eight words).

    Bands and sketch are null for a text without words.
    """
    fields = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("n_bytes", pa.int64()), ("set_digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = shingler()
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].to_pylist(), chain.from_iterable(in_parts(batch["text"]))):
                found = shingle(text)
                if len(found):
                    samples = minhashes(found)
                    out.append((doc, len(found), len(text), set_digest(found), band_keys(samples), np.frombuffer(odd_sketch(samples), np.int64)))
                else:
                    out.append((doc, 0, 0, b"", None, None))
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*out) if out else [()] * 6, fields)], schema=pa.schema(fields))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, "doc_id long, n_shingles long, n_bytes long, set_digest binary, bands array<long>, sketch array<long>")


def one_text(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """``texts`` (node, text) with one row for each node that ``repeated`` (of, least) has: one of that set digest."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = shingler()
        for batch in batches:
            yield batch.append_column("digest", pa.array([set_digest(shingle(t.as_py())) for t in batch["text"]], pa.binary()))

    many = texts.join(repeated, F.col("node") == F.col("of"), "left_semi").mapInArrow(digest, "node long, text string, digest binary")
    many = many.join(repeated, (F.col("node") == F.col("of")) & (F.col("digest") == F.col("least"))).select("node", "text").dropDuplicates(["node"])
    return texts.join(repeated, F.col("node") == F.col("of"), "left_anti").unionByName(many)


def sifted(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose odd sketches differ little enough for a link."""
    sketches = own.select(F.col("node").alias("of"), "sketch")
    both = pairs.join(sketches.withColumnRenamed("sketch", "x"), F.col("a") == F.col("of")).drop("of")
    both = both.join(sketches.withColumnRenamed("sketch", "y"), F.col("b") == F.col("of"))
    return both.where(differing(F.col("x"), F.col("y")) <= MOST_DIFFERING).select("a", "b")


def differing(x: Column, y: Column) -> Column:
    """Population count of the XOR of two sketches."""
    return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, n: s + n)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two shingle sets are similar enough."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return SHARE_OF * common >= SHARE * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose whole shingle sets are linked; ``texts`` (node, text) has both sides.

    A leader's text is sent once for so many followers, which come behind it in order, so a leader of very many is
    dealt out and a task holds one leader's set and one follower at a time.
    """
    text = texts.select(F.col("node").alias("id"), "text")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).cast("int").alias("parts"))
    behind = pairs.select("a", "b").join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    behind = behind.join(text, F.col("b") == F.col("id")).select("a", "part", "b", "text")
    ahead = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    ahead = ahead.join(text, F.col("a") == F.col("id")).select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rows = ahead.unionByName(behind).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, leader = shingler(), np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for b, t in zip(batch["b"].to_pylist(), batch["text"]):
                own = shingle(t.as_py())
                if b is None:
                    leader = own
                keep.append(b is not None and linked(leader, own))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(compare, "a long, b long")


def in_blocks(rows: DataFrame, blocks: Column, columns: list[str]) -> DataFrame:
    """``rows`` of buckets cut into so many blocks each, once for every pair of blocks: bucket, lo, hi, block, columns."""
    rows = rows.withColumn("blocks", blocks.cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")})
    return rows.select("bucket", "lo", "hi", "block", *columns).repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def links_across(left: DataFrame, own: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    """The links (a, b) between nodes of different components of a bucket; ``left`` has bucket, node, root and n, its size.

    A bucket is cut into blocks, and each pair of blocks is one piece of work, so a bucket of very many nodes is spread
    over tasks and no pair is ever a row. First sketches alone tell which nodes of a bucket have any candidate left;
    only those are then compared by text, in blocks of bounded bytes. A pair that shares several buckets is looked at
    in the first of its bands only.
    """
    about = own.withColumnRenamed("node", "of")
    rows = left.join(about, F.col("node") == F.col("of")).drop("of")
    dealt = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.ceil(F.col("n") / DEAL_FROM), F.lit(DEAL_TO)))
    rows = in_blocks(rows, dealt, ["node", "root", "n_shingles", "sketch", "bands"])
    kept_schema, link_schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64())]), pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, ["bucket", "lo", "hi"]):
            found = _with_candidates(group)
            yield pa.record_batch([pa.array(np.full(len(found), group["bucket"][0].as_py(), np.int64)), pa.array(found)], schema=kept_schema)

    kept = rows.mapInArrow(sift, "bucket long, node long").groupBy("bucket", "node").agg(F.lit(1).alias("one")).drop("one")
    kept = written(kept, f"{path}/kept")
    sizes = kept.join(own.select(F.col("node").alias("of"), "n_bytes"), F.col("node") == F.col("of"))
    sizes = bounded(sizes.groupBy(F.col("bucket").alias("in")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("m")), f"{path}/sizes")
    rows = left.join(kept.select(F.col("bucket").alias("in"), F.col("node").alias("of")), (F.col("bucket") == F.col("in")) & (F.col("node") == F.col("of")), "left_semi")
    rows = rows.join(sizes, F.col("bucket") == F.col("in")).drop("in")
    rows = rows.join(about, F.col("node") == F.col("of")).drop("of")
    rows = rows.join(texts.select(F.col("node").alias("of"), "text"), F.col("node") == F.col("of")).drop("of")
    dealt = F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.least(F.ceil(F.col("m") / DEAL_FROM), F.lit(DEAL_TO)), F.lit(1))
    rows = in_blocks(rows, dealt, ["node", "root", "n_shingles", "sketch", "bands", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, ["bucket", "lo", "hi"]):
            found = _links_in(group)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*found) if found else ((), ()))], schema=link_schema)

    return rows.mapInArrow(compare, "a long, b long").distinct()


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the adjacent rows that agree in ``keys``."""
    parts: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        ends = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows]):
            key = tuple(c[lo] for c in columns)
            if parts and key != last:
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(batch.slice(lo, hi - lo))
            last = key
    if parts:
        yield pa.Table.from_batches(parts)


class _Pairs:
    """The candidates of one pair of blocks: sketches near enough, of fitting set sizes, first seen in this bucket."""

    def __init__(self, group: pa.Table):
        n = group.num_rows
        self.node, self.root, self.size = (group[c].to_numpy() for c in ("node", "root", "n_shingles"))
        self.sketch = group["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(n, -1)  # signed ones count as absolute
        self.bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        self.bucket, self.one = group["bucket"][0].as_py(), group["lo"][0] == group["hi"][0]
        block = group["block"].to_numpy()
        self.xs, self.ys = np.flatnonzero(block == group["lo"][0].as_py()), np.flatnonzero(block == group["hi"][0].as_py())

    def __call__(self, done: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of places (x, y); pairs whose two sides are ``done``, which may change meanwhile, are left out."""
        ys, step = self.ys, max(1, (1 << 20) // max(1, len(self.ys)))
        for i in range(0, len(self.xs), step):
            xs = self.xs[i : i + step]
            fit = self.root[xs][:, None] != self.root[ys][None, :]
            small, large = (f(self.size[xs][:, None], self.size[ys][None, :]) for f in (np.minimum, np.maximum))
            fit &= SHARE_OF * small >= SHARE * large
            if self.one:
                fit &= self.node[xs][:, None] < self.node[ys][None, :]
            if done is not None:
                fit &= ~(done[xs][:, None] & done[ys][None, :])
            at, to = np.nonzero(fit)
            for j in range(0, len(at), 1 << 16):
                x, y = xs[at[j : j + (1 << 16)]], ys[to[j : j + (1 << 16)]]
                near = np.bitwise_count(self.sketch[x] ^ self.sketch[y]).sum(axis=1) <= MOST_DIFFERING
                x, y = x[near], y[near]
                same = self.bands[x] == self.bands[y]
                first = self.bands[x, same.argmax(axis=1)] == self.bucket
                yield x[first], y[first]


def _with_candidates(group: pa.Table) -> np.ndarray:
    """The nodes of one pair of blocks that have a candidate in it."""
    pairs, done = _Pairs(group), np.zeros(group.num_rows, bool)
    for x, y in pairs(done):
        done[x] = done[y] = True
    return pairs.node[done]


def _links_in(group: pa.Table) -> list[tuple[int, int]]:
    """Confirmed links of one pair of blocks; pairs that the links found so far join already are left out."""
    pairs, shingle, sets, out = _Pairs(group), shingler(), {}, []
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    for xs, ys in pairs():
        for x, y in zip(xs.tolist(), ys.tolist()):
            p, q = top(int(pairs.root[x])), top(int(pairs.root[y]))
            if p == q:
                continue
            for k in (x, y):
                if k not in sets:
                    sets[k] = shingle(group["text"][k].as_py())
            if linked(sets[x], sets[y]):
                above[max(p, q)] = min(p, q)
                out.append((int(pairs.node[x]), int(pairs.node[y])))
    return out


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, root): the smallest node that is reachable, for every node of ``edges`` (a, b) that isn't its own root.

    Large-star and small-star steps in turn until every node has one edge, to a root; each step is a sum by key and a
    join, so a node with very many neighbours is never gathered in one place. Each round is written to the shared
    folder, and rounds go on until that state is reached.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), f"{path}/edges")
    for turn in count(1):
        # large star: each larger neighbour of a node goes to the node's smallest neighbour
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = written(small.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), f"{path}/round{turn}")
        sides = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        sides = sides.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if sides.where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of five-word shingles have 100 * intersection >= 75 * union; component_id is
    the smallest doc_id that links lead to, and that document is kept. A text of fewer words is one shingle; null,
    empty and blank texts have none and are linked with nothing. doc_id is a key: rows that repeat it are one document,
    of whose texts the set of least digest counts. An empty table gives no rows. A null doc_id links with nothing: its component_id is null and it is kept. Other columns are ignored.

    Equal sets are one node. Nodes that share a band's bucket are candidates. In each of STARS rounds a node that is in
    another component than the leading node of one of its buckets is compared with one such leader, so a large group
    grows together along few comparisons. Then all nodes of a bucket that are still in different components are
    compared with each other, so no link is lost. Candidates of a low odd-sketch estimate are dropped, the others
    confirmed on their whole sets (of 64-bit hashes).
    """
    path = work_dir(docs.sparkSession)
    signed = written(signatures(docs), f"{path}/signed")
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    repeated = known.groupBy(F.col("doc_id").alias("of")).agg(F.min("set_digest").alias("least"), F.count(F.lit(1)).alias("n"))
    repeated = written(repeated.where("n > 1").drop("n"), f"{path}/repeated")
    known = known.join(repeated, F.col("doc_id") == F.col("of"), "left").where("of IS NULL OR set_digest = least").drop("of", "least")
    nodes = known.groupBy(F.col("set_digest").alias("digest")).agg(F.min("doc_id").alias("node"))
    nodes = written(nodes, f"{path}/nodes")
    own = known.join(nodes, (F.col("set_digest") == F.col("digest")) & (F.col("doc_id") == F.col("node")))
    own = written(own.dropDuplicates(["node"]).select("node", "n_shingles", "n_bytes", "sketch", "bands"), f"{path}/own")
    shares = own.select("node", F.explode("bands").alias("bucket"))
    shared = shares.groupBy(F.col("bucket").alias("in")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("in")
    shares = written(shares.join(shared, F.col("bucket") == F.col("in"), "left_semi"), f"{path}/held")
    need = bounded(shares.select(F.col("node").alias("need")).distinct(), f"{path}/need")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string"))
    texts = written(texts.join(need, F.col("node") == F.col("need"), "left_semi"), f"{path}/texts")
    if not repeated.isEmpty():
        texts = written(one_text(texts, repeated), f"{path}/one_text")
    roots = shares.select("node", F.col("node").alias("root")).limit(0)
    links = shares.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    for turn in range(STARS + 1):
        placed = shares.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "bucket", F.coalesce("root", "node").alias("root"))
        if turn:
            placed = written(placed, f"{path}/placed{turn}")
        lead = (F.min if turn % 2 == 0 else F.max)(F.struct("node", "root")).alias("lead")
        mixed = placed.groupBy(F.col("bucket").alias("in")).agg(lead, F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n")).where("x != y")
        mixed = bounded(mixed, f"{path}/mixed{turn}")
        if turn < STARS:
            star = placed.join(mixed, F.col("bucket") == F.col("in")).where(F.col("root") != F.col("lead.root"))
            pairs = star.groupBy(F.col("node").alias("b")).agg(F.min("lead.node").alias("a"))
            found = confirmed(written(sifted(pairs, own), f"{path}/sifted{turn}"), texts)
        else:
            sized = placed.join(mixed.select("in", "n"), F.col("bucket") == F.col("in")).select("bucket", "node", "root", "n")
            found = links_across(written(sized, f"{path}/left"), own, texts, path)
        found = written(found, f"{path}/links{turn}")
        if not found.isEmpty():
            links = links.union(found)
            roots = components(links, f"{path}/turn{turn}")
    signed = signed.select("doc_id", "n_shingles", "set_digest").join(repeated, F.col("doc_id") == F.col("of"), "left").drop("of")
    joined = signed.join(nodes, F.coalesce("least", "set_digest") == F.col("digest"), "left")
    joined = joined.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, with all columns, whatever their names; see ``near_groups``.

    Rows with a null id or without words stay, rows that repeat an id share their fate, and an empty table stays empty.
    The ids that go are written, and broadcast only if they are few enough.
    """
    name = unused(docs, "gone_id")
    gone = near_groups(docs).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    gone = bounded(gone, f"{work_dir(docs.sparkSession)}/gone")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
