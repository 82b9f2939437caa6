"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, bounded, unused, work_dir, written

#: Shortest and longest chunk, in bytes of UTF-8, but for what the cut itself matches.
MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Of last bytes of characters of several bytes, one in eight.
_EIGHTH = r"[\x84\x8B\x92\x9B\xA4\xAB\xB2\xBB]"
#: A chunk ends behind one of these letters, a space and one of those letters, or, in scripts whose characters have
#: several bytes, behind two in sequence that end in such a byte, before a third: a rule on content, so that the same
#: passage is cut alike wherever it stands. Text without such a place is cut at the longest length.
CUT = rf"[dnrs] [acmtw]|{_EIGHTH}[\xC2-\xF4][\x80-\xBF]{{0,2}}{_EIGHTH}(?=[\xC2-\xF4])"


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), ASCII_SPACE, " ")


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text, in order, a character for each byte of UTF-8; joined they are the text.

    Empty text has none.
    """
    by_byte = F.decode(text.cast("binary"), "ISO-8859-1")
    return F.regexp_extract_all(by_byte, F.lit(rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:{CUT})|.{{1,{MAX_CHUNK}}}"), F.lit(0))


def strong_keys(chunk: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes."""
    return [F.xxhash64(chunk), F.xxhash64(F.lit("tapewright"), chunk)]


def recipes(docs: DataFrame, keys=strong_keys) -> DataFrame:
    """(doc_id, text_sha256, recipe): per row of ``docs`` the ordered, verified identifiers of its chunks.

    An identifier is a chunk's hash. Verification: every distinct chunk is moved once to its hash, and a hash with two
    different chunks is a collision. Chunks under such a hash get their rank among them in the identifier, found by
    comparing whole chunks, so equal recipes always mean equal texts.
    """
    text = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    cut = text.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), chunks(F.col("norm")).alias("pieces"))
    names = [f"h{i}" for i in range(len(keys(F.lit(""))))]
    hashed = [k.alias(n) for k, n in zip(keys(F.col("piece")), names)]
    distinct = text.select(F.explode(chunks(F.col("norm"))).alias("piece")).select(*hashed, "piece").groupBy(*names, "piece").agg(F.lit(1).alias("one"))
    clashes = distinct.groupBy(*names).count().where("count > 1").drop("count")
    path = work_dir(docs.sparkSession)
    clashes = written(clashes, f"{path}/clashes")
    if clashes.isEmpty():
        return cut.select("doc_id", "text_sha256", F.flatten(F.transform("pieces", lambda c: F.array(*keys(c)))).alias("recipe"))
    ranked = distinct.join(clashes, names, "left_semi")
    other = ranked.select(*names, F.col("piece").alias("other"))
    ranks = ranked.join(other, [*names], "inner").groupBy(*names, "piece").agg(F.sum((F.col("other") < F.col("piece")).cast("long")).alias("rank"))
    rows = written(cut.select("doc_id", "text_sha256", "pieces").withColumn("row", F.monotonically_increasing_id()), f"{path}/cut")
    each = rows.select("row", F.posexplode("pieces").alias("at", "piece")).select("row", "at", *hashed, "piece")
    each = each.join(ranks, [*names, "piece"], "left")
    ids = F.array(*names, F.coalesce("rank", F.lit(0).cast("long")))
    lists = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", ids.alias("ids")))).alias("list"))
    lists = lists.select("row", F.flatten(F.transform("list", lambda x: x["ids"])).alias("found"))
    return rows.join(lists, "row", "left").select("doc_id", "text_sha256", F.coalesce("found", F.array().cast("array<bigint>")).alias("recipe"))


def exact_groups(docs: DataFrame, keys=strong_keys) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; null counts as empty. Of equal
    texts the smallest doc_id stays. Rows with a null doc_id count in group_size and go if the group has an id at all; a
    group without one keeps its rows, with keep_id null. Rows that repeat both doc_id and text share their fate. An
    empty table gives no rows; other columns of ``docs`` are ignored, whatever their names.

    The lists are compared, never the texts: sizes and smallest ids are summed before they are shuffled. Only lists that
    occur more than once are joined back, as a table of one row for each, so that a list that a third of all documents
    share is split by skew handling and a short table is broadcast once its size is known.
    """
    path = work_dir(docs.sparkSession)
    rows = written(recipes(docs, keys), f"{path}/recipes")
    groups = rows.groupBy(F.col("recipe").alias("list")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    repeated = written(groups.where("n > 1"), f"{path}/repeated")
    joined = rows.join(repeated, F.col("recipe") == F.col("list"), "left")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    size = F.coalesce("n", F.lit(1).cast("long"))
    return joined.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"), "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; see ``exact_groups``.

    A row goes by its id and text, so another text under the same id stays. Rows with a null id stay, rows that repeat
    both id and text share their fate, null texts count as empty, and an empty table stays empty. The list of what
    goes is written, and broadcast only if it is short enough.
    """
    name, texts = unused(docs, "gone_id"), unused(docs, "gone_texts")
    gone = exact_groups(docs).where("NOT kept AND doc_id IS NOT NULL")
    gone = gone.groupBy(F.col("doc_id").alias(name)).agg(F.collect_set("text_sha256").alias(texts))
    gone = bounded(gone, f"{work_dir(docs.sparkSession)}/gone")
    same = F.array_contains(texts, F.sha2(normalised(F.col("text")).cast("binary"), 256))  # looked at where ids agree
    return docs.join(gone, (F.col("doc_id") == F.col(name)) & same, "left_anti")
