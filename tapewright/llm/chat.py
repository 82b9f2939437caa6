"""Chat formatting with Spark expressions only: one string for each conversation, its loss mask, and the way back."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings. All begin with OPEN, which no escaped text contains.
OPEN, START, NEXT, END = "<|", "<|im_start|>", "<|im_next|>", "<|im_end|>\n"
TRAINED = "assistant"
#: Characters of a part in which spans are looked up, and pieces whose spans are listed together.
LEAF, GROUP = 4096, 256
#: In this order; the way back is the reverse. A line feed is escaped in roles only.
ESCAPES = [("&", "&amp;"), (OPEN, "&lt;|")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "&#10;")]


def escaped(text: Column, rules: list[tuple[str, str]] = ESCAPES) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), rules, text)


def unescaped(text: Column, rules: list[tuple[str, str]] = ESCAPES) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[1]), F.lit(r[0])), reversed(rules), text)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from rows (conv_id, turn, role, text).

    The turns of a conversation are sorted by turn, then role and text, nulls first. Adjacent turns of one role become
    one block, ``<|im_start|>role``, line feed, the texts with ``<|im_next|>`` between them, ``<|im_end|>``, line feed.
    ``loss_spans`` has (start, length) in characters, from 1, of each assistant text in ``formatted``. Null roles and
    texts are empty; repeated rows are turns of their own; rows without conv_id are one conversation; an empty table
    gives no rows; other columns are ignored. A conversation is one value in the end, so it has to fit a task.
    """
    row = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    at = F.sequence(F.lit(0), F.size("turns") - 1)
    first = F.filter(at, lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"]))
    starts = sorted_turns.withColumn("starts", first)

    def block(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        return F.struct(F.col("turns")[begin]["role"].alias("role"), F.transform(F.sequence(begin, end - 1), lambda i: F.col("turns")[i]["text"]).alias("texts"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(b: Column) -> Column:
        trained = b["role"] == TRAINED
        head = F.concat(F.lit(START), escaped(b["role"], ROLE_ESCAPES), F.lit("\n"))
        texts = F.transform(b["texts"], lambda t, i: F.array(piece(F.when(i > 0, F.lit(NEXT)).otherwise(head), F.lit(False)), piece(escaped(t), trained)))
        return F.concat(F.flatten(texts), F.array(piece(F.lit(END), F.lit(False))))

    merged = starts.select("conv_id", F.transform("starts", block).alias("blocks"))
    laid = merged.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return laid.select("conv_id", text.alias("formatted"), once(F.col("pieces"), loss_spans).alias("loss_spans"))


def loss_spans(pieces: Column) -> Column:
    """(start, length) in characters, from 1, of the pieces (text, loss) under the loss mask, once they are joined.

    Pieces are taken GROUP at a time, each group from 1, and then moved behind the groups before it, so no long list is
    built up piece by piece.
    """
    nothing = F.array().cast("array<struct<start:int,length:int>>")

    def span(acc: Column, p: Column) -> Column:
        n = F.length(p["text"])
        more = F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), n.alias("length"))))
        return F.struct((acc["at"] + n).alias("at"), F.when(p["loss"], more).otherwise(acc["spans"]).alias("spans"))

    def group(g: Column) -> Column:
        own = F.transform(F.sequence(g * GROUP, F.least((g + 1) * GROUP, F.size(pieces)) - 1), lambda i: pieces[i])
        return F.aggregate(own, F.struct(F.lit(1).alias("at"), nothing.alias("spans")), span)

    def moved(groups: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
        step = F.aggregate(groups, zero, lambda acc, g: F.struct((acc["at"] + g["at"] - 1).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")))
        shift = F.zip_with(groups, step["before"], lambda g, by: F.transform(g["spans"], lambda s: F.struct((s["start"] + by).alias("start"), s["length"].alias("length"))))
        return F.flatten(shift)

    return once(F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / GROUP).cast("int")), group), moved)


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted conversation, as an array of (role, text)."""

    def block(b: Column) -> Column:
        cut = F.instr(b, "\n")
        role = unescaped(b.substr(F.lit(len(START) + 1), cut - len(START) - 1), ROLE_ESCAPES)
        body = b.substr(cut + 1, F.length(b))
        return once(role, lambda r: F.transform(F.split(body, r"<\|im_next\|>"), lambda t: F.struct(r.alias("role"), unescaped(t).alias("text"))))

    ends = F.split(formatted, r"<\|im_end\|>\n")
    return F.flatten(F.transform(F.slice(ends, 1, F.size(ends) - 1), block))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once, however often a loop in it asks for it."""
    return F.transform(F.array(value), use)[0]


def leaves(formatted: Column) -> Column:
    """A string as an array of strings of LEAF characters, the last one shorter."""
    return F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{LEAF}}}"), F.lit(0))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing in between.

    A span is looked up in the leaves that it touches, so the work follows the text and not its square.
    """

    def cut(s: Column, parts: Column) -> Column:
        first, last = F.floor((s["start"] - 1) / LEAF).cast("int"), F.floor((s["start"] + s["length"] - 2) / LEAF).cast("int")
        near = F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), lambda i: parts[i]), "")
        return unescaped(F.substr(near, s["start"] - first * LEAF, s["length"]))

    return once(leaves(formatted), lambda parts: F.array_join(F.transform(spans, lambda s: cut(s, parts)), ""))


def chat_digests(turns: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted conversations."""
    made = format_conversations(turns)
    back = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
