"""Token counts of every prefix by dynamic programming over last tokens, kept for each stretch of text."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, held
from .pretokens import PATTERN, UnitMemo, compiled

NEVER = 1 << 60
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Matches of the pattern that, cut after their first letter, are two matches.
CUT_SHORT = frozenset(("'re", "'ve", "'ll"))


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for letters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Characters of the longest stretch whose array is kept; longer ones are rare and counted anew.
LONGEST_KEPT = 200


def packed(counts: list[int] | bytes | tuple) -> bytes | tuple:
    """Counts in as few bytes as they need; both forms are read by index."""
    try:
        return bytes(counts)
    except ValueError:  # one is above 255
        return tuple(counts)


def joined(arrays: Iterable[bytes | tuple | list[int]]) -> list[int]:
    """The counts of all prefixes of stretches that follow each other."""
    out, base = [0], 0
    for kept in arrays:
        out += [base + c for c in kept[1:]] if base else kept[1:]
        base += kept[-1]
    return out


class TokenCounter:
    """Exact counts for a tokenizers file of byte-level BPE, of whole texts and of all their prefixes.

    What is kept for a stretch of text is the array of the counts of all its prefixes. A text's count, its cut at a
    budget and the counts of its prefixes are read from these arrays; nothing is encoded a second time for them.

    The encoding of a prefix ends in one token, and what stands before that token is the encoding of a shorter prefix.
    So from left to right each position needs only the token that ends there: the one whose pair with the last token of
    the prefix before it would be left as it is by the merges. Counts follow by adding one. Only tokens that end at a
    position are tried there: an automaton over the bytes, filled as texts need it, gives them, longest first.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        number = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            key = (number[a], number[b])
            self.rank.setdefault(key, r)
            self.parts.setdefault(number[a + b], (*key, r))
        self.tokens = {t: i for t, i in vocab.items() if len(t) == 1 or i in self.parts}
        self.begun = {t[:k] for t in self.tokens for k in range(len(t) + 1)}
        added = spec.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that look at their neighbours aren't supported")
        self.special = [t["content"] for t in added]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.findall = compiled(PATTERN).findall
        self.right = Recent(lambda t: self._edge(t, 1), 200_000)
        self.left = Recent(lambda t: self._edge(t, 0), 200_000)
        self.fits = Recent(self._fits, 400_000)
        self.endings = Recent(self._endings, 100_000)
        self.pretokens = Recent(lambda p: packed(self._by_characters(p)), 300_000, LONGEST_KEPT)
        self.arrays = UnitMemo(lambda unit: packed(self._of_stretch(unit)), 200_000, LONGEST_KEPT)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the outermost byte of a token to the whole: (part, rank of the merge that uses it up)."""
        out = [(token, NEVER)]
        while token in self.parts:
            *both, r = self.parts[token]
            token = both[side]
            out.append((token, r))
        return out[::-1]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merging the bytes of two tokens gives those two again: no merge across them comes first."""
        xs, ys = self.right[pair[0]], self.left[pair[1]]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = xs[i], ys[j]
            r = self.rank.get((x, y))
            if r is not None and r < x_until and r <= y_until:  # of equal ranks the left one goes first
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _endings(self, read: bytes) -> tuple[bytes, tuple[tuple[int, int], ...]]:
        """The longest end of what was read that begins a token, and the tokens that end with it: (token, bytes)."""
        while read not in self.begun:
            read = read[1:]
        ends = [read[i:] for i in range(len(read))]
        return read, tuple((self.tokens[t], len(t)) for t in ends if t in self.tokens)

    def prefixes(self, data: bytes) -> list[int]:
        """Counts of the prefixes of one pretoken, by bytes; the first entry is 0."""
        count, last, state, endings, fits = [0], [-1], b"", self.endings, self.fits
        for end in range(1, len(data) + 1):
            state, ending = endings[state + data[end - 1 : end]]
            for token, size in ending:
                start = end - size
                if not start or fits[last[start], token]:
                    count.append(count[start] + 1)
                    last.append(token)
                    break
        return count

    def segments(self, text: str) -> Iterator[tuple[str, str]]:
        """Plain text and the special string behind it, which may be empty."""
        at = 0
        for found in self.cut.finditer(text) if self.cut else ():
            yield text[at : found.start()], found[0]
            at = found.end()
        yield text[at:], ""

    def _by_characters(self, pretoken: str) -> list[int]:
        counts = self.prefixes(pretoken.encode("utf-8", "replace"))
        if len(counts) == len(pretoken) + 1:
            return counts
        return [counts[i] for i in accumulate((len(c.encode("utf-8", "replace")) for c in pretoken), initial=0)]

    def _of_stretch(self, stretch: str) -> list[int] | bytes | tuple:
        """Counts of the prefixes of what stands between two spaces, which can be several units."""
        units = self.arrays.units(stretch)
        return self._of_unit(stretch) if len(units) == 1 else joined(map(self.arrays.plain.__getitem__, units))

    def _of_unit(self, unit: str) -> list[int] | bytes | tuple:
        """Counts of a unit's prefixes, by characters; the first entry is 0."""
        found = self.findall(unit)
        if len(found) == 1 and found[0] not in CUT_SHORT:
            return self.pretokens[unit]
        if unit[1] not in SPACES and CUT_SHORT.isdisjoint(found):  # a prefix's matches are those of the unit, the last one cut
            return joined(map(self.pretokens.__getitem__, found))
        spaces = len(unit) - len(unit.lstrip(SPACES))
        out = [*self.pretokens[unit[:spaces]]]  # white space at the end of a prefix is one pretoken
        base = at = 0
        for pretoken in found:
            end, kept = at + len(pretoken), self.pretokens[pretoken]
            if end > spaces:
                part = [0, 1, 2, kept[-1]] if pretoken in CUT_SHORT else kept
                out += [base + c for c in part[len(out) - at :]]
            base += kept[-1]
            at = end
        return out

    def _plain(self, text: str) -> list[int]:
        """Counts of the prefixes of a text whose special strings count as any other text."""
        return joined(self.arrays(text))

    def stretches(self, text: str) -> Iterator[bytes | tuple | list[int]]:
        """Of each stretch of a text how many tokens each of its prefixes adds to what is before the stretch.

        A special string is one token, but a cut inside it leaves plain text, together with the unit before it.
        """
        for plain, special in self.segments(text):
            yield from self.arrays(plain)
            if special:
                units = self.arrays.units(plain)
                tail, own = (units[-1], self.arrays.plain[units[-1]][-1]) if units else ("", 0)
                inside = self._plain(tail + special[:-1])
                yield [0, *[c - own for c in inside[len(tail) + 1 :]], 1]

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; special strings in it are one token each, as in the library."""
        return self.count_and_cut(text)[0]

    def prefix_counts(self, text: str | None) -> list[int]:
        """Tokens of text[:k] for every k from 0 to its length, each as encoding that prefix alone would give."""
        return joined(self.stretches(text or ""))

    def longest_prefix(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens, read from the arrays up to where it ends."""
        return self.count_and_cut(text, budget)[1]

    def count_and_cut(self, text: str | None, budget: int | None = None) -> tuple[int, int]:
        """Both of the above from one reading of the text; without a budget the whole text is the prefix."""
        text = text or ""
        special = self.has_special(text)
        arrays = [*self.stretches(text)] if special else self.arrays(text)
        n = sum([kept[-1] for kept in arrays])
        if budget is None or n <= budget:
            return n, len(text)
        if special:  # a cut inside a special string can have fewer tokens than one before it
            return n, max(k for k, c in enumerate(joined(arrays)) if c <= budget)
        used = at = 0
        for kept in arrays:
            if used + kept[-1] > budget:
                return n, at + max(k for k, c in enumerate(kept) if used + c <= budget)
            used, at = used + kept[-1], at + len(kept) - 1
        return n, at


def counter(path: str) -> TokenCounter:
    """One for each Python worker and file."""
    return held(f"counter {path}", lambda: TokenCounter(path))


def token_counts(docs: DataFrame, path: str, limit: int = 512, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and cut_chars, the length of the longest prefix within ``limit`` tokens.

    With ``prefixes`` also prefix_counts, the tokens of every prefix by characters. Null counts as empty; empty texts
    have no tokens; repeated rows and null ids are carried; other columns are ignored; an empty table gives no rows.
    Rows are counted where they are, without a shuffle.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("cut_chars", pa.int64())]
    fields += [("prefix_counts", pa.list_(pa.int32()))] * prefixes
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py() or ""
                n, cut = c.count_and_cut(text, limit)
                out.append((doc, len(text.encode("utf-8", "replace")), n, n > limit, cut, *([c.prefix_counts(text)] if prefixes else [])))
            yield pa.record_batch([pa.array(col, f.type) for col, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)

    names = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long" + ", prefix_counts array<int>" * prefixes
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, names)
