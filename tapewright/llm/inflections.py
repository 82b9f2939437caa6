"""Inflected forms as a letter transducer: beginnings, stems and endings in sequence, which writes the lemma."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache


@dataclass(frozen=True)
class Paradigm:
    """Words made of a beginning, a stem and an ending; ``-`` is none. A stem stands for itself or, as stem:lemma, for a lemma."""

    stems: str
    endings: str
    beginnings: str = "-"

    def lemmas(self) -> dict[str, str]:
        pairs = [s.split(":") for s in self.stems.split()]
        return {p[0]: p[-1] for p in pairs}


# How the grammar's verbs and pronouns are inflected in English, German, French and Spanish.
_ER = "er e es ons ez ent ant é ée és ées ai a ait aient era erai eras erez eront erait"
_AR = "ar o as a amos áis an é aste ó aron aba aban aré ará arán ando ado ada"
PARADIGMS = (
    Paradigm("kill destroy burn", "s ed ing"),
    Paradigm("hurt beat shoot", "s ing"),
    Paradigm("punish", "es ed ing"),
    Paradigm("stab", "s bed bing"),
    Paradigm("shot:shoot beaten:beat burnt:burn", "-"),
    Paradigm("say:said tell:told claim:claimed", "- s ing"),
    Paradigm("writ:wrote quot:quoted", "e es ing"),
    Paradigm("written:wrote calling:called reporting:reported", "-"),
    Paradigm("töt:töten", "e est et en ete eten end", "- ge"),
    Paradigm("verletz:verletzen", "e t en te ten end"),
    Paradigm("zerstör:zerstören", "e st t en te ten"),
    Paradigm("schlag:schlagen schläg:schlagen schlug:schlagen", "e st t en", "- ge"),
    Paradigm("sag:sagte", "e st t en te ten", "- ge"),
    Paradigm("schreib:schrieb schrieb", "e st t en", "- ge"),
    Paradigm("behaupt:behauptete", "e est et en eten"),
    Paradigm("kein dein", "e en em er es"),
    Paradigm("tu:tuer bless:blesser frapp:frapper déclar:déclaré", _ER),
    Paradigm("détrui:détruire", "s t te ts tes sons sez sent sant sait sit"),
    Paradigm("di:dit", "s sons sent sait sant"),
    Paradigm("prétend", "s ons ez ent ait aient u re"),
    Paradigm("écri:écrit", "s re te ts vons vent vait"),
    Paradigm("mat:matar golpe:golpear", _AR),
    Paradigm("her:herir", "ido í imos iste irá iré"),
    Paradigm("hier:herir", "o es e en"),
    Paradigm("hir:herir", "ió ieron iendo"),
    Paradigm("destru:destruir", "ido iste irá iré irán"),
    Paradigm("destruy:destruir", "o es e en ó eron endo"),
    Paradigm("dij:dijo", "eron e iste"),
    Paradigm("dic:dijo", "e en es iendo"),
    Paradigm("escrib:escribió", "e en es ía ir iendo ieron"),
)

_Trie = dict[str, "_Trie | str"]


def _trie(words: dict[str, str]) -> _Trie:
    """Words as nested letters; at a word's end the empty key has what it stands for."""
    root: _Trie = {}
    for word, stands_for in words.items():
        node = root
        for letter in "" if word == "-" else word:
            node = node.setdefault(letter, {})
        node[""] = stands_for
    return root


class Inflections:
    """A deterministic transducer over letters: ``arcs[state][letter]`` is the next state, ``lemma[state]`` what it writes.

    A paradigm is three machines in sequence. The states of all are joined by the subset construction, so a word is
    read once, whatever the number of paradigms. Of several lemmas the first paradigm's holds.
    """

    def __init__(self, paradigms: tuple[Paradigm, ...] = PARADIGMS):
        parts = [(_trie(dict.fromkeys(p.beginnings.split(), "")), _trie(p.lemmas()), _trie(dict.fromkeys(p.endings.split(), ""))) for p in paradigms]

        def closed(items: list) -> list:
            """With the starts of the next machine where one may end."""
            for which, part, node, lemma in items:  # grows while it is read
                if part < 2 and "" in node:
                    items.append((which, part + 1, parts[which][part + 1], node[""] if part else lemma))
            return items

        start = closed([(i, 0, p[0], "") for i, p in enumerate(parts)])
        self.arcs: list[dict[str, int]] = [{}]
        self.lemma: list[str | None] = [None]
        numbers, todo = {}, [(0, start)]
        while todo:
            state, items = todo.pop()
            for letter in {x for _, _, node, _ in items for x in node if x}:
                reached = closed([(i, part, node[letter], lemma) for i, part, node, lemma in items if letter in node])
                name = tuple((i, part, id(node), lemma) for i, part, node, lemma in reached)
                if name not in numbers:
                    numbers[name] = len(self.arcs)
                    self.arcs.append({})
                    ends = [(i, lemma) for i, part, node, lemma in reached if part == 2 and "" in node]
                    self.lemma.append(min(ends)[1] if ends else None)
                    todo.append((numbers[name], reached))
                self.arcs[state][letter] = numbers[name]

    def __call__(self, word: str) -> str | None:
        """The lemma of an inflected form; None for other words, base forms among them unless a paradigm has them."""
        state = 0
        for letter in word:
            state = self.arcs[state].get(letter)
            if state is None:
                return None
        return self.lemma[state]


@cache
def inflections() -> Inflections:
    """The transducer of PARADIGMS, built once for each process."""
    return Inflections()
