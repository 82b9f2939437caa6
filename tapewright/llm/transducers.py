"""Finite-state transducers over the symbols of a clause, as tables of arcs, and their composition.

Each transducer reads one symbol at a time and marks matches (insults and threats): as negated, as reported speech, as
aimed at a target. Composed they are one deterministic machine that reads a clause once.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator
from dataclasses import dataclass
from functools import cache

#: Kinds of symbols. WORD is any word that is none of the others, STOP the end of a clause.
WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = range(7)
KINDS = 7
#: Marks of a match; a symbol on a tape is (kind, marks).
NEGATED, REPORTED, AIMED = 1, 2, 4
MARKS = 8
#: Words over which a negation and a target reach.
REACH = 3

Symbol = tuple[int, int]


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol read) -> (next state, symbols written). All states accept at the end of a clause."""

    start: Hashable
    arcs: dict[tuple[Hashable, Symbol], tuple[Hashable, tuple[Symbol, ...]]]


def is_match(symbol: Symbol) -> bool:
    return symbol[0] in (INSULT, THREAT)


def alphabet(marks: int) -> list[Symbol]:
    """The symbols whose matches carry some of ``marks``."""
    return [(k, m) for k in range(KINDS) for m in range(MARKS) if not m or (k in (INSULT, THREAT) and m & marks == m)]


def negation(reach: int = REACH) -> Transducer:
    """Marks matches up to ``reach`` words behind a negation; the state is how many words it still reaches."""
    arcs = {}
    for left in range(reach + 1):
        for symbol in alphabet(0):
            kind, _ = symbol
            out = (kind, NEGATED) if is_match(symbol) and left else symbol
            arcs[left, symbol] = (reach if kind == NEGATION else 0 if kind == STOP else max(0, left - 1), (out,))
    return Transducer(0, arcs)


def reported_speech() -> Transducer:
    """Marks matches behind a verb of reporting up to the clause's end."""
    arcs = {}
    for reported in (False, True):
        for kind, marks in alphabet(NEGATED):
            out = (kind, marks | REPORTED * (reported and is_match((kind, marks))))
            arcs[reported, (kind, marks)] = ((reported or kind == REPORT) and kind != STOP, (out,))
    return Transducer(False, arcs)


def target(reach: int = REACH) -> Transducer:
    """Writes matches only, marked if a target is within ``reach`` words on either side in the clause.

    The state is how far the last target still reaches and which matches wait, for how many words, for one to follow;
    so a match is written as soon as that is known, in the order of reading.
    """
    arcs: dict = {}
    todo: list[tuple[int, tuple[tuple[Symbol, int], ...]]] = [(0, ())]
    seen = set(todo)
    while todo:
        state = todo.pop()
        left, waiting = state
        for symbol in alphabet(NEGATED | REPORTED):
            kind, marks = symbol
            due = [(s, n - 1) for s, n in waiting]
            if kind == STOP:
                to, out = (0, ()), [s for s, _ in waiting]
            elif kind == TARGET:
                to, out = (reach, ()), [(k, m | AIMED) for (k, m), _ in due]
            else:
                out = [s for s, n in due if not n]
                rest = tuple((s, n) for s, n in due if n)
                if is_match(symbol) and left:
                    out.append((kind, marks | AIMED))
                elif is_match(symbol):
                    rest += ((symbol, reach),)
                to = (max(0, left - 1), rest)
            arcs[state, symbol] = (to, tuple(out))
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return Transducer((0, ()), arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``second`` makes of what ``first`` writes, over the pairs of states that can be reached."""
    read: dict[Hashable, list] = {}
    for (state, symbol), arc in first.arcs.items():
        read.setdefault(state, []).append((symbol, arc))
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol, (a, between) in read[state[0]]:
            b, out = state[1], ()
            for s in between:
                b, more = second.arcs[b, s]
                out += more
            arcs[state, symbol] = ((a, b), out)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Transducer(start, arcs)


class Machine:
    """A composed transducer with numbered states: ``step[state][kind]`` and ``skip[words][state]``, each (state, matches).

    ``skip`` takes several WORDs at once, REACH + 1 of them standing for any larger number.
    """

    def __init__(self, whole: Transducer, reach: int = REACH):
        states = {whole.start: 0}
        for state, _ in whole.arcs:
            states.setdefault(state, len(states))
        self.step: list[list[tuple[int, tuple[Symbol, ...]]]] = [[(0, ())] * KINDS for _ in states]
        for (state, (kind, _)), (to, out) in whole.arcs.items():
            self.step[states[state]][kind] = (states[to], out)
        self.skip = [[(s, ()) for s in range(len(states))]]
        for _ in range(reach + 1):
            self.skip.append([(self.step[s][WORD][0], out + self.step[s][WORD][1]) for s, out in self.skip[-1]])

    def matches(self, kinds: list[int]) -> Iterator[Symbol]:
        """The marked matches of a clause, in order."""
        state = 0
        for kind in [*kinds, STOP]:
            state, out = self.step[state][kind]
            yield from out


@cache
def grammar() -> Machine:
    """Negation, reported speech and target, composed once for each process."""
    return Machine(compose(compose(negation(), reported_speech()), target()))
