"""Finite automata over text whose runs compose, so that a text can be scanned in chunks, in any order.

A chunk's effect is a function: for each state in which the scan may enter, the state in which it leaves
and the number of units that begin inside. Functions compose associatively. A ``FunctionTree`` holds
the compositions of neighbouring functions level by level; its root is the effect of the whole, and a
walk down from the root finds the place of any unit. The same tree serves the symbols of a chunk and
the chunks of a text.
"""

from __future__ import annotations

import functools

import numpy as np

Levels = list[tuple[np.ndarray, np.ndarray]]


class FunctionTree:
    """Compositions of functions (ends, counts), each an array of functions by states."""

    def __init__(self, ends: np.ndarray, counts: np.ndarray):
        self.states = ends.shape[1]
        self.levels: Levels = [(ends, counts)]
        while len(ends) > 1:
            paired = len(ends) // 2 * 2
            first, then = ends[0:paired:2], ends[1:paired:2]
            up = np.take_along_axis(then, first, 1), counts[0:paired:2] + np.take_along_axis(counts[1:paired:2], first, 1)
            if paired < len(ends):  # the last function has no neighbour and goes up as it is
                up = np.concatenate((up[0], ends[-1:])), np.concatenate((up[1], counts[-1:]))
            ends, counts = up
            self.levels.append(up)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """(ends, counts) of the whole sequence, by entry state; an empty one changes nothing."""
        ends, counts = self.levels[-1]
        if not len(ends):
            return np.arange(self.states), np.zeros(self.states, dtype=np.int64)
        return ends[0], counts[0]

    def find(self, state: int, rank: int) -> tuple[int, int, int]:
        """(place, state on entry, rank inside) of the function in which the ``rank``-th unit (from 1)
        begins, for a scan that enters in ``state``."""
        at = 0
        for ends, counts in self.levels[-2::-1]:
            at *= 2
            if at + 1 < len(ends) and counts[at, state] < rank:
                rank -= int(counts[at, state])
                state = int(ends[at, state])
                at += 1
        return at, state, rank


class LineAutomaton:
    """Counts lines (units that end with a newline or with the text) and watches for ``marks``.

    A state is a pair: whether a line is open, and how much of a mark has just been read; once a mark
    has been read whole, that stays so. A unit begins with a character that is read while no line is open.
    """

    def __init__(self, marks: tuple[str, ...]):
        parts = sorted({m[:i] for m in marks for i in range(len(m))} | {""}, key=lambda p: (len(p), p))
        letters = sorted({c for m in marks for c in m} | {"\n"})
        self.seen = len(parts)
        width = len(parts) + 1
        self.start, self.states = 0, 2 * width

        def after(part: str, letter: str) -> int:
            read = part + letter
            if any(read.endswith(m) for m in marks):
                return self.seen
            return max((i for i, p in enumerate(parts) if read.endswith(p)), key=lambda i: len(parts[i]))

        # Class 0 is every other character: no mark goes on with it.
        self.step = np.zeros((len(letters) + 1, self.states), dtype=np.int64)
        self.classes = np.zeros(1 + max(map(ord, letters)) + 1, dtype=np.uint8)
        for c, letter in enumerate(["", *letters]):
            if c:
                self.classes[ord(letter)] = c
            for state in range(self.states):
                part = state % width
                got = self.seen if part == self.seen else after(parts[part], letter) if c else 0
                self.step[c, state] = (0 if letter == "\n" else width) + got
        self.begins = (np.arange(self.states) < width).astype(np.int64)
        self.width = width

    def found(self, state: int) -> bool:
        """Whether a scan that ended in ``state`` has read a mark."""
        return state % self.width == self.seen

    def tree(self, text: str) -> tuple[FunctionTree, np.ndarray]:
        """The tree over the text's symbols and their places. A run of characters of class 0 is one
        symbol: the second and all further ones change no state and begin no unit."""
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        kind = self.classes[np.minimum(codes, len(self.classes) - 1)]
        own = np.ones(len(kind), dtype=bool)
        own[1:] = (kind[1:] != 0) | (kind[:-1] != 0)
        places = np.flatnonzero(own)
        ends = self.step[kind[places]]
        return FunctionTree(ends, np.broadcast_to(self.begins, ends.shape)), places

    def summary(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.tree(text)[0].whole()


@functools.lru_cache(maxsize=8)
def line_automaton(marks: tuple[str, ...]) -> LineAutomaton:
    return LineAutomaton(marks)
