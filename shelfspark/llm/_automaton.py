"""A generalised suffix automaton over word hashes, and its use on a token stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_BITS = 22


def pair_code(h: np.ndarray) -> np.ndarray:
    """A code of ``_BITS`` bits for each pair of neighbouring words."""
    with np.errstate(over="ignore"):
        return ((h[:-1] * _PAIR + (h[1:] ^ (h[1:] >> np.uint64(29)))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)


class SuffixAutomaton:
    """All substrings of several word sequences.

    ``shortest[s]`` is the length of the shortest sequence that holds state
    ``s``'s substrings; ``places[s]`` (if asked for) lists their occurrences as
    (sequence, end).  The table of word pairs lets ``matches`` skip along a
    stream: after a pair that occurs in no sequence, the longest match is at
    most one word, so the automaton stands where it would after its suffix
    links, and only runs of known pairs have to be walked.
    """

    def __init__(self, sequences: Sequence[np.ndarray], places: bool = False):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.shortest = [-1], [0], [1 << 60]
        self.places: list[list[tuple[int, int]]] = [[]]
        self.sizes = [len(s) for s in sequences]
        self.pairs = np.zeros(1 << _BITS, bool)
        for k, words in enumerate(sequences):
            if len(words) > 1:
                self.pairs[pair_code(words)] = True
            last = 0
            for end, w in enumerate(words.tolist(), 1):
                last = self._extend(last, w)
                self.shortest[last] = min(self.shortest[last], len(words))
                if places:
                    self.places[last].append((k, end))
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            to = self.link[s]
            self.shortest[to] = min(self.shortest[to], self.shortest[s])
            if places and to:
                self.places[to] = sorted({*self.places[to], *self.places[s]})

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        self.shortest.append(1 << 60)
        self.places.append([])
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def statistics(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """After each word, the length of the longest match that ends there, and its state."""
        state, n = 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            to = self.next[state].get(w)
            if to is None:
                state, n = 0, 0
            else:
                state, n = to, n + 1
            yield n, state

    def walks(self, h: np.ndarray, cut: np.ndarray, least: int) -> Iterator[tuple[int, int, Iterator[tuple[int, int]]]]:
        """(text, first, statistics) of each run of words in which alone matches of ``least`` (1 or more) can be."""
        if least < 1:
            raise ValueError("a match has a word at least")
        if not len(h) or len(h) < least:
            return
        known = np.zeros(len(h) + 1, bool)
        if least == 1:
            inside = np.zeros(len(h) + 2, bool)
            inside[1:-1] = np.isin(h, np.fromiter(self.next[0], np.uint64, len(self.next[0])))
            known[1:-1] = inside[1:-2] & inside[2:-1]
        else:
            known[1:-1] = self.pairs[pair_code(h)]
        known[cut] = False  # no pair spans two texts
        if least == 1:  # a run of words, each of which is known with the one before it
            firsts = np.flatnonzero(inside[1:-1] & ~known[:-1])
            ends = np.flatnonzero(inside[1:-1] & ~known[1:]) + 1
        else:
            edges = np.flatnonzero(known[1:] != known[:-1])
            firsts, ends = edges[::2], edges[1::2] + 1
        long = ends - firsts >= least
        for first, end in zip(firsts[long].tolist(), ends[long].tolist()):
            text = int(np.searchsorted(cut, first, "right")) - 1
            yield text, first - int(cut[text]), self.statistics(h[first:end].tolist())

    def matches(self, h: np.ndarray, cut: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
        """Matches of ``least`` (1 or more) words that can't be lengthened to the right, as (text, first, end, state)."""
        for text, at, found in self.walks(h, cut, least):
            before, state_before = 0, 0
            for at, (n, state) in enumerate(found, at):
                if n <= before >= least:
                    yield text, at - before, at, state_before
                before, state_before = n, state
            if before >= least:
                yield text, at + 1 - before, at + 1, state_before

    def covered(self, h: np.ndarray, cut: np.ndarray, length: int, coverage: float, floor: int) -> Iterator[tuple[int, int, int]]:
        """(text, first, end) of the longest match at each end that has ``length`` words, or ``floor`` and ``coverage`` of a sequence.

        A match too short for the sequences that hold it may end in a shorter
        one, on the suffix links, that is enough of a shorter sequence.
        """
        least = min(length, floor)
        for text, at, found in self.walks(h, cut, least):
            for end, (n, state) in enumerate(found, at + 1):
                while n >= least:
                    if n >= length or n >= coverage * self.shortest[state]:
                        yield text, end - n, end
                        break
                    state = self.link[state]
                    n = self.length[state]
