"""Operator 10: licence scans by matching statistics against a suffix automaton of licence texts."""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfspark.llm._automaton import SuffixAutomaton
from shelfspark.llm._text import Tokens, map_pieces

#: Words of a match that counts, words that may lie between two matches of a chain, share of a passage that must be covered.
LEAST, GAP, COVERED = 3, 8, 0.8
#: Words from which a passage is a long one, whose matches count from LEAST_LONG words on.
LONG, LEAST_LONG = 25, 6
#: Words of a paragraph of a licence text that is a passage.
PARAGRAPH = 12
#: The licences whose texts lie in licenses/, public texts as their authors publish them; notices.txt holds notices by licence.
FULL = (
    "Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0",
    "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib",
)


def templates() -> list[tuple[str, str]]:
    """(licence, passage): the notices, and each paragraph of ``PARAGRAPH`` words of the full texts. A passage of several licences is named after all."""
    read = lambda name: (pkgutil.get_data(__package__, f"licenses/{name}.txt") or b"").decode()
    found = [tuple(x.split("\t")) for x in read("notices").splitlines()]
    found += [(name, own) for name in FULL for own in re.split(r"\n\s*\n", read(name)) if len(Tokens([own]).h) >= PARAGRAPH]
    by: dict[bytes, tuple[dict[str, None], str]] = {}
    for name, own in found:
        by.setdefault(Tokens([own]).h.tobytes(), ({}, own))[0][name] = None
    return [("/".join(sorted(names)), own) for names, own in by.values()]




class Scanner:
    """Automata of the short and of the long passages."""

    def __init__(self, passages: Iterable[tuple[str, str]], least: int = LEAST, least_long: int = LEAST_LONG):
        own = [(name, h) for name, text in passages if len(h := Tokens([text]).h)]
        self.names, self.words = [n for n, _ in own], [len(h) for _, h in own]
        parts = [([k for k, n in enumerate(self.words) if (n >= LONG) == long], least_long if long else least) for long in (False, True)]
        self.parts = [(which, SuffixAutomaton([own[k][1] for k in which], places=True), n) for which, n in parts if which]

    def scan(self, tokens: Tokens, gap: int = GAP, covered: float = COVERED) -> dict[int, list[tuple[int, int, int, int]]]:
        """By text, spans (first, end, passage, words covered) that don't overlap, best first taken."""
        chains: dict[int, dict[int, list[list[int]]]] = {}
        for which, automaton, least in self.parts:
            by: dict[int, list[tuple[int, int, int]]] = {}
            for text, first, end, state in automaton.matches(tokens.h, tokens.cut, least):
                by.setdefault(text, []).append((first, end, state))
            for text, found in by.items():
                chains.setdefault(text, {}).update((which[k], own) for k, own in _chains(found, automaton, gap).items())
        return {t: spans for t, own in chains.items() if (spans := self._spans(own, covered))}

    def _spans(self, chains: dict[int, list[list[int]]], covered: float) -> list[tuple[int, int, int, int]]:
        # a longer passage first, then the better covered one
        good = sorted((-c[3], -c[3] / self.words[k], c[0], c[1], k) for k, own in chains.items() for c in own if c[3] >= covered * self.words[k])
        taken: list[tuple[int, int, int, int]] = []  # in order, as they don't overlap
        for n, _, first, end, k in good:
            at = bisect_left(taken, (end,))
            if not at or taken[at - 1][1] <= first:
                taken.insert(at, (first, end, k, -n))
        return taken


def _chains(found: list[tuple[int, int, int]], automaton: SuffixAutomaton, gap: int) -> dict[int, list[list[int]]]:
    """By passage, chains [first, end, place's end, covered] of matches, in order of their ends."""
    chains: dict[int, list[list[int]]] = {}
    for first, end, state in sorted(found):
        for k, place in automaton.places[state]:
            begin = place - (end - first)
            own = chains.setdefault(k, [])
            best = None
            for c in reversed(own):
                if first - c[1] > gap:
                    break
                over = max(0, c[1] - first, c[2] - begin)
                if c[0] < first and c[2] <= begin + over and place > c[2] and begin - c[2] <= gap and (best is None or c[3] > best[3]):
                    best = c
            if best is not None:
                over = max(0, best[1] - first, best[2] - begin)
                new = [best[0], end, place, best[3] + max(0, end - first - over)]
            else:
                new = [first, end, place, end - first]
            at = len(own)
            while at and own[at - 1][1] > end:
                at -= 1
            own.insert(at, new)
    return chains


def scan_licenses(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", passages: Iterable[tuple[str, str]] | None = None, least: int = LEAST, gap: int = GAP, covered: float = COVERED, least_long: int = LEAST_LONG
) -> DataFrame:
    """(doc_id, license, first_word, end_word, covered_words, coverage) of each span that a licence passage (of ``templates`` if None) covers.

    Matches of ``least`` words (2 or more; ``least_long`` in passages of
    ``LONG`` words) are chained in order, at most ``gap`` words apart in text
    and passage; a chain that covers the share ``covered`` of a passage is a
    span. Of overlapping spans the one with most covered words stays (ties: the
    better covered, then the earlier, then the passage named first). Null and
    empty texts have none; very long ones are scanned whole; a null doc_id
    stays null; repeated rows each give their spans. Other columns aren't read,
    whatever their names. No passages or an empty table: no spans. One pass,
    nothing is shuffled; the passages are a parameter of fixed size.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(templates() if passages is None else passages, least, least_long))
    names = ["doc_id", "license", "first_word", "end_word", "covered_words", "coverage"]
    kinds = [docs.schema[doc_id].dataType, T.StringType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType()]

    def run(part: pa.RecordBatch, texts: list) -> pa.RecordBatch | None:
        s = scanner.value
        found = s.scan(Tokens(texts), gap, covered)
        rows = [(t, s.names[k], a, b, n, n / s.words[k]) for t in sorted(found) for a, b, k, n in found[t]]
        if not rows:
            return None
        t, *rest = zip(*rows)
        ids = part.column(part.schema.get_field_index(doc_id)).take(pa.array(t))
        columns = [pa.array(c, k) for c, k in zip(rest, [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()])]
        return pa.RecordBatch.from_arrays([ids, *columns], names=names)

    return map_pieces(docs.select(doc_id, text), text, run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
