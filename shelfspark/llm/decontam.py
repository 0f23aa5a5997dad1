"""Operator 7: benchmark decontamination with a generalised suffix automaton."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm._automaton import SuffixAutomaton
from shelfspark.llm._text import WORD, Tokens, fresh, map_pieces, replace

#: Words of an automaton; larger benchmarks have several, all of them broadcast.
MOST_WORDS = 5_000_000
LENGTH, COVERAGE, FLOOR, SHARE = 8, 0.8, 5, 0.8


def automata_of(benchmark: DataFrame, text: str = "text", most_words: int = MOST_WORDS) -> list[SuffixAutomaton]:
    """Automata of the items' words, each of about ``most_words`` words at most; any item is whole in one."""
    items = sorted({r[0] for r in benchmark.select(text).distinct().toLocalIterator() if r[0]})
    parts: list[list[np.ndarray]] = [[]]
    size = 0
    for t in items:
        h = Tokens([t]).h
        if len(h):
            if parts[-1] and size + len(h) > most_words:
                parts.append([])
                size = 0
            parts[-1].append(h)
            size += len(h)
    return [SuffixAutomaton(p) for p in parts]


def spans(automata: list[SuffixAutomaton], tokens: Tokens, length: int, coverage: float, floor: int) -> dict[int, list[list[int]]]:
    """By text, the merged word spans to remove."""
    found: dict[int, list[tuple[int, int]]] = {}
    for a in automata:
        for text, first, end in a.covered(tokens.h, tokens.cut, length, coverage, floor):
            found.setdefault(text, []).append((first, end))
    out: dict[int, list[list[int]]] = {}
    for text, own in found.items():
        merged = out.setdefault(text, [])
        for first, end in sorted(own):
            if merged and first <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([first, end])
    return out


def without(text: str, cuts: list[list[int]]) -> str:
    """``text`` without the words of ``cuts`` and what stands between them."""
    at = [m.span() for m in WORD.finditer(text)]
    kept, k = [], 0
    for first, end in cuts:
        kept.append(text[k : at[first][0]])
        k = at[end - 1][1]
    return "".join([*kept, text[k:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", length: int = LENGTH, coverage: float = COVERAGE, floor: int = FLOOR, share: float = SHARE, flags: bool = False
) -> DataFrame:
    """``docs`` without passages of ``benchmark``.

    Every match between a text's words and an item's is found. A match
    of ``length`` words goes, and so does one of ``floor`` words (1 or more)
    that is at least ``coverage`` of the shortest item holding it; overlapping
    matches go as one span, so that ties don't arise. A document that would
    lose ``share`` of its words (or more) goes whole.

    Null and empty texts have no words: they stay as they are. Texts of any
    length are read whole. An empty table gives no rows. Empty benchmark:
    nothing goes. Items that are null, empty, or repeated count once or not at
    all. Repeated documents are each handled. All columns are kept, also ones
    of other names; ``n_chars``, if there, follows the text. With ``flags`` no
    row goes, but columns ``matched_words``, ``longest_match``, ``words``,
    ``contaminated`` and ``dropped`` are added (underscored if taken), and a
    dropped document's text is null.

    One pass over docs, nothing is shuffled; the benchmark's automata, of
    ``MOST_WORDS`` words each, are broadcast.
    """
    a = docs.sparkSession.sparkContext.broadcast(automata_of(benchmark, item_text))
    added = fresh(docs, "matched_words", "longest_match", "words", "contaminated", "dropped")
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.BooleanType(), T.BooleanType()]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField(n, k) for n, k in zip(added, kinds)] * flags)

    def clean(part: pa.RecordBatch, texts: list) -> pa.RecordBatch | None:
        tokens = Tokens(texts)
        found = spans(a.value, tokens, length, coverage, floor)
        sizes = tokens.lengths()
        gone = np.zeros(len(texts), bool)
        lost, longest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        new = list(texts)
        for k, cuts in found.items():
            each = [e - f for f, e in cuts]
            lost[k], longest[k] = sum(each), max(each)
            gone[k] = lost[k] >= share * sizes[k]
            new[k] = None if gone[k] else without(texts[k], cuts)
        if found:
            changed = {text: new}
            if "n_chars" in part.schema.names:
                old = part.column(part.schema.get_field_index("n_chars")).to_pylist()
                changed["n_chars"] = [(len(new[k]) if new[k] is not None else 0) if k in found else old[k] for k in range(len(new))]
            part = replace(part, changed)
        if flags:
            extra = [lost, longest, sizes, lost > 0, gone]
            return pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, extra)], names=[*part.schema.names, *added])
        return part.filter(pa.array(~gone)) if gone.any() else part

    return map_pieces(docs, text, clean, schema)
