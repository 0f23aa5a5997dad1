"""Operator 5: a weighted lexicon, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from typing import NamedTuple
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm._text import fresh, map_pieces

#: Words (or, ending in "*", stems) with weights that stand without any labels.
LEXICON = {
    "idiot": 1.0, "idiots": 1.0, "moron": 1.0, "morons": 1.0, "stupid": 1.0, "pathetic": 1.0, "worthless": 1.0, "disgusting": 1.0,
    "scum": 1.0, "loser": 1.0, "losers": 1.0, "clown": 1.0, "trash": 1.0, "imbecile": 1.0, "dumbass": 1.5, "scumbag": 1.5, "retard": 2.0,
    "bastard": 1.5, "bitch": 2.0, "asshole": 2.0, "fuck*": 2.0, "shit": 1.5, "bullshit": 1.5, "cunt": 2.0, "whore": 2.0, "slut": 2.0,
}
#: Phrases whose words don't count.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "white trash art", "loser bracket", "shit happens")
#: Labelled documents a lexicon is learned from, at most: toxic ones, others.
TOXIC_ROWS, OTHER_ROWS = 2000, 4000
#: Weight of matches in a hundred words from which a text is toxic, if no labels tell.
THRESHOLD = 0.2
#: A learned entry: log-likelihood (in nats) against chance, share of its documents that aren't toxic (as if there were as many of those), letters and completions of a stem, documents.
EVIDENCE, IMPURE, STEM, COMPLETIONS, LEAST = 14.0, 0.05, 4, 3, 6

_FOLD = {ord(a): b for a, b in zip("0134578９９|", "oieastbgg1")} | {ord("9"): "g"}
_FOLD |= {ord(a): b for a, b in zip("аеорсухіѕјкмтнвԁԛѡ", "aeopcyxisjkmthbdqw")}
_FOLD |= {ord(a): b for a, b in zip("αοειкρτυνχβγ", "aoeikptuvxby")}
_FOLD |= {0xFF41 + k: chr(97 + k) for k in range(26)} | {0xFF10 + k: _FOLD.get(48 + k, str(k)) for k in range(10)}
_FOLD |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_FOLD |= {ord("|"): "i", ord("l"): "i", 0xFF4C: "i", 0x131: "i", ord("ł"): "i"}
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe00-\ufe0f]+")
#: Letters of scripts that set no blanks between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")
_INNER = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])")
_INNER_TO = {"@": "a", "$": "s", "!": "i"}


def fold(text: str) -> str:
    """Lower case; look-alikes of other scripts, full-width and mathematical letters, digits and signs inside words as the letters they stand for; l and 1 as i. Accents stay."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(_FOLD)
    if "@" in text or "$" in text or "!" in text:
        text = _INNER.sub(lambda m: _INNER_TO[m[0]], text)
    return text


def bare(folded: str) -> str:
    """A folded text without its accents."""
    return folded if folded.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", folded))


@dataclass
class Lexicon:
    """Entries with weights. Those of ``accented`` are matched in texts with their accents, as they were learned from, all others in bare ones."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    threshold: float = THRESHOLD
    accented: frozenset[str] = frozenset()

    def matcher(self) -> Matcher:
        return Matcher(self._automaton(self.weights.keys() - self.accented), self._automaton(self.weights.keys() & self.accented))

    def _automaton(self, entries: Iterable[str]) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        if not (entries := sorted(entries)):
            return a
        for p in self.exceptions:
            a.add_word(fold(p), (len(fold(p)), 0.0, False))
        for w in entries:
            weight, stem = self.weights[w], w.endswith("*")
            f = fold(w.rstrip("*"))
            if f:
                a.add_word(f, (len(f), max(weight, a.get(f, (0, 0.0, False))[1]), stem or a.get(f, (0, 0.0, False))[2]))
        if len(a):
            a.make_automaton()
        return a


class Matcher(NamedTuple):
    bare: ahocorasick.Automaton
    accented: ahocorasick.Automaton

    def hits(self, text: str) -> list[float]:
        folded = fold(text)
        return hits(self.bare, bare(folded)) + hits(self.accented, folded)


def hits(a: ahocorasick.Automaton, folded: str) -> list[float]:
    """Weights of the matches at word starts (whole words, or stems) outside exception phrases."""
    if not len(a):
        return []
    out, free = [], []
    for end, (n, weight, stem) in a.iter(folded):
        first = end - n + 1
        if first and folded[first - 1].isalnum():
            continue
        if not stem and end + 1 < len(folded) and folded[end + 1].isalnum():
            continue
        if weight:
            out.append((first, end, weight))
        else:
            free.append((first, end))
    return [w for f, e, w in out if not any(x <= f and e <= y for x, y in free)] if free else [w for _, _, w in out]


def word_count(text: str) -> int:
    """Words that blanks part; each letter of a script without blanks is one more, and twenty characters are a word at least, however they are joined."""
    words = len(text.split())
    if words and not text.isascii():
        words += sum(1 for _ in _UNSPACED.finditer(text))
    return max(words, len(text.strip()) // 20)


def score(m: Matcher, text: str) -> tuple[float, int, int]:
    """(weight of matches in a hundred words, matches, words)."""
    words = word_count(text)
    found = m.hits(text)
    return (100 * sum(found) / words if words else 0.0), len(found), words


_LETTERS = re.compile(r"[^\W_]+")


def _distinct(texts: list[list[str]]) -> list[list[str]]:
    """Without near copies, whose words would count as often as there are copies: texts whose run of four words of lowest checksum was seen."""
    seen, out = set(), []
    for w in texts:
        low = min((crc32(" ".join(w[k : k + 4]).encode()) for k in range(max(1, len(w) - 3))), default=0)
        if low not in seen:
            seen.add(low)
            out.append(w)
    return out


def learn(toxic: list[str], other: list[str], base: dict[str, float] | None = None, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """``base`` and the words and stems that labelled texts add, with a threshold that parts the two kinds of text best."""
    base_words = LEXICON if base is None else base
    weights = dict(base_words)
    bags = [{*w} for w in _distinct([_LETTERS.findall(fold(t)) for t in toxic])]
    words = Counter(w for b in bags for w in b)
    heads: Counter = Counter()
    completions: dict[str, set] = {}
    for b in bags:
        heads.update({w[:n] for w in b for n in range(STEM, len(w) + 1)})
    heads = Counter({p: n for p, n in heads.items() if n >= LEAST})
    for w in words:
        for n in range(STEM, len(w) + 1):
            if w[:n] in heads:
                completions.setdefault(w[:n], set()).add(w)
    rest, rest_words = Counter(), Counter()
    for t in other:
        b = {*_LETTERS.findall(fold(t))}
        rest.update({w[:n] for w in b for n in range(STEM, len(w) + 1)} & heads.keys())
        rest_words.update(b & words.keys())
    ratio = len(bags) / max(1, len(other))
    chance = len(bags) / max(1, len(bags) + len(other))

    def weight(yes: int, no: int) -> float | None:
        n, q = yes + no, yes / (yes + no) if yes else 0.0
        if yes < LEAST or q <= chance or no * ratio > IMPURE * yes:
            return None
        rest = (1 - q) * math.log((1 - q) / (1 - chance)) if q < 1 else 0.0
        if n * (q * math.log(q / max(chance, 1e-9)) + rest) < EVIDENCE and other:
            return None
        return round(min(3.0, max(0.5, math.log((yes + 0.5) / (no * ratio + 0.5)) / 3)), 3)

    taken: set[str] = set()
    for p in sorted(heads, key=lambda p: (len(p), p)):
        if any(p[:n] in taken for n in range(STEM, len(p))):
            continue
        if len(completions[p]) >= COMPLETIONS and (w := weight(heads[p], rest[p])):
            taken.add(p)
            weights[p + "*"] = w
    for v in sorted(words):
        if len(v) > 2 and not any(v[:n] in taken for n in range(STEM, len(v) + 1)) and (w := weight(words[v], rest_words[v])):
            weights[v] = max(w, weights.get(v, 0.0))
    found = Lexicon(weights, exceptions, accented=frozenset(weights.keys() - base_words.keys()))
    a = found.matcher()
    yes = [score(a, t)[0] for t in toxic]
    no = [score(a, t)[0] for t in other]
    cuts = sorted({s for s in yes if s > 0})
    if cuts and no:
        y, n = np.sort(yes), np.sort(no)
        right = len(y) - np.searchsorted(y, cuts)
        wrong = (len(n) - np.searchsorted(n, cuts)) * len(y) / len(n)
        best = int(np.argmax(2 * right / (right + wrong + len(y))))
        below = max([s for s in (*yes, *no) if s < cuts[best]], default=0.0)
        found.threshold = (cuts[best] + below) / 2
    return found


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic") -> Lexicon:
    """A lexicon learned from at most ``TOXIC_ROWS`` toxic and ``OTHER_ROWS`` other labelled documents.

    Those whose id hashes lowest are taken; ids labelled both ways are not
    used, nor are null labels and null or empty texts. No labels: the lexicon
    that is built in. Only the sample's texts come to the driver.
    """
    kind = labels.filter(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(F.col(toxic).cast("int")).alias("low"), F.max(F.col(toxic).cast("int")).alias("high")).filter("low = high")
    picked = [(r.id, v) for v, most in ((1, TOXIC_ROWS), (0, OTHER_ROWS)) for r in kind.filter(F.col("low") == v).orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    if not any(v for _, v in picked):
        return Lexicon(dict(LEXICON))
    wanted = docs.sparkSession.createDataFrame(picked, T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("kind", T.IntegerType())]))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("length(trim(text)) > 0").join(F.broadcast(wanted), "id").collect()
    rows.sort(key=lambda r: (r.id, r.text))
    return learn([r.text for r in rows if r.kind], [r.text for r in rows if not r.kind])


def toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but the text if None) with ``words``, ``hits``, ``toxicity`` and ``toxic``.

    ``toxicity`` is the matches' summed weight in a hundred words, as
    ``word_count`` counts them; a text is toxic from the lexicon's threshold on
    (ties: toxic). Null texts have null in all four but ``toxic``, false; empty
    ones score 0. Texts of any length are matched whole. Rows are independent,
    repeated ones score alike. An empty table gives no rows. Names in use are
    underscored. One pass, nothing is shuffled; the lexicon, bounded
    by the sample it is learned from, is broadcast.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = fresh(keep, "words", "hits", "toxicity", "toxic")
    kinds = [T.LongType(), T.LongType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, k) for n, k in zip(names, kinds))])
    built: list = []

    def run(part: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        if not built:
            built.append(held.value.matcher())
        scored = [(None, None, None) if t is None else score(built[0], t) for t in texts]
        least = held.value.threshold
        new = [
            pa.array([s[2] for s in scored], pa.int64()),
            pa.array([s[1] for s in scored], pa.int64()),
            pa.array([s[0] for s in scored], pa.float64()),
            pa.array([bool(s[0]) and s[0] >= least for s in scored], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), *new], names=[*keep, *names])

    return map_pieces(docs.select(*dict.fromkeys([*keep, text])), text, run, schema)
