"""Operator 6: hierarchical language identification with linear support vector machines."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm._text import fresh, map_pieces

#: Families of languages; one that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indic": "hi bn ur mr ne gu pa".split(),
    "semitic": "ar he mt am".split(),
}
FAMILY_OF = {x: f for f, own in FAMILIES.items() for x in own}
#: Labelled rows a language that a model is fitted on, at most.
ROWS = 250
#: Rows of all languages that a model is fitted on, at most: they are held as rows of features on the driver.
TOTAL = 5000
#: A text is rejected if less than this share of its character trigrams occurs in the sample of its language.
KNOWN = 0.5
UNKNOWN = "und"
BUCKETS = 1 << 15
_CLASS = np.full(256, 32, np.uint8)
_CLASS[[*range(97, 123)]] = range(97, 123)
_CLASS[128:] = range(128, 256)


def _trigrams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams (not of blanks alone) and their number by text."""
    joined = "\x00".join("" if t is None else t for t in texts)
    if joined.count("\x00") != max(0, len(texts) - 1):
        joined = "\x00".join(("" if t is None else t).replace("\x00", " ") for t in texts)
    raw = np.frombuffer(b"  " + joined.lower().encode("utf-8", "surrogatepass") + b"  ", np.uint8)
    b = _CLASS[raw].astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    keep = code != 0x202020
    keep &= (b[1:-1] != 32) | (b[:-2] != 32)  # not two blanks before the last character
    cut = np.concatenate(([0], np.flatnonzero(raw[2:-2] == 0) + 1, [len(code)]))
    counts = np.add.reduceat(np.append(keep, False).astype(np.int64), cut[:-1]) if len(texts) else np.zeros(0, np.int64)
    counts = np.where(np.diff(cut) > 0, counts, 0)
    return ((code[keep] * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64), counts


def _sums(weights: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each text's sum of rows of ``weights``."""
    out = np.zeros((len(counts), weights.shape[1]), np.float64)
    at = np.concatenate(([0], np.cumsum(counts)))
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(weights[buckets], at[:-1][some], axis=0, dtype=np.float32)
    return out


def _features(texts: list) -> np.ndarray:
    """Each text's shares of the buckets, a text at a time so that only the result is held."""
    x = np.zeros((len(texts), BUCKETS), np.float32)
    for k, t in enumerate(texts):
        buckets, counts = _trigrams([t])
        x[k] = np.bincount(buckets, minlength=BUCKETS) / max(1, int(counts[0]))
    return x


def _svm(gram: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 40) -> np.ndarray:
    """Dual coefficients (times y) of a linear SVM with hinge loss, by coordinate descent."""
    a, f = np.zeros(len(y)), np.zeros(len(y))
    rng, q = np.random.default_rng(7), np.maximum(np.diag(gram), 1e-9)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            new = min(cost, max(0.0, a[i] + (1 - y[i] * f[i]) / q[i]))
            if new != a[i]:
                f += (new - a[i]) * y[i] * gram[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-4:
            break
    return a * y


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    #: Columns: a machine a family (one against the rest), a machine a pair of a family's languages, a share of known trigrams a language.
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: list[tuple[int, int]] = field(default_factory=list)

    def predict(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1 if there is none), its margin, its share of known trigrams."""
        buckets, counts = _trigrams(texts)
        n, nf, nl = len(texts), len(self.families), len(self.languages)
        best, margin, known = np.full(n, -1), np.zeros(n), np.zeros(n)
        if not nl:
            return best, margin, known
        s = _sums(self.weights, buckets, counts) / np.maximum(1, counts)[:, None] + self.bias
        fam = s[:, :nf].argmax(1)
        of = np.array([self.families.index(FAMILY_OF.get(x, x)) for x in self.languages])
        votes = np.where(of == fam[:, None], 0.0, -np.inf)
        sure = np.zeros((n, nl))
        for k, (a, b) in enumerate(self.pairs):
            v = s[:, nf + k]
            votes[:, a] += v > 0
            votes[:, b] += v <= 0
            sure[:, a] += v
            sure[:, b] -= v
        best = (votes + np.tanh(sure) * 1e-3).argmax(1)
        rows = np.arange(n)
        margin = np.where(np.isin(best, [x for p in self.pairs for x in p]), sure[rows, best], s[rows, fam])
        known = s[rows, nf + len(self.pairs) + best]
        return np.where(counts > 0, best, -1), np.where(counts > 0, margin, 0.0), np.where(counts > 0, known, 0.0)


def train(texts: list, labels: list[str]) -> Model:
    """A model from labelled texts; languages of one family are told apart pairwise, families one against the rest."""
    languages = sorted({x for x in labels if x})
    if not languages:
        return Model()
    families = sorted({FAMILY_OF.get(x, x) for x in languages})
    x = _features(texts)
    y = np.array(labels)
    scale = (1 / np.sqrt(x.mean(0) + 1e-6)).astype(np.float32)
    x *= scale
    gram = x @ x.T + 1.0  # the bias is one more feature
    columns, bias, pairs = [], [], []

    def fit(rows: np.ndarray, sign: np.ndarray) -> None:
        c = _svm(gram[np.ix_(rows, rows)].astype(np.float64), sign)
        full = np.zeros(len(y), np.float32)
        full[rows] = c
        columns.append((full @ x) * scale)
        bias.append(c.sum())

    everything = np.arange(len(y))
    fam = np.array([FAMILY_OF.get(v, v) for v in y])
    for f in families:
        if len(families) == 1:
            columns.append(np.zeros(BUCKETS))
            bias.append(1.0)
        else:
            fit(everything, np.where(fam == f, 1.0, -1.0))
    for a, b in combinations(range(len(languages)), 2):
        if FAMILY_OF.get(languages[a], languages[a]) == FAMILY_OF.get(languages[b], languages[b]):
            rows = np.flatnonzero((y == languages[a]) | (y == languages[b]))
            pairs.append((a, b))
            fit(rows, np.where(y[rows] == languages[a], 1.0, -1.0))
    for v in languages:
        columns.append((x[y == v] > 0).any(0).astype(float))
        bias.append(0.0)
    return Model(languages, families, np.array(columns, np.float32).T.copy(), np.array(bias), pairs)


def fit(docs: DataFrame, text: str = "text", label: str = "lang", rows: int = ROWS) -> Model:
    """A model from at most ``rows`` rows a language, those whose text hashes lowest; fewer (``TOTAL`` in all) where there are many languages.

    Null or empty labels and texts are not used. The texts' hashes pick the
    rows, so a repeated row changes nothing and the sample is the same however
    the table is partitioned; only ``rows`` texts a language come to the driver.
    """
    h, v = fresh(docs, "text_hash", "rank")
    labelled = docs.filter((F.length(F.trim(label)) > 0) & (F.length(F.trim(text)) > 0) & (F.col(label) != UNKNOWN)).select(F.col(label).alias("lang"), F.xxhash64(text).alias(h))
    # each task keeps its lowest hashes of a language, so that few rows are shuffled; repeated texts share a rank
    w = Window.partitionBy("lang").orderBy(h)
    low = labelled.withColumn(v, F.dense_rank().over(w)).filter(F.col(v) <= rows).select("lang", h).distinct()
    by: dict[str, list[int]] = {}
    for r in low.collect():
        by.setdefault(r["lang"], []).append(r[h])
    most = max(1, min(rows, TOTAL // max(1, len(by))))
    picked = [(lang, x) for lang, own in by.items() for x in sorted(own)[:most]]
    if not picked:
        return Model()
    wanted = docs.sparkSession.createDataFrame(picked, T.StructType([T.StructField("lang", T.StringType()), T.StructField(h, T.LongType())]))
    rows_ = docs.select(F.col(label).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias(h)).join(F.broadcast(wanted), ["lang", h]).select("lang", h, "text").dropDuplicates(["lang", h]).collect()
    rows_.sort(key=lambda r: (r["lang"], r[h]))
    return train([r["text"] for r in rows_], [r["lang"] for r in rows_])


def identify(docs: DataFrame, text: str = "text", label: str = "lang", rows: int = ROWS, known: float = KNOWN, model: Model | None = None) -> DataFrame:
    """``docs`` with ``predicted``, ``family``, ``margin``, ``known_share`` and ``rejected``.

    The family is that of the strongest of the families' machines; within it,
    each pair of languages has a machine, and most votes win (ties: the greater
    summed margin). A text is rejected, its language being "und", if it is null,
    has no letters, or has under ``known`` of its character trigrams among those
    of its language's sample; so is every text if no row is labelled, or there
    is no column ``label``. Texts of any length are used whole. Names in use are
    underscored; repeated rows are each answered alike. An empty table gives no
    rows.
    """
    if model is None:
        model = fit(docs, text, label, rows) if label in docs.columns else Model()
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = fresh(docs, "predicted", "family", "margin", "known_share", "rejected")
    kinds = [T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema, *(T.StructField(n, k) for n, k in zip(names, kinds))])

    def run(part: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        m = held.value
        best, margin, share = m.predict(texts)
        bad = (best < 0) | (share < known)
        found = [UNKNOWN if r else m.languages[k] for k, r in zip(best.tolist(), bad.tolist())]
        family = [None if r else FAMILY_OF.get(x, x) for x, r in zip(found, bad.tolist())]
        new = [pa.array(found, pa.string()), pa.array(family, pa.string()), pa.array(margin), pa.array(share), pa.array(bad)]
        return pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    return map_pieces(docs, text, run, schema)
