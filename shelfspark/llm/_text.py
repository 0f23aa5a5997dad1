"""Vectorised tokenising shared by the corpus operators.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII
characters that are not punctuation (``PUNCT``), after lower-casing.  Words are
handled as 64-bit hashes computed over whole batches with numpy; nothing here
loops over characters or words in Python.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Ranges of the non-ASCII punctuation, symbols and spaces, for a regular expression's set.
_RANGES = (
    (0x80, 0xa9), (0xab, 0xb4), (0xb6, 0xb9), (0xbb, 0xbf), (0xd7, 0xd7), (0xf7, 0xf7),
    (0x2000, 0x206f), (0x20a0, 0x20cf), (0x2190, 0x2bff), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030),
    (0xfe10, 0xfe6f), (0xff01, 0xff0f), (0xff1a, 0xff20), (0xff3b, 0xff40), (0xff5b, 0xff65), (0xfeff, 0xfeff),
)
PUNCT = "".join(f"{chr(a)}-{chr(b)}" for a, b in _RANGES)
_PUNCT = re.compile(f"[{PUNCT}]")
#: The words of a text that is not lower-cased: as many, in the same order.
WORD = re.compile(f"[^\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f{PUNCT}]+")

_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    step = base
    with np.errstate(over="ignore"):
        while done < n:
            take = min(done, n - done)
            out[done : done + take] = out[:take] * U64(step)
            step, done = step * step % 2**64, done + take
    return out


_POWERS: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _POWERS:
        _POWERS.extend((_powers(_BASE, _BLOCK + 1), _powers(_INVERSE, _BLOCK + 1)))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
        x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
        return x ^ (x >> U64(33))


def _hash_words(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    power, inverse = _tables()
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = starts[at]
            upto = int(np.searchsorted(ends, base + _BLOCK, "right"))
            if upto <= at:  # one word longer than a block: block hashes, combined
                total = U64(0)
                for k in range(int(base), int(ends[at]), _BLOCK):
                    piece = b[k : min(k + _BLOCK, int(ends[at]))]
                    total = mix(np.array([total + (_BYTE[piece] * power[: len(piece)]).sum(dtype=np.uint64)]))[0]
                out[at] = total
                at += 1
                continue
            piece = b[base : ends[upto - 1]]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[piece] * power[: len(piece)], out=sums[1:])
            s = starts[at:upto] - base
            out[at:upto] = (sums[ends[at:upto] - base] - sums[s]) * inverse[s]
            at = upto
    return mix(out)


class Tokens:
    """Word hashes ``h`` of some texts; those of text ``i`` are ``h[cut[i]:cut[i + 1]]``."""

    __slots__ = ("bytes", "cut", "ends", "h", "starts")

    def __init__(self, texts: Iterable[str | None], hashed: bool = True):
        texts = ["" if t is None else t for t in texts]
        joined = "\x00".join(texts)
        if joined.count("\x00") != max(0, len(texts) - 1):
            joined = "\x00".join(t.replace("\x00", " ") for t in texts)
        joined = joined.lower()
        if not joined.isascii():
            joined = _PUNCT.sub(" ", joined)
        b = self.bytes = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = _WORDLIKE[b]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.h = _hash_words(b, self.starts, self.ends) if hashed else None
        between = np.flatnonzero(b == 0)
        self.cut = np.concatenate(([0], np.searchsorted(self.starts, between), [len(self.starts)])) if texts else np.zeros(1, np.int64)

    def lengths(self) -> np.ndarray:
        return np.diff(self.cut)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.cut) - 1), self.lengths())


def hash_text(text: str) -> np.ndarray:
    return Tokens([text]).h


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of ``batch`` of about ``limit`` characters, at least a row each, with the column's values."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for k, n in enumerate(sizes):
        if k > first and total + n > limit:
            yield batch.slice(first, k - first), values.slice(first, k - first).to_pylist()
            first, total = k, 0
        total += int(n)
    if first < len(sizes):
        yield batch.slice(first), values.slice(first).to_pylist()


def map_pieces(df: DataFrame, column: str, fn: Callable, schema, limit: int = 1 << 20) -> DataFrame:
    """``mapInArrow`` where ``fn(slice, texts)`` returns a RecordBatch or None."""

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, column, limit):
                if (out := fn(part, texts)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir (or that was set before), set for checkpoints.

    Only a session with all its executors in this process gets one of its own if none is named; any other raises RuntimeError.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="shelfspark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared.rstrip("/")


def fresh(df: DataFrame | Iterable[str], *names: str) -> list[str]:
    """Each name, underscored until no column has it in any case."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def replace(batch: pa.RecordBatch, new: dict) -> pa.RecordBatch:
    """``batch`` with some columns' values replaced, in the same order."""
    return pa.RecordBatch.from_arrays(
        [pa.array(new[f.name], f.type) if f.name in new else batch.column(k) for k, f in enumerate(batch.schema)], schema=batch.schema
    )
