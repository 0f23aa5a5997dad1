"""Operator 3: byte-pair encoding and decoding with contiguous rank arrays."""

from __future__ import annotations

import base64
import heapq
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfspark.llm._text import fresh, map_pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes up to which a piece is merged by scanning its rank array; longer ones use a heap over linked parts.
SHORT = 256
#: Pieces whose ids a worker remembers before it starts over.
REMEMBERED = 400_000
_NONE = 1 << 60


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Rank of each token's bytes, from a file of lines "base64 rank"."""
    with Path(path).open("rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: part boundaries and the ranks of neighbouring parts stand in two arrays.

    The least rank (the leftmost at ties) is looked for again and again, its
    boundary deleted, and the ranks of both neighbours are refreshed.
    """
    known = ranks.get(piece)
    if known is not None:
        return [known]
    get = ranks.get
    bounds = list(range(len(piece) + 1))
    adjacent = [get(piece[k : k + 2], _NONE) for k in range(len(piece) - 1)]
    while adjacent:
        least = min(adjacent)
        if least == _NONE:
            break
        k = adjacent.index(least)
        del bounds[k + 1], adjacent[k]
        if k < len(adjacent):
            adjacent[k] = get(piece[bounds[k] : bounds[k + 2]], _NONE)
        if k:
            adjacent[k - 1] = get(piece[bounds[k - 1] : bounds[k + 1]], _NONE)
    return [ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a piece of any length, in n log n: parts are linked, candidates wait in a heap."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = bytearray(b"\x01" * n)
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, to = heapq.heappop(heap)
        other = after[k]
        if not alive[k] or other >= n or end[other] != to:
            continue
        alive[other] = 0
        end[k], after[k] = to, after[other]
        if after[k] < n:
            before[after[k]] = k
            if (r := ranks.get(piece[k : end[after[k]]])) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
        if (p := before[k]) >= 0 and (r := ranks.get(piece[p:to])) is not None:
            heapq.heappush(heap, (r, p, to))
    return [ranks[piece[k : end[k]]] for k in range(n) if alive[k]]


class Codec:
    """Encodes and decodes; ids of pieces seen before are remembered as packed 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        codec = self

        class Memory(dict):
            def __missing__(self, piece: str) -> bytes:
                raw = piece.encode("utf-8")
                ids = (merge_short if len(raw) <= SHORT else merge_long)(raw, codec.ranks)
                packed = np.array(ids, np.int32).tobytes()
                if len(raw) <= SHORT:
                    if len(self) >= REMEMBERED:
                        self.clear()
                    self[piece] = packed
                return packed

        self.memory = Memory()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memory.__getitem__, self.find(text))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all but the text if None) with ``ids``, ``n_tokens`` and ``round_trip``.

    Every text is encoded whole, and its ids are decoded again; ``round_trip``
    says whether that gave the text back, as it does for a vocabulary with all
    256 bytes. Null text: null ids, 0 tokens, null round_trip. Empty text: no
    ids, true. Very long texts are encoded whole. Equal ranks (ties) merge from
    the left. An empty table gives no rows. Rows are independent, repeated ones get the same ids. Names in
    use are underscored. The vocabulary (fixed, some hundred kB) is read once,
    on the driver, and broadcast; nothing is shuffled.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    names = fresh(keep, "ids", "n_tokens", "round_trip")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.BooleanType())])
    codecs: list[Codec] = []

    def run(part: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        if not codecs:
            codecs.append(Codec(ranks.value, pattern))
        codec = codecs[0]
        none = np.array([t is None for t in texts], bool)
        ids = [codec.encode(t or "") for t in texts]
        same = [None if t is None else codec.decode(i) == t for t, i in zip(texts, ids)]
        offsets = np.zeros(len(texts) + 1, np.int32)
        np.cumsum([len(i) for i in ids], out=offsets[1:])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)), mask=pa.array(none))
        kept = [part.column(part.schema.get_field_index(c)) for c in keep]
        return pa.RecordBatch.from_arrays([*kept, lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(same, pa.bool_())], names=[*keep, *names])

    return map_pieces(docs.select(*dict.fromkeys([*keep, text])), text, run, schema)


def decode(encoded: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY, name: str = "text") -> DataFrame:
    """``encoded`` with column ``name`` (underscored if taken): the text of the ids; null for null ids, "" for none; long lists whole, repeated rows alike, no rows of an empty table. Ids outside the vocabulary raise IndexError."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    (name,) = fresh(encoded, name)
    schema = T.StructType([*encoded.schema, T.StructField(name, T.StringType())])

    def run(batches):
        codec = Codec(ranks.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return encoded.mapInArrow(run, schema)
