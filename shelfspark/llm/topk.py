"""Operator 2: exact top-k search by tiled matrix products."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 10
#: Vectors of a group, of which a cell meets two; vectors of a tile.
GROUP, TILE = 16_384, 2048
#: Lists that are merged at once.
FAN_IN = 8


def slack(dimension: int) -> float:
    """How far a 32-bit product of unit vectors can be off: a rounding of 2 ** -24 for each term and element."""
    return (2 * dimension + 8) * 2.0**-24


def _tile_top(near: np.ndarray, q: np.ndarray, s: np.ndarray, sid: np.ndarray, k: int, least: np.ndarray, off: float):
    """(query row, id, score) of each query's best k of a shard tile, as far as they reach ``least``: the 32-bit product ``near`` selects, 64 bits decide."""
    rows, columns = np.nonzero(near >= (least - off)[:, None])
    if len(rows) > 4 * k * len(q) and near.shape[1] > k:
        bound = np.maximum(np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k], least) - off
        rows, columns = np.nonzero(near >= bound[:, None])
    fine = near[rows, columns] > -np.inf
    rows, columns = rows[fine], columns[fine]
    exact = np.concatenate([(q[rows[a : a + 65536]] * s[columns[a : a + 65536]]).sum(1) for a in range(0, len(rows), 65536)] or [np.zeros(0)])
    return _best(rows, sid[columns], exact, k)


def _best(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    order = np.lexsort((ids, -score, rows))
    rows, ids, score = rows[order], ids[order], score[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], ids[rank < k], score[rank < k]


class _Side:
    """Unit vectors of a group in order of their ids, and each tile's lists so far."""

    def __init__(self, ids: np.ndarray, packed: list[bytes], dimension: int, kind: str):
        order = np.argsort(ids, kind="stable")
        v = np.frombuffer(b"".join(packed), kind).reshape(-1, dimension)[order].astype(np.float64)
        v /= np.abs(v).max(1, initial=0)[:, None]  # so that no square vanishes or overflows
        v /= np.sqrt((v * v).sum(1))[:, None]
        self.ids, self.v, self.v32 = ids[order], v, v.astype(np.float32)
        self.tiles = [slice(a, a + TILE) for a in range(0, len(ids), TILE)]
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in self.tiles]
        self.least = np.full(len(ids), -np.inf)

    def add(self, t: int, near: np.ndarray, other: _Side, o: slice, k: int, off: float) -> None:
        at = self.tiles[t]
        new = _tile_top(near, self.v[at], other.v[o], other.ids[o], k, self.least[at], off)
        found = self.found[t] = _best(*(np.concatenate(x) for x in zip(self.found[t], new)), k)
        ends = np.searchsorted(found[0], np.arange(len(near) + 1))
        full = np.flatnonzero(np.diff(ends) == k)
        self.least[at.start + full] = found[2][ends[full + 1] - 1]

    def lists(self, part: int) -> pa.Table:
        """(id, part, top) of each vector that met another."""
        row = np.concatenate([r + at.start for at, (r, _, _) in zip(self.tiles, self.found)] or [np.zeros(0, np.int64)])
        near, score = (np.concatenate([f[c] for f in self.found] or [np.zeros(0)]) for c in (1, 2))
        ends = np.searchsorted(row, np.arange(len(self.ids) + 1))
        some = np.flatnonzero(np.diff(ends))
        offsets = np.concatenate(([0], ends[some + 1])).astype(np.int32)
        top = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(-score), pa.array(near.astype(np.int64))], names=["score", "id"]))
        return pa.table({"id": pa.array(self.ids[some]), "part": pa.array(np.full(len(some), part, np.int64)), "top": top})


def _cell(cell: pa.Table, k: int, dimension: int, kind: str) -> pa.Table:
    """Each tile of one group with each of the other (or of itself): one product gives the nearest of both sides."""
    high, low = cell["high"][0].as_py(), cell["low"][0].as_py()
    upper = cell["upper"].to_numpy()
    a, b = (_Side(own["id"].to_numpy(), own["v"].to_pylist(), dimension, kind) for own in (cell.filter(pa.array(upper)), cell.filter(pa.array(~upper))))
    off = slack(dimension)
    if high == low:
        b = a
    for i, x in enumerate(a.tiles):
        for j, y in enumerate(b.tiles):
            if a is b and j < i:
                continue
            near = a.v32[x] @ b.v32[y].T
            if a is b and i == j:
                np.fill_diagonal(near, -np.inf)
            a.add(i, near, b, y, k, off)
            if a is not b or i != j:
                b.add(j, np.ascontiguousarray(near.T), a, x, k, off)
    return a.lists(low) if a is b else pa.concat_tables([a.lists(low), b.lists(high)])


def top_k(vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", group: int = GROUP) -> DataFrame:
    """(query_id, rank, neighbour_id, score): for each vector the ``k`` others of highest cosine similarity.

    Exact: every vector is a query, and meets all others. Ties go to the lower
    id; scores are of 64 bits and summed in one order, so equal vectors tie
    exactly. Vectors that are null, empty, zero, of another than the commonest
    length (ties: the longest), or have null or non-finite elements take no
    part; nor do rows without an id. An id that occurs again counts with its
    least vector. With fewer than k others, all are listed. Other columns
    aren't read.

    Vectors fall by hash of id into groups of about ``group``; a cell meets two
    groups, a tile product at a time, which serves the queries of both, keeping
    each query's k best of a tile. Lists of k are merged in a tree. Work is
    quadratic in the vectors, as it is for any exact search of unstructured
    ones; a vector is sent to as many cells as there are groups. An empty table
    gives no rows.
    """
    element = F.transform(F.col(embedding), lambda x: x.cast("double"))
    v = vectors.filter(F.col(vec_id).isNotNull() & (F.size(embedding) > 0)).select(F.col(vec_id).cast("long").alias("id"), element.alias("e"))
    v = v.filter(F.expr("forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x != 0)"))
    sizes = v.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out = "query_id long, rank int, neighbour_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], out)
    dimension, groups = sizes["d"], max(1, math.ceil(sizes["count"] / group))

    kind = "<f4" if vectors.schema[embedding].dataType == T.ArrayType(T.FloatType()) else "<f8"

    def pack(batches):
        for pdf in batches:
            m = np.array(pdf["e"].tolist(), kind).reshape(-1, dimension)
            yield pd.DataFrame({"id": pdf["id"], "v": [x.tobytes() for x in m]})

    one = v.filter(F.size("e") == dimension).groupBy("id").agg(F.min("e").alias("e"))
    packed = one.mapInPandas(pack, "id long, v binary").withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)))
    cells = packed.withColumn("other", F.explode(F.expr(f"sequence(0L, {groups - 1}L)"))).select(F.greatest("g", "other").alias("high"), F.least("g", "other").alias("low"), (F.col("g") >= F.col("other")).alias("upper"), "id", "v")
    top = "array<struct<score:double,id:bigint>>"
    lists = cells.groupBy("high", "low").applyInArrow(lambda cell: _cell(cell, k, dimension, kind), f"id long, part long, top {top}")
    while groups > 1:
        groups = math.ceil(groups / FAN_IN)
        lists = lists.groupBy("id", F.floor(F.col("part") / FAN_IN).alias("part")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return lists.select(F.col("id").alias("query_id"), F.posexplode("top").alias("p", "t")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.id").alias("neighbour_id"), (-F.col("t.score")).alias("score")
    )
