"""Operator 4: shards of balanced bytes by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a shard, groups of a bucket that is partitioned by itself, buckets that are combined at once, parts that a step divides into.
SHARD_BYTES, BUCKET, FAN_IN, PARTS = 64 << 20, 20_000, 64, 256


class Partial:
    """A partial partition: the sums of its non-empty parts, falling, and what each holds."""

    __slots__ = ("parts", "sums")

    def __init__(self, sums: np.ndarray, parts: list):
        self.sums, self.parts = sums, parts

    def spread(self, k: int) -> int:
        return int(self.sums[0] - (self.sums[-1] if len(self.sums) == k else 0)) if len(self.sums) else 0

    def combine(self, other: Partial, k: int) -> Partial:
        """The largest parts of one with the smallest of the other; parts are pairs, so nothing is copied."""
        a, b = len(self.sums), len(other.sums)
        over = max(0, a + b - k)  # positions k - over ... of self meet parts b - over ... of other, in opposite order
        sums = np.concatenate((self.sums[: a - over], self.sums[a - over :] + other.sums[b - over :][::-1], other.sums[: b - over]))
        parts = self.parts[: a - over] + list(zip(self.parts[a - over :], other.parts[b - over :][::-1])) + other.parts[: b - over]
        order = np.argsort(-sums, kind="stable")
        return Partial(sums[order], [parts[i] for i in order.tolist()])


def difference(partials: list[Partial], k: int) -> Partial:
    """Combines the two of largest spread until one is left. Ties: the earlier."""
    heap = [(-p.spread(k), n, p) for n, p in enumerate(partials)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        c = a.combine(b, k)
        heapq.heappush(heap, (-c.spread(k), n, c))
        n += 1
    return heap[0][2] if heap else Partial(np.zeros(0, np.int64), [])


def leaves(part) -> list:
    out, stack = [], [part]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        else:
            out.append(x)
    return out


def partition(sizes: list[int], k: int) -> tuple[list[int], np.ndarray]:
    """The part of each item, and the parts' sums (falling)."""
    p = difference([Partial(np.array([s], np.int64), [n]) for n, s in enumerate(sizes)], k)
    of = [0] * len(sizes)
    for j, part in enumerate(p.parts):
        for n in leaves(part):
            of[n] = j
    return of, p.sums


def _local(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["bytes", "grp"], ascending=[False, True], kind="stable")
    of, _ = partition(pdf["bytes"].tolist(), k)
    return pd.DataFrame({"whole": pdf["whole"], "bucket": pdf["bucket"], "grp": pdf["grp"], "bytes": pdf["bytes"], "part": of})


def _combined(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of the parts of some buckets, in which part of their combination they are."""
    partials = []
    for _, own in pdf.sort_values(["bucket", "bytes", "part"], ascending=[True, False, True], kind="stable").groupby("bucket", sort=True):
        partials.append(Partial(own["bytes"].to_numpy(np.int64), list(own.index)))
    of = {i: j for j, part in enumerate(difference(partials, k).parts) for i in leaves(part)}
    return pdf.assign(into=[of[i] for i in pdf.index])[["whole", "up", "bucket", "part", "bytes", "into"]]


def _divide(groups: DataFrame, k: int, buckets: int) -> DataFrame:
    """groups (whole, grp, bytes) with ``part``, in which of ``k`` parts of its whole each is: differenced in ``buckets`` buckets, then the buckets' partial partitions."""
    bucketed = groups.withColumn("bucket", F.pmod(F.xxhash64("grp", "whole"), F.lit(buckets)))
    local = bucketed.groupBy("whole", "bucket").applyInPandas(lambda pdf: _local(pdf, k), "whole long, bucket long, grp long, bytes long, part long")
    parts = local.groupBy("whole", "bucket", "part").agg(F.sum("bytes").alias("bytes"))
    placed = local
    while buckets > 1:
        buckets = math.ceil(buckets / FAN_IN)
        up = parts.withColumn("up", F.floor(F.col("bucket") / FAN_IN)).groupBy("whole", "up").applyInPandas(lambda pdf: _combined(pdf, k), "whole long, up long, bucket long, part long, bytes long, into long")
        placed = placed.join(up.select("whole", "bucket", "part", "up", "into"), ["whole", "bucket", "part"]).select("whole", "grp", "bytes", F.col("up").alias("bucket"), F.col("into").alias("part"))
        parts = up.groupBy("whole", F.col("up").alias("bucket"), F.col("into").alias("part")).agg(F.sum("bytes").alias("bytes"))
    return placed.select("whole", "grp", "bytes", "part")


def steps_of(k: int, most: int = PARTS) -> list[int]:
    """Factors of at most ``most``, whose product is ``k`` or little more."""
    n = 1
    while most**n < k:
        n += 1
    factor = next(f for f in range(1, most + 1) if f**n >= k)
    out, left = [], k
    for _ in range(n):
        out.append(min(factor, left))
        left = math.ceil(left / out[-1])
    return out


def assign_shards(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", group: list[str] | None = None, shard_bytes: int = SHARD_BYTES, bucket: int = BUCKET, most: int = PARTS) -> DataFrame:
    """(doc_id, bytes, shard): shards of about ``shard_bytes`` bytes of UTF-8 text, no group being divided.

    A group is the documents that agree in the columns ``group``; by default
    those of equal text, so that copies share a shard. There are
    ceil(total / shard_bytes) shards (beyond ``most`` up to a few more): the
    table is divided in steps of at most ``most`` parts, each part of a step
    being divided in the next, so that no task combines more parts than that
    and those of a step run side by side. In a step groups fall by hash into
    buckets of about ``bucket``; a bucket is partitioned by differencing, and
    the buckets' partial partitions are differenced in turn, ``FAN_IN`` at a
    time, which evens out what imbalance they have. Parts of a step are
    numbered by falling bytes (ties: the order is fixed by the groups' hashes).

    Null and empty texts have 0 bytes and are assigned like others; very long
    ones too, and one of over ``shard_bytes`` makes a larger shard; null group
    columns are equal to each other. Repeated rows are all assigned, and counted.
    An empty table gives no rows. Other columns aren't read, whatever their names.

    Two scans; groups, not texts, are shuffled.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(*([F.col(c) for c in group] if group else [F.coalesce(F.col(text), F.lit(""))])).alias("grp"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    groups = own.groupBy("grp").agg(F.sum("bytes").alias("bytes"))
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    wholes, placed = 1, groups.select(F.lit(0).cast("long").alias("whole"), "grp", "bytes")
    for k in steps_of(max(1, math.ceil(total / shard_bytes)), most):
        divided = _divide(placed, k, max(1, math.ceil(n / wholes / bucket)))
        placed, wholes = divided.select((F.col("whole") * k + F.col("part")).alias("whole"), "grp", "bytes"), wholes * k
    return own.join(placed.select("grp", F.col("whole").alias("shard")), "grp").select("doc_id", "bytes", "shard")
