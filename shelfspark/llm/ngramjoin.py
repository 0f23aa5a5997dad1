"""Operator 9: all pairs of documents whose n-gram sets have a Jaccard similarity of at least a threshold, by prefix trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm._text import U64, Tokens, fresh, map_pieces, mix, shared_folder

#: Words of a gram, least similarity.
N, THRESHOLD = 3, 0.5
#: A set's lowest grams in the global (hash) order by which its block is found.
KEYS = 8
#: Sets of a block, and grams of them all, that meet in one task at a time; larger blocks are met chunk against chunk.
CHUNK, CHUNK_GRAMS = 4096, 1_000_000
#: Rows of keys of 16 bytes that are broadcast, at most.
BROADCAST = 500_000
#: Partitions of the blocks for each of the session's shuffle partitions.
SPREAD = 4
#: Grams of the sets whose postings are written at a time; rows and columns of a matrix of overlaps.
PIECE, TILE = 1_000_000, 512
#: Chunks of a part beyond which it is divided again, which costs about as much as to send its sets that often.
DIVIDE = 4
#: Sets of a part that meet in a prefix tree, at most; more of them meet in matrices.
TREE = 16


def gram_sets(tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct gram hashes of each text, concatenated, and where each begins. Fewer than n words are one gram."""
    h, cut = tokens.h, tokens.cut
    size = np.diff(cut)
    grams = np.maximum(size - n + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(size)), grams)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams) + cut[:-1][doc]
    with np.errstate(over="ignore"):
        code = np.zeros(len(doc), np.uint64)
        for k in range(n):
            has = k < size[doc]
            code[has] = mix(code[has] * U64(0x9FB21C651E98DF25) + h[place[has] + k])
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    return code[first], np.searchsorted(doc[first], np.arange(len(size) + 1))


def pack(codes: np.ndarray) -> bytes:
    """The leading 40 bits of sorted codes: two grams of a pair of sets that differ agree with a chance of 1e-12.

    As Elias and Fano write sorted numbers: 32 low bits each, then the 8 high
    ones in unary, where a one is a number and a zero steps to the next value.
    """
    v = codes >> U64(24)
    v = v[np.concatenate((v[:1] == v[:1], v[1:] != v[:-1]))]
    high = np.zeros(len(v) + 256, np.uint8)
    high[(v >> U64(32)).astype(np.int64) + np.arange(len(v))] = 1
    return v.astype("<u4").tobytes() + np.packbits(high).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    n = (8 * len(packed) - 256) // 33  # 32 bits and a one each, 256 zeros, less than a byte to fill up
    low = np.frombuffer(packed, "<u4", n).astype(np.uint64)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=4 * n)))
    return low | (ones - np.arange(n)).astype(np.uint64) << U64(32)


def _summaries(docs: DataFrame, ids: list[str], text: str, n: int, keys: int) -> DataFrame:
    """(ids, sig, size, keys) of each text with words; equal sets have equal sigs."""

    def run(part: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        code, at = gram_sets(Tokens(texts), n)
        size = np.diff(at)
        sums = np.zeros(len(code) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mix(code + U64(0x632BE59BD9B4E019)), out=sums[1:])
            sig = mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64)).view(np.int64)
        some = np.flatnonzero(size)
        low = np.minimum(size[some], keys)
        offsets = np.concatenate(([0], np.cumsum(low))).astype(np.int32)
        place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], low) + np.repeat(at[:-1][some], low)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(code[place].view(np.int64)))
        kept = [part.column(part.schema.get_field_index(c)).take(pa.array(some)) for c in ids]
        return pa.RecordBatch.from_arrays([*kept, pa.array(sig[some]), pa.array(size[some]), lists], names=[*ids, "sig", "size", "keys"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids)
    return map_pieces(docs, text, run, f"{schema}, sig long, size long, keys array<long>")


def _row_key(*columns: str) -> Column:
    """128 bits of a row's columns."""
    own = [F.col(f"`{c}`") for c in columns]
    return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit("row"), *own).alias("b"))


class PrefixTree:
    """A compressed trie of sets whose elements stand in one order: frequent ones first, so that paths share them.

    Elements that only one set holds can't be shared and are left out; a set's
    full size still counts. ``partners(i)`` walks the tree from the root a level
    at a time, carrying the overlap of set i with each path, and leaves a
    subtree when what the overlap can still gain (the lesser of the set's and
    the subtree's remaining elements) can't reach the threshold, or when the
    subtree's sizes can't.
    """

    def __init__(self, sets: list[np.ndarray], threshold: float, full: np.ndarray | None = None):
        self.t, m = threshold, len(sets)
        sizes = np.array([len(s) for s in sets])
        values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(values))
        owner = np.repeat(np.arange(m), sizes)
        use = shared[inverse]
        r, o = rank[inverse[use]], owner[use]
        order = np.lexsort((r, o))
        r, o = r[order], o[order]
        at = np.searchsorted(o, np.arange(m + 1))
        paths = [r[a:b] for a, b in zip(at, at[1:])]
        self.order = sorted(range(m), key=lambda k: paths[k].astype(">u4").tobytes())
        self.paths = [paths[k] for k in self.order]
        self.sizes = (sizes if full is None else full)[self.order]
        self.universe = int(shared.sum())
        self._build()

    def _build(self) -> None:
        m = len(self.paths)
        lengths = np.array([len(p) for p in self.paths])
        common = np.zeros(m + 1, np.int64)  # with the path before
        for k in range(1, m):
            a, b = self.paths[k - 1], self.paths[k]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            common[k] = differ[0] if len(differ) else n
        # a node for each distinct (depth, range): begun by the stack of open depths
        low, high, top, deep = [], [], [], []  # of each node: first and last path, depth above, depth
        stack: list[tuple[int, int]] = []  # (depth above, first path)
        depth_open: list[int] = []
        for k in range(m + 1):
            c = int(common[k]) if k < m else 0
            begin = k
            while depth_open and depth_open[-1] > c:
                d = depth_open.pop()
                begin = stack.pop()[1]
                above = max(depth_open[-1] if depth_open else 0, c)
                low.append(begin), high.append(k - 1), top.append(above), deep.append(d)
                if above == c and (not depth_open or depth_open[-1] < c) and c > 0:
                    depth_open.append(c)
                    stack.append((c, begin))
                    break
            if k < m and lengths[k] > (depth_open[-1] if depth_open else 0):
                depth_open.append(int(lengths[k]))
                stack.append((int(lengths[k]), k))
        self.low, self.high, self.top, self.deep = (np.array(x, np.int64) for x in (low, high, top, deep))
        order = np.lexsort((-self.high, self.low, self.top))
        self.low, self.high, self.top, self.deep = self.low[order], self.high[order], self.top[order], self.deep[order]
        # parents: the node that ends at a node's upper depth and holds its range
        ends = {}
        for k, (a, d) in enumerate(zip(self.low.tolist(), self.deep.tolist())):
            ends.setdefault(d, []).append((a, k))
        parent = np.full(len(self.low), -1)
        for d, own in ends.items():
            own.sort()
            firsts = np.array([a for a, _ in own])
            at = np.flatnonzero(self.top == d)
            if len(at):
                parent[at] = [own[j][1] for j in np.searchsorted(firsts, self.low[at], "right") - 1]
        by = np.argsort(parent, kind="stable")
        self.child, self.first_child = by, np.searchsorted(parent[by], np.arange(-1, len(parent) + 1))
        labels = [self.paths[a][t:d] for a, t, d in zip(self.low, self.top, self.deep)]
        self.label_at = np.concatenate(([0], np.cumsum(self.deep - self.top)))
        self.labels = np.concatenate(labels) if labels else np.zeros(0, np.int64)
        self.last = self.labels[self.label_at[1:] - 1] if labels else np.zeros(0, np.int64)
        n = len(self.low)
        self.most, self.least = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k in range(n):
            a, b = self.low[k], self.high[k] + 1
            self.most[k], self.least[k] = lengths[a:b].max(), self.sizes[a:b].min()
        #: Paths that end at a node (with no child for them), or at the root (-1).
        self.end_at: dict[int, list[int]] = {}
        node_of = {}
        for k in range(n):
            node_of.setdefault(int(self.deep[k]), []).append((int(self.low[k]), int(self.high[k]), k))
        for j in range(m):
            for a, b, k in node_of.get(int(lengths[j]), ()):
                if a <= j <= b:
                    self.end_at.setdefault(k, []).append(j)
                    break
            else:
                self.end_at.setdefault(-1, []).append(j)
        self.ends = np.zeros(n, bool)
        self.ends[[k for k in self.end_at if k >= 0]] = True

    def need(self, a: int, b: np.ndarray) -> np.ndarray:
        return self.t / (1 + self.t) * (a + b) - 1e-9

    def partners(self, i: int, mark: np.ndarray) -> list[tuple[int, int]]:
        """(j, overlap) for each j after i in tree order that reaches the threshold; ``mark`` is all zeros, and is again after."""
        path, size = self.paths[i], int(self.sizes[i])
        mark[path] = 1
        out = []
        nodes = self.child[self.first_child[0] : self.first_child[1]]
        overlap = np.zeros(len(nodes), np.int64)
        while len(nodes):
            live = self.high[nodes] > i
            live &= self.least[nodes] * self.t <= size + 1e-9
            nodes, overlap = nodes[live], overlap[live]
            if not len(nodes):
                break
            begin, n = self.label_at[nodes], self.deep[nodes] - self.top[nodes]
            offsets = np.cumsum(n) - n
            index = np.arange(int(n.sum())) - np.repeat(offsets - begin, n)
            overlap = overlap + np.add.reduceat(mark[self.labels[index]], offsets, dtype=np.int64)
            for k in np.flatnonzero(self.ends[nodes]):
                for j in self.end_at[int(nodes[k])]:
                    if j > i and overlap[k] >= self.need(size, self.sizes[j]):
                        out.append((j, int(overlap[k])))
            mine = len(path) - np.searchsorted(path, self.last[nodes], "right")
            live = overlap + np.minimum(mine, self.most[nodes] - self.deep[nodes]) >= self.need(size, self.least[nodes])
            nodes, overlap = nodes[live], overlap[live]
            a, b = self.first_child[nodes + 1], self.first_child[nodes + 2]
            n = b - a
            overlap = np.repeat(overlap, n)
            nodes = self.child[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - a, n)]
        mark[path] = 0
        return out


def block_pairs(sets: list[np.ndarray], threshold: float, full: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(i, j, overlap), i < j, of the sets that reach the threshold. ``full``: their sizes, if grams of one set alone are left out."""
    if len(sets) == 2:  # a tree of two paths is their merge
        a, b = sets
        m, n = (len(a), len(b)) if full is None else full
        if min(m, n) < threshold * max(m, n) - 1e-9:
            return []
        both = len(np.intersect1d(a, b, assume_unique=True))
        return [(0, 1, both)] if both >= threshold / (1 + threshold) * (m + n) - 1e-9 else []
    tree = PrefixTree(sets, threshold, full)
    mark = np.zeros(max(1, tree.universe), np.int8)
    out = []
    for i in range(len(sets) - 1):
        a = tree.order[i]
        for j, n in tree.partners(i, mark):
            b = tree.order[j]
            out.append((min(a, b), max(a, b), n))
    return out


def _blocks(batches, threshold: float):
    """Pairs of each block of batches sorted by (key, low, high); a pair comes out in the block of its lowest common key."""
    names = ["sig_a", "sig_b", "common", "size_a", "size_b"]
    rows: list[tuple] = []
    held = None

    def done(block):
        found = []
        if len(block) > 1:
            key, low, high = block[0][:3]
            sets = [unpack(r[6]) for r in block]
            for i, j, n in block_pairs(sets, threshold):
                a, b = block[i], block[j]
                if {a[3], b[3]} != {low, high} or min({*a[5]} & {*b[5]}) != key:
                    continue
                if a[4] > b[4]:
                    a, b, i, j = b, a, j, i
                found.append((a[4], b[4], n, len(sets[i]), len(sets[j])))
        return found

    out: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if held is not None and r[:3] != held:
                out += done(rows)
                rows = []
            if held != r[:3] or r[4] != rows[-1][4]:  # a repeated document has one set
                rows.append(r)
            held = r[:3]
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
            out = []
    out += done(rows)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)


def _once(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared folder: executors may be lost after."""
    shared_folder(df.sparkSession)
    df = df.persist(StorageLevel.DISK_ONLY)  # for the second of the two jobs of a checkpoint
    try:
        return df.checkpoint()
    finally:
        df.unpersist()


def set_pairs(docs: DataFrame, ids: list[str], row: str, text: str, n: int, threshold: float, keys: int) -> tuple[DataFrame, DataFrame]:
    """Summaries of all rows, and (sig_a, sig_b, common, size_a, size_b) of the distinct sets that reach the threshold."""
    spark = docs.sparkSession
    summary = _once(_summaries(docs.select(*dict.fromkeys([*ids, row, text])), list(dict.fromkeys([*ids, row])), text, n, keys))
    wide = summary.select("sig", "size", F.col(row).alias("row"), *[F.get("keys", F.lit(k)).alias(f"k{k}") for k in range(keys)])
    classes = wide.groupBy("sig").agg(F.min("row").alias("row"), F.max("size").alias("size"), *[F.min(f"k{k}").alias(f"k{k}") for k in range(keys)])
    keyed = classes.select("sig", "size", F.explode(F.array(*[f"k{k}" for k in range(keys)])).alias("key")).filter("key is not null")
    # of a block's sets only those that another comes near in size; a set is a row of some bytes here
    block = Window.partitionBy("key")
    by_size = block.orderBy("size")
    near = (F.lead("size").over(by_size) * threshold <= F.col("size") + 1e-9) | (F.lag("size").over(by_size) >= F.col("size") * threshold - 1e-9)
    met = keyed.withColumn("near", near).filter("near").select("key", "sig", F.count(F.lit(1)).over(block).alias("n"), F.sum("size").over(block).alias("grams"))
    # a block all of whose sets have a lower key in common too has no pair of its own: all of its pairs meet there
    own = met.groupBy("sig").agg(F.collect_list(F.struct("key", "n")).alias("met"))
    below = own.select(F.explode("met").alias("m"), "met").select("m.key", "m.n", F.explode(F.expr("filter(met, x -> x.key < m.key)")).alias("l"))
    idle = below.groupBy("key", F.col("l.key").alias("low")).agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).filter("c = n").select("key").distinct()
    met = met.join(idle, "key", "left_anti").withColumn("chunks", F.ceil(F.greatest(F.col("n") / CHUNK, F.col("grams") / CHUNK_GRAMS)).cast("int"))
    wanted = met.groupBy("sig").agg(F.collect_list(F.struct("key", "chunks")).alias("met")).join(classes.select("sig", "row"), "sig")
    texts = docs.select(F.col(row).alias("row"), F.col(text).alias("text")).join(wanted, "row")

    def sets(part: pa.RecordBatch, own: list) -> pa.RecordBatch:
        code, at = gram_sets(Tokens(own), n)
        packed = pa.array([pack(code[a:b]) for a, b in zip(at, at[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([part.column(1), part.column(2), packed], names=["sig", "met", "grams"])

    packed = map_pieces(texts.select("text", "sig", "met"), "text", sets, "sig long, met array<struct<key:long,chunks:int>>, grams binary")
    spread = packed.select("sig", F.expr("transform(met, x -> x.key)").alias("keys"), "grams", F.explode("met").alias("m"))
    chunk = F.expr("cast(pmod(xxhash64(sig), m.chunks) as int)")
    spread = spread.withColumn("chunk", chunk).withColumn("other", F.explode(F.expr("sequence(0, m.chunks - 1)")))
    cells = spread.select(F.col("m.key").alias("key"), F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "sig", "keys", "grams")
    parts = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = cells.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high", "sig")
    pairs = sorted_.mapInArrow(lambda it: _blocks(it, threshold), "sig_a long, sig_b long, common long, size_a long, size_b long")
    return summary, pairs

def _pieces_of(batches, limit: int):
    """(columns, sets) of slices of batches whose sets, packed in the last column, have about ``limit`` grams; a row at least."""
    for batch in batches:
        packed, first, total, own = batch.column(batch.num_columns - 1), 0, 0, []
        for k in range(batch.num_rows):
            own.append(unpack(packed[k].as_py()))
            total += len(own[-1])
            if total >= limit or k + 1 == batch.num_rows:
                yield [batch.column(c).slice(first, k + 1 - first) for c in range(batch.num_columns - 1)], own
                first, total, own = k + 1, 0, []


def _write(v: np.ndarray) -> bytes:
    """Ascending numbers: the width of a gap, the first number, the gaps."""
    gaps = np.diff(v).astype("<u8")
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + int(v[0]).to_bytes(8, "little") + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _read(written: bytes) -> np.ndarray:
    width, first = written[0], int.from_bytes(written[1:9], "little")
    n = (len(written) - 9) // width
    out = np.zeros((n + 1, 8), np.uint8)
    out[1:, :width] = np.frombuffer(written, np.uint8, offset=9).reshape(n, width)
    out = out.view("<u8").reshape(-1)
    out[0] = first
    return np.cumsum(out, dtype=np.uint64)


def _places(doc: np.ndarray, documents: int) -> bytes:
    return doc.astype("<u2" if documents <= 65_536 else "<u4").tobytes()


def _placed(written: bytes, n: int) -> np.ndarray:
    return np.frombuffer(written, "<u2" if len(written) == 2 * n else "<u4").astype(np.uint32)


_POSTED = "part int, piece long, kind int, grams binary, doc binary, df binary"
_NAMES = ["part", "piece", "kind", "grams", "doc", "df"]


def _posted(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_NAMES)


def _post(batches, parts: int):
    """Of batches (sig, size, cell, grams): each gram with its document's place in the piece, by range of the grams; a row of kind 1 tells the piece's documents."""
    number = TaskContext.get().partitionId() << 32
    for (sig, size, cell), sets in _pieces_of(batches, PIECE):
        sig, size, cell = (x.to_numpy(zero_copy_only=False) for x in (sig, size, cell))
        lengths = [len(s) for s in sets]
        v, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
        if cell.any():  # grams of different cells are different ones
            with np.errstate(over="ignore"):
                v = mix(v + mix(cell.astype(np.int64).view(np.uint64))[doc]) >> U64(24)
        order = np.argsort(v, kind="stable")
        v, doc = v[order], doc[order]
        cut = np.searchsorted(v, (np.arange(parts + 1, dtype=np.uint64) << U64(40)) // U64(parts))
        rows = [(number % parts, number, 1, sig.astype("<i8").tobytes(), size.astype("<i8").tobytes(), cell.astype("<i8").tobytes())]
        for k in np.flatnonzero(np.diff(cut)):
            own = slice(cut[k], cut[k + 1])
            rows.append((int(k), number, 0, _write(v[own]), _places(doc[own], len(sets)), b""))
        yield _posted(rows)
        number += 1


def _count(batches):
    """Of the rows of a range of grams: those in two documents or more, with the number of documents, back to their pieces."""
    pieces, grams, docs = [], [], []
    for batch in batches:
        for part, piece, kind, written, doc, df in zip(*(c.to_pylist() for c in batch.columns)):
            if kind:
                yield _posted([(part, piece, kind, written, doc, df)])
                continue
            grams.append(_read(written))
            docs.append(_placed(doc, len(grams[-1])))
            pieces.append(piece)
    if not grams:
        return
    lengths = [len(g) for g in grams]
    g, doc, of = np.concatenate(grams), np.concatenate(docs), np.repeat(np.arange(len(grams)), lengths)
    del grams, docs
    order = np.argsort(g, kind="stable")
    g = g[order]
    edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    n = np.diff(np.append(edge, len(g)))
    df = np.repeat(n, n)
    shared = df > 1
    order, g, df = order[shared], g[shared], np.minimum(df[shared], 65_535)
    doc, of = doc[order], of[order]
    order = np.argsort(of, kind="stable")
    g, df, doc, of = g[order], df[order], doc[order], of[order]
    cut = np.searchsorted(of, np.arange(len(pieces) + 1))
    rows = []
    for k in np.flatnonzero(np.diff(cut)):
        own = slice(cut[k], cut[k + 1])
        rows.append((0, pieces[k], 0, _write(g[own]), _places(doc[own], int(doc[own].max()) + 1), df[own].astype("<u2").tobytes()))
        if len(rows) == 500:
            yield _posted(rows)
            rows = []
    if rows:
        yield _posted(rows)


def _gather(batches, threshold: float):
    """Of rows sorted by piece: the documents whose shared grams could reach the threshold, with those grams and the keys, which are the shared ones of the exact prefix."""

    def done(rows: list[tuple]) -> pa.RecordBatch | None:
        told = next(r for r in rows if r[2])
        sig, size, cell = (np.frombuffer(x, "<i8") for x in told[3:6])
        own = [r for r in rows if not r[2]]
        if not own:
            return None
        g, df = np.concatenate([_read(r[3]) for r in own]), np.concatenate([np.frombuffer(r[5], "<u2") for r in own])
        doc = np.concatenate([_placed(r[4], len(r[5]) // 2) for r in own])
        order = np.lexsort((g, df, doc))
        g, doc = g[order], doc[order]
        at = np.searchsorted(doc, np.arange(len(sig) + 1))
        n, least = np.diff(at), np.ceil(threshold * size - 1e-9).astype(np.int64)
        live = np.flatnonzero((n >= least) & (n > 0))
        # grams of one document alone come first in the order and are no keys
        keys = [g[at[k] : at[k] + n[k] - least[k] + 1].astype("<i8").tobytes() for k in live]
        packed = [pack(np.sort(g[at[k] : at[k + 1]]) << U64(24)) for k in live]
        return pa.RecordBatch.from_arrays([pa.array(sig[live]), pa.array(size[live]), pa.array(cell[live]), pa.array(keys, pa.binary()), pa.array(n[live]), pa.array(packed, pa.binary())], names=["sig", "size", "cell", "keys", "n", "grams"])

    rows: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and r[1] != rows[0][1]:
                if (out := done(rows)) is not None:
                    yield out
                rows = []
            rows.append(r)
    if rows and (out := done(rows)) is not None:
        yield out


def _spell(batches):
    """(key, size, sig) of each key."""
    for batch in batches:
        keys = [np.frombuffer(k, "<i8") for k in batch.column(2).to_pylist()]
        if keys:
            n = [len(k) for k in keys]
            sig, size = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(size), pa.array(sig)], names=["key", "size", "sig"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) of the nodes of edges (a, b) that aren't the least of their component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    least, i, j = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(i):
        i, j = least[i], least[j]
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        np.minimum.at(least, j, i)
        while (least[least] != least).any():
            least = least[least]
    own = least != np.arange(len(nodes))
    return nodes[least[own]], nodes[own]


def _joint(batches):
    """The components of edges (a, b), as ``_forest`` gives them."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if parts:
        root, node = _forest(*(np.concatenate(c) for c in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def _roots(edges: DataFrame) -> DataFrame:
    """(sig, root) of all nodes of edges (a, b): in one task while there are up to ``BROADCAST`` of them, by ``components`` beyond; the result is the same."""
    edges = _once(edges)
    found = _once(edges.coalesce(1).mapInArrow(_joint, "node long, root long")) if edges.count() <= BROADCAST else components(edges)
    return found.union(found.select(F.col("root").alias("node"), "root").distinct()).toDF("sig", "root")


def _stars(batches, threshold: float):
    """Of (key, size, sig): edges that connect the sets that have a key, as far as one comes near the next in size."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if not parts:
        return
    key, size, sig = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((size, key))
    key, size, sig = key[order], size[order], sig[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (size[1:] * threshold > size[:-1] + 1e-9)
    at = np.flatnonzero(first)
    if len(at):
        least = np.minimum.reduceat(sig, at)[np.cumsum(first) - 1]
        a, b = _forest(least[least != sig], sig[least != sig])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _narrow(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of sets (sig, size, cell, grams): those that may have a partner in their cell, with the grams they share, and (sig, root): the parts a cell falls into.

    A gram that one document of a cell has counts for no pair. The others stand
    in one order, rare ones before frequent ones; two sets that reach the
    threshold share a gram of the leading ``size - ceil(threshold * size) + 1``
    of both, and so are in one part.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = sets.select("sig", "size", "cell", "grams").mapInArrow(lambda it: _post(it, parts), _POSTED)
    counted = posted.repartitionById(parts, F.col("part")).mapInArrow(_count, _POSTED)
    pieces = counted.repartition(parts, "piece").sortWithinPartitions("piece")
    left = _once(pieces.mapInArrow(lambda it: _gather(it, threshold), "sig long, size long, cell long, keys binary, n long, grams binary"))
    spelled = left.select("sig", "size", "keys").mapInArrow(_spell, "key long, size long, sig long").repartition(parts, "key")
    return left, _roots(spelled.mapInArrow(lambda it: _stars(it, threshold), "a long, b long"))


def linked_tiles(sets: list[np.ndarray], sizes: np.ndarray, threshold: float, rows: np.ndarray, columns: np.ndarray):
    """(i, j, overlap) of the pairs of a row and a later column that reach the threshold, as arrays, tile by tile.

    Up to ``TREE`` sets are a prefix tree. Of more, whose pairs a walk would
    list one by one, grams of many sets are a matrix whose products add up, and
    of a gram of few each pair of its sets is counted by itself.
    """
    m = len(sets)
    if m <= TREE and len(rows) == len(columns) == m:
        if pairs := block_pairs(sets, threshold, sizes):
            yield tuple(np.array(c) for c in zip(*pairs))
        return
    values, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    many = count > max(4, 0.07 * m)
    dense, sparse = many[gram], (count > 1)[gram] & ~many[gram]
    column = (np.cumsum(many) - 1)[gram[dense]]
    by = np.argsort(column, kind="stable")
    column, holder = column[by], owner[dense][by]
    by = np.argsort(gram[sparse], kind="stable")
    few, held = gram[sparse][by], owner[sparse][by]  # owners ascend within a gram
    end = np.searchsorted(few, few, "right")
    right = np.zeros(m, bool)
    right[columns] = True
    for a in range(0, len(rows), TILE):
        tile = rows[a : a + TILE]
        place = np.full(m, -1)
        place[tile] = np.arange(len(tile))
        total = np.zeros((len(tile), m), np.float32)
        for c in range(0, int(many.sum()), TILE):
            own = slice(*np.searchsorted(column, (c, c + TILE)))
            x = np.zeros((m, TILE), np.float32)
            x[holder[own], column[own] - c] = 1
            total += x[tile] @ x.T
        flat = total.reshape(-1)
        mine = np.flatnonzero(place[held] >= 0)
        later = end[mine] - mine - 1  # pairs with the owners behind it
        upto = np.cumsum(later)
        begin = 0
        while begin < len(mine):
            stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + 4_000_000, "right")))
            n = later[begin:stop]
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(mine[begin:stop] + 1, n)
            at, times = np.unique(np.repeat(place[held[mine[begin:stop]]], n) * m + held[k], return_counts=True)
            flat[at] += times
            begin = stop
        reach = total >= threshold / (1 + threshold) * (sizes[tile][:, None] + sizes[None, :]) - 1e-9
        reach &= right[None, :] & (np.arange(m)[None, :] > tile[:, None])
        i, j = np.nonzero(reach)
        yield tile[i], j, total[i, j].astype(np.int64)


def _cells(batches, threshold: float, listed: bool):
    """Of sets sorted by (root, low, high, sig): the linked pairs if ``listed``, else (sig, root, links) of each set in its cell."""
    names = ["sig_a", "sig_b", "common", "size_a", "size_b"] if listed else ["sig", "root", "links"]

    def done(block: list[tuple]):
        sizes, weights, chunk = (np.array([r[k] for r in block]) for k in (5, 6, 3))
        sig = np.array([r[4] for r in block])
        sets, (_, low, high) = [unpack(r[7]) for r in block], block[0][:3]
        both = np.arange(len(block))
        # pairs across two chunks are those of either's rows with the other's columns behind them
        sides = [(both, both)] if low == high else [(both[chunk == low], both[chunk == high]), (both[chunk == high], both[chunk == low])]
        links, least = np.zeros(len(block), np.int64), both.copy()
        for rows, columns in sides:
            for i, j, n in linked_tiles(sets, sizes, threshold, rows, columns):
                if listed:
                    yield [sig[i], sig[j], n, sizes[i], sizes[j]]
                    continue
                links += np.bincount(i, weights[j], len(block)).astype(np.int64) + np.bincount(j, weights[i], len(block)).astype(np.int64)
                a, b = least[i], least[j]
                root, node = _forest(a[a != b], b[a != b])
                least[node] = root
                least = least[least]
        if not listed:
            yield [sig, sig[least], links]

    def all_done(block):
        for columns in done(block) if len(block) > 1 else ():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    rows: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and r[:3] != rows[0][:3]:
                yield from all_done(rows)
                rows = []
            if not rows or r[4] != rows[-1][4]:  # a repeated document has one set
                rows.append(r)
    if rows:
        yield from all_done(rows)


def _joined(own: DataFrame, ids: list[str], text: str, n: int, threshold: float, listed: bool) -> tuple[DataFrame, DataFrame]:
    """(ids, sig) of each text with words, and what ``_cells`` finds of all sets."""
    spark = own.sparkSession

    def run(part: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        code, at = gram_sets(Tokens(texts), n)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(code + U64(0x632BE59BD9B4E019)))))
            sig = mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)
        some = np.flatnonzero(np.diff(at))
        packed = [pack(code[at[k] : at[k + 1]]) for k in some]
        size = [(8 * len(p) - 256) // 33 for p in packed]
        kept = [part.column(part.schema.get_field_index(c)).take(pa.array(some)) for c in ids]
        return pa.RecordBatch.from_arrays([*kept, pa.array(sig[some]), pa.array(size, pa.int64()), pa.array(packed, pa.binary())], names=[*ids, "sig", "size", "grams"])

    schema = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in ids)
    summary = _once(map_pieces(own.select(*ids, text), text, run, f"{schema}, sig long, size long, grams binary"))
    members = summary.select(*ids, "sig").distinct()
    weights = members.groupBy("sig").agg(F.count(F.lit(1)).alias("weight"))
    left, roots = _narrow(summary.select("sig", "size", F.lit(0).cast("long").alias("cell"), "grams"), threshold)
    placed, before, chunked = [], None, False
    while True:
        whole = left.select("sig", "n").distinct().join(roots, "sig")
        total = whole.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("g"))
        chunks = F.ceil(F.greatest(F.col("c") / CHUNK, F.col("g") / CHUNK_GRAMS)).cast("int")
        info = _once(roots.join(total.select("root", chunks.alias("chunks")), "root"))
        chunked = chunked or bool(info.filter("chunks > 1").take(1))
        large = info.filter(F.col("chunks") > DIVIDE).count()
        if not large or before is not None and large > 0.9 * before:
            placed.append((left, info))
            break
        # parts that are too large fall into smaller ones by the grams that are rare within them
        placed.append((left, info.filter(F.col("chunks") <= DIVIDE)))
        again = left.select("sig", "size", "grams").join(info.filter(F.col("chunks") > DIVIDE), "sig").select("sig", "size", F.col("root").alias("cell"), "grams")
        before = large
        left, roots = _narrow(again.dropDuplicates(["sig"]), threshold)
    found = None
    for left, info in placed:
        sets = left.select("sig", "size", "grams").join(info.join(weights, "sig"), "sig")
        sets = sets.withColumn("chunk", F.expr("cast(pmod(xxhash64(sig), chunks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        cells = sets.select("root", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "sig", "size", "weight", "grams")
        parts = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
        sorted_ = cells.repartition(parts, "root", "low", "high").sortWithinPartitions("root", "low", "high", "sig")
        out = sorted_.mapInArrow(lambda it: _cells(it, threshold, listed), "sig_a long, sig_b long, common long, size_a long, size_b long" if listed else "sig long, root long, links long")
        found = out if found is None else found.union(out)
    return members, found, chunked


def similar_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_a, doc_b, jaccard), doc_a < doc_b, of documents whose sets of n-grams have a Jaccard similarity of ``threshold`` or more.

    Every document is a query against all others. Documents with equal sets are
    a class; the lowest of their ids stands for it. Each other document of the
    class has a row with the lowest and jaccard 1, and two classes that reach
    the threshold have one row, of their lowest ids. So each document that has
    a partner is in some row, and ``all_pairs`` spells out the pairs of any
    members of two classes, whose number grows as the square of the copies.
    ``linked`` has a row a document instead.

    No pair is left out: a gram that one document alone has can't be common to
    two, and of the others, ordered by the number of their documents, two sets
    that reach the threshold t share one of the leading |set| - ceil(t * |set|)
    + 1 of both (the exact prefix). Documents that are connected by such grams
    meet in one task, once; if they are too many for one they are divided again
    by the grams that are rare among them, and what stays too large is met
    chunk against chunk. Grams are compared by 40 bits of their hashes.

    Texts of fewer than ``n`` words are one gram. Null, empty and wordless
    texts have no grams and no partners; rows without doc_id can't be named and
    take no part. A text of any length is one set. Ties don't arise, as all
    pairs are given; repeated rows count once, and an id that stands on several
    texts isn't paired with itself. Of an empty table the result is empty. Other
    columns aren't read, whatever their names.
    """
    own = docs.select(F.col(doc_id).alias(doc_id), F.col(text).alias(text)).filter(F.col(doc_id).isNotNull())
    members, pairs = _joined(own, [doc_id], text, n, threshold, True)[:2]
    lowest = members.groupBy("sig").agg(F.min(doc_id).alias("rep"))
    left, right = (lowest.select(F.col("sig").alias(f"sig_{x}"), F.col("rep").alias(x)) for x in "ab")
    distinct = pairs.join(left, "sig_a").join(right, "sig_b").filter("a != b").select(
        F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), (F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))).alias("jaccard")
    )
    equal = members.select("sig", F.col(doc_id).alias("doc_b")).join(lowest, "sig").filter("doc_b != rep")
    return distinct.unionByName(equal.select(F.col("rep").alias("doc_a"), "doc_b", F.lit(1.0).alias("jaccard")))


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links) of each document: the lowest id it is connected with by pairs that reach ``threshold``, and the number of documents that do so with it.

    The pairs are those of any two documents, copies among them, as
    ``similar_pairs`` and ``all_pairs`` spell them out, none left out; here they
    are counted where they are found, so that rows are as many as documents.

    A document without partners is its own class and has no links: null, empty
    and wordless texts too. Rows without doc_id take no part, repeated rows
    count once; an id that stands on texts of different sets has a row for
    each, which count as documents of their own.
    """
    own = docs.select(F.col(doc_id).alias(doc_id), F.col(text).alias(text)).filter(F.col(doc_id).isNotNull())
    members, cells, chunked = _joined(own, [doc_id], text, n, threshold, False)
    cells = _once(cells)
    counted = cells.groupBy("sig").agg(F.sum("links").alias("links"))
    roots = cells.select("sig", "root")
    if chunked:  # a set is in several cells
        roots = _roots(roots.filter("sig != root").toDF("a", "b"))
    placed = members.join(counted.join(roots, "sig", "left"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    copies = members.groupBy("sig").agg((F.count(F.lit(1)) - 1).alias("copies"))
    lowest = placed.groupBy("root").agg(F.min(doc_id).alias("class_id"))
    found = placed.join(copies, "sig").join(lowest, "root").select(doc_id, "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies")).alias("links"))
    wordless = own.select(doc_id).join(members.select(doc_id), doc_id, "left_anti").distinct()
    return found.unionByName(wordless.select(doc_id, F.col(doc_id).alias("class_id"), F.lit(0).cast("long").alias("links")))


def all_pairs(pairs: DataFrame) -> DataFrame:
    """The rows of ``similar_pairs`` with each class spelled out: (doc_a, doc_b, jaccard) of all members of the two classes of a row, and of all pairs within a class. For tables whose ids stand on one text each."""
    same, other = pairs.filter("jaccard = 1"), pairs.filter("jaccard < 1")
    heads = same.select("doc_a").union(other.select("doc_a")).union(other.select("doc_b")).distinct()
    members = same.select(F.col("doc_a").alias("rep"), F.col("doc_b").alias("member")).union(heads.select(F.col("doc_a").alias("rep"), F.col("doc_a").alias("member")))
    left, right = (members.select(F.col("rep").alias(f"doc_{x}"), F.col("member").alias(x)) for x in "ab")
    crossed = other.join(left, "doc_a").join(right, "doc_b").select("a", "b", "jaccard")
    within = left.join(right, F.col("doc_a") == F.col("doc_b")).filter("a < b").select("a", "b", F.lit(1.0).alias("jaccard"))
    return crossed.union(within).select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b): root is the least node of its connected component.

    Large-star and small-star steps by turns until nothing changes, each turn
    cut off with a checkpoint in the cluster's shared folder; a turn shuffles
    the edges twice, and long chains take logarithmically many.
    """
    shared_folder(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct().checkpoint()
    w, before = Window.partitionBy("u"), None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(w))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(w))
        e = small.select("u", F.col("m").alias("v")).union(small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct().checkpoint()


def _without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key isn't in ``gone`` (a checkpointed table of keys): by broadcast while that has up to ``BROADCAST`` rows, by a shuffle beyond; the result is the same."""
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST else gone, key, "left_anti")


def drop_near_copies(docs: DataFrame, text: str = "text", n: int = N, threshold: float = THRESHOLD, keys: int = KEYS) -> DataFrame:
    """``docs`` with one document of each group of near copies: of those linked by pairs as ``similar_pairs`` finds them.

    The document whose key (a 128-bit hash of doc_id and text) is lowest stays,
    which settles ties. Rows that repeat another in doc_id and text are copies
    as well; one stays. Texts without words (null or empty ones too) are no
    copies of anything and stay, one for each key; very long texts are sets
    like any. An empty table stays empty. All columns stay, whatever their names.
    """
    row, rank = fresh(docs, "row_key", "copy_rank")
    keyed = docs.withColumn(row, _row_key(*[c for c in docs.columns if c in ("doc_id", text)]))
    summary, pairs = set_pairs(keyed.select(row, text), [row], row, text, n, threshold, keys)
    roots = components(pairs.select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b")))
    members = summary.select("sig", F.col(row).alias("row")).distinct()
    rooted = members.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("row", F.coalesce("root", "sig").alias("root"))
    keepers = rooted.groupBy("root").agg(F.min("row").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = _once(rooted.join(keepers, "root").filter("row != keep").select(F.col("row").alias(row)))
    # rows that repeat another's key: they alone have to meet for one of them to stay
    twice = _once(keyed.groupBy(row).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(row))
    kept = _without(keyed, gone, row)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not twice.take(1):
        return kept.select(*columns)
    again = kept.join(F.broadcast(twice) if twice.count() <= BROADCAST else twice, row, "left_semi")
    first = again.withColumn(rank, F.row_number().over(Window.partitionBy(row).orderBy(row))).filter(F.col(rank) == 1)
    return _without(kept, twice, row).select(*columns).unionByName(first.select(*columns))
