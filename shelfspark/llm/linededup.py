"""Operator 8: line dedup with a log-template tree of fixed depth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm._text import U64, Tokens, fresh, map_pieces, mix, replace

#: A template is dropped once it is in so many documents; one of over LONG words once it is in LONG_DOCUMENTS.
DOCUMENTS, LONG, LONG_DOCUMENTS = 5, 50, 2
#: Share of a document's words from which it counts as a copy as a whole, where copies are left to another operator.
WHOLE = 0.5
#: Lines of fewer words are left alone.
WORDS = 3
#: Leading words below the level of word counts; variable fields are passed over, so that lines that open with numbers part.
LEADING = 3
#: Share of a line's words that equal the template's, place by place.
ALIKE = 0.7
_FIELD = U64(0x5851F42D4C957F2D)


class Lines:
    """The lines of some texts: words, with words that hold a digit made one variable field."""

    def __init__(self, texts: list):
        t = Tokens(texts)
        digits = np.zeros(len(t.bytes) + 1, np.int64)
        np.cumsum((t.bytes >= 48) & (t.bytes <= 57), out=digits[1:])
        words = np.where(digits[t.ends] > digits[t.starts], _FIELD, t.h)
        feeds = np.flatnonzero((t.bytes == 10) | (t.bytes == 0))
        self.cut = np.concatenate(([0], np.searchsorted(t.starts, feeds), [len(t.starts)]))
        self.words = words
        self.n = np.diff(self.cut)
        self.doc = np.zeros(len(self.n), np.int64)
        self.doc[1:] = np.cumsum(t.bytes[feeds] == 0)
        with np.errstate(over="ignore"):
            place = np.arange(len(words)) - np.repeat(self.cut[:-1], self.n)
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(mix(words + place.astype(np.uint64) * U64(0xD1B54A32D192ED03)), out=sums[1:])
            self.whole = mix(sums[self.cut[1:]] - sums[self.cut[:-1]] + self.n.astype(np.uint64))
            leaf = self.n.astype(np.uint64)
            fixed = np.flatnonzero(words != _FIELD)
            line = np.repeat(np.arange(len(self.n)), self.n)[fixed]
            rank = np.arange(len(fixed)) - np.searchsorted(line, line)
            for k in range(LEADING):
                at = np.flatnonzero(rank == k)
                leaf[line[at]] = mix(leaf[line[at]] * U64(0x9FB21C651E98DF25) + words[fixed[at]])
            self.leaf = leaf


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _scan(lines: DataFrame, key: str, text: str, least: int, words: bool) -> DataFrame:
    """(leaf, line, doc[, words]): each document's distinct lines of ``least`` words, words as 16 bits each."""
    schema = "leaf long, line long, doc long" + ", words binary" * words

    def run(part: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        x = Lines(texts)
        keys = part.column(part.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        use = np.flatnonzero(x.n >= least)
        with np.errstate(over="ignore"):
            _, once = np.unique(mix(x.whole[use] + x.doc[use].astype(np.uint64) * _FIELD), return_index=True)
        use = use[np.sort(once)]
        out = [_signed(x.leaf[use]), _signed(x.whole[use]), pa.array(keys[x.doc[use]])]
        if words:
            short = (x.words >> U64(48)).astype(np.uint16)
            out.append(pa.array([short[a:b].tobytes() for a, b in zip(x.cut[use], x.cut[use + 1])], pa.binary()))
        return pa.RecordBatch.from_arrays(out, names=["leaf", "line", "doc", "words"][: len(out)])

    return map_pieces(lines, text, run, schema)


class Leaf:
    """The templates of one leaf: distinct lines join, in order of their hashes, the template they are most alike, or found one.

    A template's word that differs from a joining line's becomes a field that
    no word equals. A line can only join a template that shares a word with it
    at one of the first places enough to make up what may differ, so templates
    are looked up by those.
    """

    def __init__(self, size: int, alike: float):
        self.need = max(1, int(np.ceil(alike * size - 1e-9)))
        self.probes = size - self.need + 1
        self.words: list[np.ndarray] = []
        self.members: list[list[int]] = []
        self.by: dict[tuple[int, int], list[int]] = {}

    def add(self, words: np.ndarray, member: int) -> None:
        count: dict[int, int] = {}
        for p, w in enumerate(words[LEADING : LEADING + self.probes].tolist(), LEADING):
            for k in self.by.get((p, w), ()):
                count[k] = count.get(k, 0) + 1
        found, most = -1, self.need - 1
        leading = min(LEADING, len(words))
        if not count and self.need <= leading and self.words:
            count = dict.fromkeys(range(len(self.words)), 0)
        for k in sorted(count):
            n = int((self.words[k] == words).sum())
            if n > most:
                found, most = k, n
        if found >= 0:
            own = self.words[found]
            own[own != words] = -1
            self.members[found].append(member)
            return
        k = len(self.words)
        self.words.append(words.astype(np.int32))
        self.members.append([member])
        for p, w in enumerate(words.tolist()[LEADING : LEADING + self.probes], LEADING):
            self.by.setdefault((p, w), []).append(k)


def _templates(batches, documents: int, alike: float, long: int, long_documents: int):
    """Recurring lines of batches sorted by leaf and line: (line, keeper, template, floor, few).

    ``template`` is null where the counts and first documents of lines show
    that it recurs; elsewhere its documents have to be counted against
    ``floor``. ``few`` is 0 where they show that it does in ``documents``.
    """
    names = ["line", "keeper", "template", "floor", "few"]
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table):
        leaf = table["leaf"].to_numpy()
        line, n, first = table["line"].to_numpy(), table["n"].to_numpy(), table["first"].to_numpy()
        floor = np.where(pc.binary_length(table["words"]).to_numpy() > 2 * long, min(documents, long_documents), documents)
        at = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1], [True])))
        totals = np.add.reduceat(n, at[:-1])
        lines, keepers, templates, floors, few = [], [], [], [], []
        for g in np.flatnonzero(totals >= np.minimum.reduceat(floor, at[:-1])):
            rows = range(at[g], at[g + 1])
            if len(rows) == 1:
                groups = [list(rows)]
            else:
                words = [np.frombuffer(w, np.uint16) for w in table["words"].slice(at[g], len(rows)).to_pylist()]
                by_size: dict[int, Leaf] = {}
                for k, w in zip(rows, words):
                    by_size.setdefault(len(w), Leaf(len(w), alike)).add(w, k)
                groups = [m for x in by_size.values() for m in x.members]
            for m in groups:
                need, most = int(floor[m[0]]), n[m].max()
                if n[m].sum() < need:
                    continue
                firsts = len(np.unique(first[m]))
                sure = most >= need or firsts >= need
                if sure or most > 1:  # lines of one document each have no more documents than first ones
                    lines.extend(line[m].tolist())
                    keepers.extend([int(first[m].min())] * len(m))
                    templates.extend([None if sure else int(line[m[0]])] * len(m))
                    floors.extend([need] * len(m))
                    few.extend([int(most < documents and firsts < documents)] * len(m))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (lines, keepers, templates, floors, few)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        leaf = batch.column(0).to_numpy()
        last = int(np.searchsorted(leaf, leaf[-1], "left"))
        if last:
            yield done(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif held and held[0].column(0)[0].as_py() != leaf[0]:
            yield done(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(last))
    if held:
        yield done(pa.Table.from_batches(held))


def drop_lines(docs: DataFrame, text: str = "text", documents: int = DOCUMENTS, words: int = WORDS, alike: float = ALIKE, flags: bool = False, long: int = LONG, long_documents: int = LONG_DOCUMENTS, whole: float | None = None) -> DataFrame:
    """``docs`` without lines whose template recurs in at least ``documents`` documents, or in ``long_documents`` if it has over ``long`` words.

    The tree has a level for the number of words and one for each of the first
    ``LEADING`` fixed words, words with digits being variable fields. In a
    leaf, lines of which a share ``alike`` of the words equals a template's
    belong to it. A recurring template stays in one document, the one whose
    key (a hash of the row) is lowest, and goes from all others; a document
    nothing is left of goes. Lines of fewer than ``words`` words stay.

    Null and empty texts stay; very long ones are lines like any, and of a text
    that loses a line NULs become blanks. Ties of the lowest key can only be
    between repeated rows. An empty table gives no rows. A repeated row is a document more with the same
    key, so copies of the keeper keep the template too. All columns stay,
    whatever their names; ``n_chars``, if there, follows the text. With
    ``flags`` no row goes, but ``dropped_lines`` and ``emptied`` are added.

    A document counts once a template, however many of its lines belong to it.
    With ``whole``, a document keeps the long lines that go for being in few
    documents if they are that share of its words: it is a copy as a whole, for
    an operator that drops copies to find, which it couldn't in what is left.

    Two shuffles of lines (hash, key and 16 bits a word; a line's occurrences
    are combined before the first), one of the lines' keys, two of the keys of
    recurring lines, and one of docs against the lists of lines to drop.
    """
    key, drop = fresh(docs, "row_key", "drop_lines")
    keyed = docs.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c in ("doc_id", text)]))
    slim = keyed.select(key, text)
    lines = _scan(slim, key, text, words, True).groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"), F.min("words").alias("words"))
    sorted_ = lines.repartition("leaf").sortWithinPartitions("leaf", "line")
    recurring = sorted_.mapInArrow(lambda it: _templates(it, documents, alike, long, long_documents), "line long, keeper long, template long, floor long, few long")
    hits = _scan(slim, key, text, words, False).join(recurring, "line").filter("template is not null or doc != keeper")
    # by template where its documents are to be counted, by document elsewhere; a document's rows all have all of its lines
    apart = hits.withColumn("alone", F.expr("if(template is null, doc, null)")).repartition("template", "alone")
    own = apart.groupBy("template", "alone", "doc").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.struct("line", "few")).alias("lines"), F.first("keeper").alias("keeper"), F.first("floor").alias("floor"))
    counted = own.groupBy("template", "alone").agg(F.sum(F.expr("n div size(lines)")).alias("documents"), F.collect_list(F.struct("doc", "lines", "keeper")).alias("own"), F.first("floor").alias("floor"))
    lists = (
        counted.filter("template is null or documents >= floor")
        .select("template", F.inline("own"))
        .filter("template is null or doc != keeper")
        .groupBy(F.col("doc").alias(key))
        .agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias(drop))
    )
    joined = keyed.join(lists, key, "left").drop(key)
    added = fresh(docs, "dropped_lines", "emptied")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(added, (T.LongType(), T.BooleanType())))][: len(docs.columns) + 2 * flags])

    def clean(part: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        at = part.schema.get_field_index(drop)
        lists_ = part.column(at)
        part = part.select([f for f in part.schema.names if f != drop])
        lost, emptied = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        hit = np.flatnonzero(lists_.is_valid().to_numpy(zero_copy_only=False))
        if len(hit):
            new, own = list(texts), [texts[k] for k in hit]
            x = Lines(own)
            first = np.searchsorted(x.doc, np.arange(len(own) + 1))
            for j, k in enumerate(hit):
                own_lines, n = x.whole[first[j] : first[j + 1]].view(np.int64), x.n[first[j] : first[j + 1]]
                listed = lists_[int(k)].values
                line, few = (c.to_numpy(zero_copy_only=False) for c in listed.flatten())
                gone = np.isin(own_lines, line) & (n >= words)
                if whole is not None:
                    rare = gone & (n > long) & np.isin(own_lines, line[few > 0])
                    if n[rare].sum() >= whole * n.sum():
                        gone &= ~rare
                rest = [s for s, g in zip(texts[k].replace("\x00", " ").split("\n"), gone) if not g]
                lost[k] = gone.sum()
                new[k] = "\n".join(rest)
                emptied[k] = not new[k].strip()
            changed = {text: new}
            if "n_chars" in part.schema.names:
                old = part.column(part.schema.get_field_index("n_chars")).to_pylist()
                changed["n_chars"] = [len(new[k]) if lost[k] else old[k] for k in range(len(new))]
            part = replace(part, changed)
        if flags:
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(lost), pa.array(emptied)], names=[*part.schema.names, *added])
        return part.filter(pa.array(~emptied)) if emptied.any() else part

    return map_pieces(joined, text, clean, schema)
