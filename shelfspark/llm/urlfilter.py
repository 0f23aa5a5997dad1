"""Operator 1: logistic regression on hashed character n-grams of a URL's host and path."""

from __future__ import annotations

import pkgutil
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm._text import fresh, map_pieces

BUCKETS, GRAMS = 1 << 16, (2, 3, 4)
#: URLs whose probability is at least so high are blocked.
BLOCK = 0.5
#: Weight of unwanted rows against all; by cross-validation with whole hosts held out, of 0.3 to 0.8.
UNWANTED = 0.65
#: Labelled rows a filter is fitted on, at most.
ROWS = 20_000

def labelled_urls() -> list[tuple[str, int]]:
    """The small table of (url, label) that a filter is fitted on by default, urls.txt; 1: unwanted."""
    lines = (pkgutil.get_data(__package__, "urls.txt") or b"").decode().splitlines()
    return [(f"https://{host}{path}", int(label)) for label, host, *paths in map(str.split, lines) if label != "#" for path in paths]


def split_url(url: str) -> tuple[str, str]:
    """(host, path with query and fragment), lower-cased; scheme, user, port and a leading www. or m. are left out."""
    rest = url.strip().lower()
    if "://" in rest:
        rest = rest.split("://", 1)[1]
    at = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host = rest[:at].rsplit("@", 1)[-1].split(":", 1)[0]
    return host.removeprefix("www.").removeprefix("m."), rest[at:]


def features(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all URLs' n-grams (host and path apart), the row of each, and its value: the root of its share of the host's or the path's grams."""
    raw = [f"\x01{h}\x01\x02{p}\x02".encode("utf-8", "surrogatepass") for h, p in map(split_url, urls)]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in raw], np.int64)
    row = np.repeat(np.arange(len(raw)), sizes)
    starts = np.cumsum(sizes) - sizes
    host_bytes = np.array([r.index(b"\x02") for r in raw], np.int64)
    path = np.arange(len(b)) - np.repeat(starts, sizes) >= np.repeat(host_bytes, sizes)
    buckets, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(b) < n:
                continue
            code = np.zeros(len(b) - n + 1, np.uint64)
            for k in range(n):
                code = code * np.uint64(0x100000001B3) + b[k : len(b) - n + 1 + k] + np.uint64(1)
            code = (code + path[: len(code)].astype(np.uint64) * np.uint64(77)) * np.uint64(0x9E3779B97F4A7C15)
            whole = (row[: len(code)] == row[n - 1 :]) & (path[: len(code)] == path[n - 1 :])
            buckets.append((code[whole] >> np.uint64(48)).astype(np.int64))
            parts.append(2 * row[: len(code)][whole] + path[: len(code)][whole])
    part = np.concatenate(parts)
    return np.concatenate(buckets), part // 2, 1 / np.sqrt(np.maximum(1, np.bincount(part, minlength=2 * len(raw))))[part]


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def probability(self, urls: list[str]) -> np.ndarray:
        buckets, rows, values = features(urls)
        z = np.bincount(rows, self.weights[buckets] * values, minlength=len(urls)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(urls: list[str], labels: list[int], rounds: int = 600, rate: float = 4.0, decay: float = 1e-5, unwanted: float = UNWANTED) -> UrlModel:
    """Full-batch gradient descent with momentum on the mean log loss, in which unwanted rows have the share ``unwanted``; the order of the rows doesn't matter."""
    y = np.array(labels, float)
    w, bias = np.zeros(BUCKETS), 0.0
    if not len(y) or y.min() == y.max():
        return UrlModel(w, 50.0 if len(y) and y.min() else -50.0)
    buckets, rows, scale = features(urls)
    share = np.where(y > 0, unwanted / y.sum(), (1 - unwanted) / (1 - y).sum())
    used, at = np.unique(buckets, return_inverse=True)
    v, speed, bias_speed = np.zeros(len(used)), np.zeros(len(used)), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(rows, v[at] * scale, minlength=len(y)) + bias)))
        e = (p - y) * share
        speed = 0.9 * speed - rate * (np.bincount(at, e[rows] * scale, minlength=len(used)) + decay * v)
        bias_speed = 0.9 * bias_speed - rate * e.sum()
        v, bias = v + speed, bias + bias_speed
    w[used] = v
    return UrlModel(w, float(bias))


def fit(labelled: DataFrame | None = None, url: str = "url", label: str = "label", rows: int = ROWS) -> UrlModel:
    """A model from ``labelled`` (the built-in table if None): its ``rows`` rows of lowest hash, without nulls, repeated rows counted once."""
    if labelled is None:
        table = labelled_urls()
    else:
        found = labelled.filter(F.col(url).isNotNull() & F.col(label).isNotNull()).select(F.col(url).alias("u"), F.col(label).cast("int").alias("y")).distinct()
        table = [(r.u, r.y) for r in found.orderBy(F.xxhash64("u"), "u", "y").limit(rows).collect()]
    return train([u for u, _ in table], [int(y > 0) for _, y in table])


def filter_urls(pages: DataFrame, model: UrlModel, url: str = "url", keep: list[str] | None = None, least: float = BLOCK) -> DataFrame:
    """Columns ``keep`` (all if None) with ``host``, ``probability`` that the URL is unwanted and ``blocked``.

    Null URL: null host and probability, not blocked. An empty one is judged by
    what the model makes of no host and no path. A very long one is judged as a whole, its grams
    weighing less each. Ties with the bound are blocked. Rows are independent;
    repeated ones are judged alike. An empty table gives no rows. Names in use
    are underscored. One pass, reading only ``keep`` and the URL; the model is
    of fixed size.
    """
    keep = pages.columns if keep is None else keep
    held = pages.sparkSession.sparkContext.broadcast(model)
    names = fresh(keep, "host", "probability", "blocked")
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])

    def run(part: pa.RecordBatch, urls: list) -> pa.RecordBatch:
        none = np.array([u is None for u in urls], bool)
        p = held.value.probability([u or "" for u in urls])
        hosts = [None if u is None else split_url(u)[0] for u in urls]
        new = [pa.array(hosts, pa.string()), pa.array(p, mask=none), pa.array((p >= least) & ~none)]
        return pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), *new], names=[*keep, *names])

    return map_pieces(pages.select(*dict.fromkeys([*keep, url])), url, run, schema)
