"""The stages in their order on the small tables, and what each leaves."""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from shelfspark.llm import bpe, decontam, ngramjoin
from shelfspark.llm._text import shared_folder
from tests.llm.test_operators import awkward, brute_spans, english, grams


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line dedup", "near copies", "decontamination", "bpe"]
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).checkpoint()
        left[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == start.columns
    assert len(left["language"]) >= 0.99 * start.count()
    own = [grams(r.text) for r in left["near copies"]]
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            assert not a or len(a & b) < ngramjoin.THRESHOLD * len(a | b)
    for r in left["decontamination"]:
        assert not any(brute_spans(r.text, items, decontam.LENGTH, 2.0, 10**6))
    codec = bpe.Codec(bpe.load_ranks())
    texts = {r.doc_id: r.text for r in left["decontamination"]}
    assert all(r.round_trip and codec.decode(np.array(r.ids)) == texts[r.doc_id] for r in left["bpe"])
    assert len(left["bpe"]) == len(texts)


def test_run_equals_stages(spark, sf):
    out = __spark_entry__.queries()["pipeline"](spark, sf)
    assert out.count() > 100 and out.filter("not round_trip").count() == 0


def test_queries_are_registered():
    numbers = [int(m[1]) for n in __spark_entry__.queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 11))


def awkward_folder(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    item = "in the year of the dragon the river rose above the old stone house by the mill"
    spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return item


def test_run_on_awkward_documents(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and columns of names that stages use."""
    rng = random.Random(21)
    texts = [english(rng, 80) for _ in range(40)]
    item = "in the year of the dragon the river rose above the old stone house by the mill"
    rows = [(100 + k, t) for k, t in enumerate(texts)]
    rows += [(200, texts[0]), (201, texts[0] + " and more"), (202, texts[1] + ". " + item), (203, item)]
    docs = awkward(spark, rows)
    awkward_folder(spark, tmp_path, docs)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    codec = bpe.Codec(bpe.load_ranks())
    text = {i: codec.decode(np.array(r.ids)) for i, r in out.items()}
    assert all(r.round_trip for r in out.values()) and 203 not in out
    assert len({0, 100, 200, 201} & out.keys()) == 1  # one of each group stays
    assert not any(item in t for t in text.values())
    assert sum(i in out for i in range(102, 140)) == 38 and all(text[i] == texts[i - 100] for i in range(102, 140))
    for name, stage in corpus_pipeline.STAGES:  # each stage by itself
        left = stage(spark, docs, str(tmp_path))
        assert left.count() <= docs.count() and (name == "bpe" or left.columns == docs.columns)


def test_run_on_an_empty_table(spark, tmp_path):
    awkward_folder(spark, tmp_path, awkward(spark).limit(0))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_without_languages(spark, tmp_path):
    awkward_folder(spark, tmp_path, awkward(spark).drop("lang", "n_chars"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # no language is known, so all are rejected


def test_a_run_that_fails_leaves_nothing(spark, tmp_path):
    shared = Path(shared_folder(spark).removeprefix("file:"))
    there = {*shared.glob("pipeline-*")}
    awkward(spark, [(9, "some words of a text that stay")]).write.parquet(str(tmp_path / "documents.parquet"))
    with pytest.raises(Exception, match="benchmark"):
        corpus_pipeline.run(spark, str(tmp_path))
    assert {*shared.glob("pipeline-*")} == there
