"""The corpus pipeline: documents to token ids, in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each as Parquet and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import bpe, decontam, langid, linededup, ngramjoin
from shelfspark.llm._text import fresh, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; ``lang`` becomes the language found. Rejected ones (null, wordless or of no known language) go."""
    predicted, rejected = fresh(docs, "predicted", "rejected")
    found = langid.identify(docs)
    found = found.filter(f"not `{rejected}`")
    return found.select(*[found[predicted].alias("lang") if c == "lang" else found[f"`{c}`"] for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines, as ``linededup.drop_lines``; those of which nothing is left go. Copies of whole documents are left to the next stage. Null and empty texts stay."""
    return linededup.drop_lines(docs, whole=linededup.WHOLE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, as ``ngramjoin.drop_near_copies``. Texts without words stay, repeated rows once."""
    return ngramjoin.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, as ``decontam.decontaminate``; those that consist of them go. Null and empty texts stay."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of each document, as ``bpe.encode``. Null texts have null ids, empty ones none."""
    return bpe.encode(docs, keep=["doc_id"])


STAGES = [("language", language), ("line dedup", lines), ("near copies", near_copies), ("decontamination", benchmark), ("bpe", tokens)]
#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written to the cluster's shared folder and read again.

    What the stage before left is deleted once the next is written, and all of
    it if a stage fails; the last table stays, as the result is read from it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"

    def delete(at: str) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                delete(f"{folder}/{k - 1}")
    except BaseException:
        delete(folder)
        raise
    return docs
