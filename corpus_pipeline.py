"""A corpus pipeline: what a quality classifier rejects goes, recurring lines are cut, one document of each near-duplicate group stays, benchmark passages
are removed, and the rest is encoded and decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.bpe import encoded
from tidewright.llm.common import drop_since, new_path, read, written
from tidewright.llm.decontaminate import decontaminate
from tidewright.llm.lines import dedup_lines
from tidewright.llm.minhash import keep_one
from tidewright.llm.quality import keep_good
from tidewright.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of 0.5 or more."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates, of any length, are cut, but for their first occurrence."""
    return dedup_lines(docs, min_tokens=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more) stays, that of the smallest doc_id."""
    return keep_one(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of several benchmark items go; single passages are cut out."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text."""
    return encoded(docs, tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]
#: The classifier, MinHash and BPE have no SQL; tests/llm/test_pipeline.py holds each stage, on its own input, against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        mark = written()
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_since(mark)  # what the stage wrote on its way
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
