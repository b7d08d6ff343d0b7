"""Corpus pipeline: from raw documents to a mix, in stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with their columns. A
run writes every stage to the shared folder and reads it back, so that a lost executor costs one
stage at most and each stage plans with the real size of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.llm import decontaminate, langid, line_dedup, minhash, mixing
from snapweave.llm.common import set_aside
from snapweave.plans.durable import discard, keep, materialize, scope


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones show; those without letters go."""
    return langid.identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of three-line windows; a document goes if all its lines
    stand in earlier ones. n_chars follows the text."""
    aside, own = set_aside(docs, "doc_id", "text")
    out = line_dedup.dedup_lines(aside).where("n_removed = 0 OR length(text) > 0").select(*own)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.dedup(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often (copies) and the numbers behind it."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", remove_benchmark),
    ("mix", mix_sources),
]

#: Near-duplicates by hashing and a learned language model have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope() as made:  # a stage's own tables go when its result is written
            after = keep(made, materialize(stage(spark, docs, sf_dir), name))
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
