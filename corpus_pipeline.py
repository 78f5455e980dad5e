"""Documents to token files, in stages that each take what the one before kept.

Defined results: rows with a NULL or blank text fail the quality rules; NULL languages and sources are groups of their own; a NULL doc_id is kept by
every stage that compares documents, as it is linked with nothing; rows that repeat a doc_id are judged alike by the near-duplicate stage, so they stay or go
together, and are rows of their own in the mix; very long texts are taken whole; an empty table gives empty stages. Further columns of the input are kept up to
the last stage, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stowage.llm.decontamination import without_contaminated
from stowage.llm.mixing import mixed
from stowage.llm.near_dups import keep_one_per_group
from stowage.llm.quality import filter_quality
from stowage.llm.token_files import token_output
from stowage.session import configure, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return filter_quality(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source comes to its share: a document appears once for each pass that takes words of it."""
    return mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' index; the files stay in the shared folder."""
    import public_tokenizers

    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"), last=True)


def configured(stage: Stage) -> Stage:
    """A stage in a session with the settings that every job relies on, whoever calls it."""
    return lambda spark, docs, sf_dir: stage(configure(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("quality", configured(quality_stage)),
    ("near_dups", configured(near_dup_stage)),
    ("decontamination", configured(decontamination_stage)),
    ("mixing", configured(mixing_stage)),
    ("token_files", configured(token_stage)),
]

#: Some stages have no SQL form; their tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
