"""A training corpus from raw documents in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontamination import decontaminate_stage
from tidemark.llm.jaccard_join import near_duplicate_stage
from tidemark.llm.mixing import mixing_stage
from tidemark.llm.shared import cut
from tidemark.llm.sharding import shard_stage
from tidemark.llm.toxicity import toxicity_stage

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mixing_stage),
    ("sharding", shard_stage),
]

#: The fitted classifiers of the first and fourth stage have no SQL form; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with their shard, slot and grown_shard after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
