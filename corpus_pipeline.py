"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Quality rules drop documents, line dedup shortens texts, the n-gram join keeps one document of each group of near
copies, decontamination drops documents that hold benchmark passages, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quartier.llm import bpe, decontaminate, linededup, ngramjoin, quality
from quartier.llm.store import written

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", linededup.stage),
    ("ngram_join", ngramjoin.stage),
    ("decontamination", decontaminate.stage),
    ("byte_bpe", bpe.stage),
]

#: The similarity joins and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
