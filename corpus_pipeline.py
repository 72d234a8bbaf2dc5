"""Corpus pipeline: quality, near-duplicates, decontamination, mixing, token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarterdeck.llm import common
from quarterdeck.llm.pipeline_stages import decontaminate, dedup, mix_sources, quality, token_ids

STAGES = [
    ("quality", quality),
    ("minhash", dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("tokens", token_ids),
]

#: The stages learn a model, sample hashes and write binary files; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
