"""The stages of corpus_pipeline.py: each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import quarterdeck

from . import common, mixing, token_store
from . import quality as quality_model
from .queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    quarterdeck.ship(spark)
    model = quality_model.train(docs, common.labels(spark, sf_dir))
    scored = quality_model.classify(docs, model, keep=tuple(docs.columns), names=("\x01score", "\x01predicted"))
    return scored.where(F.col("\x01predicted") == 1).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    from . import near_duplicates

    quarterdeck.ship(spark)
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    from . import decontamination

    quarterdeck.ship(spark)
    return decontamination.clean(docs, common.benchmark(spark, sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    quarterdeck.ship(spark)
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shard files, read back."""
    quarterdeck.ship(spark)
    return token_store.token_output(docs, vocabulary_path())
