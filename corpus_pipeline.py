"""Corpus pipeline over `documents`: five stages, each one operator.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame.  Between stages the rows are written as Parquet and reread.
All but the last return the columns of ``docs``.  SQL cannot express the first,
second and last stage, so there is no ``ORACLE_SQL``; ``tests/llm/test_pipeline.py``
holds every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilscore.llm import language, mix, shard, simhash, winnow
from veilscore.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, SHARDS, mix_levels
from veilscore.llm.scratch import stored
from veilscore.sources.tables import read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; a missing `lang` is filled in."""
    return language.identified(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.one_per_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row (or whole short item) with `benchmark`."""
    return winnow.decontaminated(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to the target weights; one row per epoch that takes a document."""
    return mix.mixed_documents(docs, mix_levels(), MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix shuffled into shards: columns of `documents`, shard and slot."""
    return shard.sharded(docs, SHARDS, seed=2024)


STAGES = [
    ("language", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("shards", deal_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
