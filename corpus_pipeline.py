"""From raw documents to token shards: five stages, each written as Parquet and read again.

Every function takes (spark, docs, sf_dir).  All but the last return the columns of
`documents`; the last returns what its shards, read back, hold for each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lantern.llm.decontaminate import decontaminate
from lantern.llm.mixing import mix
from lantern.llm.simhash import near_dedup
from lantern.llm.tables import staged, table
from lantern.llm.token_ids import token_binary
from lantern.llm.toxicity import reject_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return near_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other parameters, go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their weights; a document appears as often as the mixture reads it, once at least."""
    return mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mixture, and what they hold."""
    return token_binary(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_binary", write_tokens),
]

#: Hashes, Viterbi decoding and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
