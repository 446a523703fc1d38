"""Corpus pipeline: toxicity, near-duplicates, personal data, mixing, pieces.

Each stage reads what its predecessor kept, written as Parquet. All but the
last return the columns of ``documents``. Scratch tables of a stage go when its
result is written.

Defined results: documents without a text are ordinary, one of them stays as
the near-duplicate of all empty texts, and have null ids; null sources are one
source; of rows with one doc_id that hold equal texts one stays; the mix may
repeat or drop rows, by whole documents; extra columns pass through the stages,
whatever their names, until the last, which returns its own; very long texts
are treated whole in every stage; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenorlake.llm import mixing, pieces, pii, simhash, toxicity
from tenorlake.llm.common import materialize, release, tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_ids and the decoded text."""
    coded = pieces.round_trip(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", "ids", F.size("ids").alias("n_ids"), "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Kneser-Ney models and fingerprints have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = tables(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        release(spark, docs, but=others)
    return STAGES[-1][1](spark, docs, sf_dir)
