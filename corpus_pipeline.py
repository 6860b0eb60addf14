"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet and reads again as the next one's docs. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pixelweft.llm import decontam, mixing, quality, secrets, simhash
from pixelweft.llm.common import read_table, removed, shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts have the score of those, and stay or go together; ties and
    repeated rows do as well, as a score depends on the text alone.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Texts are near if the SimHashes of their words are within 8 bits, those of their
    five-word shingles within 18, and the sets of these shingles have 0.8 of their
    union in common, which is looked at exactly. Null
    and empty texts are one group. Of repeated rows one stays, of different texts
    with the smallest id the one with the smallest hash; rows without an id go where
    their group has one.
    """
    return simhash.near_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of five words or more.

    Null and empty texts stay; repeated rows stay or go together.
    """
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials masked in their texts.

    Null texts stay null; a null source is an owner of its own, repeated rows are one
    document among those that hold a value.
    """
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mixture takes of each document.

    Null and empty texts have no words and are kept with none taken; a null source is
    the last one; repeated rows are documents of their own.
    """
    return mixing.mix(docs)


STAGES = [("quality", keep_good), ("near_dedup", keep_first_copies), ("decontamination", drop_leaks), ("secrets", mask_secrets), ("mixing", mixture)]

#: SQL can state neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of documents; a stage's table goes when the next one is written."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        if before:
            removed(spark, f"{folder}/{before}")
        before = name
    return docs
