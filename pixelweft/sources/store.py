"""Intermediate results in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and everything runs on this machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="pixelweft-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder.

    A checkpoint carries on the size that Spark has reckoned for df's plan. This is the
    product of both sides of every join, so after a few rounds of joins it has millions
    of digits, and knows nothing of the rows that explode() adds, so that large tables
    look small enough for a broadcast. Without it joins go by the sizes that AQE measures.
    """
    spark = df.sparkSession
    folder(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)
