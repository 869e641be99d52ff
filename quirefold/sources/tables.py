"""Readers of the document-model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.session import is_small, materialize

KEY = ["doc_id", "page", "idx"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the model, stored as one parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_once(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, without a shuffle of the other columns where keys stand once: keys alone are counted, in a job of their
    own, and only the rows of repeated keys meet. Rows with a null key are left out. For tables whose keys seldom repeat."""
    df = df.dropna(subset=keys)
    twice = materialize(df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys), "repeated-keys")
    if twice.isEmpty():
        return df
    again = F.broadcast(twice) if is_small(twice) else twice
    return df.join(again, keys, "left_anti").unionByName(df.join(again, keys, "left_semi").dropDuplicates(keys))


def delivered_once(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """One row per key. Re-deliveries carry the same content, so any of them serves."""
    return df.dropDuplicates(keys)
