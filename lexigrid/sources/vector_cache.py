"""Vectors that have been encoded before, as a table bucketed by text: a join with it moves the asked texts and never the cache."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import backends as B

#: Buckets of a cache. A cache keeps the number that it was made with, which its folder's name should tell if it is another.
BUCKETS = 64


def cache_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> str:
    """The name of the table (encoder, text, vec) over the files in ``path``, which may not exist yet; it is made known to this session."""
    name = "vectors_" + hashlib.sha256(path.encode()).hexdigest()[:16]
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (encoder STRING, text STRING, vec ARRAY<FLOAT>) USING parquet CLUSTERED BY (text) SORTED BY (text) INTO {buckets} BUCKETS LOCATION '{where}'")
    spark.catalog.refreshTable(name)
    return name


def cached_vectors(texts: DataFrame, encoder: B.Encoder, key: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """(text, vec) for each distinct text of ``texts(text)``; only those that the cache lacks under ``key`` are encoded, and added to it.

    Rows are appended by Spark's commit, so that those of a failed job never show. Two writers may add a text twice: any of
    its rows counts, as an encoder gives a text one vector. A null text has no vector.
    """
    spark = texts.sparkSession
    name = cache_table(spark, path, buckets)
    held = lambda: spark.table(name).filter(F.col("encoder") == key)
    asked = texts.select("text").filter("text IS NOT NULL").distinct()
    missing = asked.join(held().select("text").hint("merge"), "text", "left_anti")
    new = missing.repartition(buckets, "text").select(F.lit(key).alias("encoder"), "text", B.encode(F.col("text"), encoder).alias("vec"))
    new.write.insertInto(name)
    spark.catalog.refreshTable(name)
    once = held().groupBy("text").agg(F.first("vec").alias("vec"))  # in the table's own buckets
    return asked.join(once.hint("merge"), "text")
