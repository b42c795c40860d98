"""Streams of notes: the stateless operators on unbounded tables, and the two aggregates that make sense there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.plans import pipelines


def document_stats(notes: DataFrame) -> DataFrame:
    """The columns of the batch query for each arriving (filename, text); no state is kept."""
    return pipelines.document_stats(notes)


def counts_by_window(events: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows by window and key; rows later than the watermark are not counted, and a window is given once it is past."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_seen(entities: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key's first row within the watermark; repeats go."""
    return entities.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append a stream to Parquet, exactly once by way of its checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
