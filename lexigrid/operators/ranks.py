"""Rows by their rank within a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Whole rows, the first in order of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def top_per(rows: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("long"))
