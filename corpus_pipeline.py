"""The training-data pipeline: five operators over ``documents``, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm.decontaminate import drop_contaminated
from lexigrid.llm.language import known_language
from lexigrid.llm.mixing import mixed_rows
from lexigrid.llm.shared import WRITTEN, cut, drop_cuts, table
from lexigrid.llm.simhash import keep_one
from lexigrid.llm.tokens import token_output


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is in doubt, go."""
    return known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the balanced mix of sources takes it, 0 to 2 times."""
    return mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids are written and read back; a row for each document of the mix."""
    return token_output(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_ids),
]

#: The stages learn, embed and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written as Parquet and read again as the next one's documents.

    What a stage has written on its way is deleted as soon as its rows are.
    """
    docs, before = table(spark, sf_dir, "documents"), len(WRITTEN)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
            drop_cuts(spark, before, last=1)
    return docs
