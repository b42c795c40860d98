"""Sinks: tables, per-key folders, JSON and a markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Spark's writer would trim every field.
AS_THEY_ARE = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_tsv(df: DataFrame, path: str, columns: list[str] | None = None, order: list[str] | None = None, by: list[str] | None = None) -> None:
    """Tab-separated with a header; nulls are blank. ``by`` makes a folder for each value."""
    rows = df.select(*columns) if columns else df
    rows = rows.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns])
    writer = (rows.sortWithinPartitions(*order) if order else rows).write.mode("overwrite").options(**AS_THEY_ARE).option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").options(**AS_THEY_ARE).option("header", True).option("escape", '"').csv(path)


def write_text(df: DataFrame, path: str, text: str, by: list[str] | None = None) -> None:
    writer = df.select(*(by or []), F.col(text)).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).text(path)


def write_summary(summary: DataFrame, documents: DataFrame, key: str, path: str) -> None:
    """A row of JSON for the summary and one for each document, by key, as lines."""
    one = summary.select(F.lit("summary").alias("kind"), F.lit(None).cast("string").alias("key"), F.to_json(F.struct("*")).alias("body"))
    many = documents.select(F.lit("document").alias("kind"), F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("body"))
    one.unionByName(many).write.mode("overwrite").json(path)


def write_object(summary: DataFrame, documents: DataFrame, key: str, path: str) -> None:
    """One JSON object {"summary": ..., "documents": {key: ...}} as lines of text: a line a document, in one file, in order of key."""
    keep = {"ignoreNullFields": "false"}
    head = summary.select(F.lit(0).alias("part"), F.lit("").alias("at"), F.concat(F.lit('{"summary": '), F.to_json(F.struct("*"), keep), F.lit(', "documents": {')).alias("line"))
    body = documents.select(F.lit(1).alias("part"), F.col(key).cast("string").alias("at"), F.concat(F.to_json(F.array(F.col(key).cast("string"))), F.lit(": "), F.to_json(F.struct("*"), keep)).alias("line"))
    body = body.withColumn("line", F.regexp_replace("line", r'^\[("(?:[^"\\]|\\.)*")\]', "$1"))
    first = body.agg(F.min("at").alias("least"))
    body = body.join(F.broadcast(first), F.lit(True)).select("part", "at", F.when(F.col("at") == F.col("least"), F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("line"))
    tail = head.select(F.lit(2).alias("part"), F.lit("").alias("at"), F.lit("}}").alias("line"))
    head.unionByName(body).unionByName(tail).orderBy("part", "at").coalesce(1).select("line").write.mode("overwrite").text(path)


def label_name(label: str) -> str:
    """A label as part of a file name."""
    return label.replace(" ", "_").replace("/", "_")


def write_knowledge_base(kb: DataFrame, path: str) -> None:
    """``kb(label, cui, name)`` as a folder for each label, and ``kb_all`` with the distinct names of all; each in order of concept, then name."""
    named = kb.select(F.translate("label", " /", "__").alias("label"), "cui", "name")
    by_label = named.repartitionByRange("label", "cui", "name").sortWithinPartitions("label", "cui", "name")
    by_label.write.mode("overwrite").options(**AS_THEY_ARE).option("sep", "\t").option("header", False).option("quote", '"').option("escape", '"').partitionBy("label").csv(f"{path}/labels")
    kb.select("cui", "name").distinct().orderBy("cui", "name").write.mode("overwrite").options(**AS_THEY_ARE).option("sep", "\t").option("header", False).option("quote", '"').option("escape", '"').csv(f"{path}/kb_all")


def write_cached(df: DataFrame, path: str, keys: tuple = ("encoder", "text"), by: list[str] | None = None) -> DataFrame:
    """Parquet in place of an object cache: rows whose keys it lacks are added, and all are read back.

    A vector belongs to its encoder and text, so the keys are both where a frame has them. ``by`` makes a folder for each value, such as
    the entity type.
    """
    there = [k for k in (*keys, *(by or [])) if k in df.columns]
    spark = df.sparkSession
    try:
        known = spark.read.parquet(path)
    except Exception as missing:  # nothing is cached yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        new = df.dropDuplicates(there) if there else df
    else:
        new = df.dropDuplicates(there).join(known.select(*there).distinct(), there, "left_anti") if there else df
    writer = new.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.parquet(path)


def missing_from_cache(texts: DataFrame, cache: DataFrame, key: str = "text") -> DataFrame:
    """Texts that no cached row has yet."""
    return texts.select(key).distinct().join(cache.select(key), key, "left_anti")


def report(summary: DataFrame, title: str) -> str:
    """A markdown table of a summary, which has a row a metric."""
    rows = summary.collect()
    lines = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + "---|" * len(summary.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"


def corpus_report(summary: DataFrame, vocabulary: int, categories: DataFrame, title: str = "Corpus statistics") -> str:
    """A markdown report: the corpus as a whole, then each metric's summary, then how both were counted."""
    listed = categories.orderBy("disease").collect()
    whole = [("Documents", sum(r["documents"] for r in listed)), ("Categories", len(listed)), ("Vocabulary", vocabulary), ("Sentences", sum(r["sentences"] or 0 for r in listed))]
    lines = [f"# {title}", "", "| Corpus | Value |", "|---|---|", *[f"| {k} | {v} |" for k, v in whole], "", report(summary, "Documents").removeprefix("# Documents\n\n"), "## Notes", ""]
    lines += ["- Words are runs of letters, digits and underscores, joined by hyphens or apostrophes.", "- Sentences end at a full stop, question or exclamation mark before a capital or a digit.", "- Deviations are of the whole population; quartiles are interpolated."]
    return "\n".join(lines) + "\n"
