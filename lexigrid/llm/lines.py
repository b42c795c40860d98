"""Line deduplication over range-partitioned hashes; documents get keep bitmaps, not new texts.

Only DataFrame functions run here. Lines become 128-bit hashes of their keys once, in one pass over the
texts. The hashes are range-partitioned by key and sorted by document and position behind the key, largest document
first, and each partition is streamed in that order: the first document of a key keeps its lines, those after it
lose theirs if there are enough of them. A key that many rows have is known beforehand, with its largest document,
and its rows are ranges of their own. What was dropped comes back as run lengths of kept lines, one small row a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm.shared import ascii_lower, by_ranges, cut, hot_keys, join_found, key_limit, table

#: Lines of a range at most, on average: a corpus of more lines has more ranges than the session's shuffles.
RANGE_ROWS = 4_000_000

#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line):
    """A line without blanks at its ends and with A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def line_rows(df: DataFrame, doc: str, text: str, min_chars: int) -> DataFrame:
    """(doc, text_hash, n_lines, pos, h1, h2): a row for each line with a key of enough code points."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(whole).alias("text_hash"), F.split(whole, "\n", -1).alias("lines"))
    rows = rows.select("doc", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    rows = rows.select("doc", "text_hash", "n_lines", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return rows.select("doc", "text_hash", "n_lines", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def frequent_keys(rows: DataFrame, total: int | None = None) -> DataFrame:
    """(h1, h2, times, shards, hot_docs, hot_keeper) of the hot keys: over one row in HOT, or over what a task can hold.

    ``total`` is the number of rows where it is known already.
    """
    total = rows.count() if total is None else total
    hot = hot_keys(rows, ["h1", "h2"], total, F.max("doc").alias("hot_keeper")).withColumn("shards", F.ceil(F.col("times") / key_limit(total)))
    hot = cut(hot, "lines-hot")
    flagged = join_found(rows, hot.select("h1", "h2", "times", F.lit(True).alias("hot")), ["h1", "h2"], "times", total)
    held = flagged.filter("hot").groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    return hot.join(held.groupBy("h1", "h2").agg(F.count("*").alias("hot_docs")), ["h1", "h2"]).select("h1", "h2", "times", "shards", "hot_docs", "hot_keeper")


def dropped_lines(rows: DataFrame, frequent: DataFrame, min_docs: int, total: int | None = None) -> DataFrame:
    """The rows of keys that at least ``min_docs`` documents hold, but those of the largest of the documents.

    One range exchange by key (and shard, for a frequent key) and one sort by (key, document from the largest, position) carry
    all of it: ``turn`` numbers a key's documents in that order, so the first occurrences have turn 1. A group of the windows
    has one key's rows, or one shard's of a frequent key: ``key_limit`` rows or a few more.
    """
    total = rows.count() if total is None else total
    known = join_found(rows, frequent, ["h1", "h2"], "times", total)
    shard = F.when(F.col("shards").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc", "pos"), F.col("shards"))).cast("int")
    ranged = by_ranges(known.withColumn("shard", shard), ["h1", "h2", "shard"], total, RANGE_ROWS)
    stream = Window.partitionBy("h1", "h2", "shard").orderBy(F.col("doc").desc_nulls_last(), "pos")
    key = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fresh = F.when((F.row_number().over(stream) == 1) | ~F.col("doc").eqNullSafe(F.lag("doc").over(stream)), 1).otherwise(0)
    streamed = ranged.withColumn("fresh", fresh).withColumn("turn", F.sum("fresh").over(stream)).withColumn("n_docs", F.sum("fresh").over(key))
    rare = (F.col("n_docs") >= min_docs) & (F.col("turn") > 1)
    often = (F.col("hot_docs") >= min_docs) & ~F.col("doc").eqNullSafe(F.col("hot_keeper"))
    return streamed.filter(F.when(F.col("shards").isNull(), rare).otherwise(often)).select("doc", "text_hash", "n_lines", "pos")


def keep_bitmaps(df: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, text_hash, kept_runs) of the documents that lose lines.

    ``kept_runs`` is the compressed bitmap: how many lines stay before each dropped line, and how
    many after the last. Rows with one id and one text share a bitmap. The same id in several
    rows counts as one document; rows without an id count together as one, the smallest.
    """
    rows = cut(line_rows(df, doc, text, min_chars), "lines")
    total = rows.count()
    dropped = dropped_lines(rows, cut(frequent_keys(rows, total), "lines-frequent"), min_docs, total)
    by_doc = dropped.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("out"), F.first("n_lines").alias("n_lines"))
    before = F.concat(F.array(F.lit(-1)), F.col("out"))
    after = F.concat(F.col("out"), F.array(F.col("n_lines")))
    return by_doc.select("doc", "text_hash", F.zip_with(before, after, lambda a, b: b - a - 1).alias("kept_runs"))


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for each row of ``df``."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(doc).cast("long").alias("doc_id"), whole.alias("whole")).withColumn("hash", F.xxhash64("whole"))
    met = rows.join(bitmaps, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("text_hash")), "left")
    flags = F.flatten(F.transform("kept_runs", lambda n: F.concat(F.array_repeat(F.lit(True), n), F.array(F.lit(False)))))
    kept = F.array_join(F.zip_with(F.split("whole", "\n", -1), flags, lambda line, keep: F.when(keep, line)), "\n")
    n_lines = F.length("whole") - F.length(F.translate("whole", "\n", "")) + 1
    return met.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("kept_runs").isNull(), 0).otherwise(F.size("kept_runs") - 1).cast("long").alias("n_dropped"),
        F.when(F.col("kept_runs").isNull(), F.col("whole")).otherwise(kept).alias("kept_text"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are one empty line; a text that loses all lines becomes empty."""
    docs = table(spark, sf_dir, "documents")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS whole FROM documents),
l AS (
  SELECT doc_id, whole, t.pos AS pos, t.line AS line,
         translate(trim(t.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, LATERAL (SELECT unnest(string_split(whole, chr(10))) AS line,
                          generate_subscripts(string_split(whole, chr(10)), 1) AS pos) t),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.pos, l.line, (k.key IS NOT NULL AND l.doc_id <> k.keeper) AS gone
      FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
