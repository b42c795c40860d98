"""Clinical tables made from the shared test tables, each in Spark and as SQL.

No clinical data is at hand, so each role has a stand-in: documents are notes, frequent words are
entity mentions, conversation turns are sentence pairs, parts and line items are the concept tables, and the
embeddings are the encoded names. Whole tables are used throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (token, label in the gold annotation, label in the prediction); None where a side has no such entity.
LEXICON = (
    ("thon", "disease", "disease"), ("thnt", "symptom", "symptom"), ("thre", "drug name", "drug name"), ("thble", "drug dosage", "drug dosage"), ("thsh", "body site", "body site"),
    ("thly", "laboratory test", "laboratory test"), ("thing", "laboratory result", "laboratory test"), ("thin", "medication", "drug name"), ("qui", "disease", "disorder"), ("für", "disease", "disease"),
    ("auf", "symptom", "symptom"), ("por", "drug name", "drug name"), ("dans", "symptom", None), ("pour", "disease", None), ("eron", None, "symptom"), ("erth", None, "disease"),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """(filename, text, lang, source, doc_id): the stem names language, source and number."""
    d = table(spark, sf, "documents")
    return d.select(F.concat_ws("_", "lang", "source", "doc_id").alias("stem"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")


NOTES = "notes AS (SELECT lang || '_' || source || '_' || doc_id AS stem, coalesce(text, '') AS text, doc_id FROM documents)"


def found_tokens(rows: DataFrame, key: str, text: str, side: str) -> DataFrame:
    """(key, start, end, text, label): tokens of the lexicon in a text, with offsets in code points; ``side`` is gold or pred.

    A text is split once. Expressions would do it anew for each filter that Spark derives from the rows they explode into.
    """
    column = 1 if side == "gold" else 2
    return looked_up(rows, key, text, {row[0]: row[column] for row in LEXICON if row[column]})


def looked_up(rows: DataFrame, key: str, text: str, known: dict[str, str]) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    return rows.filter(F.col(text).isNotNull()).select(key, text).mapInArrow(_lookup(key, known), f"`{key}` {kind}, start bigint, `end` bigint, text string, label string")


#: Texts whose tokens are held at once.
TEXTS = 256


def _lookup(key: str, known: dict[str, str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words, labels = pa.array(list(known)), pa.array(list(known.values()))
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(lo, TEXTS)
                split = pc.split_pattern(batch.column(1), " ")
                tokens, row = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
                ends = np.cumsum(pc.utf8_length(tokens).to_numpy().astype(np.int64) + 1)  # with a space after each
                first = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())[:-1]])
                base = np.concatenate([[0], ends])[first]  # where a row's text begins
                which = pc.index_in(tokens, words)
                at = np.flatnonzero(pc.is_valid(which).to_numpy(zero_copy_only=False))
                found, which = tokens.take(pa.array(at)), which.take(pa.array(at))
                end = ends[at] - 1 - base[row[at]]
                start = end - pc.utf8_length(found).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at])), pa.array(start), pa.array(end), found, labels.take(which)], [key, "start", "end", "text", "label"])

    return run


def mentions(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """(doc_id, ent, start, end, text, label): tokens of the lexicon in documents."""
    return found_tokens(table(spark, sf, "documents"), "doc_id", "text", side).withColumn("ent", F.col("start"))


def sided_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, start, end, text, source, label): the mentions of both sides, gold and pred, from one look-up of the texts."""
    kinds = [(row[0], side, row[column]) for row in LEXICON for side, column in (("gold", 1), ("pred", 2)) if row[column]]
    told = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(kind, ("text", "source", "label"))]) for kind in kinds])))
    found = looked_up(table(spark, sf, "documents"), "doc_id", "text", {row[0]: row[0] for row in LEXICON}).drop("label")
    return found.join(F.broadcast(told), "text")


def mentions_sql(side: str, name: str, docs: str = "documents") -> str:
    column = 1 if side == "gold" else 2
    rows = ", ".join(f"('{r[0]}', '{r[column]}')" for r in LEXICON if r[column])
    return f"""{name} AS (
  SELECT t.doc_id, CAST(t.start AS BIGINT) AS start, CAST(t.start + length(t.tok) AS BIGINT) AS "end", t.tok AS text, x.label, CAST(t.start AS BIGINT) AS ent
  FROM (SELECT doc_id, tok, coalesce(sum(length(tok) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) AS pos FROM {docs} WHERE text IS NOT NULL)) t
  JOIN (VALUES {rows}) AS x(tok, label) ON t.tok = x.tok)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(filename, bead_idx, source, hypothesis): a user turn with the assistant turn after it."""
    c = table(spark, sf, "conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    answer = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return user.join(answer, ["conv_id", "turn"], "left").select(F.concat(F.lit("conv_"), "conv_id", F.lit(".txt")).alias("filename"), F.col("turn").alias("bead_idx"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("hypothesis", F.lit("")).alias("hypothesis"))


PAIRS = """pairs AS (
  SELECT 'conv_' || u.conv_id || '.txt' AS filename, u.turn AS bead_idx, coalesce(u.text, '') AS source, coalesce(a.text, '') AS hypothesis
  FROM (SELECT * FROM conversations WHERE role = 'user') u
  LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"""


def beads(spark: SparkSession, sf: str, size: int = 400) -> DataFrame:
    """(doc_id, bead_idx, bead_text, span_start, span_end): documents cut into stretches of ``size`` characters."""
    d = table(spark, sf, "documents").filter("length(text) > 0")
    rows = d.select("doc_id", F.length("text").cast("long").alias("n"), "text", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("text") - 1) / size))).alias("bead_idx"))
    return rows.select("doc_id", "bead_idx", F.substring("text", (F.col("bead_idx") * size + 1).cast("int"), F.lit(size)).alias("bead_text"), (F.col("bead_idx") * size).alias("span_start"), F.least(F.col("n"), (F.col("bead_idx") + 1) * size).alias("span_end"))


def beads_sql(size: int = 400) -> str:
    return f"""beads AS (
  SELECT doc_id, b AS bead_idx, substr(text, b * {size} + 1, {size}) AS bead_text, b * {size} AS span_start, least(length(text), (b + 1) * {size}) AS span_end
  FROM (SELECT doc_id, text, unnest(range(0, CAST((length(text) - 1) // {size} + 1 AS BIGINT))) AS b FROM documents WHERE length(text) > 0))"""


#: Characters by which the hypothesis side of a stand-in bead begins later than its source side, so that swapped sides show.
SHIFT = 50


def aligned_beads(spark: SparkSession, sf: str) -> DataFrame:
    """Beads as sentence alignment gives them, over the first 300 of every 400 characters of a document; the hypothesis begins SHIFT later."""
    rows = beads(spark, sf).withColumn("end", F.least("span_end", F.col("span_start") + 300))
    source, hypothesis = F.substring("bead_text", 1, 300), F.substring("bead_text", SHIFT + 1, 300 - SHIFT)
    later = F.least(F.col("span_start") + SHIFT, F.col("end"))
    return rows.select("doc_id", "bead_idx", source.alias("source"), hypothesis.alias("hypothesis"), F.col("span_start").alias("src_start"), F.col("end").alias("src_end"), later.alias("hyp_start"), F.col("end").alias("hyp_end"))


def pair_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(filename, source, hypothesis): each sentence pair as a document pair of its own."""
    return pairs(spark, sf).select(F.concat_ws("#", "filename", "bead_idx").alias("filename"), "source", "hypothesis")


def concept():
    """A concept that two lexicon words may share; none for words whose length three divides."""
    return F.when(F.length("text") % 3 != 0, F.concat(F.lit("C"), F.ascii(F.substring(F.col("text"), -1, 1)).cast("string")))


def pair_linked(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """Linked entities of the document pairs: of the sources (gold) or the hypotheses (pred)."""
    m = found_tokens(pair_rows(spark, sf), "filename", "source" if side == "gold" else "hypothesis", side).withColumnRenamed("filename", "doc_id")
    return m.select("doc_id", F.col("start").alias("id"), "start", "end", "text", "label", concept().alias("cui"))


def neighbours(linked: DataFrame) -> DataFrame:
    """(doc_id, id, relation, s_start, s_end, o_start, o_end): each entity with the next one of its document."""
    order = Window.partitionBy("doc_id").orderBy("start")
    m = linked.withColumn("o_start", F.lead("start").over(order)).withColumn("o_end", F.lead("end").over(order)).filter("o_start IS NOT NULL")
    return m.select("doc_id", "id", F.concat(F.lit("rel_"), F.length("text").cast("string")).alias("relation"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), "o_start", "o_end")


def linked(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """Mentions with an id, a concept that two lexicon words may share, and a text to compare."""
    m = mentions(spark, sf, side)
    return m.select("doc_id", (F.col("doc_id") * 10_000_000 + F.col("start")).alias("id"), "start", "end", "text", "label", concept().alias("cui"))


def linked_sql(side: str, name: str) -> str:
    return f"""{name} AS (
  SELECT doc_id, doc_id * 10000000 + start AS id, start, "end", text, label,
         CASE WHEN length(text) % 3 <> 0 THEN 'C' || ascii(substr(text, length(text), 1)) END AS cui FROM {name}_m)"""


def relations(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """Relations of each mention with the next one of its document."""
    return neighbours(linked(spark, sf, side))


def relations_sql(side: str, name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT doc_id, doc_id * 10000000 + start AS id, 'rel_' || length(text) AS relation, start AS s_start, "end" AS s_end, o_start, o_end
  FROM (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS o_start, lead("end") OVER (PARTITION BY doc_id ORDER BY start) AS o_end FROM {source})
  WHERE o_start IS NOT NULL)"""
