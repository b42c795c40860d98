"""Replacement of known phrases where they are a table of any size: phrases and texts meet in joins, not in one pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators.durable import cut

#: A text is its runs of word characters and, one by one, all other characters: a whole-word match is a run of these units.
UNIT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"

#: First units of phrases that are broadcast at most, and their bytes; of more the places are shuffled.
HEADS, HEAD_BYTES = 100_000, 4 << 20


def units(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(UNIT), F.lit(0))


def leftmost(batches):
    """Matches sorted by text, place and falling length to those that begin after the one taken before has ended."""
    import pyarrow as pa

    here, free = None, 0
    for batch in batches:
        kept = []
        columns = [batch.column(c).to_pylist() for c in ("__h1", "__h2", "at", "n")]
        for row, (h1, h2, at, n) in enumerate(zip(*columns)):
            if (h1, h2) != here:
                here, free = (h1, h2), 0
            if at >= free:
                free = at + n
                kept.append(row)
        yield batch.take(pa.array(kept, pa.int64()))


def matches(texts: DataFrame, table: DataFrame, template: str) -> DataFrame:
    """(__h1, __h2, at, n, put): what is replaced in each of ``texts(__h1, __h2, text)``, in units: the first from the left, of those at one place the longest.

    A place first meets the units that phrases begin with, as no more than its number and its unit; those are broadcast while they are
    counted and few. Only places that one of them is at then get the units round them, in their text, and meet whole phrases.
    """
    put = F.lit(template)
    for name, value in (("{token}", F.col("phrase")), ("{expansion}", F.col("expansion"))):
        put = F.replace(put, F.lit(name), value)
    phrases = table.filter("phrase <> '' AND expansion IS NOT NULL").groupBy("phrase").agg(F.min("expansion").alias("expansion"))
    phrases = cut(phrases.select("phrase", units(F.col("phrase")).alias("u"), put.alias("put")).select("phrase", "put", F.get("u", F.lit(0)).alias("first"), F.size("u").alias("n")))
    longest, firsts, size = phrases.agg(F.coalesce(F.max("n"), F.lit(1)), F.count_distinct("first"), F.coalesce(F.sum(F.octet_length("first")), F.lit(0))).first()
    heads = phrases.groupBy("first").agg(F.collect_set("n").alias("lengths"))
    if firsts <= HEADS and size <= HEAD_BYTES:
        heads = F.broadcast(heads)
    # the outer kind, as for the other Spark derives filters that look for all units once more each
    places = texts.select("__h1", "__h2", F.posexplode_outer(units(F.col("text"))).alias("at", "first")).join(heads, "first")
    spots = places.groupBy("__h1", "__h2").agg(F.collect_list(F.struct("at", "lengths")).alias("__spots"))
    around = lambda u: F.transform("__spots", lambda s: F.struct(s["at"].alias("at"), F.get(u, s["at"] - 1).alias("prev"), F.slice(u, s["at"] + 1, F.lit(longest + 1)).alias("next"), s["lengths"].alias("lengths")))
    met = texts.join(spots, ["__h1", "__h2"]).select("__h1", "__h2", F.explode_outer(T.let(units(F.col("text")), around)).alias("p"))
    met = met.select("__h1", "__h2", "p.at", "p.prev", "p.next", F.get("p.next", F.lit(0)).alias("first"), "p.lengths")
    asked = met.select("__h1", "__h2", "at", "prev", "first", "next", F.explode("lengths").alias("n")).filter(F.size("next") >= F.col("n"))
    # a phrase that begins or ends with another character than a word's must not touch a word there
    word = lambda c: F.coalesce(c.rlike(r"^[\p{L}\p{N}_]"), F.lit(False))
    last, after = F.get("next", F.col("n") - 1), F.get("next", F.col("n"))
    asked = asked.filter((word(F.col("first")) | ~word(F.col("prev"))) & (word(last) | ~word(after)))
    found = asked.withColumn("phrase", F.array_join(F.slice("next", F.lit(1), F.col("n")), "")).join(phrases.select("phrase", "put"), "phrase")
    found = found.select("__h1", "__h2", "at", "n", "put").repartition("__h1", "__h2").sortWithinPartitions("__h1", "__h2", "at", F.col("n").desc())
    return found.mapInArrow(leftmost, found.schema)


def replace_from_table(df: DataFrame, text: str, table: DataFrame, out: str, template: str = "{expansion}") -> DataFrame:
    """``df`` with ``out``: ``text`` with the whole words of ``table(phrase, expansion)`` replaced in one pass, as ``replace_known`` does with a few.

    Nothing that is put in is looked at again. A distinct text is searched once. Null texts stay null; of a phrase's several
    expansions the smallest counts.
    """
    keyed = df.withColumn("__h1", F.xxhash64(text)).withColumn("__h2", F.xxhash64(F.lit(7), text))
    texts = keyed.filter(F.col(text).isNotNull()).select("__h1", "__h2", F.col(text).alias("text")).dropDuplicates(["__h1", "__h2"])
    found = matches(texts, table, template).groupBy("__h1", "__h2").agg(F.array_sort(F.collect_list(F.struct("at", "n", "put"))).alias("__m"))

    def built(u):
        end = lambda k: F.get("__m", k)["at"] + F.get("__m", k)["n"]
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(end(i - 1))
        pieces = F.transform("__m", lambda x, i: F.concat(F.array_join(F.slice(u, before(i) + 1, x["at"] - before(i)), ""), x["put"]))
        last = end(F.size("__m") - 1)
        return F.concat(F.array_join(pieces, ""), F.array_join(F.slice(u, last + 1, F.size(u)), ""))

    met = keyed.join(found, ["__h1", "__h2"], "left")
    return met.select(*df.columns, F.when(F.col("__m").isNull(), F.col(text)).otherwise(T.let(units(F.col(text)), built)).alias(out))
