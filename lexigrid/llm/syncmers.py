"""Document fingerprints by closed syncmers over words, with DataFrame functions alone.

A k-mer of K words is kept if the smallest of its hashed inner S-mers is the first or the last.
That depends on the k-mer and nothing around it, so an unchanged stretch keeps all its anchors
wherever it stands. The fingerprint is the anchors in order of position, 32 bits each.

Short texts have few k-mers of words, so theirs are of characters, and a text of middling length has both, so that
an edit that changes the number of words leaves anchors of a kind to compare. What is taken depends on the text alone.

The whole computation is a chain of array steps; each array is used by position against shifted
copies of itself, so a text costs time in proportion to its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm.shared import SPACE_CLASS, free_name, table

#: Words in a k-mer and in an inner s-mer.
K, S = 5, 2
#: A text of under FEW words has anchors of characters, one of under twice as many has both kinds.
FEW = 20
#: A word of over LONG characters counts as its characters; of a text of under TINY characters every trigram is an anchor.
LONG, TINY = 64, 32


def shifted(array: str, by: int, short: int):
    """Elements from ``by`` on, as many as leave ``short`` off the array's end in all."""
    return F.slice(array, by + 1, F.greatest(F.size(array) - short, F.lit(0)))


def _fold(h):
    return F.shiftright(h, 32).cast("int")


def _closed(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """Put ``out``, the anchors of the array ``hashes`` of units, beside it.

    The steps are separate projections on purpose: an array that a later step uses twice is computed once.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    least = lambda a, b: F.least(a, b)
    df = df.select(*keep, F.zip_with(shifted(hashes, 0, 1), shifted(hashes, 1, 1), lambda a, b: F.xxhash64(a, b)).alias("__g"))
    df = df.select(*keep, "__g", F.zip_with(shifted("__g", 0, 1), shifted("__g", 1, 1), least).alias("__m2"))
    df = df.select(*keep, "__g", F.zip_with(shifted("__m2", 0, 2), shifted("__m2", 2, 2), least).alias("__m4"))
    ends = F.arrays_zip(
        F.col("__m4").alias("m"),
        shifted("__g", 0, 3).alias("first"),
        shifted("__g", 3, 3).alias("last"),
        shifted("__g", 2, 3).alias("middle"),
        shifted(hashes, 4, 4).alias("end"),
    )
    closed = F.filter(ends, lambda x: (x["m"] == x["first"]) | (x["m"] == x["last"]))
    return df.select(*keep, F.transform(closed, lambda x: _fold(F.xxhash64(x["first"], x["middle"], x["end"]))).alias(out))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the anchors (array of int) of column ``text``, those of words before those of characters, each in order of position.

    A text without anchors has one, the hash of all its words; one without words has none. Characters are
    those of the words with a space between.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    none = F.array().cast("array<bigint>")
    hashed = lambda units: F.transform(units, lambda u: F.xxhash64(u))
    characters = lambda c: F.filter(F.split(c, ""), lambda u: u != "")
    df = df.select(*keep, F.filter(F.split(F.col(text), SPACE_CLASS + "+"), lambda w: w != "").alias("__w"))
    n = F.size("__w")
    cut_up = F.flatten(F.transform("__w", lambda w: F.when(F.length(w) > LONG, characters(w)).otherwise(F.array(w))))
    units = F.when(F.exists("__w", lambda w: F.length(w) > LONG), cut_up).otherwise(F.col("__w"))
    df = df.select(*keep, F.xxhash64("__w").alias("__all"), n.alias("__n"), F.when(n >= FEW, hashed(units)).otherwise(none).alias("__h"), F.when(n < 2 * FEW, hashed(characters(F.array_join("__w", " ")))).otherwise(none).alias("__c"))
    df = _closed(_closed(df, "__h", "__words"), "__c", "__characters")
    trigrams = F.zip_with(F.zip_with(shifted("__c", 0, 2), shifted("__c", 1, 2), lambda a, b: F.xxhash64(a, b)), shifted("__c", 2, 2), lambda a, b: _fold(F.xxhash64(a, b)))
    small = F.when(F.size("__c") < TINY, trigrams).otherwise(F.col("__characters"))
    df = df.select(*keep, F.concat("__words", small).alias("__a"), _fold(F.col("__all")).alias("__all"), "__n")
    only = F.when(F.col("__n") > 0, F.array("__all")).otherwise(F.array().cast("array<int>"))
    return df.select(*keep, F.when(F.size("__a") > 0, F.col("__a")).otherwise(only).alias(out))


def as_text(anchors):
    """Eight hex digits an anchor."""
    return F.array_join(F.transform(anchors, lambda a: F.lower(F.lpad(F.hex(F.shiftrightunsigned(F.shiftleft(a.cast("long"), 32), 32)), 8, "0"))), "")


def likeness(a: str, b: str):
    """Dice coefficient of two sets of anchors; 1 for two empty ones."""
    left, right = F.array_distinct(a), F.array_distinct(b)
    sizes = F.size(left) + F.size(right)
    return F.when(sizes == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(left, right)) / sizes)


def in_order(key: str, tie: str):
    """Text that sorts like ``key`` from the largest down, null last, then ``tie`` (both long) from the lowest up."""
    low = F.lit(-(2**63))
    digits = lambda c: F.lpad(F.hex(c.bitwiseXOR(low)), 16, "0")
    down = F.coalesce(digits(F.bitwise_not(F.col(key).cast("long"))), F.lit("G"))
    return F.concat(down, digits(F.coalesce(F.col(tie).cast("long"), F.lit(0))))


def range_starts(order: DataFrame, parts: int) -> list[str]:
    """Where each of at most ``parts`` ranges of the one column of ``order`` begins, apart from the first; a text a range comes to the driver."""
    name = order.columns[0]
    ranged = order.repartitionByRange(parts, name).groupBy(F.spark_partition_id()).agg(F.min(name).alias("least"))
    return sorted(r["least"] for r in ranged.collect())[1:]


def range_of(value, starts: list[str]):
    """The number of ``starts`` that are not above ``value``. A first look at some of them leaves few to look at."""
    if not starts:
        return F.lit(0)
    step = max(1, round(len(starts) ** 0.5))
    whole = lambda texts: F.split(F.lit(",".join(texts)), ",")
    reached = lambda array: F.size(F.filter(array, lambda x: x <= value))
    coarse = reached(whole(starts[step - 1 :: step]))
    return coarse * step + reached(F.slice(whole(starts), coarse * step + 1, step))


def with_next(df: DataFrame, key: str, tie: str, columns: list[str], parts: int) -> DataFrame:
    """Add ``next_<c>`` of the next row in descending order of ``key`` (ties by ``tie``, null last); the last row's next is the first.

    Rows are dealt out by range of that order, so one key with many rows has many ranges. The first row of a range is also sent, as a
    halo, to the range before, whose last row it follows, and the first of all to the last range. So each row is
    shuffled once, straight to its range, and no task sees more than one. What comes to the driver is a row a range.
    """
    order, place, first, goal, halo = (free_name(df, c) for c in ("in_order", "range_no", "range_first", "halo_for", "is_halo"))
    rows = df.withColumn(order, in_order(key, tie))
    starts = range_starts(rows.select(order), parts)
    rows = rows.withColumn(place, range_of(F.col(order), starts).cast("int"))
    tops = sorted((r[place], r["top"]) for r in rows.groupBy(place).agg(F.min(order).alias("top")).collect())
    before = [tops[-1][0], *(p for p, _ in tops[:-1])] if tops else []
    listed = df.sparkSession.range(1).select(F.explode(F.split(F.lit(",".join(f"{top}:{b}" for (_, top), b in zip(tops, before))), ",")).alias(first))
    targets = F.broadcast(listed.select(F.substring_index(first, ":", 1).alias(first), F.substring_index(first, ":", -1).try_cast("int").alias(goal)).filter(F.col(goal).isNotNull()))  # a row a range
    found = rows.join(targets, F.col(order) == F.col(first), "left")
    both = F.array_compact(F.array(F.struct(F.col(place).alias("at"), F.lit(0).alias("halo")), F.when(F.col(goal).isNotNull(), F.struct(F.col(goal).alias("at"), F.lit(1).alias("halo")))))
    dealt = found.select(*[F.col(f"`{c}`") for c in df.columns], order, F.explode(both).alias(first)).withColumn(place, F.col(f"{first}.at")).withColumn(halo, F.col(f"{first}.halo")).drop(first)
    window = Window.partitionBy(place).orderBy(halo, order)
    dealt = dealt.repartitionById(len(starts) + 1, F.col(place))
    return dealt.select("*", *[F.lead(F.col(f"`{c}`")).over(window).alias(f"next_{c}") for c in columns]).filter(F.col(halo) == 0).drop(place, halo, order)


#: Bytes of text in a range, about, and the most ranges, whose starts the driver knows; beyond those the ranges grow.
RANGE, RANGES = 8 << 20, 1 << 16


def compare_edits(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The last third of a text's code points gives way to as many of the next document's first. Null
    text counts as empty: no words, an empty fingerprint, and likeness 1 with another such text, 0 with any
    other. Rows with one id follow one another by hash of the text; rows without an id come last; a
    table of one row is its own next; an empty table gives no rows; other columns are not read.
    """
    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = min(RANGES, 1 + (rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // RANGE)
    rows = with_anchors(rows, "text", "anchors").withColumn("tie", F.xxhash64("text"))
    rows = with_next(rows, "doc_id", "tie", ["text", "anchors"], parts)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    rows = with_anchors(rows.drop("text", "next_text", "tie"), "edited", "edited_anchors")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"),
        likeness("anchors", "next_anchors").alias("near_next"),
    )


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))
