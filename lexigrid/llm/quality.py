"""Quality rules: counted defects, then a hashed n-gram log-likelihood ratio of every document.

Two multinomials over hashed words and word pairs are counted: the raw one over all documents, the target's over trusted
ones. A document's ratio is the mean, over its own n-grams, of the logarithm of target over raw, so that its length has no say.
Every document is kept or not by one threshold, drawn where it parts labelled documents best that the target has not counted.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.shared import BROADCAST_ROWS, bound_batches, cut, table

#: Logarithm of the number of hash buckets: both multinomials are that long at any size of the corpus.
LOG_BUCKETS = 18
#: How much the target's counts lean on the raw ones, in n-grams.
LEAN = 1e4
#: Fewer words, or a larger part of them in repeated windows, fail a document whatever its ratio.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Width of the bins in which ratios are counted to draw the threshold, and the largest ratio either way that they tell apart.
BIN, WIDEST = 0.005, 20.0

BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Words, and runs of signs between them; bytes from 128 on are parts of letters.
PIECE = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\x20\x09-\x0d]+")


class Codes(dict):
    """Hashes of pieces; remembers a bounded number of them."""

    MOST = 500_000

    def __missing__(self, piece: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[piece] = zlib.crc32(piece)
        return value


def buckets(raw: bytes, codes: Codes, log_buckets: int = LOG_BUCKETS) -> np.ndarray:
    """The bucket of each piece and of each pair of neighbouring pieces of a text."""
    ids = np.fromiter(map(codes.__getitem__, PIECE.findall(raw)), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    one = (ids * np.uint64(0x9E3779B1) + np.uint64(1)) & low
    two = (ids[:-1] * np.uint64(0x85EBCA6B) ^ (ids[1:] * np.uint64(0xC2B2AE35) + np.uint64(7))) & low
    return (np.concatenate([one, two]) >> np.uint64(32 - log_buckets)).astype(np.int64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows of ``window`` words (a power of two) found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    size = 1
    while size < window:  # numbers of windows twice as long, exact: equal numbers are equal pairs
        pairs = ids[:-size] * (int(ids.max()) + 1) + ids[size:]
        _, ids = np.unique(pairs, return_inverse=True)
        size *= 2
    often = np.bincount(ids)[ids] > 1
    if not often.any():
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += often
    edge[window:] -= often
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counted(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = raw.split()  # at the six blanks, as bytes know no others
    chars = len(raw) - sum(map(raw.count, (b"%c" % b for b in BLANKS)))
    chars -= sum(len(c) for c in re.findall(rb"[\x80-\xbf]+", raw)) if not raw.isascii() else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, sum(raw.count(b"%c" % s) for s in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def _tally(log_buckets: int):
    """(bucket, raw, target): what a task's documents hold, a row a bucket."""

    def tally(batches):
        codes, sums = Codes(), np.zeros((2, 1 << log_buckets), dtype=np.int64)
        for batch in batches:
            for text, trusted in zip(batch.column("text"), batch.column("trusted").to_pylist()):
                found = buckets((text.as_py() or "").encode(), codes, log_buckets)
                np.add.at(sums[0], found, 1)
                if trusted:
                    np.add.at(sums[1], found, 1)
        at = np.flatnonzero(sums[0])
        for lo in range(0, len(at), 10_000):
            part = at[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[0, part]), pa.array(sums[1, part])], ["bucket", "raw", "target"])

    return tally


def log_ratios(raw: np.ndarray, target: np.ndarray, lean: float = LEAN) -> np.ndarray:
    """log target / raw of each bucket: the raw counts begin at one, the target leans on the raw multinomial."""
    p = (raw + 1.0) / (raw + 1.0).sum()
    return np.log((target / p + lean) / (target.sum() + lean))


def _judge(ratios, log_buckets: int):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio"]

    def judge(batches):
        codes, table = Codes(), ratios.value
        for batch in batches:
            rows, means = [], []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                rows.append(counted(raw))
                found = buckets(raw, codes, log_buckets)
                means.append(float(table[found].mean()) if len(found) else 0.0)
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], pa.array(means, pa.float64())], names)

    return judge


def labelled_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """(id, good, held): all labelled ids, or ``most`` of each class, a quarter of them held out by the crc32 of the id.

    Good is of quality and not toxic; an id whose rows disagree, or without an id or a label, is not labelled.
    """
    told = F.coalesce("quality", F.lit(-1))
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), ((told == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"), (told == 0).alias("bad"))
    agreed = rows.filter("id IS NOT NULL").groupBy("id").agg(F.bool_and("good").alias("good"), F.bool_and("bad").alias("bad")).filter("good OR bad").drop("bad")
    if most is not None:
        lowest = lambda good: agreed.filter("good" if good else "NOT good").orderBy(F.xxhash64("id"), "id").limit(most)
        agreed = lowest(True).unionByName(lowest(False))
    return agreed.withColumn("held", F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2)


def threshold_of(scored: DataFrame, labelled: DataFrame) -> float:
    """The ratio that parts held-out good from bad documents best, among those that the base rules pass.

    Ratios are counted in bins, of which there is a fixed number; of equally good thresholds the one in the middle counts. Where a
    class is missing, all pass.
    """
    place = F.floor(F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.col("ratio"))) / BIN).cast("int").alias("place")
    held = scored.filter("NOT base_failed").join(labelled.filter("held"), F.col("doc_id") == F.col("id"))
    rows = held.groupBy(place).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect()  # bins
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return -float("inf")
    tells, kept, caught = {}, good, 0
    for r in sorted(rows, key=lambda r: r["place"]):
        tells[r["place"]] = kept / good + caught / bad
        kept, caught = kept - r["good"], caught + r["bad"]
    best = max(tells.values())
    first = min(p for p, v in tells.items() if v >= best - 1e-12)
    below = max((r["place"] for r in rows if r["place"] < first), default=first)
    return BIN * (first + below + 1) / 2 if below < first else BIN * first


def quality(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", most: int | None = None, log_buckets: int = LOG_BUCKETS, lean: float = LEAN) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept for each row of ``df``.

    Null text counts as empty, has ratio 0 and fails for its few words; null or repeated ids keep their rows apart; without
    labels of both classes the base rules alone decide; an empty table gives no rows; other columns are not read. Both
    multinomials, all counts and the threshold cover every row and, unless ``most`` bounds them, every labelled id; labels meet
    texts in a shuffle, by broadcast only while the trusted ones are counted and few.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    labelled = cut(labelled_ids(labels, most), "quality-labels")
    trusted = labelled.filter("good AND NOT held").select(F.col("id"), F.lit(True).alias("trusted"))
    trusted = F.broadcast(trusted) if trusted.count() <= BROADCAST_ROWS else trusted.hint("merge")
    marked = rows.join(trusted, F.col("doc_id") == F.col("id"), "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = marked.mapInArrow(_tally(log_buckets), "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    counts = np.zeros((2, 1 << log_buckets))
    for k, name in enumerate(("raw", "target")):
        counts[k, sums.column("bucket").to_numpy()] = sums.column(name).to_numpy()
    ratios = spark.sparkContext.broadcast(log_ratios(*counts, lean))  # a number a bucket
    shape = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, ratio double"
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = cut(rows.mapInArrow(_judge(ratios, log_buckets), shape).withColumn("base_failed", failed), "quality-scored")
    least = threshold_of(scored, labelled)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.lit(least)))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
