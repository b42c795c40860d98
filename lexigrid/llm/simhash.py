"""SimHash near-duplicates: pivot distance tables choose pairs and discard them, the rest is verified bit by bit.

Fingerprints are made distinct first, so that copies cost one row, and each gets its row of the pivot table once: its Hamming
distances to fixed reference fingerprints. Equal blocks of bits bring together every two fingerprints within the
radius (pigeonhole: with ``radius`` differing bits and more blocks than that, the others agree). A bucket is
ordered by the pivot table: only fingerprints within the radius of each other on the first pivot make a pair (the triangle
inequality), a pair is discarded where any other coordinate differs by more, and the survivors are compared exactly. A bucket that is too
large is split by blocks of the bits that it does not have in common yet, as often as it takes, which loses no pair.
What a bucket passes on is a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.components import components
from lexigrid.llm.shared import ASCII_LOWER, bound_batches, cut, free_name, join_spread, table

RADIUS = 4
#: Reference fingerprints: hashes of their own number, the same for every corpus.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i) for i in range(24)], dtype=np.uint64)
#: A bucket of over this many fingerprints is split. As they are distinct, one whose fingerprints have all but 11 bits in common never is.
MOST = 2048
#: Blocks that a split makes of the bits left: two fingerprints within the radius agree on two of six.
SPLIT = 6
#: Shingles whose bits are summed at once.
PART = 1 << 15


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over shingles of ``words`` words, repeats included; 0 without words."""
    found = (text or "").encode().translate(ASCII_LOWER).split()
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1)
    if n == 1:
        return digest(joined, seed)
    at, starts = 0, []
    for w in found:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[words:]] + [len(joined)]
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, n, PART):
        high = min(n, low + PART)
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[low:high], ends[low:high])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(fps, pa.int64())], [*kept, "fp"])


def fingerprints(df: DataFrame, doc: str = "doc_id", text: str = "text", mark: str | None = None) -> DataFrame:
    """(doc, fp), with ``mark`` (doc, mark, fp): one row for each row of ``df``; fp as a signed long."""
    bound_batches(df.sparkSession)
    marks = [F.col(mark).cast("long").alias("mark")] if mark else []
    rows = df.select(F.col(doc).cast("long").alias("doc"), *marks, F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc bigint, mark bigint, fp bigint" if mark else "doc bigint, fp bigint")


def block_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of kept bits, one a table, that are cheapest for ``n`` fingerprints.

    64 bits in b blocks; each way to leave out ``radius`` of them is a table, so two fingerprints
    within the radius agree on the kept bits of one table at least. More blocks mean more rows and
    fewer chance pairs; every choice finds every link.
    """

    def cost(b: int) -> float:
        tables, bits = math.comb(b, radius), 64 * (b - radius) / b
        return tables * n * (2.0 + 0.02 * n / 2 ** (bits + 1))

    b = min(range(radius + 1, 2 * radius + 2), key=cost)
    edges = [round(64 * i / b) for i in range(b + 1)]
    blocks = [sum(1 << k for k in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [sum(kept) for kept in combinations(blocks, b - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every pivot, a row for each fingerprint."""
    return np.stack([np.bitwise_count(fps ^ p) for p in PIVOTS], axis=1).astype(np.uint8)


def _tabulate(batches):
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(PIVOTS)), len(fps), [None, pa.py_buffer(pivot_table(fps).tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("fp"), rows.cast(pa.binary())], ["fp", "pivots"])


def _coordinates(column) -> np.ndarray:
    fixed = column.cast(pa.binary(len(PIVOTS)))
    data = np.frombuffer(fixed.buffers()[1], dtype=np.uint8) if len(fixed) else np.empty(0, dtype=np.uint8)
    return data.reshape(-1, len(PIVOTS))[fixed.offset : fixed.offset + len(fixed)]


def linked(run: np.ndarray, fps: np.ndarray, coordinates: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links within each run of equal ``run`` values.

    A run is in order of its first pivot coordinate, so those that can be in reach of a fingerprint there stand next
    after it; the k-th round takes each with the k-th after it.
    """
    n = len(fps)
    label = np.arange(n)
    none = np.empty(0, dtype=np.int64)
    if n < 2:
        return none, none
    place = run.astype(np.int64) * 256 + coordinates[:, 0]
    left = np.searchsorted(place, place + radius, side="right") - np.arange(n)
    others = np.ascontiguousarray(coordinates.T[1:]).astype(np.int16)
    held_a, held_b, held = [], [], 0
    at, k = np.flatnonzero(left > 1), 1
    while at.size:
        a, b = at, at + k
        for row in others:
            ok = np.abs(row[a] - row[b]) <= radius
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        if ok.any():
            held_a.append(a[ok])
            held_b.append(b[ok])
            held += int(ok.sum())
            if held > 500_000:
                _join(label, np.concatenate(held_a), np.concatenate(held_b))
                held_a, held_b, held = [], [], 0
        k += 1
        at = at[left[at] > k]
    if held:
        _join(label, np.concatenate(held_a), np.concatenate(held_b))
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lower labels in place until both ends of every link have the label of the lowest node."""
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            return
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _links(batches):
    """Batches sorted by (bucket, pivots) to forest edges; a bucket that a batch breaks off is held over."""
    held = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty((0, len(PIVOTS)), dtype=np.uint8))

    def done(key, fps, coordinates):
        run = np.zeros(len(key), dtype=np.int64)
        run[1:] = np.cumsum(key[1:] != key[:-1])
        child, root = linked(run, fps, coordinates)
        return pa.RecordBatch.from_arrays([pa.array(fps[child].view(np.int64)), pa.array(fps[root].view(np.int64))], ["u", "v"])

    for batch in batches:
        new = (batch.column("bucket").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), _coordinates(batch.column("pivots")))
        held = tuple(np.concatenate(x) for x in zip(held, new))
        key = held[0]
        if not len(key):
            continue
        at = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if at:
            yield done(*(x[:at] for x in held))
            held = tuple(x[at:] for x in held)
    if len(held[0]):
        yield done(*held)


def split_masks(left: int) -> list[int]:
    """The bits to keep, for each way to choose two of the SPLIT blocks of the bits ``left``."""
    bits = [1 << k for k in range(64) if left >> k & 1]
    edges = [round(len(bits) * i / SPLIT) for i in range(SPLIT + 1)]
    blocks = [sum(bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    return [sum(kept) for kept in combinations(blocks, SPLIT - RADIUS)]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _split(batches):
    """Each row of a crowded bucket to its buckets of the next level."""
    for batch in batches:
        bucket, fps, left = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("bucket", "fp", "left"))
        for one in np.unique(left):
            rows = np.flatnonzero(left == one)
            for j, kept in enumerate(split_masks(int(one))):
                key = _mixed(_mixed(bucket[rows], fps[rows] & np.uint64(kept)), np.full(len(rows), j, dtype=np.uint64)).view(np.int64)
                rest = np.full(len(rows), _signed(int(one) & ~kept), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("fp").take(pa.array(rows)), batch.column("pivots").take(pa.array(rows)), pa.array(rest)], ["bucket", "fp", "pivots", "left"])


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fps(fp)`` that connect all those within RADIUS.

    The edges span the same components as all links do. A bucket key is a 64-bit hash of table and kept bits; should
    two meet, a run only holds more fingerprints to compare. Buckets of over ``most`` are split again and again.
    """
    masks = block_masks(fps.count())
    tabled = cut(fps.mapInArrow(_tabulate, "fp bigint, pivots binary"), "simhash-pivots")
    every = (1 << 64) - 1
    homes = F.array(*[F.struct(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("bucket"), F.lit(_signed(every & ~m)).alias("left")) for t, m in enumerate(masks)])
    rows = tabled.select("fp", "pivots", F.explode(homes).alias("home")).select("home.bucket", "fp", "pivots", "home.left")
    shape, edges, level = "bucket bigint, fp bigint, pivots binary, left bigint", None, 0
    while True:
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"))
        crowded = cut(sizes.filter(F.col("size") > most), "simhash-crowded")
        told = crowded.agg(F.count("*").alias("n"), F.sum("size").alias("rows")).first()
        calm = rows
        if told["n"]:
            calm = join_spread(rows, crowded, ["bucket"], "size", told["rows"], "left_anti")
        found = calm.repartition("bucket").sortWithinPartitions("bucket", "pivots").mapInArrow(_links, "u bigint, v bigint")
        edges = found if edges is None else edges.unionByName(found)
        if not told["n"]:
            return edges
        level += 1
        rows = cut(join_spread(rows, crowded, ["bucket"], "size", told["rows"]).select("bucket", "fp", "pivots", "left").mapInArrow(_split, shape), f"simhash-level-{level}")


def groups(prints: DataFrame, least: list) -> DataFrame:
    """(fp, label, times) and the aggregates ``least`` for each fingerprint of ``prints``; ``label`` is the lowest fingerprint that links reach."""
    distinct = cut(prints.groupBy("fp").agg(F.count("*").alias("times"), *least), "simhash-distinct")
    found = components(links(distinct.select("fp")).distinct(), "simhash-links")
    return cut(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "simhash-labels")


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach).

    One row for each row of ``df``. Null text has no words, so fingerprint zero, and links like
    any other; a null id is kept and takes its component's id (null if no document there has
    one); repeated rows are alike; an empty table gives no rows; other columns are not read.
    """
    prints = cut(fingerprints(df, doc, text), "simhash")
    labelled = groups(prints, [F.min("doc").alias("least")])
    told = labelled.agg(F.count("*").alias("fps"), F.coalesce(F.sum("times"), F.lit(0)).alias("rows")).first()
    lowest = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    per_print = join_spread(labelled.select("fp", "label", "times"), lowest, ["label"], "fps", told["fps"]).select("fp", "component_id", "times")
    out = join_spread(prints, cut(per_print, "simhash-found"), ["fp"], "times", told["rows"])
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, all columns: the smallest id, then the lowest hash of the text.

    Rows without an id come after those with one. A row is known by its id and text together, so
    an id on two texts, or none, ties no groups together; of rows that agree in both one stays.
    """
    own_id, own_mark, kept_id, kept_mark = (free_name(df, c) for c in ("id_of_row", "mark_of_row", "id_kept", "mark_kept"))
    marked = df.withColumn(own_id, F.col(doc).cast("long")).withColumn(own_mark, F.xxhash64(F.col(text).cast("string")))
    order = F.struct(F.col("doc").isNull().alias("none"), F.col("doc"), F.col("mark"))
    labelled = groups(cut(fingerprints(marked, own_id, text, own_mark), "simhash"), [F.min(order).alias("least")])
    keep = labelled.groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.doc").alias(kept_id), F.col("least.mark").alias(kept_mark))
    ids = marked.agg(F.count("*").alias("n"), F.count_distinct(own_id).alias("d")).first()
    rows = marked if ids["n"] == ids["d"] else marked.dropDuplicates([own_id, own_mark])
    kept = rows.join(keep, F.col(own_id).eqNullSafe(F.col(kept_id)) & (F.col(own_mark) == F.col(kept_mark)), "left_semi")
    return kept.drop(own_id, own_mark)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
