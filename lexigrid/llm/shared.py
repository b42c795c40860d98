"""What the training-data operators share: durable cuts of lineage, row ids and batch bounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\\x20\\x09-\\x0D]``: the white space that the word and line definitions name.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Maps A-Z to a-z and nothing else, in UTF-8 bytes.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column):
    """A-Z to a-z, all other code points unchanged (``lower`` would fold more)."""
    return F.translate(column, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs in one process (tests) a temporary one is set; with
    executors elsewhere it would be another folder for each.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


#: A key is hot with over one part in HOT of all rows, and in any case with over TASK_ROWS, which one task can hold and spill.
HOT, TASK_ROWS = 512, 1_000_000
#: Keys' hashes fall into so many slots; what is broadcast about hot keys has a row a slot at most.
SLOTS = 1 << 16
#: A table of hot keys up to this many rows, which is counted, may be broadcast itself.
BROADCAST_ROWS = 100_000


def key_limit(total: int) -> int:
    """Rows from which on a key is hot: it never exceeds TASK_ROWS, however many rows there are."""
    return max(1, min(total // HOT, TASK_ROWS))


def key_slot(keys: list[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def join_spread(big: DataFrame, per_key: DataFrame, keys: list[str], times: str, total: int, how: str = "inner", hint: str | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Join with a table of one row a key. ``times`` of it, or of ``hot``, says how many rows of ``big`` a key has.

    The rows of a hot key are dealt out to as many salts as it needs for each to stay below the limit. A row of ``big`` learns
    the number of salts from its key's slot, a table of at most SLOTS rows; a row of ``per_key`` is repeated once a
    salt of its slot. All rows then meet in one shuffle, in which no key is large. ``how`` is inner, left, left_anti or left_semi.
    Rows of ``big`` are dealt by their number, so it has to be a scan of files and what follows without a shuffle: then
    a task that runs again deals as before.
    """
    limit, slot, salts, salt = key_limit(total), free_name(big, "__slot"), free_name(big, "__salts"), free_name(big, "__salt")
    crowded = (per_key if hot is None else hot).filter(F.col(times) > limit)
    hot = F.broadcast(crowded.groupBy(key_slot(keys).alias(slot)).agg(F.ceil(F.max(times) / limit).cast("int").alias(salts)))
    dealt = big.withColumn(slot, key_slot(keys)).join(hot, slot, "left")
    dealt = dealt.withColumn(salt, F.when(F.col(salts).isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col(salts))).cast("int")).drop(slot, salts)
    copies = per_key.withColumn(slot, key_slot(keys)).join(hot, slot, "left")
    copies = copies.withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))).drop(slot, salts)
    return dealt.join(copies.hint(hint) if hint else copies, [*keys, salt], how).drop(salt)


def hot_keys(rows: DataFrame, keys: list[str], total: int, *aggregates) -> DataFrame:
    """(keys, times, aggregates) of the hot keys.

    Rows are counted by slots first, so that only the keys of crowded slots are counted on their own.
    """
    limit, slot = key_limit(total), key_slot(keys)
    crowded = rows.groupBy(slot.alias("__slot")).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit).select("__slot")
    seen = rows.withColumn("__slot", slot).join(F.broadcast(crowded), "__slot", "left_semi")
    return seen.groupBy(*keys).agg(F.count("*").alias("times"), *aggregates).filter(F.col("times") > limit)


def join_found(big: DataFrame, found: DataFrame, keys: list[str], times: str, total: int) -> DataFrame:
    """Left join with a written table of hot keys: by broadcast while it has few rows, else spread like any other."""
    if found.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(found.drop(times)), keys, "left")
    return join_spread(big, found, keys, times, total, "left").drop(times)


def by_ranges(rows: DataFrame, keys: list[str], total: int, most: int) -> DataFrame:
    """Range partitions by the keys: as many as the session's shuffles have, more where they would hold over ``most`` rows on average."""
    n = -(-total // most)
    if n <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows.repartitionByRange(*keys)
    return rows.repartitionByRange(n, *keys)


#: Folders that this process has written, until they are dropped.
WRITTEN: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    The rows then come from replicated storage: a lost executor costs a re-read, not the
    recomputation of all that came before, and iterative plans stay short.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigrid/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession, keep: int = 0, last: int = 0) -> None:
    """Delete the folders of all cuts after the first ``keep`` and before the ``last``, for when no DataFrame reads them any more."""
    jvm = spark.sparkContext._jvm
    stop = len(WRITTEN) - last
    for path in WRITTEN[keep:stop]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del WRITTEN[keep:stop]


#: Bytes of an Arrow batch on its way to a Python worker; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep an Arrow batch of whole texts small: at most BATCH_BYTES and ``rows`` documents at a time.

    Spark has these bounds for a session alone, so they stay as they are set here unless they were lower before.
    """
    key, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    now = spark.conf.get(size, None)
    if now is not None and not (now.rstrip("bB").isdigit() and 0 < int(now.rstrip("bB")) <= BATCH_BYTES):
        spark.conf.set(size, f"{BATCH_BYTES}b")


#: What the operator of the last task prepared in this worker.
RESIDENT: dict = {}


def resident(name, make):
    """``make()`` once for each name; it outlives a task in the worker that runs it, until another name is asked for."""
    if name not in RESIDENT:
        RESIDENT.clear()
        RESIDENT[name] = make()
    return RESIDENT[name]


def release() -> None:
    """Forget what an earlier task prepared in this worker."""
    RESIDENT.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs in a text, 0 for null; JVM only."""
    pieces = F.size(F.split(text, SPACE_CLASS + "+"))
    ends = F.when(text.rlike("^" + SPACE_CLASS), 1).otherwise(0) + F.when(text.rlike(SPACE_CLASS + r"\z"), 1).otherwise(0)
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(pieces - ends).cast("long")
