"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits, the lowest first. Level 0 holds the first chunk of every id,
level 1 the second of those that have one, and so on; a bitmap beside each level marks the ids that
go on, and a rank directory counts the marks before every block of 512. The place of id i in the
next level is the number of marks before it, so any token is read with one look-up a level.

A file is a Parquet folder; each row is a segment of consecutive documents with its levels as
binary columns. Spark's writer commits it, so a lost executor leaves no half-written segment.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm.shared import bound_batches, by_ranges, cut, resident, table

END_ID = 2
BLOCK = 512
#: Ids in a segment, about: a segment closes with the document that reaches it.
SEGMENT = 1 << 20
#: Words, and parts of words, that an encoder remembers in each of two ages, and the longest of them.
REMEMBERED, LONGEST = 400_000, 48


def dac_encode(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of an id array: chunks, continuation bitmap and rank directory of each."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest >> 8
        goes_on = more > 0
        marks = np.packbits(goes_on, bitorder="little")
        per_block = np.add.reduceat(goes_on, np.arange(0, len(goes_on), BLOCK), dtype=np.uint32) if len(goes_on) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4") if len(per_block) else np.zeros(0, "<u4")
        levels.append({"chunks": (rest & 0xFF).astype(np.uint8).tobytes(), "marks": marks.tobytes(), "ranks": ranks.tobytes()})
        rest = more[goes_on]
    return levels


def dac_decode(levels) -> np.ndarray:
    """All ids of a segment."""
    out = np.zeros(len(levels[0]["chunks"]), dtype=np.uint32)
    at = np.arange(len(out))
    for depth, level in enumerate(levels):
        chunks = np.frombuffer(level["chunks"], dtype=np.uint8)
        out[at] |= chunks.astype(np.uint32) << (8 * depth)
        at = at[np.unpackbits(np.frombuffer(level["marks"], dtype=np.uint8), count=len(chunks), bitorder="little").astype(bool)]
    return out


def dac_get(levels, i: int) -> int:
    """The i-th id, without decoding any other."""
    value = 0
    for depth, level in enumerate(levels):
        value |= level["chunks"][i] << (8 * depth)
        marks = level["marks"]
        if not marks[i >> 3] >> (i & 7) & 1:
            break
        block = i // BLOCK
        rank = int.from_bytes(level["ranks"][4 * block : 4 * block + 4], "little")
        bits = int.from_bytes(marks[block * BLOCK // 8 : (i >> 3) + 1], "little") & ((1 << (i - block * BLOCK)) - 1)
        i = rank + bits.bit_count()
    return value


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


BYTE_CHARS = byte_chars()
SPACE = BYTE_CHARS[0x20]


class Memory(dict):
    """A bounded dictionary that makes what it lacks; what was not asked for in a while is forgotten."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.pop(key, None) if self.old else None
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(key) <= LONGEST:
            self[key] = value
        return value


class Encoder:
    """Ids of texts as little-endian uint32 bytes, with a bounded memory of words and their parts.

    The byte-level vocabulary never joins a word to the space after it. So a text falls into a first
    word and words with a space before them, each encoded alone, unless a space stands beside other
    white space or a special token may occur; such a text goes to the library whole. Words of Latin-1
    characters fall further into the parts that the vocabulary's pattern names.
    """

    PLAIN = re.compile(r" ?[!-~\nÀ-ÖØ-öø-ÿ]+")
    PARTS = regex.compile(public_tokenizers.PATTERN)

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.tokenize = self.library.model.tokenize
        self.parts = Memory(self._part, REMEMBERED)
        self.words = Memory(self._word, REMEMBERED)

    def _library(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        """A part's ids straight from the library's model, which sees bytes as BYTE_CHARS."""
        if part.isascii() and part.replace(" ", "", 1).isalnum():
            seen = part.replace(" ", SPACE)
        else:
            seen = part.encode().decode("latin-1").translate(BYTE_CHARS)
        return array("I", [t.id for t in self.tokenize(seen)]).tobytes()

    def _word(self, word: str) -> bytes | None:
        """Ids of a word with the space before it; None where that space stands beside other white space or ends the text."""
        if not word or word[0].isspace():
            return None
        if word.isascii() and word.isalpha():
            return array("I", [t.id for t in self.tokenize(SPACE + word)]).tobytes()
        body, last = word[:-1], word[-1:]
        if last in STOPS and body.isalpha() and (body.isascii() or self.PLAIN.fullmatch(body)):
            return self.words[body] + self.parts[last]
        if word.isalpha() and self.PLAIN.fullmatch(word):
            return array("I", [t.id for t in self.tokenize(SPACE + word.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()
        return self._pieces(" " + word)

    def _pieces(self, text: str) -> bytes:
        if not self.PLAIN.fullmatch(text):
            return self._library(text)
        return b"".join([self.words[p[1:]] if p[0] == " " and p[1:].isalpha() else self.parts[p] for p in self.PARTS.findall(text)])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._library(text)
        words = text.split(" ")
        first = words.pop(0)
        try:
            return (self._pieces(first) if first else b"") + b"".join(map(self.words.__getitem__, words))
        except TypeError:  # a word without ids of its own
            return self._library(text)


#: What most often ends a word, and is always a part of its own there.
STOPS = frozenset(".,")

def encoder_of(path: str) -> Encoder:
    return resident(("encoder", path), lambda: Encoder(path))


LEVELS = "array<struct<chunks:binary,marks:binary,ranks:binary>>"
SEGMENTS = f"part int, start_in_part bigint, n_tokens bigint, docs array<bigint>, counts array<bigint>, levels {LEVELS}"


def _write(path: str):
    level_type = pa.list_(pa.struct([("chunks", pa.binary()), ("marks", pa.binary()), ("ranks", pa.binary())]))

    def write(batches):
        encoder, part, start = encoder_of(path), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], dtype="<u4").tobytes()
        docs, pieces, held = [], [], 0

        def segment():
            ids = np.frombuffer(b"".join(pieces), dtype="<u4")
            arrays = [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(p) // 4 for p in pieces]], pa.list_(pa.int64())), pa.array([dac_encode(ids)], level_type)]
            return pa.RecordBatch.from_arrays(arrays, ["part", "start_in_part", "n_tokens", "docs", "counts", "levels"])

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                ids = encoder.encode(text.as_py())
                docs.append(doc)
                pieces.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= SEGMENT:
                    yield segment()
                    start, docs, pieces, held = start + held, [], [], 0
        if docs:
            yield segment()

    return write


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = dac_decode(row["levels"]).astype("<u4")
            ends = np.cumsum(row["counts"])
            starts = ends - row["counts"]
            crcs = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends)]
            arrays = [pa.array(row["docs"], pa.int64()), pa.array(starts + row["start"], pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])


#: Rows of a range at most, on average.
RANGE_ROWS = 250_000


def write_tokens(df: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """The written segments of ``df``, in ascending order of id, then of a hash of the text, then text."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    ordered = by_ranges(rows, ["doc", "hash"], rows.count(), RANGE_ROWS).sortWithinPartitions("doc", "hash", "text").select("doc", "text")
    return cut(ordered.mapInArrow(_write(public_tokenizers.path(tokenizer)), SEGMENTS), "tokens")


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the segments alone."""
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    placed = segments.join(F.broadcast(offsets), "part")  # a row a partition of the writing job
    placed = placed.select((F.col("start_in_part") + F.col("before")).alias("start"), "docs", "counts", "levels")
    return placed.mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(df: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Write the ids of every row of ``df`` and digest what the files hold.

    Null text is empty and has the end id alone; rows without an id come first; rows with the same id follow
    one another by hash of the text; an empty table gives no rows; other columns are not read.
    """
    return read_tokens(write_tokens(df, doc, text, tokenizer))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
