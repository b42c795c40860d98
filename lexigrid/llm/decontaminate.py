"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit verification.

Texts are sequences of words (runs of letters and digits, lower-cased). A document is contaminated
by an item of m words if some stretch of it is within floor((1 - similarity) * m) word edits.

A CGK walk over a sequence repeats or moves past a word by a random bit of step and word, so few edits become few
differing places. In each of REPEATS walks the words at SAMPLED random steps are the LSH key. Items of about one length are
a class, whose sampled steps spread over that length; the index holds the keys of a class's items for each walk. In a
document the same walks start from every place, and windows that share a key with an item are candidates. A place
is left out for a class only where none of its items can match: where its own word is in none, or too few words of the window are (each
other word costs an edit). Candidates are verified by the exact edit distance against the stretch around them.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.shared import bound_batches, cut, resident, table

WORD = re.compile(r"[^\W_]+")
SIMILARITY = 0.8
REPEATS, SAMPLED = 28, 3
#: Sampled steps reach so many times the length of a window; the walk takes about twice as many to its end.
REACH = 1.4
#: A class holds items whose lengths differ by less than this factor.
CLASS = 1.15
#: The random bits of a walk: for so many steps (then again) and so many words, which share bits beyond that.
STEPS, SLOTS = 128, 4096
#: Places whose walks go together.
TOGETHER = 60_000
#: Items of fewer words may not differ by an edit; one of a single word must be all that a text has.
LEAST_WORDS = 5
#: Characters of items that one broadcast block holds; larger benchmarks take several passes, one after the other.
BLOCK_CHARS = 20_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def edits_allowed(m: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * m + 1e-9)


def best_match(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the part of ``stretch`` nearest to ``item``; the earliest, then shortest.

    A cell is edits times ``one`` plus start, so a row is a few array steps: an insertion carries the least cell so far on.
    """
    n = len(stretch)
    one = n + 1
    ramp = np.arange(n + 1, dtype=np.int64) * one
    row = np.arange(n + 1, dtype=np.int64)
    for i, word in enumerate(item, 1):
        here = row + one
        here[1:] = np.minimum(here[1:], row[:-1] + one * (stretch != word))
        here[0] = i * one
        row = np.minimum.accumulate(here - ramp) + ramp
    end = int(np.argmin(row))
    return int(row[end]) // one, int(row[end]) % one, end


def least_edits(items: list[np.ndarray], stretches: list[np.ndarray]) -> np.ndarray:
    """The edits of ``best_match`` for each pair, taken together row by row; the longest items come first."""
    sizes = np.array([len(x) for x in items])
    width = max(map(len, stretches)) + 1
    words, held = np.zeros((int(sizes[0]), len(items)), dtype=np.int32), np.full((len(items), width - 1), -1, dtype=np.int32)
    for r, (item, stretch) in enumerate(zip(items, stretches)):
        words[: len(item), r], held[r, : len(stretch)] = item, stretch
    ramp = np.arange(width, dtype=np.int32)
    rows = np.zeros((len(items), width), dtype=np.int32)
    for i in range(1, int(sizes[0]) + 1):
        n = int(np.searchsorted(-sizes, -i, side="right"))  # items that have a word i
        last = rows[:n]
        here = last + 1
        np.minimum(here[:, 1:], last[:, :-1] + (held[:n] != words[i - 1, :n, None]), out=here[:, 1:])
        here -= ramp
        np.minimum.accumulate(here, axis=1, out=rows[:n])
        rows[:n] += ramp
    return rows.min(axis=1)


def random_bits() -> np.ndarray:
    """The bit of each walk, step and word; the same everywhere."""
    return np.random.default_rng(42).integers(0, 2, size=(REPEATS, STEPS, SLOTS), dtype=np.uint8)


def sampled_steps(length: int) -> np.ndarray:
    """(REPEATS, SAMPLED) distinct steps of the walks over windows of about ``length`` words, which take about twice as many."""
    share = np.sort(np.random.default_rng(43).random((REPEATS, SAMPLED)), axis=1)
    return (share * (REACH * length - SAMPLED)).astype(np.int64) + np.arange(SAMPLED)


def walk(ids: np.ndarray, slots: np.ndarray, starts: np.ndarray, bits: np.ndarray, steps: list[int]) -> dict[int, np.ndarray]:
    """The words at ``steps`` of one walk (whose bits these are) from each of ``starts``; ``ids`` ends in enough zeros."""
    place, wanted, out = starts.copy(), set(steps), {}
    slot, move = np.empty(len(place), dtype=slots.dtype), np.empty(len(place), dtype=bits.dtype)
    for step in range(max(steps) + 1):
        if step in wanted:
            out[step] = ids[place]
        np.take(slots, place, out=slot, mode="clip")
        np.take(bits[step % STEPS], slot, out=move, mode="clip")
        np.add(place, move, out=place)
    return out


def key_of(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of the sampled words, and whether all are known (0 is a word of no item, or none)."""
    key, known = np.zeros(len(words[0]), dtype=np.uint64), np.ones(len(words[0]), dtype=bool)
    for w in words:
        key = (key + w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        known &= w > 0
    return key ^ (key >> np.uint64(32)), known


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, str | None]], similarity: float = SIMILARITY):
        pairs = [(i, w) for i, t in items if (w := words_of(t))]
        self.ids = [p[0] for p in pairs]
        self.number: dict[str, int] = {}
        for _, ws in pairs:
            for w in ws:
                self.number.setdefault(w, len(self.number) + 1)
        self.words = [np.array([self.number[w] for w in ws], dtype=np.int64) for _, ws in pairs]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.edits = np.array([edits_allowed(len(w), similarity) for w in self.words], dtype=np.int64)
        self.short: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        members = defaultdict(list)
        for r, ws in enumerate(self.words):
            if len(ws) < LEAST_WORDS:
                self.short[len(ws)][tuple(ws.tolist())].append(r)
            else:
                members[int(math.log(len(ws) / LEAST_WORDS) / math.log(CLASS) + 1e-9)].append(r)
        self.bits = random_bits() if members else None
        self.classes = [self._class(np.array(rows)) for _, rows in sorted(members.items())]
        self.pad = 1 + max((max(int(c["steps"].max()), c["span"]) for c in self.classes), default=LEAST_WORDS)

    def _class(self, rows: np.ndarray) -> dict:
        length = int(self.sizes[rows].min())
        steps = sampled_steps(length)
        pad = int(steps.max()) + 1
        begins = np.cumsum(np.concatenate([[0], self.sizes[rows][:-1] + pad]))
        ids = np.concatenate([np.concatenate([self.words[r], np.zeros(pad, dtype=np.int64)]) for r in rows])
        index, maybe = [], np.zeros((REPEATS, 1 << 16), dtype=bool)
        for r in range(REPEATS):
            found = walk(ids, (ids % SLOTS).astype(np.int16), begins.astype(np.int32), self.bits[r], steps[r].tolist())
            key, known = key_of([found[int(t)] for t in steps[r]])
            order = np.argsort(key[known], kind="stable")
            keys, first = np.unique(key[known][order], return_index=True)
            maybe[r, keys & np.uint64(0xFFFF)] = True
            index.append((keys, np.append(first, known.sum()), rows[known][order]))
        member = np.zeros(len(self.number) + 1, dtype=np.int8)
        member[np.concatenate([self.words[r] for r in rows])] = 1
        return {"steps": steps, "index": index, "maybe": maybe, "member": member, "least": int((self.sizes - self.edits)[rows].min()), "span": int((self.sizes + self.edits)[rows].max())}

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (item, start) whose windows share a key. ``ids`` ends in ``pad`` zeros."""
        n = len(ids) - self.pad
        if n <= 0 or not self.classes:
            return (np.empty(0, dtype=np.int64),) * 2
        able = []
        for c in self.classes:
            inside = c["member"][ids]
            held = np.cumsum(inside, dtype=np.int32)
            ends = held[c["span"] - 1 : c["span"] - 1 + n]  # pad is longer than any span
            able.append((inside[:n] > 0) & (ends - held[:n] + 1 >= c["least"]))
        begins = np.flatnonzero(np.any(able, axis=0)).astype(np.int32)
        able = [a[begins] for a in able]
        slots, found = (ids % SLOTS).astype(np.int16), []
        for low in range(0, len(begins), TOGETHER):
            starts = begins[low : low + TOGETHER]
            mine = [(c, np.flatnonzero(a[low : low + TOGETHER])) for c, a in zip(self.classes, able)]
            mine = [(c, rows) for c, rows in mine if len(rows)]
            for r in range(REPEATS):
                words = walk(ids, slots, starts, self.bits[r], sorted({int(t) for c, _ in mine for t in c["steps"][r]}))
                for c, rows in mine:
                    key, known = key_of([words[int(t)][rows] for t in c["steps"][r]])
                    met = np.flatnonzero(known & c["maybe"][r][key & np.uint64(0xFFFF)])
                    keys, first, items = c["index"][r]
                    if not len(met) or not len(keys):
                        continue
                    slot = np.minimum(np.searchsorted(keys, key[met]), len(keys) - 1)
                    same = keys[slot] == key[met]
                    met, slot = met[same], slot[same]
                    times = first[slot + 1] - first[slot]
                    if not times.sum():
                        continue
                    source = np.repeat(first[slot] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                    found.append(np.stack([items[source], np.repeat(starts[rows[met]], times)]))
        if not found:
            return (np.empty(0, dtype=np.int64),) * 2
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of the best match of each contaminated text and item."""
        if not self.ids:
            return []
        get = self.number.get
        numbers = [[get(w, 0) for w in words_of(t)] for t in texts]
        sizes = np.array([len(x) for x in numbers], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else sizes  # a word of no item between texts
        ids = np.zeros(int((sizes + 1).sum()) + self.pad, dtype=np.int32)
        for b, x in zip(begins, numbers):
            ids[b : b + len(x)] = x
        best: dict[tuple[int, int], tuple[int, int, int]] = {}

        def matched(text: int, item: int, edits: int, first: int, last: int) -> None:
            match = (edits, first - int(begins[text]), last - int(begins[text]))
            best[text, item] = min(best.get((text, item), match), match)

        for size, listed in self.short.items():
            starts = {run[0] for run in listed}
            for at in np.flatnonzero(np.isin(ids, list(starts))).tolist():
                for item in listed.get(tuple(ids[at : at + size].tolist()), ()):
                    text = int(np.searchsorted(begins, at, side="right")) - 1
                    if size > 1 or sizes[text] == 1:
                        matched(text, item, 0, at, at + size)
        items, starts = self.candidates(ids)
        of_text = np.searchsorted(begins, starts, side="right") - 1
        k, m = self.edits[items], self.sizes[items]
        low, high = np.maximum(begins[of_text], starts - k), np.minimum((begins + sizes)[of_text], starts + m + 2 * k)
        fresh = np.ones(len(items), dtype=bool)  # of stretches one after the other that end alike, the first is the longest
        fresh[1:] = (items[1:] != items[:-1]) | (of_text[1:] != of_text[:-1]) | (high[1:] != high[:-1])
        order = np.flatnonzero(fresh)
        order = order[np.argsort(-m[order], kind="stable")]
        for part in (order[i : i + 2000] for i in range(0, len(order), 2000)):
            stretches = [ids[a:b] for a, b in zip(low[part], high[part])]
            edits = least_edits([self.words[i] for i in items[part]], stretches)
            for at in np.flatnonzero(edits <= k[part]).tolist():
                row = part[at]
                found, first, last = best_match(self.words[items[row]], stretches[at])
                matched(int(of_text[row]), int(items[row]), found, int(low[row]) + first, int(low[row]) + last)
        return [(a, b, first, last, edits) for (a, b), (edits, first, last) in sorted(best.items())]


def item_blocks(bench: DataFrame, item: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """The benchmark in parts of about ``block_chars`` characters, each small enough to broadcast."""
    picked = bench.select(F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    chars = picked.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / block_chars))
    return [picked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) for b in range(n)]


def _listed(block: DataFrame):
    """One bounded block, known by a name of its own."""
    rows = sorted((r["item"] if r["item"] is not None else -1, r["text"]) for r in block.collect())
    return block.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))


def prepared(listed, similarity: float) -> Items:
    name, rows = listed.value
    return resident(("items", name, similarity), lambda: Items(rows, similarity))


def _chunks(column, words: int = 400_000):
    """Slices of a batch's texts with a bounded number of characters, or one text."""
    texts, low, held = column.to_pylist(), 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > 6 * words:
            yield low, texts[low : i + 1]
            low, held = i + 1, 0
    if low < len(texts):
        yield low, texts[low:]


def _passes(df: DataFrame, bench: DataFrame, item: str, item_text: str, one_pass, gather: bool) -> DataFrame:
    """``one_pass(rows, listed)`` for each block. Of several, each is written before the next is broadcast, so one is held at a time.

    ``gather`` unions what the passes find in ``df``; otherwise each pass takes what the last has left.
    """
    blocks, out = item_blocks(bench, item, item_text), None
    for block in blocks:
        listed = _listed(block)
        part = one_pass(df if gather or out is None else out, listed)
        if len(blocks) > 1:
            part = cut(part, "leaks")
            listed.unpersist()
        out = part if out is None or not gather else out.unionByName(part)
    return out


def find_leaks(df: DataFrame, bench: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start, end (words), edits, similarity: a row for each contaminated document and item.

    Null and empty texts hold nothing; items without words match nothing, those of under LEAST_WORDS words match as they
    are, and one of a single word only a text that is that word; a null item id is given as -1; repeated documents or items give a
    row each; either table may be empty; other columns are not read.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def one_pass(rows, listed):
        def find(batches):
            items = prepared(listed, similarity)
            for batch in batches:
                docs = batch.column("doc_id").to_pylist()
                for low, texts in _chunks(batch.column("text")):
                    hits = items.search(texts)
                    columns = [[docs[low + a] for a, *_ in hits], [items.ids[b] for _, b, *_ in hits], [h[2] for h in hits], [h[3] for h in hits], [h[4] for h in hits]]
                    arrays = [pa.array(c, pa.int64()) for c in columns]
                    arrays.append(pa.array([1 - h[4] / int(items.sizes[h[1]]) for h in hits], pa.float64()))
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "start", "end", "edits", "similarity"])

        return rows.mapInArrow(find, "doc_id bigint, item_id bigint, start bigint, end bigint, edits bigint, similarity double")

    return _passes(rows, bench, item, item_text, one_pass, gather=True)


def drop_contaminated(df: DataFrame, bench: DataFrame, text: str = "text", similarity: float = SIMILARITY, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that hold no item. Rows are judged where they are read."""
    bound_batches(df.sparkSession)
    at, schema = df.columns.index(text), df.schema

    def one_pass(rows, listed):
        def keep(batches):
            items = prepared(listed, similarity)
            for batch in batches:
                leaked = {low + hit[0] for low, texts in _chunks(batch.column(at)) for hit in items.search(texts)}
                yield batch.filter(pa.array([i not in leaked for i in range(batch.num_rows)], pa.bool_()))

        return rows.mapInArrow(keep, schema)

    return _passes(df, bench, item, item_text, one_pass, gather=False)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
