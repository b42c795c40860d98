"""Exact search for the nearest vectors, in which bounds on angles tell what need not be compared.

The vectors of the base go to the nearest of some centres, and by their angle to it into rings; a block is a part of a ring. What a
query can score in a block is bounded by its own angle to the block's centre: from a vector between two angles to the centre it is at
least as far as it is from that ring. A query first meets the blocks with the highest bounds, as many as it takes to hold k vectors. Its
k-th best score then, or the threshold, is what the bound of every other block has to reach for the two to meet at all.

A few queries are fewer than the centres that a vector would be placed by: they go to all tasks, and the base stays where it is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.operators import metrics
from lexigrid.operators.durable import TASK_ROWS, cut, dealt
from lexigrid.operators.ranks import top_per

#: Vectors of one side in a cell of the comparison, on average at most; blocks in all, beyond which they grow instead.
CELL, MOST_BLOCKS = 4096, 65_536
#: Centres at most, and the width of a ring in radians. Both bound what goes to the driver and to every task.
CENTRES, RING = 1024, 0.1
#: Queries that all tasks get at most.
FEW = 256
#: What a bound may be off by in floating point.
SLACK = 1e-6

BLOCK = ["__centre", "__ring", "__part"]


def matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and the lengths; a zero vector stays as it is."""
    norms = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norms > 0, norms, 1)[:, None], norms


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def typed(df: DataFrame, columns: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def blocks_of(kb: DataFrame, by: list[str], cell: int = CELL) -> tuple[np.ndarray, DataFrame, pd.DataFrame]:
    """(centres, kb with its block, blocks): the centres are the vectors with the lowest hashes of their names; ``blocks`` has a row
    a block (by, BLOCK, n, near, far, short, long): its vectors' least and largest angle to the centre, and lengths."""
    n = kb.count()
    if kb.rdd.getNumPartitions() * TASK_ROWS < n:
        kb = dealt(kb, n, "cui", "name")
    cell = max(cell, -(-n // MOST_BLOCKS))
    some = kb.orderBy(F.xxhash64("cui", "name"), "name", "cui").limit(max(1, min(CENTRES, -(-n // cell)))).select("vec").toPandas()
    centres = unit(matrix(some["vec"]))[0] if len(some) else np.zeros((0, 1))
    columns = [*by, "cui", "name", "vec"]

    def place(frames):
        for pdf in frames:
            if len(pdf):
                m, norms = unit(matrix(pdf["vec"]))
                at = m @ centres.T
                home = at.argmax(axis=1)
                near = np.arccos(np.clip(at[np.arange(len(pdf)), home], -1.0, 1.0))
                yield pdf.assign(__centre=home.astype(np.int32), __angle=near, __norm=norms)[[*columns, "__centre", "__angle", "__norm"]]

    placed = kb.select(*columns).mapInPandas(place, f"{typed(kb, columns)}, __centre int, __angle double, __norm double")
    placed = cut(placed.withColumn("__ring", F.floor(F.col("__angle") / RING).cast("int")))
    sizes = placed.groupBy(*by, "__centre", "__ring").agg(F.count("*").alias("__n"))  # types times centres times rings at most
    parts = F.broadcast(sizes.select(*by, "__centre", "__ring", F.ceil(F.col("__n") / cell).alias("__parts")))
    dealt = placed.join(parts, [*by, "__centre", "__ring"]).withColumn("__part", F.pmod(F.xxhash64("cui", "name"), F.col("__parts")).cast("int"))
    told = dealt.groupBy(*by, *BLOCK).agg(F.count("*").alias("n"), F.min("__angle").alias("near"), F.max("__angle").alias("far"), F.min("__norm").alias("short"), F.max("__norm").alias("long"))
    return centres, dealt.select(*columns, *BLOCK), told.toPandas()


def bounds(queries: np.ndarray, centres: np.ndarray, blocks: pd.DataFrame) -> np.ndarray:
    """The highest product that each query can have with a vector of each block."""
    m, norms = unit(queries)
    at = angles(m, centres)[:, blocks["__centre"].to_numpy()]
    apart = np.maximum(np.maximum(at - blocks["far"].to_numpy(), blocks["near"].to_numpy() - at) - SLACK, 0)
    cosine = np.cos(np.minimum(apart, np.pi))
    return norms[:, None] * cosine * np.where(cosine > 0, blocks["long"].to_numpy(), blocks["short"].to_numpy()) + SLACK


def visits(queries: DataFrame, by: list[str], centres: np.ndarray, blocks: pd.DataFrame, k: int, threshold: float, reached: DataFrame | None = None, slack: float = 0.0) -> DataFrame:
    """(q, vec, by, BLOCK): which blocks each query meets. Without ``reached``, its first ones; with it (q, by, kth), all others that can
    still matter. ``slack`` is what rounding may add to a score."""
    rows = queries if reached is None else queries.join(reached, ["q", *by], "left")
    columns, again = ["q", "vec", *by], reached is not None

    def plan(frames):
        keys = blocks[by].apply(tuple, axis=1).to_numpy() if by and len(blocks) else None
        n = blocks["n"].to_numpy()
        for whole in frames:
            for lo in range(0, len(whole), 256):
                pdf = whole.iloc[lo : lo + 256]
                high = bounds(matrix(pdf["vec"]), centres, blocks) if len(blocks) else np.zeros((len(pdf), 0))
                if keys is not None:
                    for r, own in enumerate(pdf[by].itertuples(index=False, name=None)):
                        high[r, [key != own for key in keys]] = -np.inf
                order = np.argsort(-high, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                ranked = np.take_along_axis(high, order, axis=1)
                met = (before < k) & (ranked + slack >= threshold)
                if again:
                    kth = pdf["kth"].fillna(-np.inf).to_numpy(dtype=np.float64)
                    met = (before >= k) & (ranked + slack >= np.maximum(kth, threshold)[:, None])
                q, place = np.nonzero(met & (ranked > -np.inf))
                out = pdf.iloc[q][columns].reset_index(drop=True)
                for c in BLOCK:
                    out[c] = blocks[c].to_numpy()[order[q, place]].astype(np.int32)
                yield out

    return rows.mapInPandas(plan, f"{typed(queries, columns)}, " + ", ".join(f"{c} int" for c in BLOCK))


def best(a: pd.DataFrame, b: pd.DataFrame, k: int, digits: int | None) -> tuple[np.ndarray, pd.DataFrame]:
    """(rows of ``a``, as many rows of ``b`` with their score): the k best of ``b`` for each of ``a``; of equal scores the first by name, then cui."""
    scores = matrix(a["vec"]) @ matrix(b["vec"]).T
    if digits is not None:
        scores = np.floor(np.abs(scores) * 10**digits + 0.5) / 10**digits * np.sign(scores)
    if len(b) > k:  # all that reach the k-th score, and of its equals the first by name
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        reach = np.flatnonzero((scores >= kth).any(axis=0))
        reach = reach[b.iloc[reach][["name", "cui"]].reset_index(drop=True).sort_values(["name", "cui"], kind="stable").index.to_numpy()]
        b, scores = b.iloc[reach], scores[:, reach]
        inside = scores > kth
        equal = scores == kth
        inside |= equal & (np.cumsum(equal, axis=1) <= k - inside.sum(axis=1, keepdims=True))
    else:
        inside = np.ones(scores.shape, dtype=bool)
    rows, picked = np.nonzero(inside)
    return rows, b.iloc[picked][["cui", "name"]].reset_index(drop=True).assign(score=scores[rows, picked])


def scanned(few: pd.DataFrame, kb: DataFrame, by: list[str], k: int, digits: int | None) -> DataFrame:
    """(__i, cui, name, score): the k best of every stretch of TASK_ROWS rows of the base for each of ``few(__i, vec, by)``."""
    columns = [*by, "cui", "name", "vec"]

    def stretch(frames):
        pdf = pd.concat(frames, ignore_index=True)
        for own, a in few.groupby(by, dropna=True) if by else [((), few)]:
            b = pdf[(pdf[by] == list(own)).all(axis=1)] if by else pdf
            if len(a) and len(b):
                rows, found = best(a, b, k, digits)
                yield found.assign(__i=a["__i"].to_numpy()[rows])[["__i", "cui", "name", "score"]]

    def scan(frames):
        held, n = [], 0
        for pdf in frames:
            held, n = [*held, pdf], n + len(pdf)
            if n >= TASK_ROWS:
                yield from stretch(held)
                held, n = [], 0
        if n:
            yield from stretch(held)

    return kb.select(*columns).mapInPandas(scan, "__i long, cui string, name string, score double")


def compared(met: DataFrame, kb: DataFrame, by: list[str], k: int, digits: int | None, cell: int) -> DataFrame:
    """(q, by, cui, name, score): of each query and block that meet, the k best. A block's queries are dealt out as well, ``cell`` a task."""
    sizes = met.groupBy(*by, *BLOCK).agg(F.ceil(F.count("*") / cell).alias("__groups"))
    left = met.join(sizes, [*by, *BLOCK]).withColumn("__group", F.pmod(F.xxhash64(F.to_json(F.struct("q"))), F.col("__groups")).cast("int")).drop("__groups")
    right = kb.join(sizes, [*by, *BLOCK]).withColumn("__group", F.explode(F.sequence(F.lit(0), (F.col("__groups") - 1).cast("int")))).drop("__groups")
    keys, columns = [*by, *BLOCK, "__group"], [*by, "q", "cui", "name", "score"]

    def cells(a, b):
        if a.empty or b.empty:
            return pd.DataFrame(columns=columns)
        rows, found = best(a, b, k, digits)
        return pd.concat([a.iloc[rows][[*by, "q"]].reset_index(drop=True), found], axis=1)[columns]

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cells, f"{typed(met, [*by, 'q'])}, cui string, name string, score double")


def top_candidates(queries: DataFrame, kb: DataFrame, k: int, threshold: float, by: list[str] | None = None, digits: int | None = None, cell: int = CELL) -> DataFrame:
    """The k names of ``kb(cui, name, vec[, by])`` with the highest products with each of ``queries(q, vec[, by])``, ranked, that reach
    the threshold; of equal scores the first by name, then cui. With ``by`` a query meets its own type alone. Exact for vectors of any length.
    """
    by = by or []
    vec = F.col("vec").cast("array<double>").alias("vec")
    queries = cut(queries.select("q", vec, *by).withColumn("__i", F.monotonically_increasing_id()))
    kb, order = kb.select(*by, "cui", "name", vec), [F.col("score").desc(), "name", "cui"]
    few = queries.select("__i", "vec", *by).limit(FEW + 1).toPandas()
    if len(few) <= FEW:
        found = top_per(scanned(few, kb, by, k, digits).filter(F.col("score") >= threshold), ["__i"], order, k)
        return found.join(F.broadcast(queries.select("__i", "q", *by)), "__i").select("q", *by, "cui", "name", "score", "rank")
    kb = cut(kb)
    centres, dealt, blocks = blocks_of(kb, by, cell)
    slack = 0.5 * 10.0**-digits if digits is not None else 0.0
    rank = lambda rows: top_per(rows.filter(F.col("score") >= threshold), ["q", *by], order, k)
    local = compared(visits(queries, by, centres, blocks, k, threshold, slack=slack), dealt, by, k, digits, cell)
    if not len(blocks) or (blocks.groupby(by).size().max() if by else len(blocks)) == 1:
        return rank(local).select("q", *by, "cui", "name", "score", "rank")
    first = cut(local)
    reached = rank(first).filter(F.col("rank") == k).select("q", *by, F.col("score").alias("kth"))
    others = compared(visits(queries, by, centres, blocks, k, threshold, reached, slack), dealt, by, k, digits, cell)
    return rank(metrics.unioned([first, others])).select("q", *by, "cui", "name", "score", "rank")
