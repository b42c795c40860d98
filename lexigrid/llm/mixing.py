"""Mixing sources to target weights with balanced sampling by the cube method.

A source's target over its size says how often each of its documents should be taken, between 0
and 2 times. The whole part is taken; the fraction is every document's inclusion probability.
The flight phase moves three undecided probabilities at a time through the null space of the two
balancing constraints (number of documents, number of tokens) until one of them is 0 or 1, so both
totals stay what they were. It runs in groups of bounded size, whose few undecided documents meet
again in the next round; the last handful of each source is landed on the nearest total.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm.shared import cut, free_name, table, word_count

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Documents in a group of the flight phase, on average at most.
GROUP = 4000
#: Documents of a source that are left to the landing, beside the last that the flight leaves undecided.
LANDING = 10
EPS = 1e-9


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, docs, target: ``share`` of all sizes by weight, none over ``most`` sizes.

    Sorted by size over weight, the sources that stop at their limit come first, so running
    sums tell which do. ``per_source`` has one row for each source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    rows = per_source.withColumn("weight", weight).withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("full", F.col("ratio") <= F.col("level"))
    rest = F.when(~F.col("full"), F.col("level"))
    rows = rows.withColumn("level", F.max(rest).over(everything))  # the first that is not full
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * F.col("level")))
    return rows.select("source", "source_size", "docs", target.cast("double").alias("target"))


def fly(sizes: list[int], probs: list[float], rng: random.Random) -> list[float]:
    """The flight phase: both ``sum(p)`` and ``sum(p * size)`` stay, at most two p stay undecided."""
    probs = list(probs)
    active: list[int] = []
    for k in range(len(probs)):
        if not EPS < probs[k] < 1 - EPS:
            probs[k] = round(probs[k])
            continue
        active.append(k)
        while len(active) > 2 or (len(active) == 2 and sizes[active[0]] == sizes[active[1]]):
            if len(active) == 2:
                move = (1.0, -1.0)
            else:
                a, b, c = (sizes[i] for i in active)
                move = (float(c - b), float(a - c), float(b - a))
                if not any(move):
                    move = (1.0, -1.0, 0.0)
            up = min((1 - probs[i]) / m if m > 0 else probs[i] / -m for i, m in zip(active, move) if m)
            down = min(probs[i] / m if m > 0 else (1 - probs[i]) / -m for i, m in zip(active, move) if m)
            step = up if rng.random() * (up + down) < down else -down
            for i, m in zip(active, move):
                p = probs[i] + step * m
                probs[i] = 0.0 if p < EPS else 1.0 if p > 1 - EPS else p
            active = [i for i in active if 0.0 < probs[i] < 1.0]
    return probs


def land(sizes: list[int], probs: list[float]) -> list[int]:
    """0 or 1 for the few undecided: the nearest total of tokens, then of documents."""
    n = len(sizes)
    choices = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    off = np.abs(choices @ np.array(sizes, dtype=np.float64) - float(np.dot(sizes, probs)))
    miscount = np.abs(choices.sum(axis=1) - sum(probs))
    return choices[np.lexsort((miscount, np.round(off, 6)))[0]].tolist()


def _flight(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last = bool(pdf["last"].iloc[0])
        pdf = pdf.sort_values(["order", "size", "rid"], kind="stable").reset_index(drop=True)
        rng = random.Random(f"{seed} {pdf['order'].iloc[0]} {len(pdf)}")
        sizes, probs = [int(s) for s in pdf["size"]], pdf["p"].tolist()
        kept: set[int] = set()
        if last:  # for the landing: documents of all sizes, spread over the order of size
            by_size = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
            kept = {by_size[round(k * (len(sizes) - 1) / LANDING)] for k in range(LANDING + 1)}
        flying = [i for i in range(len(sizes)) if i not in kept]
        for i, p in zip(flying, fly([sizes[i] for i in flying], [probs[i] for i in flying], rng)):
            probs[i] = p
        if last:
            left = [i for i, p in enumerate(probs) if 0.0 < p < 1.0]
            for i, x in zip(left, land([sizes[i] for i in left], [probs[i] for i in left])):
                probs[i] = float(x)
        return pdf.assign(p=probs)[["rid", "sid", "size", "order", "p"]]

    return run


def cube_sample(units: DataFrame, seed: int = 42) -> DataFrame:
    """(rid, p) with p 0 or 1 from ``units(rid, sid, size, order, p)``, balanced in each ``sid``.

    ``order`` is a hash that is the same in every run; units that agree in it and in size may
    change places without a difference.
    """
    decided, rounds = [], 0
    while True:
        per = units.groupBy("sid").agg(F.count("*").alias("n"))
        largest = per.agg(F.max("n")).first()[0]
        if largest is None:
            break
        groups = F.ceil(F.col("n") / GROUP).cast("long")
        # a source lands in the round that it fits a group, whatever the size of the others
        dealt = units.join(per, "sid").withColumn("last", F.col("n") <= GROUP).withColumn("bucket", F.pmod(F.xxhash64("order", F.lit(rounds)), groups))
        flown = cut(dealt.groupBy("sid", "bucket").applyInPandas(_flight(seed + rounds), "rid long, sid int, size long, order long, p double"), "cube")
        decided.append(flown.filter((F.col("p") == 0) | (F.col("p") == 1)).select("rid", "p"))
        if largest <= GROUP:
            break
        units, rounds = flown.filter((F.col("p") > 0) & (F.col("p") < 1)), rounds + 1
    if not decided:
        return units.select("rid", "p")
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix(df: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, size, source_size, target, copies, taken: one row for each row of ``df``.

    Null text has size 0; null sources are one source, the last; a source of size 0 has target 0
    and takes nothing; repeated rows are units of their own; a null id is kept; an empty table
    gives no rows; other columns are not read.
    """
    whole = F.col(text).cast("string")
    sized = df.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(whole).alias("text_hash"), F.col(source).cast("string").alias("source"), word_count(whole).alias("size"))
    sized = cut(sized.withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = targets(per_source, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(F.lit(0.0))
    plan = cut(plan.withColumn("whole", F.floor(ratio + EPS)).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0))).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("int")).withColumnRenamed("source", "plan_source"), "mix-plan")
    rows = cut(sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).select("rid", "doc_id", "text_hash", "size", "source_size", "target", "whole", "sid", "p"), "mix-rows")
    units = rows.filter(F.col("p") > EPS).select("rid", "sid", "size", F.xxhash64("doc_id", "text_hash", "size").alias("order"), "p")
    drawn = cube_sample(units, seed).withColumnRenamed("p", "drawn")
    copies = (F.col("whole") + F.coalesce(F.col("drawn"), F.lit(0.0))).cast("long")
    out = rows.join(drawn, "rid", "left").withColumn("copies", copies)
    return out.select("doc_id", "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(df: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``df``, all columns, each as often as the mix takes it."""
    mix_doc, mix_hash, mix_copies, mix_turn, row_hash, row_turn, copy = (free_name(df, c) for c in ("mix_doc", "mix_hash", "mix_copies", "mix_turn", "row_hash", "row_turn", "mix_copy"))
    plan = mix(df, doc, text, source, **how).filter("copies > 0").select(F.col("doc_id").alias(mix_doc), F.col("text_hash").alias(mix_hash), F.col("copies").alias(mix_copies))
    ids = df.agg(F.count("*").alias("n"), F.count_distinct(doc).alias("d")).first()
    rows = df.withColumn(row_hash, F.xxhash64(F.col(text).cast("string")))
    same = F.col(doc).cast("long").eqNullSafe(F.col(mix_doc)) & (F.col(row_hash) == F.col(mix_hash))
    if ids["n"] != ids["d"]:
        plan = plan.withColumn(mix_turn, F.row_number().over(Window.partitionBy(mix_doc, mix_hash).orderBy(mix_copies)))
        rows = rows.withColumn(row_turn, F.row_number().over(Window.partitionBy(doc, row_hash).orderBy(F.col(source))))
        same = same & (F.col(row_turn) == F.col(mix_turn))
    met = rows.join(plan, same)
    return met.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array_repeat(F.lit(1), F.col(mix_copies).cast("int"))).alias(copy)).drop(copy)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")
