"""Aggregates: summaries, set overlap, per-label scores and rounded means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.durable import cut


def ratio(top: Column, bottom: Column) -> Column:
    """0.0 where the denominator is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def summary(df: DataFrame, metrics: list[str], digits: int = 2) -> DataFrame:
    """A row for each metric: count, mean, median, min, max, population std, quartiles by interpolation.

    Values are counted first, map-side, so that what meets for a metric is its distinct values and not a value a row; and
    even those meet in ranges alone, as many as there are shuffle partitions (``quantiles``).
    """
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    counted = cut(df.select(F.explode(values).alias("v")).select("v.*").groupBy("metric", "value").agg(F.count("*").alias("n")))
    rounded = lambda x: F.round(x, digits)
    n = F.when(F.col("value").isNull(), 0).otherwise(F.col("n"))
    total, mean = F.sum(n), F.sum(F.col("value") * n) / F.nullif(F.sum(n), F.lit(0))
    spread = F.when(F.sum(n) > 0, F.sqrt(F.greatest(F.sum(F.col("value") * F.col("value") * n) / F.nullif(F.sum(n), F.lit(0)) - mean * mean, F.lit(0.0))))
    found = counted.groupBy("metric").agg(total.cast("long").alias("count"), rounded(mean).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), rounded(spread).alias("std"))
    cuts = quantiles(counted, {"median": 0.5, "p25": 0.25, "p75": 0.75})
    named = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    met = named.join(found, "metric", "left").join(cuts, "metric", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    return met.select("metric", "count", "mean", rounded(F.col("median")).alias("median"), "min", "max", "std", rounded(F.col("p25")).alias("p25"), rounded(F.col("p75")).alias("p75"))


def quantiles(counted: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """metric and a column for each wanted share: exact quantiles, interpolated, of ``counted(metric, value, n)``.

    Distinct values are sorted by ranges. How many rows stand before a range follows from one row a range; inside it running sums
    give each value its ranks, and only values that hold a wanted rank go on.
    """
    ranged = cut(counted.filter("value IS NOT NULL").repartitionByRange("metric", "value").withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("metric", "__range").agg(F.sum("n").alias("__size"))
    order = Window.partitionBy("metric").orderBy("__range")
    before = F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.select("metric", "__range", before.alias("__before"), F.sum("__size").over(Window.partitionBy("metric")).alias("__all"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("metric", "__range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranged.withColumn("__in", inside).join(placed, ["metric", "__range"]).withColumn("__first", F.col("__before") + F.col("__in"))
    has = lambda rank: (F.col("__first") <= rank) & (rank < F.col("__first") + F.col("n"))
    ranks = {name: F.lit(q) * (F.col("__all") - 1) for name, q in wanted.items()}
    kept = rows.filter(reduce(lambda a, b: a | b, [has(f(r)) for r in ranks.values() for f in (F.floor, F.ceil)]))
    at = lambda rank: F.max(F.when(has(rank), F.col("value")))
    columns = []
    for name, rank in ranks.items():
        columns += [at(F.floor(rank)).alias(f"__lo_{name}"), at(F.ceil(rank)).alias(f"__hi_{name}"), F.max(rank - F.floor(rank)).alias(f"__part_{name}")]
    found = kept.groupBy("metric").agg(*columns)
    between = lambda n: F.col(f"__lo_{n}") * (1 - F.col(f"__part_{n}")) + F.col(f"__hi_{n}") * F.col(f"__part_{n}")
    return found.select("metric", *[between(n).alias(n) for n in wanted])


def overlap(gold: DataFrame, pred: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two sets of keys, for each ``by`` or overall.

    The sets are made distinct and united with side flags, so one shuffle on the keys and one on
    ``by`` are all there is; no side is broadcast.
    """
    by = by or []
    columns = list(dict.fromkeys([*by, *keys]))
    side = lambda df, g, p: df.select(*columns, F.lit(g).alias("in_gold"), F.lit(p).alias("in_pred"))
    both = side(gold, 1, 0).unionByName(side(pred, 0, 1)).groupBy(*columns).agg(F.max("in_gold").alias("g"), F.max("in_pred").alias("p"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    g, p = F.col("g") == 1, F.col("p") == 1
    counted = both.groupBy(*by).agg(total(g & p).alias("tp"), total(~g & p).alias("fp"), total(g & ~p).alias("fn"))
    return counted.select(*by, "tp", "fp", "fn", *[c.alias(k) for k, c in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def overlap_by_label(gold: DataFrame, pred: DataFrame, keys: list[str], classes: DataFrame) -> DataFrame:
    """Scores of every label of ``classes(label)``, zeros for those without rows."""
    found = overlap(gold, pred, keys, ["label"])
    met = classes.select("label").distinct().join(found, "label", "left")
    return met.select("label", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")], *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


def class_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """label, gold, pred, diff, and a row TOTAL."""
    side = lambda df, g: df.select("label", F.lit(g).alias("g"))
    both = side(gold, 1).unionByName(side(pred, 0))
    counted = both.rollup("label").agg(F.grouping("label").alias("whole"), F.sum("g").cast("long").alias("gold"), F.sum(1 - F.col("g")).cast("long").alias("pred"))
    return counted.select(F.when(F.col("whole") == 1, F.lit("TOTAL")).otherwise(F.col("label")).alias("label"), F.coalesce("gold", F.lit(0)).alias("gold"), F.coalesce("pred", F.lit(0)).alias("pred"), (F.coalesce("pred", F.lit(0)) - F.coalesce("gold", F.lit(0))).alias("diff"))


def covered_share(scores: DataFrame, left: list[str], right: list[str], by: list[str], threshold: float) -> DataFrame:
    """Precision and recall of best scores: shares of each side whose best reaches the threshold."""
    best = lambda keys: scores.groupBy(*by, *keys).agg(F.max("score").alias("best")).groupBy(*by).agg(F.avg((F.col("best") >= threshold).cast("double")).alias("share"))
    p, r = F.col("precision"), F.col("recall")
    met = best(right).withColumnRenamed("share", "precision").join(best(left).withColumnRenamed("share", "recall"), by)
    return met.select(*by, F.round(p, 5).alias("precision"), F.round(r, 5).alias("recall"), F.round(ratio(2 * p * r, p + r), 5).alias("f1"))


def mean_scores(df: DataFrame, columns: list[str], digits: int = 5) -> DataFrame:
    """Means that skip nulls; null where a column has none."""
    return df.agg(*[F.round(F.avg(F.col(c).cast("double")), digits).alias(c) for c in columns])


def unioned(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
