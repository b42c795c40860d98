"""Joins of texts by the words that they share, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefixes(rows: DataFrame, keys: list[str], tokens: str, threshold: float) -> DataFrame:
    """(keys, size, token, place): the first tokens of each row in one order of all tokens, as many as two rows that reach the threshold
    cannot both do without.

    Long tokens come first, as they are rare. A set of n shares at least n * t / (2 - t) of its tokens with whatever it reaches an
    F1 of t with, so one of its first n - that + 1 is among them.
    """
    ordered = F.transform(F.array_sort(F.transform(F.col(tokens), lambda x: F.struct((-F.length(x)).alias("short"), x.alias("token")))), lambda x: x["token"])
    n = F.size(tokens)
    least = F.ceil(n * F.lit(threshold / (2 - threshold)) - 1e-9)
    cut = rows.filter(n > 0).select(*keys, n.alias("size"), F.slice(ordered, F.lit(1), (n - least + 1).cast("int")).alias("__first"))
    return cut.select(*keys, "size", F.posexplode("__first").alias("place", "token"))


def overlap_candidates(left: DataFrame, right: DataFrame, scope: list[str], a: str, b: str, threshold: float, tokens: str = "tokens") -> DataFrame:
    """Distinct (scope, a, b) that hold every pair of rows of a scope whose token sets have an F1 of at least ``threshold``.

    Rows meet by a token of both their prefixes. A pair goes where the sizes alone keep it below the threshold, and where
    what comes after the shared token does: at the first token that two rows share, nothing before it counts.
    """
    x = prefixes(left, [*scope, a], tokens, threshold).withColumnsRenamed({"size": "__n", "place": "__i"})
    y = prefixes(right, [*scope, b], tokens, threshold).withColumnsRenamed({"size": "__m", "place": "__j"})
    met = x.join(y, [*scope, "token"])
    needed = threshold * (F.col("__n") + F.col("__m")) / 2 - 1e-9
    rest = F.least(F.col("__n") - F.col("__i"), F.col("__m") - F.col("__j"))
    return met.filter(rest >= needed).select(*scope, a, b).distinct()
