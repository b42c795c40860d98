"""Peak concurrency: how many intervals are open at each moment, and what they are worth.

Starts and ends are counted by group and moment, so that a moment is one row however many rows share it. Moments fall
into ranges of fixed length. A range holds its starts and its ends as two sorted arrays with prefix sums of counts and
cents; at each of its moments ``searchsorted`` tells how much has started and how much has finished, the
one minus the other is what the range itself adds, and what all ranges before it left open is its carry. The carries,
the highest count so far and the next moment come from one row a range, of which a group has as many as its time span needs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm.shared import cut, hot_keys, join_spread, table

#: Moments are multiples of so many seconds.
STEP = 900
#: Moments in a range; years 1 to 9999 have 343 thousand such ranges of 900 seconds, so a group's windows over ranges are bounded.
MOMENTS = 1024
#: The group that holds all others, and the group of what has none.
EVERYTHING, NOWHERE = -2, -1
#: From here on an amount is taken for broken and counts 0, as do null and NaN: below it cents are exact in a double.
BROKEN = 1e13


def utc_seconds(df: DataFrame, column: str):
    """Seconds since 1970, rounded down, whatever the session's zone: a time without zone is read as UTC."""
    at = F.col(column)
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return F.unix_seconds(at.cast("timestamp"))
    days = F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.floor(F.second(at)).cast("long")


def to_step(seconds, step: int):
    return seconds - F.pmod(seconds, F.lit(step))


def cents_of(amount):
    return F.when(F.abs(amount) < BROKEN, F.floor(100 * amount + 0.5)).otherwise(0).cast("long")


def met(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """Left join with a table of one row a key, in a shuffle in which hot keys are spread; nothing that grows is broadcast."""
    total = rows.count()
    hot = cut(hot_keys(rows.select(key), [key], total), "concurrency-hot")
    return join_spread(rows, per_key, [key], "times", total, "left", "merge", hot)


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame, step: int = STEP, days: int = 0) -> DataFrame:
    """(group, start, end, cents): a row for each row of ``sales`` that is open for at least one moment.

    ``end`` is the latest shipping of the sale's lines plus ``days``, null if there is none. A null
    time of sale takes no part; a null or broken total counts 0; without a client, or a client without a nation,
    the group is NOWHERE; of a client's several nations the largest counts; repeated rows of ``sales`` count each.
    """
    sold = sales.select("sale_id", "client_id", cents_of(F.col("total")).alias("cents"), to_step(utc_seconds(sales, "sold_at"), step).alias("start")).filter("start IS NOT NULL")
    ends = lines.filter("sale_id IS NOT NULL").groupBy("sale_id").agg(F.max(to_step(utc_seconds(lines, "shipped_at") + 86400 * days, step)).alias("end")).filter("end IS NOT NULL")
    nations = clients.filter("client_id IS NOT NULL").groupBy("client_id").agg(F.max(F.col("nation_id").cast("int")).alias("group"))
    timed = cut(met(sold, ends, "sale_id").filter("end IS NULL OR end > start").drop("sale_id"), "concurrency-timed")
    return met(timed, nations, "client_id").select(F.coalesce("group", F.lit(NOWHERE)).alias("group"), "start", "end", "cents")


def moments(intervals: DataFrame, step: int, per_range: int) -> DataFrame:
    """(group, range, at, n_started, c_started, n_ended, c_ended): one row a group and moment, all groups together as EVERYTHING."""
    ends = F.when(F.col("end").isNotNull(), F.struct(F.col("end").alias("at"), F.lit(0).alias("s"), F.lit(1).alias("e")))
    both = F.filter(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("s"), F.lit(0).alias("e")), ends), lambda x: x.isNotNull())
    rows = intervals.select("group", "cents", F.explode(both).alias("x")).select("group", "cents", "x.*")
    sums = [F.sum("s").alias("n_started"), F.sum(F.col("s") * F.col("cents")).alias("c_started"), F.sum("e").alias("n_ended"), F.sum(F.col("e") * F.col("cents")).alias("c_ended")]
    own = cut(rows.groupBy("group", "at").agg(*sums), "concurrency-own")
    whole = own.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n_started", "c_started", "n_ended", "c_ended")])
    union = own.unionByName(whole.withColumn("group", F.lit(EVERYTHING)))
    return union.withColumn("range", F.floor(F.col("at") / (step * per_range)).cast("long"))


def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range of one group: at each moment that changes something, what is open, with the range's carry added."""
    pdf = pdf.sort_values("at", kind="stable")
    at = pdf["at"].to_numpy(np.int64)
    opened, left = {}, {}
    for side, held in (("started", opened), ("ended", left)):
        n, c = pdf[f"n_{side}"].to_numpy(np.int64), pdf[f"c_{side}"].to_numpy(np.int64)
        own = n > 0
        held["at"] = at[own]
        held["n"], held["c"] = (np.concatenate([[0], np.cumsum(x[own])]) for x in (n, c))
    gone, come = (np.searchsorted(side["at"], at, side="right") for side in (left, opened))
    n_open = int(pdf["n_carry"].iloc[0]) + opened["n"][come] - left["n"][gone]
    c_open = int(pdf["c_carry"].iloc[0]) + opened["c"][come] - left["c"][gone]
    changed = (pdf["n_started"] != pdf["n_ended"]).to_numpy() | (pdf["c_started"] != pdf["c_ended"]).to_numpy()
    at, n_open, c_open = at[changed], n_open[changed], c_open[changed]
    high = np.maximum.accumulate(n_open) if len(n_open) else n_open
    next_at = pd.array(np.roll(at, -1), dtype="Int64")
    next_at[-1:] = pd.NA
    return pd.DataFrame({"group": pdf["group"].iloc[0], "range": pdf["range"].iloc[0], "from_s": at, "next_s": next_at, "n_open": n_open, "open_cents": c_open, "high": high})


SWEPT = "group int, range long, from_s long, next_s long, n_open long, open_cents long, high long"


def concurrency(intervals: DataFrame, step: int = STEP, per_range: int = MOMENTS) -> DataFrame:
    """group, from_s, to_s, n_open, open_cents, high_open, is_peak for intervals ``(group, start, end, cents)``.

    A row for each group, and for EVERYTHING, and moment at which the number of open intervals or their cents change;
    ``start`` is included, ``end`` excluded and null if never. Starts and ends that cancel out make no row. An empty
    table gives no rows.
    """
    rows = cut(moments(intervals, step, per_range), "concurrency-moments")
    per = rows.groupBy("group", "range").agg(F.sum(F.col("n_started") - F.col("n_ended")).alias("n"), F.sum(F.col("c_started") - F.col("c_ended")).alias("c"))
    before = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("group", "range", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_carry") for x in ("n", "c")])
    swept = rows.join(carry.hint("merge"), ["group", "range"]).groupBy("group", "range").applyInPandas(sweep, SWEPT)
    swept = cut(swept, "concurrency-swept")
    told = swept.groupBy("group", "range").agg(F.max("high").alias("top"), F.min("from_s").alias("first_s"))
    order, whole = Window.partitionBy("group").orderBy("range"), Window.partitionBy("group")
    told = told.select("group", "range", F.max("top").over(before).alias("top_before"), F.max("top").over(whole).alias("peak"), F.lead("first_s").over(order).alias("first_after"))
    out = swept.join(told.hint("merge"), ["group", "range"])
    high = F.greatest("high", "top_before")  # null is skipped
    return out.select("group", "from_s", F.coalesce("next_s", "first_after").alias("to_s"), "n_open", "open_cents", high.alias("high_open"), (F.col("n_open") == F.col("peak")).alias("is_peak"))


def op13_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open sales by nation."""
    intervals = open_sales(*(table(spark, sf_dir, t) for t in ("sales", "sale_lines", "clients")))
    return concurrency(intervals).withColumnRenamed("group", "nation_id")


OP13_SQL = """
WITH ends AS (SELECT sale_id, max(shipped_at) AS latest FROM sale_lines GROUP BY sale_id),
nations AS (SELECT client_id, max(nation_id) AS nation_id FROM clients GROUP BY client_id),
sold AS (
  SELECT coalesce(nations.nation_id, -1) AS nation_id, CAST(floor(epoch(sold_at) / 900) * 900 AS BIGINT) AS s,
         CAST(floor(epoch(latest) / 900) * 900 AS BIGINT) AS f, coalesce(CAST(floor(100 * total + 0.5) AS BIGINT), 0) AS cents
  FROM sales LEFT JOIN ends ON sales.sale_id = ends.sale_id LEFT JOIN nations ON sales.client_id = nations.client_id
  WHERE sold_at IS NOT NULL),
own AS (SELECT * FROM sold WHERE f IS NULL OR f > s),
every AS (SELECT * FROM own UNION ALL SELECT -2, s, f, cents FROM own),
moves AS (SELECT nation_id, s AS t, 1 AS n, cents AS c FROM every UNION ALL SELECT nation_id, f, -1, -cents FROM every WHERE f IS NOT NULL),
net AS (SELECT nation_id, t, sum(n) AS n, sum(c) AS c FROM moves GROUP BY nation_id, t HAVING sum(n) <> 0 OR sum(c) <> 0),
run AS (
  SELECT nation_id, t AS from_s, lead(t) OVER w AS to_s, CAST(sum(n) OVER w AS BIGINT) AS n_open, CAST(sum(c) OVER w AS BIGINT) AS open_cents
  FROM net WINDOW w AS (PARTITION BY nation_id ORDER BY t))
SELECT CAST(nation_id AS INTEGER) AS nation_id, from_s, to_s, n_open, open_cents, max(n_open) OVER (PARTITION BY nation_id ORDER BY from_s) AS high_open,
       n_open = max(n_open) OVER (PARTITION BY nation_id) AS is_peak
FROM run
"""
