"""Joins of annotated text: spans, beads, positional cascades, greedy pairs and nearest vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.operators import metrics
from lexigrid.operators.durable import cut
from lexigrid.operators.nearest import top_candidates as top_candidates
from lexigrid.operators.ranks import first_per as first_per
from lexigrid.operators.ranks import top_per as top_per


def last_per_span(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One value for each key; of repeated spans the last in order counts."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


#: Characters in a bin of a document, by which spans and the points in them meet.
BIN = 1024


def in_span(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str = "span_start", end: str = "span_end") -> DataFrame:
    """Each point with every half-open span of its group that holds it. Both meet by bins of the document, not all with all."""
    return points.withColumn("__bin", F.floor(F.col(at) / BIN)).join(binned(spans, start, end), [*by, "__bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bin")


def starts_inside(start: str = "span_start", end: str = "span_end", at: tuple = ("s_start", "o_start")) -> Column:
    """Whether all of the positions lie in a half-open span: a relation is where both its arguments begin."""
    inside = F.lit(True)
    for c in at:
        inside = inside & (F.col(c) >= F.col(start)) & (F.col(c) < F.col(end))
    return inside


def binned(spans: DataFrame, start: str = "span_start", end: str = "span_end") -> DataFrame:
    """Spans with ``__bin``, a row for each bin that they reach into."""
    return spans.filter(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor((F.col(end) - 1) / BIN))))


def in_span_or_not(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str = "span_start", end: str = "span_end") -> DataFrame:
    """As ``in_span``, but a point that no span of its group holds stays too, facing null."""
    wide = binned(spans, start, end).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__bin").alias("__span_bin"), *[c for c in spans.columns if c not in by])
    same = (F.floor(F.col(at) / BIN) == F.col("__span_bin")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    for c in by:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return points.join(wide, same, "left").drop("__span_bin", *[f"__{c}" for c in by])


def outside(rows: DataFrame, held: DataFrame, row_id: str) -> DataFrame:
    """The rows that no span held."""
    return rows.join(held.select(row_id).distinct(), row_id, "left_anti")


def bead_offsets(beads: DataFrame, doc: str, index: str, text: str, out: str) -> DataFrame:
    """Where each bead would start if the beads' texts stood one after the other."""
    before = Window.partitionBy(doc).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    return beads.withColumn(out, F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)))


def nearest_bead(entities: DataFrame, beads: DataFrame, doc: str, text: str, start: str, bead_text: str, index: str, offset: str) -> DataFrame:
    """Every entity with non-blank text and the bead that holds its text, the nearest by offset; null where none does.

    The document is the equi-key, and each distinct text of a document is looked up in its beads once. Beads and entities of a text are then
    put in order of place together: the nearest is the last bead before or the first after, so a frequent text costs a sort and not
    all pairs. The first bead wins ties and stands in where the entity's start is no number.
    """
    mine = entities.filter(T.strip(F.col(text)) != "")
    keyed = mine.select(F.struct(*mine.columns).alias("__row"), F.col(doc).alias("__doc"), T.strip(F.col(text)).alias("__what"), F.greatest(F.coalesce(F.col(start).try_cast("int"), F.lit(-1)), F.lit(-1)).alias("__pos"))
    there = beads.select(F.col(doc).alias("__doc"), F.col(bead_text).alias("__text"), F.col(index).alias("__bead"), F.col(offset).alias("__pos"))
    held = keyed.select("__doc", "__what").distinct().join(there, "__doc").filter(F.contains("__text", "__what")).groupBy("__doc", "__what", "__pos").agg(F.min("__bead").alias("__bead"))
    both = held.withColumn("__kind", F.lit(0)).unionByName(keyed.withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    place = F.when(F.col("__kind") == 0, F.struct(F.col("__pos").alias("at"), F.col("__bead").alias("bead")))
    group = Window.partitionBy("__doc", "__what")
    before = F.last(place, ignorenulls=True).over(group.orderBy("__pos", "__kind"))
    after = F.last(place, ignorenulls=True).over(group.orderBy(F.col("__pos").desc(), F.col("__kind").desc()))
    near = both.withColumn("__before", before).withColumn("__after", after).filter("__kind = 1")
    further = F.col("__before").isNull() | (F.col("__after.at") - F.col("__pos") < F.col("__pos") - F.col("__before.at"))
    return near.select("__row.*", F.when(further, F.col("__after.bead")).otherwise(F.col("__before.bead")).alias("bead_idx"))


def match_cascade(src: DataFrame, hyp: DataFrame, scope: list[str], passes: list[tuple[str, str]], order: str = "id") -> DataFrame:
    """(scope, src_id, hyp_id, match_type): each pass pairs what the last left over; the rest stand alone.

    Rows have ``id`` and a key a pass. Within a key that both sides have, the n-th row faces the n-th and surplus rows face
    null; a null key is never shared. Both sides travel as one table: a shuffle a pass and one for the pairs, whatever
    the number of rows, and rows without a key are spread by their ids.
    """
    keys = [key for _, key in passes]
    rows = src.select(*scope, "id", *keys, F.lit(0).alias("__side")).unionByName(hyp.select(*scope, "id", *keys, F.lit(1).alias("__side")))
    own = F.concat_ws("|", F.lit("own"), "__side", "id")
    rows = rows.withColumn("__kind", F.lit(None).cast("string")).withColumn("__slot", own)
    for kind, key in passes:
        open_ = F.col("__kind").isNull() & F.col(key).isNotNull()
        rows = rows.withColumn("__group", F.when(open_, F.concat(F.lit("key|"), F.col(key))).otherwise(own))
        group = Window.partitionBy(*scope, "__group")
        rows = rows.withColumn("__both", F.min("__side").over(group) < F.max("__side").over(group))
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*scope, "__group", "__side").orderBy(order)))
        rows = rows.withColumn("__slot", F.when(F.col("__both"), F.concat_ws("|", "__n", "__group")).otherwise(F.col("__slot")))
        rows = rows.withColumn("__kind", F.when(F.col("__both"), F.lit(kind)).otherwise(F.col("__kind")))
    side = lambda n, name: F.max(F.when(F.col("__side") == n, F.col("id"))).alias(name)
    pairs = rows.groupBy(*scope, "__kind", "__slot").agg(side(0, "src_id"), side(1, "hyp_id"))
    return pairs.select(*scope, "src_id", "hyp_id", F.coalesce("__kind", F.lit("none")).alias("match_type"))


#: A scope of up to so many candidates is walked through in one task; larger ones are taken apart in rounds first.
WALKED = 200_000


def greedy_pairs(candidates: DataFrame, scope: list[str], score: str = "score", i: str = "i", j: str = "j", most: int = WALKED) -> DataFrame:
    """One-to-one pairs taken by falling score, then i, then j; (scope, i, j, score).

    Scopes are sorted and walked through as a stream that remembers only what is taken. Of a scope with more than ``most``
    candidates, each round takes all pairs that are the best of both their ends: nothing that comes before them in the order could
    ever take one of the two, so that they are what the walk would take. What shares an end with them goes, until the scope is
    small enough to be walked. A round is a job over the large scopes alone, whose rows are spread by scope and end.
    """
    rows = cut(candidates.select(*scope, F.col(score).cast("double").alias("score"), F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j")))
    taken, walked = [], []
    while True:
        large = rows.groupBy(*scope).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).drop("__n")
        if large.isEmpty():
            break
        walked.append(rows.join(large, scope, "left_anti"))
        marked = cut(best_of_both(rows.join(large, scope, "left_semi"), scope))
        taken.append(marked.filter("__best").select(*scope, "i", "j", "score"))
        rows = marked.filter("NOT __gone").drop("__best", "__gone")
    order = [*scope, F.col("score").desc(), F.col("i").desc(), F.col("j").desc()]
    stream = metrics.unioned([*walked, rows]).repartition(*scope).sortWithinPartitions(*order)
    return metrics.unioned([stream.mapInArrow(walk(scope), rows.schema).select(*scope, "i", "j", "score"), *taken])


def best_of_both(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Candidates with ``__best``, whether each is the first of all that share its i and of all that share its j, and ``__gone``,
    whether it shares an end with one that is."""
    by_i, by_j = Window.partitionBy(*scope, "i"), Window.partitionBy(*scope, "j")
    own = F.struct("score", "i", "j")
    first = rows.withColumn("__of_i", F.max(own).over(by_i)).withColumn("__of_j", F.max(own).over(by_j))
    first = first.withColumn("__best", (F.col("__of_i") == own) & (F.col("__of_j") == own)).drop("__of_i", "__of_j")
    return first.withColumn("__gone", F.max("__best").over(by_j)).withColumn("__gone", F.col("__gone") | F.max("__best").over(by_i))


def walk(scope: list[str]):
    """Batches sorted by scope and order to the candidates that find both their ends free."""

    def run(batches):
        import pyarrow as pa

        here, used_i, used_j = None, set(), set()
        for batch in batches:
            kept = []
            scopes = zip(*[batch.column(c).to_pylist() for c in scope])
            for row, (key, a, b) in enumerate(zip(scopes, batch.column("i").to_pylist(), batch.column("j").to_pylist())):
                if key != here:
                    here, used_i, used_j = key, set(), set()
                if a not in used_i and b not in used_j:
                    used_i.add(a)
                    used_j.add(b)
                    kept.append(row)
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def with_singletons(pairs: DataFrame, src: DataFrame, hyp: DataFrame, scope: list[str]) -> DataFrame:
    """Pairs and, facing null with score 0, everything that found none. Rows have ``i`` and ``j``."""
    zero = F.lit(0.0)
    left = src.select(*scope, "i").join(pairs, [*scope, "i"], "left").select(*scope, "i", "j", F.coalesce("score", zero).alias("score"))
    alone = hyp.select(*scope, "j").join(pairs.select(*scope, "j"), [*scope, "j"], "left_anti")
    return left.unionByName(alone.select(*scope, F.lit(None).cast("long").alias("i"), "j", zero.alias("score")))


def band_pairs(entities: DataFrame, doc: str, relations: DataFrame, max_distance: int) -> DataFrame:
    """Ordered pairs of a document's entities within reach whose labels suit a relation, a row a relation.

    ``entities(doc, ent, label, start, end)`` join ``relations(seq, relation, subject_label,
    object_label)`` on the subject's label first, so the self-join has the document and the object's label for
    keys. An object stands in the bins that it covers and a subject in those within reach of it; a pair counts in the first bin that both have.
    """
    width = max_distance + 1
    bin_of = lambda c: F.floor(c / width)
    bins = lambda lo, hi: F.explode(F.sequence(lo, F.greatest(lo, hi))).alias("bin")
    subjects = entities.join(F.broadcast(relations), F.col("label") == F.col("subject_label"))
    from_, to = bin_of(F.col("start") - max_distance), bin_of(F.col("end") + max_distance)
    subjects = subjects.select(F.col(doc), F.col("ent").alias("s_ent"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), "seq", "relation", F.col("object_label").alias("o_label"), from_.alias("s_bin"), bins(from_, to))
    own = bin_of(F.col("start"))
    objects = entities.select(F.col(doc), F.col("ent").alias("o_ent"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("label").alias("o_label"), own.alias("o_bin"), bins(own, bin_of(F.col("end"))))
    met = subjects.join(objects, [doc, "o_label", "bin"]).filter((F.col("s_ent") != F.col("o_ent")) & (F.col("bin") == F.greatest("s_bin", "o_bin")))
    apart = T.gap(F.col("s_start"), F.col("s_end"), F.col("o_start"), F.col("o_end"))
    return met.withColumn("gap", apart).filter(F.col("gap") <= max_distance).drop("bin", "o_label", "s_bin", "o_bin")


def best_relation(scored: DataFrame, doc: str, threshold: float) -> DataFrame:
    """For each ordered pair of spans the best relation that reaches the threshold, the first of equals."""
    keys = [doc, "s_start", "s_end", "o_start", "o_end"]
    return first_per(scored.filter(F.col("score") >= threshold), keys, [F.col("score").desc(), "s_ent", "o_ent", "seq"])


def wide_candidates(ranked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """umls_cui_1, umls_name_1, score_1, ...: k of each, blank where there are fewer."""
    pick = lambda c, n: F.coalesce(F.max(F.when(F.col("rank") == n, F.col(c))), F.lit(""))
    columns = []
    for n in range(1, k + 1):
        columns += [pick("cui", n).alias(f"umls_cui_{n}"), pick("name", n).alias(f"umls_name_{n}"), F.coalesce(F.max(F.when(F.col("rank") == n, F.format_string("%.4f", "score"))), F.lit("")).alias(f"score_{n}")]
    return queries.select("q").join(ranked, "q", "left").groupBy("q").agg(*columns)


def relation_table(spark, relations, templates: dict[str, str] | None = None) -> DataFrame:
    """(seq, relation, subject_label, object_label[, head, middle, tail]): a row for each label pair.

    A template is kept as the text before, between and after its two places, so that filling it in is one concatenation.
    """
    rows = []
    for seq, (name, subjects, objects) in enumerate(relations):
        around = ("", "", "")
        if templates:
            head, rest = templates[name].split("{subject}")
            around = (head, *rest.split("{object}"))
        rows += [(seq, name, s, o, *around) for s in subjects for o in objects]
    return spark.createDataFrame(rows, "seq int, relation string, subject_label string, object_label string, head string, middle string, tail string")


def hypothesis(subject: Column, obj: Column) -> Column:
    return F.concat("head", subject, "middle", obj, "tail")
