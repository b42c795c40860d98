"""Document alignment, cross-lingual matching and file-wise evaluation as whole queries, with the columns that their sinks write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import backends as B
from lexigrid.functions import text as T
from lexigrid.functions import vocab as V
from lexigrid.operators import matching
from lexigrid.operators.durable import cut
from lexigrid.plans import pipelines as P

SCOPE = ["doc_id", "bead_idx"]


def held_rows(beads: DataFrame, rows: DataFrame, side: str) -> DataFrame:
    """Rows with the index of each bead that holds them: entities by their start, relations by those of both arguments."""
    spans = beads.select(*SCOPE, F.col(f"{side}_start").alias("span_start"), F.col(f"{side}_end").alias("span_end"))
    if "s_start" not in rows.columns:
        return matching.in_span(rows, spans, ["doc_id"], "start").drop("span_start", "span_end")
    held = matching.in_span(rows, spans, ["doc_id"], "s_start")
    return held.filter(matching.starts_inside()).drop("span_start", "span_end")


def left_over(beads: DataFrame, rows: DataFrame, held: DataFrame) -> DataFrame:
    """Rows that no bead holds, of documents that have beads."""
    return rows.join(held.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti").join(beads.select("doc_id").distinct(), "doc_id", "left_semi")


def scored_rows(beads: DataFrame, rows: DataFrame, side: str) -> DataFrame:
    """The rows that count: those in beads, once for each bead; all of them where a document has no bead."""
    spans = beads.select("doc_id", F.col(f"{side}_start").alias("span_start"), F.col(f"{side}_end").alias("span_end"))
    aligned = beads.select("doc_id").distinct().withColumn("aligned", F.lit(True))
    placed = matching.in_span_or_not(rows, spans, ["doc_id"], "s_start" if "s_start" in rows.columns else "start").join(aligned, "doc_id", "left")
    held = F.col("span_start").isNotNull()
    if "s_start" in rows.columns:
        held = held & matching.starts_inside()
    return placed.filter(held | F.col("aligned").isNull()).select(*rows.columns)


def prefixed(rows: DataFrame, prefix: str, *keys: str) -> DataFrame:
    """Every column but the keys with a prefix, in order of name."""
    return rows.select(*keys, *[F.col(c).alias(prefix + c) for c in sorted(rows.columns) if c not in keys])


def _translated(rows: DataFrame) -> DataFrame:
    """Hypothesis rows show the translation as their text, where it is not blank."""
    return rows.withColumn("text", F.coalesce(F.nullif(P.shown_text(rows), F.lit("")), F.col("text")))


def _bead_texts(matches: DataFrame, beads: DataFrame) -> DataFrame:
    texts = beads.select(*SCOPE, F.col("source").alias("bead_src"), F.col("hypothesis").alias("bead_hyp"))
    return matches.join(texts, SCOPE, "left")


def _both(src: DataFrame, hyp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of documents that have some on both sides."""
    return src.join(hyp.select("doc_id").distinct(), "doc_id", "left_semi"), hyp.join(src.select("doc_id").distinct(), "doc_id", "left_semi")


def aligned_entities(beads: DataFrame, src: DataFrame, hyp: DataFrame, enforce_label: bool = False) -> DataFrame:
    """Q12: doc_id, bead_idx, bead_src, bead_hyp, match_type and all columns of both entities, prefixed.

    ``beads`` as ``align_documents`` gives them, with the document as ``doc_id``; ``src`` and ``hyp`` have (doc_id, id, start, end, text,
    cui, label). Matches are made inside each bead; what no bead holds stands alone, with the bead's columns null. Documents
    need entities on both sides and a bead.
    """
    beads, src, hyp = cut(beads), cut(src), cut(hyp)
    src, hyp = _both(src, hyp)
    a, b = held_rows(beads, src, "src"), held_rows(beads, hyp, "hyp")
    inside = P.entity_matches(a, b, SCOPE, enforce_label)
    none = F.lit(None)
    alone = left_over(beads, src, a).select("doc_id", F.col("id").alias("src_id"), none.cast("long").alias("hyp_id"))
    alone = alone.unionByName(left_over(beads, hyp, b).select("doc_id", none.cast("long").alias("src_id"), F.col("id").alias("hyp_id")))
    every = _bead_texts(inside, beads).unionByName(alone.withColumn("match_type", F.lit("none")), allowMissingColumns=True)
    left, right = prefixed(src, "src_", "doc_id"), prefixed(_translated(hyp), "hyp_", "doc_id")
    met = every.join(left, ["doc_id", "src_id"], "left").join(right, ["doc_id", "hyp_id"], "left")
    return met.select(*SCOPE, "bead_src", "bead_hyp", "match_type", *left.columns[1:], *right.columns[1:])


def _relation_rows(rows: DataFrame, linked: DataFrame, by: list[str], prefix: str, translated: bool) -> DataFrame:
    found = P.spanned_relations(rows, linked, by)
    own = [c for c in rows.columns if c not in by]
    texts = [F.col(f"{p}_text").alias(f"{prefix}{name}_text") for p, name in (("s", "subject"), ("o", "object"))] if translated else []
    cuis = [F.nullif(F.col(f"{p}_cui"), F.lit("")).alias(f"{prefix}{name}_cui") for p, name in (("s", "subject"), ("o", "object"))]
    return found.select(*by, *[F.col(c).alias(prefix + c) for c in sorted(own)], *texts, *cuis)


def aligned_relations(beads: DataFrame, src: DataFrame, hyp: DataFrame, src_linked: DataFrame, hyp_linked: DataFrame) -> DataFrame:
    """Q12: doc_id, bead_idx, bead_src, bead_hyp, the match types of subject, object and relation, and the columns of both relations.

    Relations inside a bead are matched by the entities that it holds; those in none are matched in their document, by all of its
    entities, with the bead's columns null. The hypothesis's argument texts are those of its entities, translated where they are.
    """
    beads, src, hyp, src_linked, hyp_linked = map(cut, (beads, src, hyp, src_linked, hyp_linked))
    spans = cut(beads.drop("source", "hypothesis"))  # what places rows does not read the texts
    src_linked, hyp_linked = _both(src_linked, hyp_linked)
    docs = src_linked.select("doc_id").distinct()
    src, hyp = (rows.join(docs, "doc_id", "left_semi") for rows in (src, hyp))
    a, b = cut(held_rows(spans, src, "src")), cut(held_rows(spans, hyp, "hyp"))
    a_ents, b_ents = cut(held_rows(spans, src_linked, "src")), cut(held_rows(spans, hyp_linked, "hyp"))

    def matched(left, right, left_ents, right_ents, by):
        pairs = P.relation_matches(left, right, left_ents, right_ents, by, tuple(by))
        x, y = _relation_rows(left, left_ents, by, "src_", False), _relation_rows(right, right_ents, by, "hyp_", True)
        return pairs.join(x, [*by, "src_id"], "left").join(y, [*by, "hyp_id"], "left")

    inside = _bead_texts(matched(a, b, a_ents, b_ents, SCOPE), beads)
    every = inside.unionByName(matched(left_over(spans, src, a), left_over(spans, hyp, b), src_linked, hyp_linked, ["doc_id"]), allowMissingColumns=True)
    kind = F.col("match_type")
    named = every.withColumn("subject_match_type", kind).withColumn("object_match_type", kind).withColumn("relation_match_type", F.when(kind == "none", kind).otherwise("text"))
    front = [*SCOPE, "bead_src", "bead_hyp", "subject_match_type", "object_match_type", "relation_match_type"]
    rest = sorted(c for c in named.columns if c.startswith("src_")) + sorted(c for c in named.columns if c.startswith("hyp_"))
    return named.select(*front, *rest)


def named_rows(files: DataFrame, rows: DataFrame, key: str = "filename", suffix: str | None = None) -> DataFrame:
    """Rows under the names of ``files(filename)``: by the exact name (with ``suffix``), or, for a file that has none, by its stem."""
    wanted = files.select(F.col("filename").alias("file")).distinct().withColumn("name", T.with_suffix(F.col("file"), suffix) if suffix else F.col("file"))
    wanted = wanted.withColumn("stem", F.regexp_replace("name", r"\.[^./]+\z", ""))
    there = cut(rows.select(F.col(key).alias("name")).distinct())
    found = wanted.join(there.withColumn("exact", F.lit(True)), "name", "left").join(there.select(F.col("name").alias("stem"), F.lit(True).alias("short")), "stem", "left")
    keys = found.select("file", F.when(F.col("exact"), F.col("name")).when(F.col("short"), F.col("stem")).alias(key)).filter(F.col(key).isNotNull())
    return keys.join(rows, key).drop(key).withColumnRenamed("file", "filename")


def bead_entities(entities: DataFrame, beads: DataFrame, text: str) -> DataFrame:
    """Entities (filename, ent, text, start_span, ...) with the bead whose text holds theirs, the nearest by offset; -1 where none does.

    Blank texts go. An entity's text is looked up once for each bead and distinct text of a document.
    """
    placed = matching.bead_offsets(beads, "filename", "bead_idx", text, "at")
    found = matching.nearest_bead(entities, placed, "filename", "text", "start_span", text, "bead_idx", "at")
    return found.withColumn("bead_idx", F.coalesce("bead_idx", F.lit(-1)))


def entity_match_rows(beads: DataFrame, src: DataFrame, hyp: DataFrame, encoder: B.Encoder, threshold: float = V.MATCH_THRESHOLD, same_label: bool = False, suffix: str | None = None, digits: int | None = None) -> DataFrame:
    """Q13: the 15 columns of the match file.

    ``beads(filename, bead_idx, source, hypothesis)``; ``src`` and ``hyp`` have (filename, ent, entity_label, start_span, end_span, text
    [, translated_text]). Entities go to beads by text and are matched inside each; those that no bead holds are matched among
    themselves, under a blank bead. What is compared is the translation where there is one.
    """
    beads = cut(beads)
    files = beads.select("filename").distinct()
    shown = lambda df: df if "translated_text" in df.columns else df.withColumn("translated_text", F.lit(""))
    named = lambda df, end: cut(named_rows(files, cut(shown(df)), suffix=end))
    a, b = cut(bead_entities(named(src, None), beads, "source")), cut(bead_entities(named(hyp, suffix), beads, "hypothesis"))
    keyed = lambda df, row: df.select("filename", "bead_idx", F.col("ent").alias(row), F.col("entity_label").alias("label"), T.preferred(F.col("translated_text"), F.col("text")).alias("text"))
    pairs = P.cross_lingual_matches(keyed(a, "i"), keyed(b, "j"), encoder, threshold, same_label, digits)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    columns = ("entity_label", "start_span", "end_span", "text")
    scope = ["filename", "bead_idx"]
    left = a.select(*scope, F.col("ent").alias("i"), *[blank(c).alias(f"src_{c}") for c in columns])
    right = b.select(*scope, F.col("ent").alias("j"), *[blank(c).alias(f"hyp_{c}") for c in (*columns, "translated_text")])
    texts = beads.select(*scope, F.col("source").alias("bead_src"), F.col("hypothesis").alias("bead_hyp"))
    met = pairs.join(left, [*scope, "i"], "left").join(right, [*scope, "j"], "left").join(texts, scope, "left")
    paired = F.col("i").isNotNull() & F.col("j").isNotNull()
    met = met.withColumn("sapbert_similarity", F.when(paired, F.format_string("%.4f", "score")).otherwise("")).withColumn("match_type", F.when(paired, "sapbert").otherwise("none"))
    met = met.withColumn("bead_idx", F.when(F.col("bead_idx") > 0, F.col("bead_idx").cast("string")).otherwise(""))
    return met.select(*[blank(c).alias(c) for c in V.MATCH_COLUMNS])


def scored_files(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold spans (filename, start, end, label, text) against predictions by file: kind and scores of each document.

    A gold file's predictions carry the name that ``prediction_name`` derives; a file without any counts as missed, and
    predictions of files without gold are left out.
    """
    named = gold.withColumn("doc_id", T.prediction_name(F.col("filename"))).drop("filename")
    mine = pred.withColumnRenamed("filename", "doc_id").join(named.select("doc_id").distinct(), "doc_id", "left_semi")
    return P.ner_scores(named, mine)
