"""The sixteen end-user queries as functions of DataFrames. Nothing is collected and nothing loops over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions import backends as B
from lexigrid.functions import text as T
from lexigrid.functions import vocab as V
from lexigrid.operators import alignment, dictionary, matching, metrics, setjoin
from lexigrid.operators.durable import bound_batches, cut, dealt
from lexigrid.operators.ranks import top_per
from lexigrid.sources import readers, vector_cache

DOC_METRICS = ["characters", "characters_no_spaces", "lines", "sentences", "words_regex", "tokens_whitespace", "avg_words_per_sentence"]


def document_stats(docs: DataFrame, name: str = "filename", text: str = "text") -> DataFrame:
    """Q1: nine columns for each text, which is stripped first."""
    body = docs.select(F.col(name).alias("file"), T.strip(F.col(text)).alias("body"))
    body = body.select("file", "body", T.sentences(F.col("body")).alias("s"), T.words(F.col("body")).alias("w"))
    n_sent, n_words = F.size("s"), F.size("w")
    return body.select(
        "file",
        T.category(F.regexp_replace("file", r"\.[^./]*\z", "")).alias("disease"),
        F.length("body").cast("long").alias("characters"),
        F.length(F.regexp_replace("body", r"\s", "")).cast("long").alias("characters_no_spaces"),
        T.line_count(F.col("body")).cast("long").alias("lines"),
        n_sent.cast("long").alias("sentences"),
        n_words.cast("long").alias("words_regex"),
        F.size(T.tokens(F.col("body"))).cast("long").alias("tokens_whitespace"),
        F.when(n_sent > 0, F.round(n_words / n_sent, 2)).alias("avg_words_per_sentence"),
    )


def corpus_summary(stats: DataFrame) -> DataFrame:
    return metrics.summary(stats, DOC_METRICS)


def vocabulary_size(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(T.words(F.lower(F.col(text)))).alias("w")).agg(F.count_distinct("w").alias("vocabulary"))


def category_counts(stats: DataFrame) -> DataFrame:
    return stats.groupBy("disease").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"))


def combined_tables(files: DataFrame, header: list[str]) -> DataFrame:
    """Q2, Q3: rows of markdown tables with as many cells as the header; repeats within a file go, the first stays."""
    rows = readers.markdown_rows(files, len(header), header[0].lower())
    rows = rows.groupBy("filename", "cells").agg(F.min("row_no").alias("row_no"))
    return rows.select(F.col("filename").alias("Source File"), *[F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(header)], "row_no")


def duplicates_removed(files: DataFrame, header: list[str]) -> DataFrame:
    """(rows, kept, removed): how many rows the tables of all files have, and how many of them repeat one of their own file."""
    rows = readers.markdown_rows(files, len(header), header[0].lower()).groupBy("filename", "cells").agg(F.count("*").alias("n"))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("kept")).withColumn("removed", F.col("rows") - F.col("kept"))


def translation_lookup(names: DataFrame, files: DataFrame, suffix: str = "_BGgpt") -> DataFrame:
    """(filename, translation) of ``names(filename)``: the file with the suffix, else the one of the same name in ``files(filename, text)``.

    A file that is there counts even if it is empty; a name without either is left out.
    """
    asked = names.select("filename").distinct().withColumn("first", T.with_suffix(F.col("filename"), suffix))
    options = asked.select("filename", F.posexplode(F.array("first", "filename")).alias("turn", "name"))
    found = options.join(files.select(F.col("filename").alias("name"), "text"), "name")
    return found.groupBy("filename").agg(F.min_by("text", "turn").alias("translation"))


def rows_under_either(names: DataFrame, rows: DataFrame, suffix: str = "_BGgpt", key: str = "doc_id") -> DataFrame:
    """The rows of each of ``names(key)``, under its own name: those that stand under its name with the suffix, or, where none does,
    those under its own. A group without rows falls through, whether its name is known or not."""
    asked = names.select(key).distinct().withColumn("__first", T.with_suffix(F.col(key), suffix))
    there = rows.select(F.col(key).alias("__first")).distinct().withColumn("__held", F.lit(True))
    picked = asked.join(there, "__first", "left").select(F.col(key).alias("__name"), F.when(F.col("__held"), F.col("__first")).otherwise(F.col(key)).alias(key))
    return picked.join(rows, key).drop(key).withColumnRenamed("__name", key).select(*rows.columns)


def combined_runs(runs: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Q4: (plain, linked) entities of each run; plain ones count where the run has no linked file of the language."""
    parts = []
    for plain, linked in runs:
        parts += [linked, plain.join(linked.select("language").distinct(), "language", "left_anti")]
    columns = ["document_id", "language", "model", "entity_type", "text", "start_index", "end_index", "umls_cui"]
    return metrics.unioned(parts).select(*columns)


def model_counts(combined: DataFrame) -> DataFrame:
    return combined.filter("model IS NOT NULL").groupBy("model").agg(F.count("*").alias("n"))


def shortest(rows: DataFrame, n: int, category: str = "category", length: str = "length", tie: str = "document_id") -> DataFrame:
    """Q5: the n shortest of each category; ranks are cut inside each task before the shuffle."""
    return matching.top_per(rows, [category], [length, tie], n)


def ner_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Q6: strict, span and lenient scores of (doc, start, end, label, text) sets.

    Strict and span keys have the document; the lenient set of the whole corpus is (text, label) alone.
    """
    lower = lambda df: df.withColumn("lower_text", F.lower("text"))
    kinds = {"strict": ["doc_id", "start", "end", "label"], "span": ["doc_id", "start", "end"], "lenient": ["lower_text", "label"]}
    return metrics.unioned([metrics.overlap(lower(gold), lower(pred), keys).withColumn("kind", F.lit(k)) for k, keys in kinds.items()])


def ner_rows(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Rows of both sides with ``match``: whether the other side has the same strict key."""
    keys = ["doc_id", "start", "end", "label"]

    def flagged(mine, other, name):
        there = other.select(*keys).distinct().withColumn("there", F.lit(True))
        return mine.join(there, keys, "left").select(F.lit(name).alias("source"), *keys, "text", F.col("there").isNotNull().alias("match"))

    return flagged(gold, pred, "gold").unionByName(flagged(pred, gold, "pred"))


def annotator_sets(spans: DataFrame, which: str) -> DataFrame:
    """first, all (as they are) or union (without repeats) of annotators' sets."""
    if which == "first":
        return spans.filter("annotator = 0").drop("annotator")
    return spans.drop("annotator").distinct() if which == "union" else spans


def expanded_spans(concepts: DataFrame, texts: DataFrame, suffix: str | None = None) -> DataFrame:
    """Q7: every whole-word mention of each concept in the document its file name points to."""
    located = concepts.withColumn("filename", readers.source_name(F.col("specialty"), F.col("condition"), F.col("note_index"), suffix)).join(texts, "filename")
    rows = located.withColumn("m", F.explode(T.mentions(F.col("text"), F.col("concept"))))
    return rows.select("filename", F.col("type").alias("entity_label"), F.lit("concept").alias("entity_kind"), F.col("m.start").alias("start_span"), F.col("m.end").alias("end_span"), F.col("m.text").alias("text"), "fhir_mapping", "icd10_code", "atc_code", "loinc_code", "snomed_code")


def knowledge_base(concepts: DataFrame, types: DataFrame, labels: DataFrame, vocabularies, language: str, suppressed) -> DataFrame:
    """Q8: distinct (label, cui, name).

    ``concepts(cui, lat, sab, str, suppress)``, ``types(cui, tui)``, ``labels(label, tui)``. The vocabulary test
    looks at every row of a concept, whatever its language or flag, so it is a semi-join on the unfiltered table.
    """
    allowed = concepts.filter(F.col("sab").isin(*vocabularies)).select("cui").distinct()
    named = concepts.filter((F.col("lat") == language) & ~F.col("suppress").isin(*suppressed) & (F.col("str") != "")).select("cui", F.col("str").alias("name")).distinct()
    typed = types.join(F.broadcast(labels), "tui").select("label", "cui").distinct().join(allowed, "cui", "left_semi")
    return typed.join(named, "cui").select("label", "cui", "name")


def expanded(df: DataFrame, text: str, out: str, known: dict[str, str] | DataFrame | None) -> DataFrame:
    """``df`` with ``out``: ``text`` with known phrases replaced, out of a few in a dict or any number in a table (phrase, expansion)."""
    if isinstance(known, DataFrame):
        return dictionary.replace_from_table(df, text, known, out)
    return df.withColumn(out, T.replace_known(F.col(text), known or {}))


#: Asked texts whose candidates are broadcast at most.
FEW_ASKED = 10_000


def linked_entities(entities: DataFrame, kb: DataFrame, encoder: B.Encoder, k: int = V.TOP_K, threshold: float = V.LINK_THRESHOLD, by_type: bool = True, known: dict[str, str] | DataFrame | None = None, translator: B.Translator | None = None, digits: int | None = None, cache: tuple[str, str] | None = None) -> DataFrame:
    """Q9: entities with their ranked candidates. Each distinct text is expanded, translated and encoded once.

    A name has one vector, so names are searched and then stand for their concepts, of which the first ``k`` alone can be among the best.

    ``cache`` is (the encoder's name, a folder): vectors that it holds are not encoded again.
    """
    entities = cut(entities)

    def vectors_of(texts, n):
        if cache is None:
            return dealt(texts, n, "text").distinct().withColumn("vec", B.encode(F.col("text"), encoder))
        return vector_cache.cached_vectors(texts, encoder, *cache)

    asked = expanded(entities.select("text", F.col("entity_label").alias("label")).distinct(), "text", "asked", known)
    if translator is not None:
        asked = asked.withColumn("asked", B.translate(F.col("asked"), translator))
    asked = cut(asked)
    n_asked, keys = asked.count(), ["label", "name"] if by_type else ["name"]
    vectors = vectors_of(asked.select(F.col("asked").alias("text")), n_asked).withColumnRenamed("text", "asked")
    queries = asked.join(vectors, "asked").withColumn("q", F.struct("text", "label"))
    rows = kb.join(asked.select("label").distinct(), "label", "left_semi") if by_type else kb.select("cui", "name").distinct()
    rows = cut(top_per(rows.select(*keys, "cui"), keys, ["cui"], k, "nth"))
    names = rows.filter("nth = 1").drop("nth")
    n = names.count()
    names = dealt(names, n, "name").join(vectors_of(names.select(F.col("name").alias("text")), n).withColumnRenamed("text", "name"), "name")
    few = F.broadcast if n_asked <= FEW_ASKED else lambda df: df
    found = cut(matching.top_candidates(queries.select("q", "label", "vec"), names, k, threshold, ["label"] if by_type else None, digits))
    ranked = top_per(rows.drop("nth").join(few(found.drop("cui", "rank")), keys), ["q"], [F.col("score").desc(), "name", "cui"], k)
    lists = ranked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "cui", "name", "score"))).alias("candidates"))
    lists = lists.select(F.col("q.text").alias("text"), F.col("q.label").alias("entity_label"), "candidates")
    return entities.join(few(lists), ["text", "entity_label"], "left")


def translated_entities(entities: DataFrame, translator: B.Translator, known: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Q10: all columns, expanded_text and translated_text; a distinct text is sent once."""
    rows = expanded(entities, "text", "expanded_text", known)
    once = rows.select("expanded_text").distinct().withColumn("translated_text", B.translate(F.col("expanded_text"), translator))
    return rows.join(once, "expanded_text", "left").select(*entities.columns, "expanded_text", "translated_text")


def translated_documents(docs: DataFrame, translator: B.Translator, text: str = "text") -> DataFrame:
    """Whole documents, one call each; (all columns, translation). Those that fail are left out."""
    return docs.withColumn("translation", B.translate(F.col(text), translator, batch=1)).filter("translation <> ''")


def extracted_relations(entities: DataFrame, texts: DataFrame, scorer: B.PairScorer, lang: str | None = "en", threshold: float = 0.5, max_distance: int = V.MAX_DISTANCE, detector: B.LanguageDetector | None = None) -> DataFrame:
    """Q11: the best relation of each ordered pair of spans.

    ``entities(doc_id, ent, start, end, label, text)`` and ``texts(doc_id, text)``. Hypotheses are in ``lang``, or, with a
    detector, in the language that it finds in each text. Output labels are those of the first entity on a span.
    """
    spark, entities = entities.sparkSession, cut(entities)
    docs = texts.select("doc_id", F.col("text").alias("body"))
    docs = docs.withColumn("lang", F.lit(lang) if detector is None else B.detect_language(F.col("body"), detector))
    tables = {one: matching.relation_table(spark, V.RELATIONS, words).select("seq", "head", "middle", "tail").distinct().withColumn("lang", F.lit(one)) for one, words in V.TEMPLATES.items()}
    pairs = matching.band_pairs(entities.select("doc_id", "ent", "label", "start", "end"), "doc_id", matching.relation_table(spark, V.RELATIONS), max_distance).drop("head", "middle", "tail")
    first = matching.first_per(entities, ["doc_id", "start", "end"], ["ent"])
    side = lambda p: first.select("doc_id", F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.col("text").alias(f"{p}_text"), F.col("label").alias(f"{p}_label"))
    own = lambda p: entities.select("doc_id", F.col("ent").alias(f"{p}_ent"), F.col("text").alias(f"{p}_own"))
    words = F.broadcast(metrics.unioned(list(tables.values())))  # the relations times the languages
    worded = F.when(F.col("lang").isin(*V.TEMPLATES), F.col("lang")).otherwise("en")
    full = pairs.join(own("s"), ["doc_id", "s_ent"]).join(own("o"), ["doc_id", "o_ent"]).join(docs.select("doc_id", F.col("lang").alias("doc_lang"), worded.alias("lang")), "doc_id").join(words, ["seq", "lang"])
    placed = alignment.contexts(full, docs)
    scored = placed.withColumn("score", B.entail(F.col("context"), matching.hypothesis(F.col("s_own"), F.col("o_own")), scorer)).drop("context")
    best = matching.best_relation(scored, "doc_id", threshold)
    out = best.join(side("s"), ["doc_id", "s_start", "s_end"]).join(side("o"), ["doc_id", "o_start", "o_end"])
    return out.select("doc_id", F.col("s_text").alias("subject_text"), F.col("s_label").alias("subject_label"), F.col("s_start").alias("subject_start"), F.col("s_end").alias("subject_end"), "relation", F.col("o_text").alias("object_text"), F.col("o_label").alias("object_label"), F.col("o_start").alias("object_start"), F.col("o_end").alias("object_end"), F.round("score", 4).alias("score"), F.col("doc_lang").alias("lang"))


def resolved_triples(relations: DataFrame, linked: DataFrame) -> DataFrame:
    """Distinct (doc_id, s_cui, relation, o_cui): both spans must have a concept; the last of repeated spans counts."""
    spans = matching.last_per_span(linked.filter(F.coalesce("cui", F.lit("")) != ""), ["doc_id", "start", "end"], "cui", "id")
    side = lambda p: spans.select("doc_id", F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.col("cui").alias(f"{p}_cui"))
    met = relations.join(side("s"), ["doc_id", "s_start", "s_end"]).join(side("o"), ["doc_id", "o_start", "o_end"])
    return met.select("doc_id", "s_cui", "relation", "o_cui").distinct()


def shown_text(df: DataFrame):
    """The translation where there is one, else the text itself, stripped."""
    return T.preferred(F.col("translated"), F.col("text")) if "translated" in df.columns else T.strip(F.col("text"))


def spanned_relations(relations: DataFrame, linked: DataFrame, by: list[str]) -> DataFrame:
    """Relations with the concepts and texts (s_cui, o_cui, s_text, o_text) of both spans among the entities of their ``by``; of repeated spans the last counts."""
    last = lambda c, value: F.max_by(value, F.when(F.coalesce(value, F.lit("")) != "", F.col("id"))).alias(c)
    spans = linked.groupBy(*by, "start", "end").agg(last("cui", F.col("cui")), last("text", shown_text(linked)))
    side = lambda p: spans.select(*by, *[F.col(c).alias(f"{p}_{c}") for c in ("start", "end", "cui", "text")])
    return relations.join(side("s"), [*by, "s_start", "s_end"], "left").join(side("o"), [*by, "o_start", "o_end"], "left")


def relation_texts(relations: DataFrame, linked: DataFrame, by: tuple = ("doc_id",)) -> DataFrame:
    """(doc_id, id, rel_text): ``subject [relation] object`` where no part is blank."""
    met = spanned_relations(relations, linked, list(by))
    met = met.filter((F.coalesce("s_text", F.lit("")) != "") & (F.coalesce("o_text", F.lit("")) != "") & (T.strip(F.col("relation")) != ""))
    return met.select("doc_id", "id", F.concat("s_text", F.lit(" ["), T.strip(F.col("relation")), F.lit("] "), "o_text").alias("rel_text"))


def entity_matches(src: DataFrame, hyp: DataFrame, scope: list[str], enforce_label: bool = False) -> DataFrame:
    """Q12: src and hyp entities by concept, then by text; the label is no part of the key unless asked for."""
    def keyed(df):
        label = F.lower(T.strip(F.col("label"))) if enforce_label else F.lit("")
        body = shown_text(df)
        text = F.when(body != "", F.concat(label, F.lit("|text:"), F.lower(body)))
        return df.select(*scope, "id", F.when(F.coalesce("cui", F.lit("")) != "", F.concat(label, F.lit("|cui:"), "cui")).alias("by_cui"), text.alias("by_text"))

    return matching.match_cascade(keyed(src), keyed(hyp), scope, [("CUI", "by_cui"), ("text", "by_text")])


def relation_matches(src: DataFrame, hyp: DataFrame, src_linked: DataFrame, hyp_linked: DataFrame, scope: list[str], by: tuple = ("doc_id",)) -> DataFrame:
    """Q12: relations by the concepts of both arguments, then by their texts; the relation is part of each key."""
    def keyed(rel, linked):
        rows = spanned_relations(rel, linked, list(by))
        name = F.lower(T.strip(F.col("relation")))
        both = lambda a, b, kind: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("|", name, F.concat(F.lit(kind), a), F.concat(F.lit(kind), b)))
        return rows.select(*scope, "id", both(F.col("s_cui"), F.col("o_cui"), "cui:").alias("by_cui"), both(F.lower(F.col("s_text")), F.lower(F.col("o_text")), "text:").alias("by_text"))

    return matching.match_cascade(keyed(src, src_linked), keyed(hyp, hyp_linked), scope, [("CUI", "by_cui"), ("text", "by_text")])


def cross_lingual_matches(src: DataFrame, hyp: DataFrame, encoder: B.Encoder, threshold: float = V.MATCH_THRESHOLD, same_label: bool = False, digits: int | None = None) -> DataFrame:
    """Q13: greedy one-to-one matches inside each (filename, bead_idx); what finds none stands alone.

    Rows have filename, bead_idx (null for those that no bead holds, which form a group of their
    own), i or j, label and the text to compare. A text without a vector is never a candidate. Distinct texts of a group meet
    without their vectors, each distinct pair of texts is scored once, and only rows of texts that are alike meet at all.
    """
    scope = ["filename", "bead_idx"]
    src, hyp = (cut(df.withColumn("bead_idx", F.coalesce("bead_idx", F.lit(-1)))) for df in (src, hyp))
    scored = alike_texts(src, hyp, scope, encoder, threshold, digits)
    label = lambda df, c: df.withColumn(c, F.lower("label"))
    met = label(src, "la").select(*scope, "i", F.col("text").alias("ta"), "la").join(scored, [*scope, "ta"])
    met = met.join(label(hyp, "lb").select(*scope, "j", F.col("text").alias("tb"), "lb"), [*scope, "tb"])
    if same_label:
        met = met.filter("la = lb")
    return matching.with_singletons(matching.greedy_pairs(met.select(*scope, "i", "j", "score"), scope), src, hyp, scope)


def alike_texts(src: DataFrame, hyp: DataFrame, scope: list[str], encoder: B.Encoder, threshold: float, digits: int | None = None) -> DataFrame:
    """(scope, ta, tb, score): the distinct pairs of texts of a scope that reach the threshold by cosine."""
    side = lambda df, c: df.filter("text <> ''").select(*scope, F.col("text").alias(c)).distinct()
    pairs = cut(side(src, "ta").join(side(hyp, "tb"), scope))
    once = pairs.select("ta", "tb").distinct()
    texts = once.select(F.explode(F.array("ta", "tb")).alias("text")).distinct()
    vectors = cut(texts.withColumn("vec", B.encode(F.col("text"), encoder)))
    of = lambda t, v: vectors.select(F.col("text").alias(t), F.col("vec").alias(v))
    score = T.cosine(F.col("va"), F.col("vb"))
    scored = once.join(of("ta", "va"), "ta").join(of("tb", "vb"), "tb").select("ta", "tb", (score if digits is None else F.round(score, digits)).alias("score"))
    return pairs.join(scored.filter(F.col("score") >= threshold), ["ta", "tb"])


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count_if(F.col("i").isNotNull() & F.col("j").isNotNull()).alias("matched"), F.count_if(F.col("j").isNull()).alias("unmatched_src"), F.count_if(F.col("i").isNull()).alias("unmatched_hyp"))


def cui_scores(src: DataFrame, hyp: DataFrame) -> DataFrame:
    """Per document: tp, fp, fn, precision, recall, f1 of the distinct concepts of hyp against src."""
    has = lambda df: df.filter(F.coalesce("cui", F.lit("")) != "").select("doc_id", "cui")
    return metrics.overlap(has(src), has(hyp), ["cui"], ["doc_id"])


def cui_overlap(src: DataFrame, hyp: DataFrame) -> DataFrame:
    """Rounded scores and the sizes of both sets."""
    return cui_scores(src, hyp).select("doc_id", *[F.round(c, 5).alias(f"kg_entity_{c}") for c in ("precision", "recall", "f1")], (F.col("tp") + F.col("fn")).alias("kg_n_src_entities"), (F.col("tp") + F.col("fp")).alias("kg_n_hyp_entities"))


def combined_score(kg_f1, text_f1, alpha: float = 0.5):
    return F.round(alpha * kg_f1 + (1 - alpha) * text_f1, 5)


def sentence_scores(beads: DataFrame, scorer: B.SimilarityScorer, encoder: B.Encoder) -> DataFrame:
    """Q14, sentences: means over each document's beads, the population deviation and the share of low ones."""
    scored = beads.withColumn("bs", B.similarity(F.col("hypothesis"), F.col("source"), scorer))
    scored = scored.withColumn("labse", T.cosine(B.encode(F.col("source"), encoder), B.encode(F.col("hypothesis"), encoder)))
    mean = lambda c: F.round(F.round(F.avg(c), 10), 5)  # whatever the order of the sum
    return scored.groupBy("filename").agg(
        mean("bs.p").alias("sent_bs_precision_mean"), mean("bs.r").alias("sent_bs_recall_mean"), mean("bs.f1").alias("sent_bs_f1_mean"),
        mean("labse").alias("sent_labse_mean"), F.round(F.stddev_pop("labse"), 5).alias("sent_labse_std"), mean((F.col("labse") < V.LOW_SIMILARITY).cast("double")).alias("sent_labse_low_frac"), F.count("*").alias("n_aligned_sentences"),
    )


def text_cover(src: DataFrame, hyp: DataFrame, scorer: B.SimilarityScorer, threshold: float = V.MATCH_THRESHOLD) -> DataFrame:
    """(doc_id, precision, recall, f1) of texts whose best score against the other side's reaches the threshold.

    ``src`` and ``hyp`` are (doc_id, text) with repeats; each distinct pair of texts is scored once. Documents
    with texts on one side alone have no row.
    """
    counted = lambda df, name, n: cut(df.filter("text <> ''").groupBy("doc_id", F.col("text").alias(name)).agg(F.count("*").alias(n)))
    a, b = counted(src, "s", "n_s"), counted(hyp, "h", "n_h")
    reached = cut(covered_pairs(a.select("doc_id", "s"), b.select("doc_id", "h"), scorer, threshold))

    def share(rows, name, n):
        hit = reached.select("doc_id", name).distinct().withColumn("hit", F.lit(True))
        return rows.join(hit, ["doc_id", name], "left").groupBy("doc_id").agg((F.sum(F.when(F.col("hit"), F.col(n)).otherwise(0)) / F.sum(n)).alias("share"))

    met = share(b, "h", "n_h").withColumnRenamed("share", "precision").join(share(a, "s", "n_s").withColumnRenamed("share", "recall"), "doc_id")
    return met.withColumn("f1", metrics.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def covered_pairs(src: DataFrame, hyp: DataFrame, scorer: B.SimilarityScorer, threshold: float) -> DataFrame:
    """Distinct (doc_id, s, h) of ``src(doc_id, s)`` and ``hyp(doc_id, h)`` whose F1 reaches the threshold.

    Where the scorer tells the token sets that its F1 is that of, texts that share too few do not meet; another scorer's have to be
    compared all with all of their document. A pair of texts that many documents have is scored once.
    """
    if hasattr(scorer, "tokens") and threshold > 0:
        with_tokens = lambda df, c: df.join(cut(df.select(c).distinct().withColumn("tokens", B.token_sets(F.col(c), scorer))), c)
        pairs = setjoin.overlap_candidates(with_tokens(src, "s"), with_tokens(hyp, "h"), ["doc_id"], "s", "h", threshold)
    else:
        pairs = src.join(hyp, "doc_id")
    pairs = cut(pairs)
    scored = pairs.select("s", "h").distinct().withColumn("score", B.similarity(F.col("h"), F.col("s"), scorer)["f1"])
    return pairs.join(scored.filter(F.col("score") >= threshold).select("s", "h"), ["s", "h"], "left_semi")


def concept_scores(src: DataFrame, hyp: DataFrame, scorer: B.SimilarityScorer, src_relations: DataFrame | None = None, hyp_relations: DataFrame | None = None, threshold: float = V.MATCH_THRESHOLD) -> DataFrame:
    """Q14, concepts: the kg_* columns and the unrounded kg_f1 of each document that has entities on both sides.

    Entities by concept and by text, relations by concepts and by text. Relation columns are null unless both
    sides have relations; text columns are null unless both sides have texts.
    """
    r5 = lambda c: F.round(c, 5)
    three = ("precision", "recall", "f1")

    def overlapped(found, prefix, sizes):
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        return [*[r5(zero(found[k])).alias(f"{prefix}_{k}") for k in three], count(found["tp"] + found["fn"]).alias(f"kg_n_src_{sizes}"), count(found["tp"] + found["fp"]).alias(f"kg_n_hyp_{sizes}")]

    def covered(a, b, prefix):
        return text_cover(a, b, scorer, threshold).select("doc_id", *[r5(F.col(k)).alias(f"{prefix}_{k}") for k in three])

    src, hyp, src_relations, hyp_relations = (None if x is None else cut(x) for x in (src, hyp, src_relations, hyp_relations))
    both = lambda a, b: a.select("doc_id").distinct().join(b.select("doc_id"), "doc_id", "left_semi")
    docs = both(src, hyp)
    found = cui_scores(src, hyp)
    out = docs.join(found, "doc_id", "left").select("doc_id", F.coalesce(found["f1"], F.lit(0.0)).alias("kg_f1"), *overlapped(found, "kg_entity", "entities"))
    shown = lambda df: df.select("doc_id", F.coalesce(shown_text(df), F.lit("")).alias("text"))
    out = out.join(covered(shown(src), shown(hyp), "kg_embed"), "doc_id", "left")
    if src_relations is None or hyp_relations is None:
        return out
    triples = metrics.overlap(resolved_triples(src_relations, src), resolved_triples(hyp_relations, hyp), ["s_cui", "relation", "o_cui"], ["doc_id"])
    related = both(src_relations, hyp_relations).join(triples, "doc_id", "left").select("doc_id", *overlapped(triples, "kg_rel", "relations"))
    told = lambda rel, ents: relation_texts(rel, ents).select("doc_id", F.col("rel_text").alias("text"))
    return out.join(related, "doc_id", "left").join(covered(told(src_relations, src), told(hyp_relations, hyp), "kg_rel_embed"), "doc_id", "left")


def translation_scores(pairs: DataFrame, scorer: B.SimilarityScorer, encoder: B.Encoder, src_linked: DataFrame | None = None, hyp_linked: DataFrame | None = None, src_relations: DataFrame | None = None, hyp_relations: DataFrame | None = None, threshold: float = V.MATCH_THRESHOLD, alpha: float = 0.5) -> DataFrame:
    """Q14: a row for each (filename, source, hypothesis) with document, sentence and concept scores.

    Entities and relations are by ``doc_id``, the file's name. Those that an aligned bead holds count; in a
    document without beads all do. Without linked entities of both sides the concept columns are null.
    """
    from lexigrid.plans import composites

    bound_batches(pairs.sparkSession)
    whole = pairs.withColumn("bs", B.similarity(F.col("hypothesis"), F.col("source"), scorer)).withColumn("labse", T.cosine(B.encode(F.col("source"), encoder), B.encode(F.col("hypothesis"), encoder)))
    r5 = lambda c: F.round(c, 5)
    n = lambda c: F.size(alignment.split_sentences(c))
    docs = whole.select("filename", r5("bs.p").alias("doc_bs_precision"), r5("bs.r").alias("doc_bs_recall"), r5("bs.f1").alias("doc_bs_f1"), F.col("bs.f1").alias("raw_f1"), r5("labse").alias("doc_labse"), n("source").alias("n_src"), n("hypothesis").alias("n_hyp"))
    beads = cut(alignment.align_documents(pairs))
    out = docs.join(sentence_scores(beads, scorer, encoder), "filename", "left")
    counted = lambda c: F.when(F.col("n_aligned_sentences").isNotNull(), F.col(c))
    out = out.withColumn("n_src_sentences", counted("n_src")).withColumn("n_hyp_sentences", counted("n_hyp"))
    if src_linked is not None and hyp_linked is not None:
        by_doc = beads.withColumnRenamed("filename", "doc_id")
        src_linked, hyp_linked = cut(src_linked), cut(hyp_linked)
        ents = [composites.scored_rows(by_doc, rows, side) for side, rows in (("src", src_linked), ("hyp", hyp_linked))]
        rels = [None if rows is None else composites.scored_rows(by_doc, rows, side) for side, rows in (("src", src_relations), ("hyp", hyp_relations))]
        known = src_linked.select("doc_id").distinct().join(hyp_linked.select("doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "filename").withColumn("known", F.lit(True))
        out = out.join(known, "filename", "left").join(concept_scores(*ents, scorer, *rels, threshold).withColumnRenamed("doc_id", "filename"), "filename", "left")
        unheld = lambda c, value: F.when(F.col("known"), F.coalesce(c, F.lit(value)))
        for c in ("kg_entity_precision", "kg_entity_recall", "kg_entity_f1"):
            out = out.withColumn(c, unheld(c, 0.0))
        for c in ("kg_n_src_entities", "kg_n_hyp_entities"):
            out = out.withColumn(c, unheld(c, 0))
        out = out.withColumn("kg_bertscore_f1", F.when(F.col("known"), combined_score(F.coalesce("kg_f1", F.lit(0.0)), F.col("raw_f1"), alpha)))
    empty = [c for c in V.EVAL_COLUMNS if c not in out.columns and c != "file"]
    return out.select(F.col("filename").alias("file"), *[F.col(c) if c not in empty else F.lit(None).cast("double").alias(c) for c in V.EVAL_COLUMNS if c != "file"])


def documents_with_triples(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """(with_triples, documents): how many documents with relations have a resolved triple."""
    has = triples.select("doc_id").distinct().withColumn("has", F.lit(1))
    return relations.select("doc_id").distinct().join(has, "doc_id", "left").agg(F.count("has").alias("with_triples"), F.count("*").alias("documents"))


def pair_stats(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q15: by document and over all; pairs with both sides blank go first."""
    src, hyp = T.strip(F.col("source")), T.strip(F.col("hypothesis"))
    rows = pairs.select("filename", src.alias("s"), hyp.alias("h")).filter((F.col("s") != "") | (F.col("h") != ""))
    n = lambda c: F.sum(F.size(T.tokens(F.col(c))))
    docs = rows.groupBy("filename").agg(F.count("*").alias("pairs"), n("s").alias("src_words"), n("h").alias("hyp_words"))
    whole = docs.agg(F.count("*").alias("documents"), F.sum("pairs").alias("pairs"), F.sum("src_words").alias("src_words"), F.sum("hyp_words").alias("hyp_words"), F.avg("pairs").alias("avg_pairs"))
    return docs, whole.withColumn("avg_src_words", metrics.ratio(F.col("src_words"), F.col("pairs"))).withColumn("avg_hyp_words", metrics.ratio(F.col("hyp_words"), F.col("pairs")))


def abbreviation_search(table: DataFrame, term: str) -> DataFrame:
    """Q16: entries whose expansion in either language holds the term, whatever its case."""
    has = lambda c: F.contains(F.lower(c), F.lit(term.lower()))
    return table.filter(has("bg") | has("en")).orderBy("abbreviation")


def found_entities(texts: DataFrame, model: B.NerModel, batches=V.LABEL_BATCHES, threshold: float = 0.5, most: int = V.CHUNK_CHARS) -> DataFrame:
    """NER: chunks of each text are asked for each batch of labels; offsets are moved back and repeats go, the first stays."""
    import pandas as pd

    cut = texts.withColumn("chunk", F.explode(T.chunks(F.col("text"), most))).select("filename", F.col("chunk.start").alias("base"), F.expr("substring(text, chunk.start + 1, chunk.end - chunk.start)").alias("body"))

    def run(frames):
        for pdf in frames:
            rows = []
            for name, base, body in pdf.itertuples(index=False):
                for b, labels in enumerate(batches):
                    rows += [(name, e["label"], base + e["start"], base + e["end"], e["text"], (base + e["start"]) * 100 + b) for e in model.predict(body, list(labels), threshold)]
            yield pd.DataFrame(rows, columns=["filename", "entity_label", "start_span", "end_span", "text", "seq"])

    found = cut.mapInPandas(run, "filename string, entity_label string, start_span int, end_span int, text string, seq long")
    once = matching.first_per(found, ["filename", "start_span", "end_span", "entity_label"], ["seq"]).drop("seq")
    return once.withColumn("entity_kind", F.when(F.col("entity_label").isin(*V.LITERAL_LABELS), "literal").otherwise(V.DEFAULT_KIND))
