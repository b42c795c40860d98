"""All queries of the library over the shared test tables, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexigrid.functions import backends as B
from lexigrid.functions import text as T
from lexigrid.functions import vocab as V
from lexigrid.operators import alignment, dictionary, matching, metrics
from lexigrid.operators.durable import cut
from lexigrid.plans import align_sql
from lexigrid.plans import composites as C
from lexigrid.plans import pipelines as P
from lexigrid.plans import standins as S
from lexigrid.sources import readers

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# corpus statistics

STATS = S.NOTES + r""",
body AS (SELECT stem || '.txt' AS file, stem, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM notes),
parts AS (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(b, '\s+', ' ', 'g'), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS s,
  regexp_extract_all(b, '[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*') AS w FROM body),
stats AS (SELECT file,
  CASE WHEN regexp_extract(stem, '^(.+?)_\d+.*$', 1) = '' THEN stem ELSE regexp_extract(stem, '^(.+?)_\d+.*$', 1) END AS disease,
  length(b) AS characters, length(regexp_replace(b, '\s', '', 'g')) AS characters_no_spaces,
  CASE WHEN b = '' THEN 0 ELSE len(regexp_split_to_array(b, '\r\n|[\n\r]')) END AS lines,
  len(s) AS sentences, len(w) AS words_regex, len(list_filter(regexp_split_to_array(b, '\s+'), lambda x: x <> '')) AS tokens_whitespace,
  CASE WHEN len(s) > 0 THEN round(len(w) / len(s), 2) END AS avg_words_per_sentence FROM parts)"""


def _notes(spark, sf):
    return S.notes(spark, sf).withColumn("filename", F.concat("stem", F.lit(".txt")))


@query(f"WITH {STATS} SELECT * FROM stats")
def corpus_doc_stats(spark, sf):
    return P.document_stats(_notes(spark, sf))


@query(f"WITH {STATS} " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, count({m}) AS count, round(avg({m}), 2) AS mean, round(quantile_cont({m}, 0.5), 2) AS median, CAST(min({m}) AS DOUBLE) AS min, CAST(max({m}) AS DOUBLE) AS max, round(stddev_pop({m}), 2) AS std, round(quantile_cont({m}, 0.25), 2) AS p25, round(quantile_cont({m}, 0.75), 2) AS p75 FROM stats" for m in P.DOC_METRICS))
def corpus_summary(spark, sf):
    return P.corpus_summary(P.document_stats(_notes(spark, sf)))


@query(r"SELECT count(DISTINCT w) AS vocabulary FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*')) AS w FROM documents)")
def corpus_vocabulary(spark, sf):
    return P.vocabulary_size(S.table(spark, sf, "documents"))


@query(f"WITH {STATS} SELECT disease, count(*) AS documents, CAST(sum(sentences) AS BIGINT) AS sentences FROM stats GROUP BY disease")
def category_sentence_counts(spark, sf):
    return P.category_counts(P.document_stats(_notes(spark, sf)))


# subset selection


def _lengths(spark, sf):
    parts = T.id_parts(F.concat_ws("_", "lang", "source", "doc_id"))
    return S.table(spark, sf, "documents").select(parts[0].alias("category"), parts[1].alias("document_id"), F.length("text").cast("long").alias("length"))


IDS = "ids AS (SELECT lang || '_' || source AS category, CAST(doc_id AS VARCHAR) AS document_id, length(text) AS length FROM documents)"


@query(f"WITH {IDS} SELECT category, document_id, length FROM ids")
def id_split_projection(spark, sf):
    return _lengths(spark, sf)


@query(f"WITH {IDS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY length, document_id) AS rank FROM ids) WHERE rank <= 30")
def shortest_30_per_category(spark, sf):
    return P.shortest(_lengths(spark, sf), 30)


@query(f"WITH {IDS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY length, document_id) AS rank FROM ids) WHERE rank <= 1")
def shortest_1_per_category(spark, sf):
    return P.shortest(_lengths(spark, sf), 1)


# markdown tables: a file for each brand and PER_FILE keys, with a row broken across lines and a repeat

#: Keys of parts in a stand-in file: more parts are more files, and none grows.
PER_FILE = 500


def _tables(spark, sf):
    part = S.table(spark, sf, "part")
    row = F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_type", F.lit(" |\n| "), "p_name", F.lit(" | "), "p_brand", F.lit(" |\nof "), F.col("p_size").cast("string"), F.lit(" | x |"))
    lines = part.groupBy("p_brand", F.floor(F.col("p_partkey") / PER_FILE).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    head = "intro\n| English Term | Bulgarian Term | Justification |\n|---|:-:|---|\n"
    return lines.select(F.concat("p_brand", F.lit("_"), "k", F.lit(".txt")).alias("filename"), F.concat(F.lit(head), "rows").alias("text"))


MD = f"rows AS (SELECT p_brand || '_' || p_partkey // {PER_FILE} || '.txt' AS f, p_name, p_brand, p_size FROM part)"


@query(f"""WITH {MD}
SELECT DISTINCT f AS "Source File", p_name AS "English Term", p_brand AS "Bulgarian Term", 'of ' || p_size AS "Justification", 'x' AS "Note" FROM rows""")
def md_table_rows_4col(spark, sf):
    return P.combined_tables(_tables(spark, sf), ["English Term", "Bulgarian Term", "Justification", "Note"]).drop("row_no")


def _names(spark, sf):
    rows = S.table(spark, sf, "part")
    line = F.concat(F.lit("|"), F.concat_ws("|", "p_name", "p_type", "p_brand"), F.lit("|"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("r")))), lambda x: x["r"]), "\n")
    return rows.groupBy(F.floor(F.col("p_partkey") / PER_FILE).cast("string").alias("filename")).agg(text.alias("text"))


@query(f"""SELECT CAST(p_partkey // {PER_FILE} AS VARCHAR) AS "Source File", p_name AS "English Term", p_type AS "Bulgarian Term", p_brand AS "Justification" FROM part GROUP BY ALL""")
def md_table_rows_3col(spark, sf):
    return P.combined_tables(_names(spark, sf), ["English Term", "Bulgarian Term", "Justification"]).drop("row_no")


@query(f"""SELECT CAST(p_partkey // {PER_FILE} AS VARCHAR) AS filename, p_name AS a, p_type AS b, p_brand AS c,
  min(r) AS row_no FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey // {PER_FILE} ORDER BY p_partkey) AS r FROM part) GROUP BY 1, 2, 3, 4""")
def dedup_ordered(spark, sf):
    rows = P.combined_tables(_names(spark, sf), ["a", "b", "c"])
    return rows.select(F.col("Source File").alias("filename"), "a", "b", "c", "row_no")


@query(f"""SELECT 2 * count(*) AS rows, count(DISTINCT (p_partkey // {PER_FILE}, p_name, p_type, p_brand)) AS kept, 2 * count(*) - count(DISTINCT (p_partkey // {PER_FILE}, p_name, p_type, p_brand)) AS removed FROM part""")
def table_duplicates_removed(spark, sf):
    """Every file's table twice over: repeats within a file go, those of other files stay."""
    twice = _names(spark, sf).withColumn("text", F.concat_ws("\n", "text", "text"))
    return P.duplicates_removed(twice, ["English Term", "Bulgarian Term", "Justification"])


# NER runs


def _run(spark, sf, side, model, language):
    m = S.mentions(spark, sf, side)
    return m.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(language).alias("language"), F.lit(model).alias("model"), F.upper("label").alias("entity_type"), "text", F.col("start").cast("int").alias("start_index"), F.col("end").cast("int").alias("end_index"), F.lit("C1" if side == "pred" else None).cast("string").alias("umls_cui"))


def _runs(spark, sf):
    gold, pred = (lambda lang, s=s: _run(spark, sf, s, "m1", lang) for s in ("gold", "pred"))
    both = gold("en").unionByName(gold("bg"))
    other = _run(spark, sf, "gold", "m2", "en")
    return P.combined_runs([(both, pred("en")), (other, other.limit(0))])


RUNS = f"""WITH {S.mentions_sql('gold', 'g')}, {S.mentions_sql('pred', 'p')},
runs AS (SELECT doc_id, 'bg' AS language, 'm1' AS model, label, text, start, "end", CAST(NULL AS VARCHAR) AS cui FROM g
  UNION ALL SELECT doc_id, 'en', 'm1', label, text, start, "end", 'C1' FROM p
  UNION ALL SELECT doc_id, 'en', 'm2', label, text, start, "end", NULL FROM g)"""


@query(RUNS + """ SELECT CAST(doc_id AS VARCHAR) AS document_id, language, model, upper(label) AS entity_type, text, CAST(start AS INTEGER) AS start_index, CAST("end" AS INTEGER) AS end_index, cui AS umls_cui FROM runs""")
def ner_runs_combined(spark, sf):
    return _runs(spark, sf)


@query(RUNS + " SELECT model, count(*) AS n FROM runs GROUP BY model")
def model_value_counts(spark, sf):
    return P.model_counts(_runs(spark, sf))


# sentence pairs

PAIR_STATS = S.PAIRS + r""",
stripped AS (SELECT filename, regexp_replace(source, '^\s+|\s+$', '', 'g') AS s, regexp_replace(hypothesis, '^\s+|\s+$', '', 'g') AS h FROM pairs),
docs AS (SELECT filename, count(*) AS pairs, CAST(sum(len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> ''))) AS BIGINT) AS src_words,
  CAST(sum(len(list_filter(regexp_split_to_array(h, '\s+'), lambda x: x <> ''))) AS BIGINT) AS hyp_words FROM stripped WHERE s <> '' OR h <> '' GROUP BY filename)"""


@query(f"WITH {PAIR_STATS} SELECT * FROM docs")
def sentence_pair_doc_stats(spark, sf):
    return P.pair_stats(S.pairs(spark, sf))[0]


@query(f"""WITH {PAIR_STATS} SELECT count(*) AS documents, CAST(sum(pairs) AS BIGINT) AS pairs, CAST(sum(src_words) AS BIGINT) AS src_words, CAST(sum(hyp_words) AS BIGINT) AS hyp_words,
avg(pairs) AS avg_pairs, sum(src_words) / sum(pairs) AS avg_src_words, sum(hyp_words) / sum(pairs) AS avg_hyp_words FROM docs""")
def sentence_pair_corpus_stats(spark, sf):
    return P.pair_stats(S.pairs(spark, sf))[1]


# mentions and abbreviations


@query(f"WITH {S.mentions_sql('gold', 'g')} SELECT doc_id, ent, start, \"end\", text, label FROM g")
def token_entities_with_spans(spark, sf):
    return S.mentions(spark, sf, "gold").select("doc_id", "ent", "start", "end", "text", "label")


@query(r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(lower(text), '(^|[^\p{L}\p{N}_])(token)($|[^\p{L}\p{N}_])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), chr(1)) AS p FROM documents),
x AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM t)
SELECT doc_id, start, "end" FROM (SELECT doc_id, i, CAST(coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start,
 CAST(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS "end" FROM x) WHERE i % 2 = 0""")
def mention_offsets(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", F.explode(T.mentions(F.col("text"), F.lit("TOKEN"))).alias("m"))
    return d.select("doc_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"))


#: Expansions by token; "re" is part of no key and "the" is found by upper case.
KNOWN = {"of": "aaa", "re": "of the", "THE": "bbb", "and": "ccc"}
BOUNDARY = r"[^\p{L}\p{N}_]"


def _words_sql(expr: str) -> str:
    """Texts taken apart into runs of word characters and the rest, mapped and put together again."""
    return rf"""SELECT doc_id, sha256(array_to_string(list_transform(string_split(regexp_replace(text, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda w: {expr}), '')) AS digest FROM documents"""


@query(_words_sql("CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KNOWN.items()) + " ELSE w END"))
def abbrev_replace_text(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", F.sha2(T.replace_known(F.col("text"), KNOWN), 256).alias("digest"))


@query(_words_sql("CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KNOWN.items()) + " ELSE w END"))
def abbrev_replace_table(spark, sf):
    """The same replacements out of a table, which may be of any size."""
    table = spark.createDataFrame(list(KNOWN.items()), "phrase string, expansion string")
    docs = S.table(spark, sf, "documents").select("doc_id", "text")
    return dictionary.replace_from_table(docs, "text", table, "new").select("doc_id", F.sha2("new", 256).alias("digest"))


def _annotated(w: str) -> str:
    cases = " ".join(f"WHEN {w} = '{k}' THEN {w} || ' ({v})'" for k, v in KNOWN.items()) + " " + " ".join(f"WHEN upper({w}) = '{k}' THEN {w} || ' ({v})'" for k, v in KNOWN.items())
    return f"CASE {cases} ELSE {w} END"


@query(_words_sql(_annotated("w")).replace(r"([\p{L}\p{N}_]+)", r"([\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?)"))
def abbrev_expand_text(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", F.sha2(T.annotate_known(F.col("text"), KNOWN), 256).alias("digest"))


@query("SELECT p_partkey, CASE upper(p_type) WHEN 'ECONOMY' THEN 'eco' WHEN 'STANDARD' THEN 'std' END AS found FROM part")
def abbrev_lookup(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", T.lookup(F.lower("p_type"), {"ECONOMY": "eco", "STANDARD": "std"}).alias("found"))




@query("SELECT p_name AS abbreviation, p_type AS bg, p_brand AS en FROM part WHERE contains(lower(p_type), 'eco') OR contains(lower(p_brand), 'eco')")
def abbrev_search(spark, sf):
    rows = S.table(spark, sf, "part").select(F.col("p_name").alias("abbreviation"), F.col("p_type").alias("bg"), F.col("p_brand").alias("en"))
    return P.abbreviation_search(rows, "Eco")


# NER evaluation


def _sides(spark, sf):
    return S.mentions(spark, sf, "gold"), S.mentions(spark, sf, "pred")


SIDES = f"{S.mentions_sql('gold', 'g')}, {S.mentions_sql('pred', 'p')}"


def _prf_sql(keys: str, by: str = "", source: str = "g0", other: str = "p0") -> str:
    cols = f"{by}, {keys}" if by else keys
    group = f"GROUP BY {by}" if by else ""
    return f"""u AS (SELECT {cols}, max(gg) AS gg, max(pp) AS pp FROM (SELECT {cols}, 1 AS gg, 0 AS pp FROM {source} UNION ALL SELECT {cols}, 0, 1 FROM {other}) GROUP BY {cols}),
c AS (SELECT {by + ',' if by else ''} CAST(coalesce(sum(gg * pp), 0) AS BIGINT) AS tp, CAST(coalesce(sum((1 - gg) * pp), 0) AS BIGINT) AS fp, CAST(coalesce(sum(gg * (1 - pp)), 0) AS BIGINT) AS fn FROM u {group}),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r)"""


def _scores_sql(keys: str) -> str:
    low = """g0 AS (SELECT *, lower(text) AS lower_text FROM g), p0 AS (SELECT *, lower(text) AS lower_text FROM p)"""
    return f"WITH {SIDES}, {low}, {_prf_sql(keys)} SELECT tp, fp, fn, precision, recall, f1 FROM f"


def _score(kind):
    def run(spark, sf):
        return P.ner_scores(*_sides(spark, sf)).filter(F.col("kind") == kind).drop("kind")

    return run


for _kind, _keys in (("strict", 'doc_id, start, "end", label'), ("span", 'doc_id, start, "end"'), ("lenient", "lower_text, label")):
    QUERIES[f"ner_eval_{_kind}"] = _score(_kind)
    ORACLE[f"ner_eval_{_kind}"] = _scores_sql(_keys)


@query(f"""WITH {SIDES}, g0 AS (SELECT * FROM g), p0 AS (SELECT * FROM p), {_prf_sql('doc_id, start, "end"', 'label')}
SELECT l.label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(precision, 0.0) AS precision, coalesce(recall, 0.0) AS recall, coalesce(f1, 0.0) AS f1
FROM (SELECT unnest([{', '.join(repr(x) for x in V.LABELS)}]) AS label) l LEFT JOIN f ON f.label = l.label""")
def ner_eval_per_label(spark, sf):
    classes = spark.createDataFrame([(x,) for x in V.LABELS], "label string")
    return metrics.overlap_by_label(*_sides(spark, sf), ["doc_id", "start", "end"], classes)


@query(f"""WITH {SIDES}, u AS (SELECT label, 1 AS a FROM g UNION ALL SELECT label, 0 FROM p)
SELECT coalesce(label, 'TOTAL') AS label, CAST(sum(a) AS BIGINT) AS gold, CAST(sum(1 - a) AS BIGINT) AS pred, CAST(sum(1 - a) - sum(a) AS BIGINT) AS diff FROM u GROUP BY ROLLUP (label)""")
def ner_eval_class_counts(spark, sf):
    return metrics.class_counts(*_sides(spark, sf))


@query(f"""WITH {SIDES} SELECT doc_id, start, label, text FROM (SELECT DISTINCT doc_id, start, label, text FROM g EXCEPT SELECT doc_id, start, label, text FROM p) ORDER BY doc_id, start, label LIMIT 10""")
def ner_eval_errors_top10(spark, sf):
    g, p = (x.select("doc_id", "start", "label", "text") for x in _sides(spark, sf))
    return g.subtract(p).orderBy("doc_id", "start", "label").limit(10)


@query(f"""WITH {SIDES} SELECT 'gold' AS source, g.doc_id, g.start, g."end", g.label, g.text, p.doc_id IS NOT NULL AS match FROM g LEFT JOIN p USING (doc_id, start, "end", label)
UNION ALL SELECT 'pred', p.doc_id, p.start, p."end", p.label, p.text, g.doc_id IS NOT NULL FROM p LEFT JOIN g USING (doc_id, start, "end", label)""")
def ner_eval_rows(spark, sf):
    return P.ner_rows(*_sides(spark, sf))


@query(f"WITH {SIDES}, u AS (SELECT doc_id, start, \"end\", label, text FROM g UNION SELECT doc_id, start, \"end\", label, text FROM p) SELECT doc_id, start, \"end\", label, text FROM u")
def annotator_union(spark, sf):
    g, p = (x.select("doc_id", "start", "end", "label", "text", F.lit(i).alias("annotator")) for i, x in enumerate(_sides(spark, sf)))
    return P.annotator_sets(g.unionByName(p), "union")


@query(f"""WITH {SIDES}, g0 AS (SELECT * FROM g), p0 AS (SELECT * FROM p), {_prf_sql('doc_id, start, "end", label')} SELECT f1 AS iaa_f1 FROM f""")
def iaa_f1(spark, sf):
    return metrics.overlap(*_sides(spark, sf), ["doc_id", "start", "end", "label"]).select(F.col("f1").alias("iaa_f1"))


@query(f"WITH {SIDES}, u AS (SELECT doc_id, start, label, 0 AS side, text FROM g UNION ALL SELECT doc_id, start, label, 1, text || '!' FROM p) SELECT doc_id, start, label, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start, label ORDER BY side) AS n FROM u) WHERE n = 1")
def entity_dedup_first(spark, sf):
    g, p = _sides(spark, sf)
    rows = g.select("doc_id", "start", "label", "text", F.lit(0).alias("side")).unionByName(p.select("doc_id", "start", "label", F.concat("text", F.lit("!")).alias("text"), F.lit(1).alias("side")))
    return matching.first_per(rows, ["doc_id", "start", "label"], ["side"]).drop("side")


# model output


def _outputs(spark, sf):
    part = S.table(spark, sf, "part")
    block = F.concat(F.lit("*   **Concept 1:** "), "p_name", F.lit("\n    *   **Type:** "), "p_type", F.lit("\n    *   **ICD-10 CM Code:** "), F.when(F.col("p_size") % 2 == 0, "N/A").otherwise(F.col("p_size").cast("string")), F.lit("\n    *   **ATC Code:** old\n    *   **ATC Code:** A"), F.col("p_partkey").cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", block.alias("b")))), lambda x: x["b"]), "\n\n")
    files = part.groupBy(F.floor(F.col("p_partkey") / PER_FILE).alias("k")).agg(text.alias("text"))
    return files.select(F.concat(F.lit("cardio_heart failure_"), "k", F.lit("_modelx_NER.txt")).alias("source_file"), F.concat(F.lit("intro\n"), "text").alias("text"))


LLM = f"""blocks AS (SELECT 'cardio_heart failure_' || (p_partkey // {PER_FILE}) || '_modelx_NER.txt' AS source_file, 'cardio' AS specialty, 'heart failure' AS condition, CAST(p_partkey // {PER_FILE} AS VARCHAR) AS note_index, 'modelx' AS model,
  row_number() OVER (PARTITION BY p_partkey // {PER_FILE} ORDER BY p_partkey) AS block, p_name AS concept, p_type AS type, '' AS fhir_mapping, CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS icd10_code, 'A' || p_partkey AS atc_code, '' AS loinc_code, '' AS snomed_code FROM part)"""


@query(f"WITH {LLM} SELECT * FROM blocks")
def llm_concept_blocks(spark, sf):
    return readers.concept_blocks(_outputs(spark, sf))


@query(f"WITH {LLM} SELECT type, count(*) AS n FROM blocks GROUP BY type")
def llm_type_counts(spark, sf):
    return readers.concept_blocks(_outputs(spark, sf)).groupBy("type").agg(F.count("*").alias("n"))


# knowledge base: parts are concepts, line items their names


def _kb(spark, sf):
    li = S.table(spark, sf, "lineitem")
    conso = li.select(F.col("l_partkey").alias("cui"), F.col("l_linestatus").alias("lat"), F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("sab"), F.concat(F.lit("name "), F.col("l_suppkey").cast("string")).alias("str"), F.col("l_returnflag").alias("suppress"))
    types = S.table(spark, sf, "part").select(F.col("p_partkey").alias("cui"), F.col("p_brand").alias("tui"))
    labels = spark.createDataFrame([("disease", "Brand#1"), ("disease", "Brand#2"), ("drug name", "Brand#2"), ("injury", "Brand#5")], "label string, tui string")
    return P.knowledge_base(conso, types, labels, ["S6", "S7"], "F", ["A"])


KB = """lab AS (SELECT * FROM (VALUES ('disease', 'Brand#1'), ('disease', 'Brand#2'), ('drug name', 'Brand#2'), ('injury', 'Brand#5')) AS t(label, tui)),
allowed AS (SELECT DISTINCT l_partkey AS cui FROM lineitem WHERE l_linenumber IN (6, 7)),
kb AS (SELECT DISTINCT lab.label, p.p_partkey AS cui, 'name ' || l.l_suppkey AS name FROM part p JOIN lab ON p.p_brand = lab.tui JOIN lineitem l ON l.l_partkey = p.p_partkey AND l.l_linestatus = 'F' AND l.l_returnflag <> 'A'
  WHERE p.p_partkey IN (SELECT cui FROM allowed))"""


@query(f"WITH {KB} SELECT label, cui, name FROM kb")
def kb_label_synonyms(spark, sf):
    return _kb(spark, sf)


@query(f"WITH {KB} SELECT DISTINCT cui, name FROM kb")
def kb_all(spark, sf):
    return _kb(spark, sf).select("cui", "name").distinct()


@query(f"WITH {KB} SELECT cui FROM allowed")
def kb_allowed_cuis(spark, sf):
    li = S.table(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").alias("cui")).distinct().join(li.filter("l_linenumber IN (6, 7)").select(F.col("l_partkey").alias("cui")), "cui", "left_semi")


# linking by vectors


def _vectors(spark, sf):
    """Queries are the ids that 50 divides; every row is a name."""
    e = S.table(spark, sf, "embeddings")
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec"), "label")
    kb = e.select(F.concat(F.lit("C"), "vec_id").alias("cui"), F.concat(F.lit("name "), F.col("vec_id") % 50).alias("name"), F.col("embedding").alias("vec"), "label")
    return queries, kb


def _topk_sql(by: str) -> str:
    return f"""scored AS (SELECT a.vec_id AS q, {'a.label,' if by else ''} 'C' || b.vec_id AS cui, 'name ' || (b.vec_id % 50) AS name, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 {'AND a.label = b.label' if by else ''}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q {', label' if by else ''} ORDER BY score DESC, name, cui) AS rank FROM scored)"""


@query(f"WITH {_topk_sql('')} SELECT q, cui, name, score, rank FROM ranked WHERE rank <= 5 AND score >= 0.2")
def topk_linking_global(spark, sf):
    queries, kb = _vectors(spark, sf)
    return matching.top_candidates(queries, kb, V.TOP_K, 0.2, digits=4).select("q", "cui", "name", "score", "rank")


@query(f"WITH {_topk_sql('label')} SELECT q, label, cui, name, score, rank FROM ranked WHERE rank <= 5 AND score >= 0.2")
def topk_linking_by_type(spark, sf):
    queries, kb = _vectors(spark, sf)
    return matching.top_candidates(queries, kb, V.TOP_K, 0.2, ["label"], digits=4).select("q", "label", "cui", "name", "score", "rank")


@query(f"WITH {_topk_sql('label')}, kept AS (SELECT * FROM ranked WHERE rank <= 2 AND score >= 0.2) SELECT e.vec_id AS q, " + ", ".join(
    f"coalesce(max(CASE WHEN rank = {n} THEN cui END), '') AS umls_cui_{n}, coalesce(max(CASE WHEN rank = {n} THEN name END), '') AS umls_name_{n}, coalesce(max(CASE WHEN rank = {n} THEN printf('%.4f', score) END), '') AS score_{n}" for n in (1, 2)) + " FROM embeddings e LEFT JOIN kept ON kept.q = e.vec_id WHERE e.vec_id % 50 = 0 GROUP BY e.vec_id")
def topk_wide(spark, sf):
    queries, kb = _vectors(spark, sf)
    return matching.wide_candidates(matching.top_candidates(queries, kb, 2, 0.2, ["label"], digits=4), queries, 2)


# beads and spans


@query(f"WITH {S.PAIRS} SELECT filename, bead_idx, CAST(coalesce(sum(length(source)) OVER (PARTITION BY filename ORDER BY bead_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM pairs")
def bead_cumulative_offsets(spark, sf):
    return matching.bead_offsets(S.pairs(spark, sf), "filename", "bead_idx", "source", "at").select("filename", "bead_idx", "at")


@query(f"""WITH {S.mentions_sql('gold', 'g')}, {S.beads_sql()},
off AS (SELECT *, coalesce(sum(length(bead_text)) OVER (PARTITION BY doc_id ORDER BY bead_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM beads),
m AS (SELECT g.doc_id, g.ent, g.text, bead_idx, row_number() OVER (PARTITION BY g.doc_id, g.ent ORDER BY abs(o - g.start), bead_idx) AS n FROM g JOIN off ON g.doc_id = off.doc_id AND contains(off.bead_text, g.text))
SELECT g.doc_id, g.ent, g.text, m.bead_idx FROM g LEFT JOIN m ON m.doc_id = g.doc_id AND m.ent = g.ent AND m.n = 1""")
def entity_to_bead_nearest(spark, sf):
    ents = S.mentions(spark, sf, "gold").withColumn("id", F.struct("doc_id", "ent")).withColumn("start_span", F.col("start").cast("string"))
    beads = matching.bead_offsets(S.beads(spark, sf), "doc_id", "bead_idx", "bead_text", "at")
    return matching.nearest_bead(ents, beads, "doc_id", "text", "start_span", "bead_text", "bead_idx", "at").select("doc_id", "ent", "text", "bead_idx")


@query(f"WITH {S.mentions_sql('gold', 'g')}, {S.beads_sql()} SELECT g.doc_id, g.ent, b.bead_idx FROM g JOIN beads b ON g.doc_id = b.doc_id AND g.start >= b.span_start AND g.start < b.span_end")
def entity_in_bead_span(spark, sf):
    return matching.in_span(S.mentions(spark, sf, "gold"), S.beads(spark, sf).drop("bead_text"), ["doc_id"], "start").select("doc_id", "ent", "bead_idx")


RELS = f"{S.mentions_sql('gold', 's_m')}, {S.mentions_sql('pred', 'h_m')}, {S.linked_sql('gold', 's')}, {S.linked_sql('pred', 'h')}, {S.relations_sql('gold', 'sr', 's_m')}, {S.relations_sql('pred', 'hr', 'h_m')}"


@query(f"WITH {RELS}, {S.beads_sql()} SELECT r.doc_id, r.id, b.bead_idx FROM sr r JOIN beads b ON r.doc_id = b.doc_id AND r.s_start >= b.span_start AND r.s_start < b.span_end AND r.o_start >= b.span_start AND r.o_start < b.span_end")
def relation_in_bead_span(spark, sf):
    held = matching.in_span(S.relations(spark, sf, "gold"), S.beads(spark, sf).drop("bead_text"), ["doc_id"], "s_start")
    return held.filter((F.col("o_start") >= F.col("span_start")) & (F.col("o_start") < F.col("span_end"))).select("doc_id", "id", "bead_idx")


@query(f"WITH {RELS}, u AS (SELECT doc_id, start, \"end\", cui, id FROM s WHERE cui IS NOT NULL UNION ALL SELECT doc_id, start, \"end\", cui || 'x', id + 1 FROM h WHERE cui IS NOT NULL) SELECT doc_id, start, \"end\", arg_max(cui, id) AS cui FROM u GROUP BY doc_id, start, \"end\"")
def span_cui_map_last_wins(spark, sf):
    a = S.linked(spark, sf, "gold").filter("cui IS NOT NULL")
    b = S.linked(spark, sf, "pred").filter("cui IS NOT NULL").withColumn("cui", F.concat("cui", F.lit("x"))).withColumn("id", F.col("id") + 1)
    return matching.last_per_span(a.unionByName(b), ["doc_id", "start", "end"], "cui", "id")


@query(f"""WITH {RELS} SELECT DISTINCT r.doc_id, a.cui AS s_cui, r.relation, b.cui AS o_cui FROM sr r
JOIN s a ON a.doc_id = r.doc_id AND a.start = r.s_start AND a."end" = r.s_end AND a.cui IS NOT NULL JOIN s b ON b.doc_id = r.doc_id AND b.start = r.o_start AND b."end" = r.o_end AND b.cui IS NOT NULL""")
def relation_triples_resolved(spark, sf):
    return P.resolved_triples(S.relations(spark, sf, "gold"), S.linked(spark, sf, "gold"))


@query(f"""WITH {RELS} SELECT r.doc_id, r.id, a.text || ' [' || r.relation || '] ' || b.text AS rel_text FROM sr r
JOIN s a ON a.doc_id = r.doc_id AND a.start = r.s_start AND a."end" = r.s_end JOIN s b ON b.doc_id = r.doc_id AND b.start = r.o_start AND b."end" = r.o_end""")
def relation_texts(spark, sf):
    return P.relation_texts(S.relations(spark, sf, "gold"), S.linked(spark, sf, "gold"))


def _cascade_sql(a: str, b: str, out: str = "") -> str:
    """Two passes over (doc_id, id, by_cui, by_text), as the rows of the query or, with a name for it, as one more table."""
    def one(n: int, key: str, src: str, hyp: str, kind: str) -> str:
        rank = lambda t: f"(SELECT doc_id, id, {key} AS k, row_number() OVER (PARTITION BY doc_id, {key} ORDER BY id) AS rn FROM {t} WHERE {key} IS NOT NULL)"
        return f"""{out}k{n} AS (SELECT DISTINCT x.doc_id, x.{key} AS k FROM {src} x JOIN {hyp} y ON x.doc_id = y.doc_id AND x.{key} = y.{key}),
{out}m{n} AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, x.id AS src_id, y.id AS hyp_id, '{kind}' AS match_type FROM {rank(src)} x FULL JOIN {rank(hyp)} y ON x.doc_id = y.doc_id AND x.k = y.k AND x.rn = y.rn
  WHERE (coalesce(x.doc_id, y.doc_id), coalesce(x.k, y.k)) IN (SELECT doc_id, k FROM {out}k{n})),
{out}a{n} AS (SELECT * FROM {src} WHERE id NOT IN (SELECT src_id FROM {out}m{n} WHERE src_id IS NOT NULL)), {out}b{n} AS (SELECT * FROM {hyp} WHERE id NOT IN (SELECT hyp_id FROM {out}m{n} WHERE hyp_id IS NOT NULL))"""

    rows = f"SELECT * FROM {out}m1 UNION ALL SELECT * FROM {out}m2 UNION ALL SELECT doc_id, id, NULL, 'none' FROM {out}a2 UNION ALL SELECT doc_id, NULL, id, 'none' FROM {out}b2"
    return f"{one(1, 'by_cui', a, b, 'CUI')}, {one(2, 'by_text', out + 'a1', out + 'b1', 'text')}" + (f", {out} AS ({rows})" if out else f"\n{rows}")


@query(f"WITH {RELS}, a0 AS (SELECT doc_id, id, '|cui:' || cui AS by_cui, '|text:' || lower(text) AS by_text FROM s), b0 AS (SELECT doc_id, id, '|cui:' || cui AS by_cui, '|text:' || lower(text) AS by_text FROM h), {_cascade_sql('a0', 'b0')}")
def entity_match_cascade(spark, sf):
    return P.entity_matches(S.linked(spark, sf, "gold"), S.linked(spark, sf, "pred"), ["doc_id"])


def _rel_keys(rel: str, ent: str) -> str:
    return f"""(SELECT r.doc_id, r.id, CASE WHEN a.cui IS NOT NULL AND b.cui IS NOT NULL THEN r.relation || '|cui:' || a.cui || '|cui:' || b.cui END AS by_cui, r.relation || '|text:' || lower(a.text) || '|text:' || lower(b.text) AS by_text
FROM {rel} r LEFT JOIN {ent} a ON a.doc_id = r.doc_id AND a.start = r.s_start LEFT JOIN {ent} b ON b.doc_id = r.doc_id AND b.start = r.o_start)"""


@query(f"WITH {RELS}, a0 AS {_rel_keys('sr', 's')}, b0 AS {_rel_keys('hr', 'h')}, {_cascade_sql('a0', 'b0')}")
def relation_match_cascade(spark, sf):
    return P.relation_matches(S.relations(spark, sf, "gold"), S.relations(spark, sf, "pred"), S.linked(spark, sf, "gold"), S.linked(spark, sf, "pred"), ["doc_id"])


#: The beads of documents as sentence alignment would give them, with gaps between.
GAPPED = f"{S.beads_sql()}, gapped AS (SELECT doc_id, bead_idx, substr(bead_text, 1, 300) AS bead_text, span_start, least(span_end, span_start + 300) AS span_end FROM beads), gapped_h AS (SELECT doc_id, bead_idx, substr(bead_text, {S.SHIFT} + 1, 300 - {S.SHIFT}) AS bead_text, least(span_start + {S.SHIFT}, span_end, span_start + 300) AS span_start, least(span_end, span_start + 300) AS span_end FROM beads)"


@query(f"WITH {RELS}, {GAPPED} SELECT s.doc_id, s.id FROM s WHERE NOT EXISTS (SELECT 1 FROM gapped b WHERE b.doc_id = s.doc_id AND s.start >= b.span_start AND s.start < b.span_end)")
def unaligned_entities(spark, sf):
    ents, beads = S.linked(spark, sf, "gold"), S.aligned_beads(spark, sf)
    return matching.outside(ents, C.held_rows(beads, ents, "src"), "id").select("doc_id", "id")


# document alignment


def _held_sql(t: str, inside: str) -> str:
    return f"{t}_in AS (SELECT x.*, b.bead_idx FROM {t} x JOIN {'gapped_h' if t[0] == 'h' else 'gapped'} b ON b.doc_id = x.doc_id AND {inside})"


ENTITY_IN = "x.start >= b.span_start AND x.start < b.span_end"
RELATION_IN = "x.s_start >= b.span_start AND x.s_start < b.span_end AND x.o_start >= b.span_start AND x.o_start < b.span_end"
HELD = ", ".join(_held_sql(t, ENTITY_IN) for t in ("s", "h"))
HELD_RELATIONS = ", ".join(_held_sql(t, RELATION_IN) for t in ("sr", "hr"))
BOTH = "both_docs AS (SELECT DISTINCT doc_id FROM s INTERSECT SELECT DISTINCT doc_id FROM h)"
ENTITY_KEYS = ", ".join(f"{n} AS (SELECT doc_id || '#' || bead_idx AS doc_id, id, '|cui:' || cui AS by_cui, '|text:' || lower(text) AS by_text FROM {t}_in WHERE doc_id IN (SELECT doc_id FROM both_docs))" for n, t in (("a0", "s"), ("b0", "h")))
PARTED = "CAST(split_part(doc_id, '#', 1) AS BIGINT) AS doc_id, CAST(nullif(split_part(doc_id, '#', 2), '') AS BIGINT) AS bead_idx, src_id, hyp_id, match_type"


def _alone_sql(t: str, columns: str) -> str:
    return f"SELECT doc_id, NULL, {columns}, 'none' FROM {t} WHERE id NOT IN (SELECT id FROM {t}_in) AND doc_id IN (SELECT doc_id FROM both_docs)"


@query(f"""WITH {RELS}, {GAPPED}, {HELD}, {BOTH}, {ENTITY_KEYS}, {_cascade_sql('a0', 'b0', 'inside')},
met AS (SELECT {PARTED} FROM inside UNION ALL {_alone_sql('s', 'id, NULL')} UNION ALL {_alone_sql('h', 'NULL, id')})
SELECT met.doc_id, met.bead_idx, length(g.bead_text) AS n_src, length(k.bead_text) AS n_hyp, match_type, src_id, s.cui AS src_cui, s.text AS src_text, hyp_id, h.cui AS hyp_cui, h.text AS hyp_text
FROM met LEFT JOIN gapped g ON g.doc_id = met.doc_id AND g.bead_idx = met.bead_idx LEFT JOIN gapped_h k ON k.doc_id = met.doc_id AND k.bead_idx = met.bead_idx LEFT JOIN s ON s.id = met.src_id LEFT JOIN h ON h.id = met.hyp_id""")
def document_alignment_entities(spark, sf):
    rows = C.aligned_entities(S.aligned_beads(spark, sf), S.linked(spark, sf, "gold"), S.linked(spark, sf, "pred"))
    return rows.select("doc_id", "bead_idx", F.length("bead_src").alias("n_src"), F.length("bead_hyp").alias("n_hyp"), "match_type", "src_id", "src_cui", "src_text", "hyp_id", "hyp_cui", "hyp_text")


def _relation_keys_sql(name: str, rel: str, ent: str, inside: bool) -> str:
    scope, rows = ("r.doc_id || '#' || r.bead_idx", f"{rel}_in r") if inside else ("CAST(r.doc_id AS VARCHAR)", f"(SELECT * FROM {rel} WHERE id NOT IN (SELECT id FROM {rel}_in)) r")
    return f"""{name} AS (SELECT {scope} AS doc_id, r.id, CASE WHEN a.cui IS NOT NULL AND b.cui IS NOT NULL THEN r.relation || '|cui:' || a.cui || '|cui:' || b.cui END AS by_cui, r.relation || '|text:' || lower(a.text) || '|text:' || lower(b.text) AS by_text
FROM {rows} LEFT JOIN {ent} a ON a.doc_id = r.doc_id AND a.start = r.s_start LEFT JOIN {ent} b ON b.doc_id = r.doc_id AND b.start = r.o_start WHERE r.doc_id IN (SELECT doc_id FROM both_docs))"""


def _sides_sql(rel: str, ent: str, p: str) -> str:
    return f"LEFT JOIN {rel} ON {rel}.id = met.{p}_id LEFT JOIN {ent} {p}_s ON {p}_s.doc_id = {rel}.doc_id AND {p}_s.start = {rel}.s_start LEFT JOIN {ent} {p}_o ON {p}_o.doc_id = {rel}.doc_id AND {p}_o.start = {rel}.o_start"


@query(f"""WITH {RELS}, {GAPPED}, {HELD_RELATIONS}, {BOTH}, {_relation_keys_sql('a0', 'sr', 's', True)}, {_relation_keys_sql('b0', 'hr', 'h', True)}, {_relation_keys_sql('c0', 'sr', 's', False)}, {_relation_keys_sql('d0', 'hr', 'h', False)},
{_cascade_sql('a0', 'b0', 'inside')}, {_cascade_sql('c0', 'd0', 'outer')}, met AS (SELECT {PARTED} FROM inside UNION ALL SELECT {PARTED} FROM outer)
SELECT met.doc_id, met.bead_idx, match_type AS subject_match_type, match_type AS object_match_type, CASE match_type WHEN 'none' THEN 'none' ELSE 'text' END AS relation_match_type,
  src_id, sr.relation AS src_relation, src_s.cui AS src_subject_cui, src_o.cui AS src_object_cui, hyp_id, hr.relation AS hyp_relation, hyp_s.cui AS hyp_subject_cui, hyp_o.cui AS hyp_object_cui, hyp_s.text AS hyp_subject_text, hyp_o.text AS hyp_object_text
FROM met {_sides_sql('sr', 's', 'src')} {_sides_sql('hr', 'h', 'hyp')}""".replace("outer", "around"))
def document_alignment_relations(spark, sf):
    rows = C.aligned_relations(S.aligned_beads(spark, sf), S.relations(spark, sf, "gold"), S.relations(spark, sf, "pred"), S.linked(spark, sf, "gold"), S.linked(spark, sf, "pred"))
    columns = [f"{p}_{c}" for p in ("src", "hyp") for c in ("id", "relation", "subject_cui", "object_cui")]
    return rows.select("doc_id", "bead_idx", "subject_match_type", "object_match_type", "relation_match_type", *columns, "hyp_subject_text", "hyp_object_text")


def _sets_sql(name: str, rows: str, keys: str, docs: str) -> str:
    """Rounded scores and sizes of distinct key sets, for the documents of ``docs``."""
    return f"""{name} AS (SELECT doc_id, tp, n_src, n_hyp, CASE WHEN n_hyp > 0 THEN tp / n_hyp ELSE 0.0 END AS p, CASE WHEN n_src > 0 THEN tp / n_src ELSE 0.0 END AS r FROM (
  SELECT d.doc_id, CAST(coalesce(sum(x * y), 0) AS BIGINT) AS tp, CAST(coalesce(sum(x), 0) AS BIGINT) AS n_src, CAST(coalesce(sum(y), 0) AS BIGINT) AS n_hyp FROM {docs} d LEFT JOIN (
  SELECT doc_id, {keys}, max(x) AS x, max(y) AS y FROM {rows} GROUP BY doc_id, {keys}) k ON k.doc_id = d.doc_id GROUP BY d.doc_id))"""


def _cover_sql(name: str, src: str, hyp: str, key: str) -> str:
    """Shares of rows whose key the other side has, for documents with rows on both sides."""
    share = lambda a, b: f"(SELECT x.doc_id, avg(CASE WHEN (x.doc_id, x.{key}) IN (SELECT doc_id, {key} FROM {b}) THEN 1.0 ELSE 0.0 END) AS v FROM {a} x GROUP BY x.doc_id)"
    return f"{name} AS (SELECT h.doc_id, h.v AS p, s.v AS r FROM {share(hyp, src)} h JOIN {share(src, hyp)} s ON s.doc_id = h.doc_id)"


def _three_sql(t: str, prefix: str) -> str:
    f1 = f"CASE WHEN {t}.p + {t}.r > 0 THEN 2 * {t}.p * {t}.r / ({t}.p + {t}.r) ELSE {t}.p + {t}.r END"
    return f"round({t}.p, 5) AS {prefix}_precision, round({t}.r, 5) AS {prefix}_recall, round({f1}, 5) AS {prefix}_f1"


def _told_sql(name: str, rel: str, ent: str) -> str:
    """Triples by concept and, as words in any order, by text."""
    return f"""{name} AS (SELECT r.doc_id, a.cui AS s_cui, r.relation, b.cui AS o_cui, r.relation || ' ' || least(a.text, b.text) || ' ' || greatest(a.text, b.text) AS words
FROM {rel}_in r JOIN {ent}_in a ON a.doc_id = r.doc_id AND a.start = r.s_start JOIN {ent}_in b ON b.doc_id = r.doc_id AND b.start = r.o_start)"""


@query(f"""WITH {RELS}, {GAPPED}, {HELD}, {HELD_RELATIONS}, known AS (SELECT DISTINCT doc_id FROM s_in INTERSECT SELECT DISTINCT doc_id FROM h_in), related AS (SELECT DISTINCT doc_id FROM sr_in INTERSECT SELECT DISTINCT doc_id FROM hr_in),
cuis AS (SELECT doc_id, cui, 1 AS x, 0 AS y FROM s_in WHERE cui IS NOT NULL UNION ALL SELECT doc_id, cui, 0, 1 FROM h_in WHERE cui IS NOT NULL), {_told_sql('st', 'sr', 's')}, {_told_sql('ht', 'hr', 'h')},
triples AS (SELECT doc_id, s_cui, relation, o_cui, 1 AS x, 0 AS y FROM st WHERE s_cui IS NOT NULL AND o_cui IS NOT NULL UNION ALL SELECT doc_id, s_cui, relation, o_cui, 0, 1 FROM ht WHERE s_cui IS NOT NULL AND o_cui IS NOT NULL),
{_sets_sql('e', 'cuis', 'cui', 'known')}, {_sets_sql('t', 'triples', 's_cui, relation, o_cui', 'related')}, {_cover_sql('em', 's_in', 'h_in', 'text')}, {_cover_sql('re', 'st', 'ht', 'words')}
SELECT e.doc_id, {_three_sql('e', 'kg_entity')}, e.n_src AS kg_n_src_entities, e.n_hyp AS kg_n_hyp_entities, {_three_sql('t', 'kg_rel')}, t.n_src AS kg_n_src_relations, t.n_hyp AS kg_n_hyp_relations, {_three_sql('em', 'kg_embed')}, {_three_sql('re', 'kg_rel_embed')}
FROM e LEFT JOIN t ON t.doc_id = e.doc_id LEFT JOIN em ON em.doc_id = e.doc_id LEFT JOIN re ON re.doc_id = e.doc_id""")
def concept_scores(spark, sf):
    """The 17 concept columns but the combined one, on what the beads hold; texts are compared by their words."""
    beads = cut(S.aligned_beads(spark, sf).drop("source", "hypothesis"))
    ents = [C.scored_rows(beads, S.linked(spark, sf, which), side) for which, side in (("gold", "src"), ("pred", "hyp"))]
    rels = [C.scored_rows(beads, S.relations(spark, sf, which), side) for which, side in (("gold", "src"), ("pred", "hyp"))]
    return P.concept_scores(*ents, B.TokenOverlap(), *rels).drop("kg_f1")


@query(f"WITH {RELS}, t AS (SELECT DISTINCT r.doc_id FROM sr r JOIN s a ON a.doc_id = r.doc_id AND a.start = r.s_start AND a.cui IS NOT NULL JOIN s b ON b.doc_id = r.doc_id AND b.start = r.o_start AND b.cui IS NOT NULL) SELECT (SELECT count(*) FROM t) AS with_triples, (SELECT count(DISTINCT doc_id) FROM sr) AS documents")
def documents_with_triples(spark, sf):
    relations = S.relations(spark, sf, "gold")
    return P.documents_with_triples(P.resolved_triples(relations, S.linked(spark, sf, "gold")), relations)


# greedy matching: the mentions of a bead, gold against pred, the nearer the better


def _candidates(spark, sf, same=False):
    beads = S.beads(spark, sf).drop("bead_text")
    held = lambda side: matching.in_span(S.mentions(spark, sf, side), beads, ["doc_id"], "start")
    a = held("gold").select("doc_id", "bead_idx", F.col("ent").alias("i"), F.col("label").alias("la"))
    b = held("pred").select("doc_id", "bead_idx", F.col("ent").alias("j"), F.col("label").alias("lb"))
    met = a.join(b, ["doc_id", "bead_idx"])
    met = met.filter("la = lb") if same else met
    return a, b, met.withColumn("score", F.round(10 / (10 + F.abs(F.col("i") - F.col("j"))), 4)).filter("score >= 0.25").select("doc_id", "bead_idx", "i", "j", "score")


def _greedy_from(candidates: str, scope: str = "doc_id, bead_idx") -> str:
    """Tables k (numbered candidates), w (the walk over them) and pairs, over ``c(scope, i, j, score)``."""
    first, rest = scope.split(", ")
    return f"""{candidates},
k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY score DESC, i DESC, j DESC) AS n FROM c),
w AS (SELECT {scope}, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS mi, CAST([] AS BIGINT[]) AS mj, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST(NULL AS DOUBLE) AS score FROM (SELECT DISTINCT {scope} FROM k)
  UNION ALL SELECT k.{first}, k.{rest}, k.n, CASE WHEN ok THEN list_append(mi, k.i) ELSE mi END, CASE WHEN ok THEN list_append(mj, k.j) ELSE mj END, CASE WHEN ok THEN k.i END, CASE WHEN ok THEN k.j END, CASE WHEN ok THEN k.score END
  FROM w JOIN k ON k.{first} = w.{first} AND k.{rest} = w.{rest} AND k.n = w.n + 1, LATERAL (SELECT NOT list_contains(w.mi, k.i) AND NOT list_contains(w.mj, k.j) AS ok) t),
pairs AS (SELECT {scope}, i, j, score FROM w WHERE i IS NOT NULL)"""


def _near_sql(same: bool) -> str:
    held = ", ".join(f"{n} AS (SELECT x.doc_id, b.bead_idx, x.ent AS {k}, x.label FROM {t} x JOIN beads b ON b.doc_id = x.doc_id AND {ENTITY_IN})" for n, k, t in (("a", "i", "g"), ("b", "j", "p")))
    return f"""{SIDES}, {S.beads_sql()}, {held},
c AS (SELECT * FROM (SELECT a.doc_id, a.bead_idx, i, j, round(10 / (10 + abs(i - j)), 4) AS score FROM a JOIN b ON a.doc_id = b.doc_id AND a.bead_idx = b.bead_idx {'AND a.label = b.label' if same else ''}) WHERE score >= 0.25)"""


@query(f"WITH RECURSIVE {_greedy_from(_near_sql(False))} SELECT doc_id, bead_idx, i, j, score FROM pairs")
def greedy_matches(spark, sf):
    return matching.greedy_pairs(_candidates(spark, sf)[2], ["doc_id", "bead_idx"])


@query(f"WITH RECURSIVE {_greedy_from(_near_sql(True))} SELECT doc_id, bead_idx, i, j, score FROM pairs")
def greedy_matches_same_label(spark, sf):
    return matching.greedy_pairs(_candidates(spark, sf, True)[2], ["doc_id", "bead_idx"])


@query(f"WITH RECURSIVE {_greedy_from(_near_sql(True))} SELECT (SELECT count(*) FROM pairs) AS matched, (SELECT count(*) FROM a) - (SELECT count(*) FROM pairs) AS unmatched_src, (SELECT count(*) FROM b) - (SELECT count(*) FROM pairs) AS unmatched_hyp")
def match_counters(spark, sf):
    a, b, c = _candidates(spark, sf, True)
    scope = ["doc_id", "bead_idx"]
    return P.match_counts(matching.with_singletons(matching.greedy_pairs(c, scope), a, b, scope))


# cross-lingual matching: vectors of letters


def _letters_sql(c: str) -> str:
    return f"list_transform(range(97, 123), lambda k: CAST(length({c}) - length(replace({c}, chr(CAST(k AS INTEGER)), '')) AS DOUBLE))"


#: Distinct words with their unit vectors of letters.
LETTERS = f"""words AS (SELECT DISTINCT text FROM g UNION SELECT DISTINCT text FROM p), counted AS (SELECT text, {_letters_sql('text')} AS v FROM words),
vectors AS (SELECT text, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM counted WHERE list_dot_product(v, v) > 0),
alike AS (SELECT x.text AS s, y.text AS h, list_dot_product(x.v, y.v) AS score FROM vectors x, vectors y WHERE round(list_dot_product(x.v, y.v), 6) >= 0.85)"""


def _cross_sql(held: str, label: str) -> str:
    return f"""{SIDES}, {S.beads_sql()}, {LETTERS}, {held},
c AS (SELECT a.doc_id, a.bead_idx, i, j, round(score, 6) AS score FROM a JOIN b ON a.doc_id = b.doc_id AND a.bead_idx = b.bead_idx {label} JOIN alike ON alike.s = a.text AND alike.h = b.text)"""


HELD_SIDES = ", ".join(f"{n} AS (SELECT x.doc_id, b.bead_idx, x.ent AS {k}, x.label, x.text FROM {t} x JOIN beads b ON b.doc_id = x.doc_id AND {ENTITY_IN})" for n, k, t in (("a", "i", "g"), ("b", "j", "p")))


@query(f"""WITH RECURSIVE {_greedy_from(_cross_sql(HELD_SIDES, 'AND a.label = b.label'))}
SELECT CAST(doc_id AS VARCHAR) AS filename, bead_idx, i, j, round(score, 4) AS score FROM pairs
UNION ALL SELECT CAST(doc_id AS VARCHAR), bead_idx, i, NULL, 0.0 FROM a WHERE (doc_id, bead_idx, i) NOT IN (SELECT doc_id, bead_idx, i FROM pairs)
UNION ALL SELECT CAST(doc_id AS VARCHAR), bead_idx, NULL, j, 0.0 FROM b WHERE (doc_id, bead_idx, j) NOT IN (SELECT doc_id, bead_idx, j FROM pairs)""")
def cross_lingual_matching(spark, sf):
    beads = S.beads(spark, sf).drop("bead_text")
    def side(name, row):
        held = matching.in_span(S.mentions(spark, sf, name), beads, ["doc_id"], "start")
        return held.select(F.col("doc_id").cast("string").alias("filename"), "bead_idx", F.col("ent").alias(row), "label", "text")
    rows = P.cross_lingual_matches(side("gold", "i"), side("pred", "j"), B.LetterCounts(), same_label=True, digits=6)
    return rows.withColumn("score", F.round("score", 4))


def _nearest_sql(n: str, row: str, t: str, off: str) -> str:
    return f"""{n} AS (SELECT x.doc_id, coalesce(m.bead_idx, -1) AS bead_idx, x.ent AS {row}, x.label, x.text, x.start, x."end" FROM {t} x LEFT JOIN (
  SELECT x.doc_id, x.ent, o.bead_idx, row_number() OVER (PARTITION BY x.doc_id, x.ent ORDER BY abs(o.o - x.start), o.bead_idx) AS n FROM {t} x JOIN {off} o ON o.doc_id = x.doc_id AND contains(o.bead_text, x.text)) m ON m.doc_id = x.doc_id AND m.ent = x.ent AND m.n = 1)"""


OFFSET = "coalesce(sum(length(bead_text)) OVER (PARTITION BY doc_id ORDER BY bead_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o"
NEAREST = f"""off AS (SELECT *, {OFFSET} FROM beads), shifted AS (SELECT doc_id, bead_idx, substr(bead_text, {S.SHIFT} + 1) AS bead_text FROM beads), off_h AS (SELECT *, {OFFSET} FROM shifted),
{_nearest_sql('a', 'i', 'g', 'off')}, {_nearest_sql('b', 'j', 'p', 'off_h')}"""


@query(f"""WITH RECURSIVE {_greedy_from(_cross_sql(NEAREST, ''))},
met AS (SELECT doc_id, bead_idx, i, j, score FROM pairs UNION ALL SELECT doc_id, bead_idx, i, NULL, 0.0 FROM a WHERE (doc_id, bead_idx, i) NOT IN (SELECT doc_id, bead_idx, i FROM pairs)
  UNION ALL SELECT doc_id, bead_idx, NULL, j, 0.0 FROM b WHERE (doc_id, bead_idx, j) NOT IN (SELECT doc_id, bead_idx, j FROM pairs))
SELECT 'doc_' || met.doc_id || '.txt' AS filename, CASE WHEN met.bead_idx > 0 THEN CAST(met.bead_idx AS VARCHAR) ELSE '' END AS bead_idx, coalesce(t.bead_text, '') AS bead_src, coalesce(k.bead_text, '') AS bead_hyp,
  coalesce(a.label, '') AS src_entity_label, coalesce(CAST(a.start AS VARCHAR), '') AS src_start_span, coalesce(CAST(a."end" AS VARCHAR), '') AS src_end_span, coalesce(a.text, '') AS src_text,
  coalesce(b.label, '') AS hyp_entity_label, coalesce(CAST(b.start AS VARCHAR), '') AS hyp_start_span, coalesce(CAST(b."end" AS VARCHAR), '') AS hyp_end_span, coalesce(b.text, '') AS hyp_text, '' AS hyp_translated_text,
  CASE WHEN met.i IS NOT NULL AND met.j IS NOT NULL THEN printf('%.4f', met.score) ELSE '' END AS sapbert_similarity, CASE WHEN met.i IS NOT NULL AND met.j IS NOT NULL THEN 'sapbert' ELSE 'none' END AS match_type
FROM met LEFT JOIN a ON a.doc_id = met.doc_id AND a.bead_idx = met.bead_idx AND a.i = met.i LEFT JOIN b ON b.doc_id = met.doc_id AND b.bead_idx = met.bead_idx AND b.j = met.j LEFT JOIN beads t ON t.doc_id = met.doc_id AND t.bead_idx = met.bead_idx LEFT JOIN shifted k ON k.doc_id = met.doc_id AND k.bead_idx = met.bead_idx""")
def entity_match_rows(spark, sf):
    """The match file of every document; predictions carry names without an extension."""
    name = lambda end: F.concat(F.lit("doc_"), "doc_id", F.lit(end)).alias("filename")
    beads = S.beads(spark, sf).select(name(".txt"), "bead_idx", F.col("bead_text").alias("source"), F.expr(f"substr(bead_text, {S.SHIFT} + 1)").alias("hypothesis"))
    side = lambda which, end: S.mentions(spark, sf, which).select(name(end), "ent", F.col("label").alias("entity_label"), F.col("start").cast("string").alias("start_span"), F.col("end").cast("string").alias("end_span"), "text")
    return C.entity_match_rows(beads, side("gold", ".txt"), side("pred", ""), B.LetterCounts(), digits=6)


# relations

REL_ROWS = ", ".join(f"({k}, '{n}', '{s}', '{o}', '{V.TEMPLATES['en'][n]}')" for k, (n, ss, oo) in enumerate(V.RELATIONS) for s in ss for o in oo)
CAND = f"""{S.mentions_sql('gold', 'g')}, rel AS (SELECT * FROM (VALUES {REL_ROWS}) AS t(seq, relation, sl, ol, tpl)),
cand AS (SELECT a.doc_id, a.ent AS s_ent, b.ent AS o_ent, seq, relation, tpl, a.text AS st, b.text AS ot, greatest(a.start, b.start) - least(a."end", b."end") AS gap
  FROM g a JOIN rel ON a.label = sl JOIN g b ON b.doc_id = a.doc_id AND b.label = ol AND b.ent <> a.ent WHERE greatest(a.start, b.start) - least(a."end", b."end") <= {V.MAX_DISTANCE})"""


def _pairs(spark, sf):
    table = matching.relation_table(spark, V.RELATIONS, V.TEMPLATES["en"])
    ents = S.mentions(spark, sf, "gold")
    return table, ents, matching.band_pairs(ents.select("doc_id", "ent", "label", "start", "end"), "doc_id", table, V.MAX_DISTANCE)


@query(f"WITH {CAND} SELECT doc_id, s_ent, o_ent, relation, gap FROM cand")
def relation_candidates(spark, sf):
    return _pairs(spark, sf)[2].select("doc_id", "s_ent", "o_ent", "relation", "gap")


def _filled(spark, sf):
    table, ents, pairs = _pairs(spark, sf)
    own = lambda p: ents.select("doc_id", F.col("ent").alias(f"{p}_ent"), F.col("text").alias(f"{p}_text"))
    rows = pairs.join(F.broadcast(table.select("seq", "head", "middle", "tail").distinct()), "seq").join(own("s"), ["doc_id", "s_ent"]).join(own("o"), ["doc_id", "o_ent"])
    return rows.withColumn("hypothesis", matching.hypothesis(F.col("s_text"), F.col("o_text")))


@query(f"WITH {CAND} SELECT doc_id, s_ent, o_ent, relation, replace(replace(tpl, '{{subject}}', st), '{{object}}', ot) AS hypothesis FROM cand")
def relation_hypotheses(spark, sf):
    return _filled(spark, sf).select("doc_id", "s_ent", "o_ent", "relation", "hypothesis")


@query(f"WITH {CAND}, sc AS (SELECT *, (length(relation) * 7 + abs(gap)) % 5 / 5.0 AS score FROM cand) SELECT doc_id, s_ent, o_ent, relation, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s_ent, o_ent ORDER BY score DESC, seq) AS n FROM sc WHERE score >= 0.4) WHERE n = 1")
def relation_argmax(spark, sf):
    scored = _pairs(spark, sf)[2].withColumn("score", ((F.length("relation") * 7 + F.abs("gap")) % 5) / 5.0)
    return matching.best_relation(scored, "doc_id", 0.4).select("doc_id", "s_ent", "o_ent", "relation", "score")


#: Contexts as ``alignment.context_bounds`` has them, over the stretches of each text.
WINDOWED = f"""marked AS (SELECT doc_id, text, regexp_replace(text, '([.!?])(\\s+)|(\\n+)', '\\1\\2\\3' || chr(1), 'g') AS t FROM documents WHERE text <> ''),
pieces AS (SELECT doc_id, unnest(list_filter(string_split(t, chr(1)), lambda x: x <> '')) AS x, generate_subscripts(list_filter(string_split(t, chr(1)), lambda x: x <> ''), 1) AS i FROM marked),
spans AS (SELECT doc_id, i, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS lo, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS hi FROM pieces),
placed AS (SELECT DISTINCT doc_id, least(a_start, b_start) AS low, greatest(a_end, b_end) AS high FROM cand),
whole AS (SELECT p.doc_id, low, high, coalesce(min(s.lo) FILTER (WHERE s.lo <= low AND low < s.hi), low) AS x, coalesce(min(s.hi) FILTER (WHERE s.lo < high AND high <= s.hi), high) AS y FROM placed p LEFT JOIN spans s ON s.doc_id = p.doc_id GROUP BY p.doc_id, low, high),
one AS (SELECT w.doc_id, low, high, y, coalesce(min(s.lo) FILTER (WHERE s.hi = x AND y - s.lo <= {V.MAX_CONTEXT} AND y - x < {V.MAX_CONTEXT}), x) AS b, y - x < {V.MAX_CONTEXT} AS grows FROM whole w LEFT JOIN spans s ON s.doc_id = w.doc_id GROUP BY w.doc_id, low, high, x, y),
after AS (SELECT o.doc_id, low, high, b, grows, greatest(y, coalesce(max(s.hi) FILTER (WHERE grows AND s.lo >= y AND s.hi - b <= {V.MAX_CONTEXT}), y)) AS z FROM one o LEFT JOIN spans s ON s.doc_id = o.doc_id GROUP BY o.doc_id, low, high, b, grows, y),
cuts AS (SELECT a.doc_id, low, high, z, least(b, coalesce(min(s.lo) FILTER (WHERE grows AND s.hi <= b AND z - s.lo <= {V.MAX_CONTEXT}), b)) AS v FROM after a LEFT JOIN spans s ON s.doc_id = a.doc_id GROUP BY a.doc_id, low, high, b, z, grows),
ctx AS (SELECT c.doc_id, low, high, regexp_extract_all(lower(substr(d.text, CAST(v AS BIGINT) + 1, CAST(z - v AS BIGINT))), '[\\p{{L}}\\p{{N}}_]+') AS have FROM cuts c JOIN documents d ON d.doc_id = c.doc_id)"""


@query(f"""WITH {CAND.replace("a.text AS st, b.text AS ot", "a.text AS st, b.text AS ot, a.label AS al, b.label AS bl, a.start AS a_start, a." + '"end"' + " AS a_end, b.start AS b_start, b." + '"end"' + " AS b_end")}, {WINDOWED},
asked AS (SELECT cand.*, have, regexp_extract_all(lower(replace(replace(tpl, '{{subject}}', st), '{{object}}', ot)), '[\\p{{L}}\\p{{N}}_]+') AS want FROM cand JOIN ctx ON ctx.doc_id = cand.doc_id AND low = least(a_start, b_start) AND high = greatest(a_end, b_end)),
scored AS (SELECT *, len(list_filter(want, lambda w: list_contains(have, w))) / len(want) AS score FROM asked),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, a_start, a_end, b_start, b_end ORDER BY score DESC, s_ent, o_ent, seq) AS n FROM scored WHERE score >= 0.3)
SELECT doc_id, st AS subject_text, al AS subject_label, a_start AS subject_start, a_end AS subject_end, relation, ot AS object_text, bl AS object_label, b_start AS object_start, b_end AS object_end, round(score, 4) AS score, 'en' AS lang FROM best WHERE n = 1""")
def relations_extracted(spark, sf):
    texts = S.table(spark, sf, "documents").select("doc_id", "text")
    return P.extracted_relations(S.mentions(spark, sf, "gold"), texts, B.TokenEntailment(), threshold=0.3)


# stretches of text


@query(r"""WITH RECURSIVE b AS (SELECT doc_id, regexp_replace(text, '([.!?])([ \t]+)|(\n+)', '\1\2\3' || chr(1), 'g') AS t FROM documents WHERE text <> ''),
s AS (SELECT doc_id, unnest(list_filter(string_split(t, chr(1)), lambda x: x <> '')) AS x, generate_subscripts(list_filter(string_split(t, chr(1)), lambda x: x <> ''), 1) AS i FROM b),
e AS (SELECT doc_id, i, CAST(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS hi, CAST(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS INTEGER) AS lo FROM s),
r AS (SELECT doc_id, i, lo AS start, hi AS "end", 0 AS closed_start, 0 AS closed_end, false AS closed FROM e WHERE i = 1
  UNION ALL SELECT e.doc_id, e.i, CASE WHEN e.hi - r.start > 1500 THEN e.lo ELSE r.start END, e.hi, r.start, r."end", e.hi - r.start > 1500 FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i + 1)
SELECT doc_id, closed_start AS start, closed_end AS "end" FROM r WHERE closed
UNION ALL SELECT doc_id, arg_max(start, i), arg_max("end", i) FROM r GROUP BY doc_id""")
def text_chunks_1500(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", F.explode(T.chunks(F.col("text"), V.CHUNK_CHARS)).alias("c"))
    return d.select("doc_id", F.col("c.start").alias("start"), F.col("c.end").alias("end"))


@query(r"""WITH b AS (SELECT doc_id, regexp_replace(text, '([.!?])(\s+)|(\n+)', '\1\2\3' || chr(1), 'g') AS t FROM documents WHERE text <> ''),
s AS (SELECT doc_id, unnest(list_filter(string_split(t, chr(1)), lambda x: x <> '')) AS x, generate_subscripts(list_filter(string_split(t, chr(1)), lambda x: x <> ''), 1) AS i FROM b)
SELECT doc_id, CAST(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS INTEGER) AS start, CAST(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS "end" FROM s""")
def sentence_spans(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", F.explode(T.break_spans(F.col("text"))).alias("c"))
    return d.select("doc_id", F.col("c.start").alias("start"), F.col("c.end").alias("end"))


@query(align_sql.BEADS_SQL)
def gale_church_beads(spark, sf):
    return alignment.align_documents(S.pairs(spark, sf).withColumn("filename", F.concat_ws("#", "filename", "bead_idx")))


ASKED = [row[:2] for row in S.LEXICON if row[1]]


@query(r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM t),
o AS (SELECT doc_id, w, i, CAST(coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS pos FROM x),
lex AS (SELECT * FROM (VALUES """ + ", ".join(f"('{t}', '{label}', '{'literal' if label in V.LITERAL_LABELS else V.DEFAULT_KIND}')" for t, label in ASKED) + """) AS l(token, label, kind))
SELECT CAST(doc_id AS VARCHAR) AS filename, label AS entity_label, pos AS start_span, CAST(pos + length(w) AS INTEGER) AS end_span, w AS text, kind AS entity_kind FROM o JOIN lex ON lower(o.w) = token WHERE i % 2 = 0""")
def ner_lexicon_entities(spark, sf):
    docs = S.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("filename"), "text")
    return P.found_entities(docs, B.Lexicon({row[0]: row[1] for row in S.LEXICON if row[1]}))


# translation scores


@query(f"""WITH {RELS}, g0 AS (SELECT DISTINCT doc_id, cui FROM s WHERE cui IS NOT NULL), p0 AS (SELECT DISTINCT doc_id, cui FROM h WHERE cui IS NOT NULL), {_prf_sql('cui', 'doc_id')}
SELECT doc_id, round(precision, 5) AS kg_entity_precision, round(recall, 5) AS kg_entity_recall, round(f1, 5) AS kg_entity_f1, tp + fn AS kg_n_src_entities, tp + fp AS kg_n_hyp_entities FROM f""")
def cui_overlap_prf(spark, sf):
    return P.cui_overlap(S.linked(spark, sf, "gold"), S.linked(spark, sf, "pred"))


@query(f"""WITH {RELS}, g0 AS (SELECT DISTINCT doc_id, cui FROM s WHERE cui IS NOT NULL), p0 AS (SELECT DISTINCT doc_id, cui FROM h WHERE cui IS NOT NULL), {_prf_sql('cui', 'doc_id')}
SELECT doc_id, round(0.5 * f1 + 0.5 * recall, 5) AS kg_bertscore_f1 FROM f""")
def kg_bertscore(spark, sf):
    return P.cui_scores(S.linked(spark, sf, "gold"), S.linked(spark, sf, "pred")).select("doc_id", P.combined_score(F.col("f1"), F.col("recall")).alias("kg_bertscore_f1"))


@query(f"""WITH {_near_sql(False)}, pr AS (SELECT doc_id, avg(CASE WHEN m >= 0.5 THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT doc_id, bead_idx, j, max(score) AS m FROM c GROUP BY doc_id, bead_idx, j) GROUP BY doc_id), re AS (SELECT doc_id, avg(CASE WHEN m >= 0.5 THEN 1.0 ELSE 0.0 END) AS r FROM (SELECT doc_id, bead_idx, i, max(score) AS m FROM c GROUP BY doc_id, bead_idx, i) GROUP BY doc_id)
SELECT doc_id, round(p, 5) AS precision, round(r, 5) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 5) AS f1 FROM pr JOIN re USING (doc_id)""")
def embed_overlap_prf(spark, sf):
    return metrics.covered_share(_candidates(spark, sf)[2], ["bead_idx", "i"], ["bead_idx", "j"], ["doc_id"], 0.5)


@query("SELECT round(avg(length(text)), 5) AS chars, round(avg(CASE WHEN length(text) > 2000 THEN length(text) END), 5) AS long_chars, CAST(NULL AS DOUBLE) AS nothing FROM documents")
def doc_metric_means(spark, sf):
    d = S.table(spark, sf, "documents").select(F.length("text").alias("chars"), F.when(F.length("text") > 2000, F.length("text")).alias("long_chars"), F.lit(None).cast("double").alias("nothing"))
    return metrics.mean_scores(d, ["chars", "long_chars", "nothing"])


def _overlap_sql(name: str, rows: str) -> str:
    """key, p, r, f1 of the word multisets of the texts c and r in ``rows``."""
    words = lambda side, c: f"SELECT key, {side} AS side, unnest(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {name}_x"
    return f"""{name}_x AS ({rows}), {name}_n AS (SELECT key, w, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM ({words(0, 'c')} UNION ALL {words(1, 'r')}) GROUP BY key, w),
{name} AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM (
  SELECT x.key, CASE WHEN sum(a) > 0 THEN sum(least(a, b)) / sum(a) ELSE 0.0 END AS p, CASE WHEN sum(b) > 0 THEN sum(least(a, b)) / sum(b) ELSE 0.0 END AS r FROM {name}_x x LEFT JOIN {name}_n n ON n.key = x.key GROUP BY x.key))"""


def _alike_sql(a: str, b: str) -> str:
    """Cosine of two texts' letters, as vectors of single precision."""
    unit = lambda c: f"list_transform({_letters_sql(f'lower({c})')}, lambda x: CAST(CAST(x / greatest(sqrt(list_dot_product({_letters_sql(f'lower({c})')}, {_letters_sql(f'lower({c})')})), 1e-9) AS FLOAT) AS DOUBLE))"
    return f"list_dot_product({unit(a)}, {unit(b)})"


def _pair_entities_sql(t: str, side: str, text: str) -> str:
    docs = f"{t}_d AS (SELECT filename AS doc_id, {text} AS text FROM f)"
    held = lambda name, inside: f"{name}_in AS (SELECT x.* FROM {name} x JOIN bead b ON b.filename = x.doc_id AND {inside} UNION ALL SELECT * FROM {name} WHERE doc_id NOT IN (SELECT filename FROM bead))"
    p = "src" if t == "s" else "hyp"
    inside = lambda c: f"x.{c} >= b.{p}_start AND x.{c} < b.{p}_end"
    return f"""{docs}, {S.mentions_sql(side, f'{t}_m', f'{t}_d')},
{t} AS (SELECT doc_id, start, "end", text, label, CASE WHEN length(text) % 3 <> 0 THEN 'C' || ascii(substr(text, length(text), 1)) END AS cui FROM {t}_m),
{t}r AS (SELECT doc_id, 'rel_' || length(text) AS relation, start AS s_start, o_start FROM (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS o_start FROM {t}_m) WHERE o_start IS NOT NULL),
{held(t, inside('start'))}, {held(f'{t}r', inside('s_start') + ' AND ' + inside('o_start'))}"""


@query(f"""WITH RECURSIVE {align_sql.TABLES}, bead AS MATERIALIZED ({align_sql.BEADS}), {_overlap_sql('db', "SELECT filename AS key, hypothesis AS c, source AS r FROM f")},
{_overlap_sql('sb', "SELECT filename || '|' || bead_idx AS key, hypothesis AS c, source AS r FROM bead")},
sent AS (SELECT filename, round(round(avg(p), 10) + 1e-9, 5) AS sent_bs_precision_mean, round(round(avg(r), 10) + 1e-9, 5) AS sent_bs_recall_mean, round(round(avg(f1), 10) + 1e-9, 5) AS sent_bs_f1_mean, round(round(avg(l), 10) + 1e-9, 5) AS sent_labse_mean, round(stddev_pop(l), 5) AS sent_labse_std,
    round(avg(CASE WHEN l < {V.LOW_SIMILARITY} THEN 1.0 ELSE 0.0 END), 5) AS sent_labse_low_frac, count(*) AS n_aligned_sentences
  FROM (SELECT filename, filename || '|' || bead_idx AS key, {_alike_sql('source', 'hypothesis')} AS l FROM bead) b JOIN sb ON sb.key = b.key GROUP BY filename),
{_pair_entities_sql('s', 'gold', 'source')}, {_pair_entities_sql('h', 'pred', 'hypothesis')},
linked AS (SELECT DISTINCT doc_id FROM s INTERSECT SELECT DISTINCT doc_id FROM h), known AS (SELECT DISTINCT doc_id FROM s_in INTERSECT SELECT DISTINCT doc_id FROM h_in), related AS (SELECT DISTINCT doc_id FROM sr_in INTERSECT SELECT DISTINCT doc_id FROM hr_in),
cuis AS (SELECT doc_id, cui, 1 AS x, 0 AS y FROM s_in WHERE cui IS NOT NULL UNION ALL SELECT doc_id, cui, 0, 1 FROM h_in WHERE cui IS NOT NULL), {_told_sql('st', 'sr', 's')}, {_told_sql('ht', 'hr', 'h')},
triples AS (SELECT doc_id, s_cui, relation, o_cui, 1 AS x, 0 AS y FROM st WHERE s_cui IS NOT NULL AND o_cui IS NOT NULL UNION ALL SELECT doc_id, s_cui, relation, o_cui, 0, 1 FROM ht WHERE s_cui IS NOT NULL AND o_cui IS NOT NULL),
{_sets_sql('e', 'cuis', 'cui', 'known')}, {_sets_sql('tr', 'triples', 's_cui, relation, o_cui', 'related')}, {_cover_sql('em', 's_in', 'h_in', 'text')}, {_cover_sql('re', 'st', 'ht', 'words')},
concept AS (SELECT e.doc_id, {_three_sql('e', 'kg_entity')}, e.n_src AS kg_n_src_entities, e.n_hyp AS kg_n_hyp_entities, {_three_sql('tr', 'kg_rel')}, tr.n_src AS kg_n_src_relations, tr.n_hyp AS kg_n_hyp_relations, {_three_sql('em', 'kg_embed')}, {_three_sql('re', 'kg_rel_embed')},
    CASE WHEN e.p + e.r > 0 THEN 2 * e.p * e.r / (e.p + e.r) ELSE 0.0 END AS kg_f1
  FROM e LEFT JOIN tr ON tr.doc_id = e.doc_id LEFT JOIN em ON em.doc_id = e.doc_id LEFT JOIN re ON re.doc_id = e.doc_id)
SELECT f.filename AS file, round(db.p, 5) AS doc_bs_precision, round(db.r, 5) AS doc_bs_recall, round(db.f1, 5) AS doc_bs_f1, round({_alike_sql('f.source', 'f.hypothesis')}, 5) AS doc_labse,
  sent.* EXCLUDE (filename), CASE WHEN n_aligned_sentences IS NOT NULL THEN sized.n END AS n_src_sentences, CASE WHEN n_aligned_sentences IS NOT NULL THEN sized.m END AS n_hyp_sentences,
  {', '.join(f"CASE WHEN linked.doc_id IS NOT NULL THEN coalesce(concept.{c}, 0) END AS {c}" for c in V.EVAL_COLUMNS if c.startswith(('kg_entity', 'kg_n_src_e', 'kg_n_hyp_e')))},
  {', '.join(f"concept.{c}" for c in V.EVAL_COLUMNS if c.startswith(('kg_rel', 'kg_embed', 'kg_n_src_r', 'kg_n_hyp_r')))},
  CASE WHEN linked.doc_id IS NOT NULL THEN round(0.5 * coalesce(concept.kg_f1, 0) + 0.5 * db.f1, 5) END AS kg_bertscore_f1
FROM f JOIN db ON db.key = f.filename JOIN sized ON sized.filename = f.filename LEFT JOIN sent ON sent.filename = f.filename LEFT JOIN linked ON linked.doc_id = f.filename LEFT JOIN concept ON concept.doc_id = f.filename""")
def translation_evaluation(spark, sf):
    """All 31 columns; entities and relations of the sources and the hypotheses are linked by the lexicon."""
    ents = [S.pair_linked(spark, sf, side) for side in ("gold", "pred")]
    return P.translation_scores(S.pair_rows(spark, sf), B.TokenOverlap(), B.LetterCounts(), *ents, *map(S.neighbours, ents))


@query("""WITH n AS (SELECT 'doc' || doc_id || '.txt' AS f, text FROM documents),
t AS (SELECT 'doc' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '_BGgpt' ELSE '' END || '.txt' AS f, 'T' || doc_id AS text FROM documents WHERE doc_id % 5 <> 0)
SELECT n.f AS filename, coalesce(a.text, b.text) AS translation FROM n LEFT JOIN t a ON a.f = replace(n.f, '.txt', '_BGgpt.txt') LEFT JOIN t b ON b.f = n.f WHERE coalesce(a.text, b.text) IS NOT NULL""")
def hyp_fallback_join(spark, sf):
    d = S.table(spark, sf, "documents")
    notes = d.select(F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("filename"))
    there = d.filter("doc_id % 5 <> 0").select(F.concat(F.lit("doc"), "doc_id", F.when(F.col("doc_id") % 3 == 0, "_BGgpt").otherwise(""), F.lit(".txt")).alias("filename"), F.concat(F.lit("T"), "doc_id").alias("text"))
    return P.translation_lookup(notes, there)


@query(f"""WITH {S.mentions_sql('pred', 'p')}, rows AS (SELECT 'd' || doc_id || CASE WHEN doc_id % 3 = 0 OR (doc_id % 3 = 1 AND start % 2 = 0) THEN '_BGgpt' ELSE '' END || '.txt' AS doc_id, start, label FROM p),
n AS (SELECT 'd' || doc_id || '.txt' AS doc_id, 'd' || doc_id || '_BGgpt.txt' AS suffixed FROM documents)
SELECT n.doc_id, rows.start, rows.label FROM n JOIN rows ON rows.doc_id = CASE WHEN n.suffixed IN (SELECT doc_id FROM rows) THEN n.suffixed ELSE n.doc_id END""")
def hyp_rows_fallback(spark, sf):
    """Entities of translations, which stand under the suffixed name, under the own, or under both, of which the first counts."""
    key, start = F.col("doc_id"), F.col("start")
    suffixed = (key % 3 == 0) | ((key % 3 == 1) & (start % 2 == 0))
    rows = S.mentions(spark, sf, "pred").select(F.concat(F.lit("d"), "doc_id", F.when(suffixed, "_BGgpt").otherwise(""), F.lit(".txt")).alias("doc_id"), "start", "label")
    names = S.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("doc_id"))
    return P.rows_under_either(names, rows)


@query(f"WITH {SIDES} SELECT DISTINCT text FROM (SELECT text FROM g UNION ALL SELECT text FROM p)")
def unique_texts(spark, sf):
    g, p = _sides(spark, sf)
    return g.select("text").unionByName(p.select("text")).distinct().orderBy("text")


@query("SELECT p_partkey, CASE WHEN TRY_CAST(v AS INTEGER) IS NOT NULL THEN CAST(CAST(v AS INTEGER) AS VARCHAR) ELSE v END AS span FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '0' || p_size WHEN 1 THEN p_type ELSE CAST(p_size AS VARCHAR) END AS v FROM part)")
def span_normalised(spark, sf):
    v = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" 0"), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise(F.col("p_size").cast("string"))
    return S.table(spark, sf, "part").select("p_partkey", T.span_text(v).alias("span"))


#: Labels of parts, by their size: a type's knowledge base is the parts of its label.
KB_LABELS = sorted({row[1] for row in S.LEXICON if row[1]})


@query(f"""WITH {S.mentions_sql('gold', 'g')}, p AS (SELECT 1 AS text WHERE false), asked AS (SELECT DISTINCT text, label FROM g),
kb AS (SELECT 'C' || p_partkey AS cui, p_name || ' ' || p_brand AS name, list_extract([{', '.join(repr(x) for x in KB_LABELS)}], CAST(p_size % {len(KB_LABELS)} AS INTEGER) + 1) AS label FROM part),
q AS (SELECT text, label, {_letters_sql('text')} AS v FROM asked), n AS (SELECT cui, name, label, {_letters_sql('lower(name)')} AS v FROM kb),
scored AS (SELECT q.text, q.label, cui, name, round(list_dot_product(q.v, n.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(n.v, n.v)), 4) AS score FROM q JOIN n ON n.label = q.label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY text, label ORDER BY score DESC, name, cui) AS rank FROM scored WHERE score >= 0.3)
SELECT g.doc_id, g.ent, g.text, g.label AS entity_label, r.rank, r.cui, r.name, r.score FROM g LEFT JOIN ranked r ON r.text = g.text AND r.label = g.label AND r.rank <= 5""")
def entity_linking(spark, sf, cache=None):
    """Mentions against the part names of their label, both encoded by their letters; a row a candidate."""
    ents = S.mentions(spark, sf, "gold").withColumnRenamed("label", "entity_label")
    label = F.element_at(F.array(*map(F.lit, KB_LABELS)), (F.col("p_size") % len(KB_LABELS) + 1).cast("int"))
    kb = S.table(spark, sf, "part").select(F.concat(F.lit("C"), "p_partkey").alias("cui"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), label.alias("label"))
    linked = P.linked_entities(ents, kb, B.LetterCounts(), threshold=0.3, digits=4, cache=cache)
    return linked.select("doc_id", "ent", "text", "entity_label", F.explode_outer("candidates").alias("c")).select("doc_id", "ent", "text", "entity_label", "c.rank", "c.cui", "c.name", "c.score")


@query(f"""WITH {S.mentions_sql('gold', 'g')}, x AS (SELECT doc_id, ent, text, CASE text WHEN 'thnt' THEN 'of the' ELSE text END AS expanded_text FROM g)
SELECT doc_id, ent, text, expanded_text, CASE expanded_text WHEN 'thon' THEN 'disease' WHEN 'of the' THEN 'symptom' ELSE expanded_text END AS translated_text FROM x""")
def entity_translation(spark, sf):
    ents = S.mentions(spark, sf, "gold").select("doc_id", "ent", "text")
    return P.translated_entities(ents, B.Dictionary({"thon": "disease", "of the": "symptom"}), {"thnt": "of the"})
