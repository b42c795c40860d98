"""Readers: text corpora, delimited and pipe tables, markdown, annotations, model output, sentence pairs.

Every reader has a fixed schema, infers nothing and reads through Spark, so paths may be in any store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.functions.vocab import CONSO_COLUMNS, NA_TOKENS

ENTITY = "filename string, entity_label string, entity_kind string, start_span string, end_span string, text string"


def _relative(root: str):
    path = F.col("_metadata.file_path")
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    base = root.rstrip("/").split("://", 1)[-1]
    return F.substring_index(decoded, base + "/", -1)


def texts(spark: SparkSession, root: str, extensions=("txt", "text", "md"), limit: int | None = None) -> DataFrame:
    """(filename, text): files below ``root`` with one of the extensions, whatever their case.

    UTF-8, or Latin-1 where that fails; white space at a text's ends stays. ``limit`` keeps the first by name, and
    only those are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.select(_relative(root).alias("filename"), "content").filter(F.lower("filename").rlike(r"\.(" + "|".join(extensions) + r")\z"))
    if limit is not None:
        first = named.select("filename").orderBy("filename").limit(limit)
        named = named.join(first, "filename", "left_semi")
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return named.select("filename", F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text"))


def table_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(filename, text): the files that match in one folder, not below it; an error where there are none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    rows = files.select(F.element_at(F.split(_relative(folder), "/"), -1).alias("filename"), F.decode("content", "UTF-8").alias("text"))
    if rows.select("filename").isEmpty():
        raise FileNotFoundError(f"no {pattern} files in {folder}")
    return rows


def ner_runs(spark: SparkSession, root: str, prefix: str = "gliner_") -> DataFrame:
    """All runs below ``root``: a folder whose name has the prefix is a run, named by its folder; an error where there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tsv").load(root).select(_relative(root).alias("path"))
    found = files.select("path", F.substring_index("path", "/", 1).alias("run")).filter(F.col("run").startswith(prefix) & F.col("path").contains("/"))
    files_of = lambda linked: F.sort_array(F.collect_list(F.when(T.is_linked_file(F.col("path")) == linked, F.col("path"))))
    runs = found.groupBy("run").agg(files_of(False).alias("plain"), files_of(True).alias("linked")).orderBy("run").collect()  # a row a run folder
    if not runs:
        raise FileNotFoundError(f"No {prefix}* folders found in {root}")
    from lexigrid.plans.pipelines import combined_runs

    base = root.rstrip("/")
    parts = []
    for r in runs:
        split = {linked: [f"{base}/{p}" for p in r["linked" if linked else "plain"]] for linked in (False, True)}
        there = [ner_run(spark, paths, r["run"], linked) for linked, paths in split.items() if paths]
        plain = next((f for f, (linked, paths) in zip(there, [x for x in split.items() if x[1]]) if not linked), there[0].limit(0))
        with_concepts = next((f for f, (linked, paths) in zip(there, [x for x in split.items() if x[1]]) if linked), there[0].limit(0))
        parts.append((plain, with_concepts))
    return combined_runs(parts)


def dataset(spark: SparkSession, path: str, text: str = "text", key: str = "id") -> DataFrame:
    """(id, text, category_diagnosis, document_id, length) of a local dataset in Parquet or JSON lines, with ids like ``a_b_7``."""
    rows = spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)
    category, number = T.id_parts(F.col(key))
    return rows.select(F.col(key).alias("id"), F.col(text).alias("text"), category.alias("category_diagnosis"), number.alias("document_id"), F.length(text).alias("length"))


def tsv(spark: SparkSession, path, schema: str | None = None, header: bool = True) -> DataFrame:
    """A tab-separated table, all strings, with quoted tabs, quotes and line breaks; missing values are ''."""
    reader = spark.read.option("sep", "\t").option("header", header).option("quote", '"').option("escape", '"').option("multiLine", "true").option("emptyValue", "").option("nullValue", "\x00")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", "false")).csv(path)
    return df.na.fill("")


def with_missing(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """The table reader's view: NA tokens are null, so a mention "NA" has no text."""
    return df.select(*[F.when(F.col(f"`{c}`").isin(*tokens), None).otherwise(F.col(f"`{c}`")).alias(c.strip()) for c in df.columns])


def entities(spark: SparkSession, path) -> DataFrame:
    """Entities by document; rows without a file name go, spans must be integers, the kind defaults to concept."""
    df = tsv(spark, path)
    kind = F.coalesce(T.non_blank(F.col("entity_kind")), F.lit("concept")) if "entity_kind" in df.columns else F.lit("concept")
    rows = df.filter(T.strip(F.col("filename")) != "").withColumn("filename", T.strip(F.col("filename")))
    return rows.withColumn("entity_kind", kind).withColumn("start_span", F.col("start_span").cast("int")).withColumn("end_span", F.col("end_span").cast("int"))


def keyed_rows(spark: SparkSession, path) -> DataFrame:
    """Entity-linking or relation rows as they are, all columns as text; the file name is stripped, and a blank one stays."""
    df = tsv(spark, path)
    return df.withColumn("filename", T.strip(F.col("filename")))


def linked_rows(spark: SparkSession, path) -> DataFrame:
    """Entity-linking rows as (doc_id, id, start, end, label, text, translated, cui), in order of the file's rows."""
    df = keyed_rows(spark, path).withColumn("id", F.monotonically_increasing_id())
    or_blank = lambda c: F.col(c) if c in df.columns else F.lit("")
    return df.select(F.col("filename").alias("doc_id"), "id", T.span_number(F.col("start_span")).alias("start"), T.span_number(F.col("end_span")).alias("end"), F.col("entity_label").alias("label"), "text", or_blank("translated_text").alias("translated"), T.strip(or_blank("umls_cui_1")).alias("cui"))


def relation_rows(spark: SparkSession, path) -> DataFrame:
    """Relation rows as (doc_id, id, relation, s_start, s_end, o_start, o_end), in order of the file's rows."""
    df = keyed_rows(spark, path).withColumn("id", F.monotonically_increasing_id())
    span = lambda c: T.span_number(F.col(c))
    return df.select(F.col("filename").alias("doc_id"), "id", "relation", span("subject_start").alias("s_start"), span("subject_end").alias("s_end"), span("object_start").alias("o_start"), span("object_end").alias("o_end"))


def ner_run(spark: SparkSession, path, model: str, linked: bool = False) -> DataFrame:
    """One folder's files as (document_id, language, model, entity_type, text, start_index, end_index, umls_cui)."""
    df = with_missing(tsv(spark, path).withColumn("__path", F.col("_metadata.file_path")))
    df = df.na.drop(subset=["filename", "start_span", "end_span"])
    cui = next((F.col(f"`{c}`") for c in ("UMLS cui", "umls_cui_1") if linked and c in df.columns), F.lit(None).cast("string"))
    given = F.col("model") if "model" in df.columns else F.lit(None).cast("string")
    return df.select(
        T.document_id(F.col("filename")).alias("document_id"),
        T.language_of_path(F.col("__path")).alias("language"),
        F.coalesce(T.non_blank(given), F.lit(model)).alias("model"),
        F.upper("entity_label").alias("entity_type"),
        "text",
        T.span_number(F.col("start_span")).alias("start_index"),
        T.span_number(F.col("end_span")).alias("end_index"),
        T.non_blank(cui).alias("umls_cui"),
    )


def predictions(spark: SparkSession, path) -> DataFrame:
    """(filename, start, end, label, text) without repeats; ".txt" is added where it lacks."""
    df = tsv(spark, path)
    name = F.when(F.col("filename").endswith(".txt"), F.col("filename")).otherwise(F.concat("filename", F.lit(".txt")))
    rows = df.select(name.alias("filename"), T.span_number(F.col("start_span")).alias("start"), T.span_number(F.col("end_span")).alias("end"), F.upper(T.strip(F.col("entity_label"))).alias("label"), "text")
    return rows.na.drop(subset=["start", "end"]).distinct()


def annotations(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Gold JSON: ((filename, classes), (filename, annotator, start, end, label, text))."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/"), -1).alias("filename"), F.parse_json("value").alias("v"))
    classes = raw.select("filename", F.transform(F.variant_get("v", "$.classes", "array<string>"), lambda c: F.upper(T.strip(c))).alias("classes"))
    sets = raw.select("filename", F.posexplode(F.variant_get("v", "$.annotations", "array<variant>")).alias("annotator", "a"))
    one = sets.select("filename", "annotator", F.variant_get("a", "$[0]", "string").alias("body"), F.explode(F.variant_get("a", "$[1].entities", "array<variant>")).alias("e"))
    start, end = F.variant_get("e", "$[0]", "int"), F.variant_get("e", "$[1]", "int")
    spans = one.select("filename", "annotator", start.alias("start"), end.alias("end"), F.upper(T.strip(F.variant_get("e", "$[2]", "string"))).alias("label"), F.substring("body", start + 1, end - start).alias("text"))
    return classes, spans


def pipe_table(spark: SparkSession, path, columns: dict[str, int], least: int) -> DataFrame:
    """Fields of a pipe-separated file without quoting; shorter rows go."""
    fields = F.split("value", r"\|", -1)
    rows = spark.read.text(path).select(fields.alias("f")).filter(F.size("f") >= least)
    return rows.select(*[F.get("f", F.lit(i)).alias(name) for name, i in columns.items()])


def concepts(spark: SparkSession, path) -> DataFrame:
    return pipe_table(spark, path, CONSO_COLUMNS, 17)


def semantic_types(spark: SparkSession, path) -> DataFrame:
    return pipe_table(spark, path, {"cui": 0, "tui": 1}, 2)


def candidates(spark: SparkSession, path, label: str | None = None) -> DataFrame:
    """(cui, name[, label]) of a headerless file; rows with a blank identifier or no name go."""
    rows = tsv(spark, path, "cui string, name string", header=False)
    rows = rows.select(T.strip(F.col("cui")).alias("cui"), T.strip(F.col("name")).alias("name")).filter((F.col("cui") != "") & (F.col("name") != ""))
    return rows if label is None else rows.withColumn("label", F.lit(label))


def numbered_lines(df: DataFrame, text: str = "value", *keep: str) -> DataFrame:
    """(keep, line_no, line): lines of whole texts, numbered, which a split file scan could not promise."""
    return df.select(*keep, F.posexplode(F.split(text, T.LINE_BREAK, -1)).alias("line_no", "line"))


def abbreviations(spark: SparkSession, path) -> DataFrame:
    """(abbreviation, expansion); comments and blanks go, the last of repeated keys counts."""
    lines = numbered_lines(spark.read.text(path, wholetext=True), "value")
    rows = lines.filter((T.strip(F.col("line")) != "") & ~F.col("line").startswith("#") & F.col("line").contains("\t"))
    parts = F.split("line", "\t", 2)
    rows = rows.select(T.strip(F.get(parts, F.lit(0))).alias("abbreviation"), T.strip(F.get(parts, F.lit(1))).alias("expansion"), "line_no")
    return rows.groupBy("abbreviation").agg(F.max_by("expansion", "line_no").alias("expansion"))


def abbreviation_table(spark: SparkSession, path) -> DataFrame:
    """(abbreviation, bg, en) of a tab-separated file with a comment or none before its rows; rows with fewer fields go."""
    lines = numbered_lines(spark.read.text(path, wholetext=True), "value").filter(~F.col("line").startswith("#"))
    parts = F.split("line", "\t")
    rows = lines.filter(F.size(parts) >= 3).select(*[T.strip(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(("abbreviation", "bg", "en"))])
    return rows.filter("abbreviation <> ''")


def label_paths(options: list[str]) -> dict[str, list[str]]:
    """``label=path,path`` options as paths by lower-case label; an error without the sign."""
    found: dict[str, list[str]] = {}
    for option in options:
        label, sign, paths = option.partition("=")
        if not sign:
            raise ValueError(f"expected label=path, got {option!r}")
        found.setdefault(label.strip().lower(), []).extend(p.strip() for p in paths.split(",") if p.strip())
    return found


def typed_candidates(spark: SparkSession, options: list[str]) -> DataFrame:
    """(cui, name, label) of the candidate files that the options name."""
    from lexigrid.operators.metrics import unioned

    return unioned([candidates(spark, paths, label) for label, paths in label_paths(options).items()])


def sentence_pairs(spark: SparkSession, path) -> DataFrame:
    """(filename, bead_idx, source, hypothesis) in order of the file's rows."""
    name = F.element_at(F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/"), -1)
    schema = "source string, hypothesis string"
    whole = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", "true").schema(schema).csv(path)
    rows = whole.select(name.alias("filename"), "source", "hypothesis", F.monotonically_increasing_id().alias("at")).na.fill("")
    return rows.withColumn("bead_idx", F.row_number().over(Window.partitionBy("filename").orderBy("at")) - 1).drop("at")


def markdown_rows(files: DataFrame, n_cells: int, header: str, file: str = "filename", text: str = "text") -> DataFrame:
    """(file, row_no, cells): table rows with exactly ``n_cells`` cells; broken rows are glued, headers and rules skipped."""
    lines = numbered_lines(files.select(F.col(file), F.col(text)), text, file).withColumn("line", T.strip(F.col("line"))).filter(F.col("line") != "")
    order = Window.partitionBy(file).orderBy("line_no")
    glued = lines.withColumn("row_no", F.sum(F.col("line").startswith("|").cast("int")).over(order)).filter("row_no > 0")
    rows = glued.groupBy(file, "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("line"))
    rows = rows.filter(~F.col("line").rlike(T.SEPARATOR_ROW)).select(file, "row_no", T.cells(F.col("line")).alias("cells"))
    return rows.filter((F.size("cells") == n_cells) & (F.lower(F.get("cells", F.lit(0))) != header))


# The fields of a model's concept block, in the order in which a line is tried.
CONCEPT = r"\*\*Concept \d+:\*\*\s*(.+)"
FIELDS = {
    "type": r"\*\*Type:\*\*\s*(.+)",
    "fhir_mapping": r"\*\*FHIR Mapping:\*\*\s*(.+)",
    "icd10_code": r"\*\*ICD-10 CM Code:\*\*\s*(.+)",
    "atc_code": r"\*\*ATC Code:\*\*\s*(.+)",
    "loinc_code": r"\*\*LOINC Code:\*\*\s*(.+)",
    "snomed_code": r"\*\*SNOMED CT Code:\*\*\s*(.+)",
}
OUTPUT_NAME = r"^(.+?)_(\d+)_(.+?)_NER\.txt$"


def concept_blocks(files: DataFrame, file: str = "source_file", text: str = "text") -> DataFrame:
    """A row for each concept of model output files, with its fields and what the file's name tells."""
    name = F.col(file)
    both = F.regexp_extract(name, OUTPUT_NAME, 1)
    lines = numbered_lines(files.select(name, F.col(text)), text, file).withColumn("line", T.strip(F.col("line")))
    concept = F.regexp_extract("line", CONCEPT, 1)
    lines = lines.withColumn("concept", F.when(F.col("line").rlike(CONCEPT), T.strip(concept)))
    lines = lines.withColumn("block", F.count("concept").over(Window.partitionBy(file).orderBy("line_no"))).filter("block > 0")
    taken, aggregates = F.col("concept").isNotNull(), []
    for field, pattern in FIELDS.items():
        here = ~taken & F.col("line").rlike(pattern)
        value = T.strip(F.regexp_extract("line", pattern, 1))
        last = F.max_by(F.when(here, F.when(value == "N/A", "").otherwise(value)), F.when(here, F.col("line_no")))
        aggregates.append(F.coalesce(last, F.lit("")).alias(field))
        taken = taken | F.col("line").rlike(pattern)
    blocks = lines.groupBy(file, "block").agg(F.max("concept").alias("concept"), *aggregates)
    split = F.split(both, "_", 2)
    return blocks.select(name.alias("source_file"), F.get(split, F.lit(0)).alias("specialty"), F.coalesce(F.get(split, F.lit(1)), F.lit("")).alias("condition"), F.regexp_extract(name, OUTPUT_NAME, 2).alias("note_index"), F.regexp_extract(name, OUTPUT_NAME, 3).alias("model"), "block", "concept", *FIELDS)


def source_name(specialty, condition, note_index, suffix: str | None = None):
    """The path of the document that a concept block was read from."""
    folder = F.concat_ws("_", specialty, condition)
    return F.concat(folder, F.lit("/"), folder, F.lit("_"), note_index, F.lit(f"_{suffix}.txt" if suffix else ".txt"))
