import pytest
from pyspark.sql import functions as F

from lexigrid.plans import pipelines
from lexigrid.sources import readers, writers


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_texts(spark, tmp_path):
    put(tmp_path / "b/x.TXT", "два\n")
    put(tmp_path / "a y.md", "caf\xe9", "latin-1")
    put(tmp_path / "c.json", "{}")
    rows = readers.texts(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [("a y.md", "café"), ("b/x.TXT", "два\n")]
    assert [r["filename"] for r in readers.texts(spark, str(tmp_path), limit=1).collect()] == ["a y.md"]


def test_abbreviation_table_of_one_file(spark, tmp_path):
    put(tmp_path / "terms.txt", "| English Abbreviation | English Expansion | Bulgarian Abbreviation | Bulgarian Expansion |\n| --- | --- | --- | --- |\n| BP | Blood pressure | АН | Артериално налягане |\n")
    header = ["English Abbreviation", "English Expansion", "Bulgarian Abbreviation", "Bulgarian Expansion"]
    got = pipelines.combined_tables(readers.texts(spark, str(tmp_path)), header).drop("row_no")
    assert got.columns == ["Source File", *header]
    assert [tuple(r) for r in got.collect()] == [("terms.txt", "BP", "Blood pressure", "АН", "Артериално налягане")]


def test_term_table_glues_lines_and_drops_repeats(spark, tmp_path):
    body = "stray\n| English Term | Bulgarian Term | Justification |\n|:--|--|--|\n| hypertension | хипертония | clinical\nterm |\n| hypertension | хипертония | clinical term |\n| a | | c |\n| a | b | c | d |\n"
    for name in ("terms.txt", "more.txt"):
        put(tmp_path / name, body)
    got = pipelines.combined_tables(readers.texts(spark, str(tmp_path)), ["English Term", "Bulgarian Term", "Justification"]).drop("row_no")
    assert sorted(map(tuple, got.collect())) == [(f, "hypertension", "хипертония", "clinical term") for f in ("more.txt", "terms.txt")]


def test_ner_run(spark, tmp_path):
    path = put(tmp_path / "gliner_test/predictions_en_ner.tsv", "filename\tentity_label\tstart_span\tend_span\ttext\ncase_1.txt\tdisease\t0\t12.0\thypertension\ncase_1.txt\tdrug\t3\t5\tNA\n\tx\t1\t2\ty\n")
    rows = sorted((tuple(r) for r in readers.ner_run(spark, path, "gliner_test").collect()), key=str)
    assert rows == [("case_1", "en", "gliner_test", "DISEASE", "hypertension", 0, 12, None), ("case_1", "en", "gliner_test", "DRUG", None, 3, 5, None)]
    linked = put(tmp_path / "m/predictions_bg_umls.tsv", "filename\tentity_label\tstart_span\tend_span\ttext\tumls_cui_1\ncase_2.txt\tdisease\t1\t2\tt\tC1\ncase_2.txt\tdisease\t1\t2\tt\t \n")
    assert sorted(str(r["umls_cui"]) for r in readers.ner_run(spark, linked, "m", linked=True).collect()) == ["C1", "None"]


def test_sentence_pairs_and_their_counts(spark, tmp_path):
    put(tmp_path / "sent_pairs_a.tsv", "source\thypothesis\nhigh blood pressure\tвисоко кръвно налягане\n\t\n")
    rows = readers.sentence_pairs(spark, str(tmp_path / "sent_pairs_*.tsv"))
    assert [r["bead_idx"] for r in rows.orderBy("bead_idx").collect()] == [0, 1]
    docs, whole = pipelines.pair_stats(rows)
    assert whole.first()["pairs"] == 1 and whole.first()["src_words"] == 3 and docs.count() == 1


def test_tsv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a\tb", 'say "x"', None), ("line\nbreak", "", "z")], "a string, b string, c string")
    writers.write_tsv(rows, str(tmp_path / "t"))
    assert sorted(map(tuple, readers.tsv(spark, str(tmp_path / "t")).collect())) == [("a\tb", 'say "x"', ""), ("line\nbreak", "", "z")]


def test_pipe_tables_have_no_quotes(spark, tmp_path):
    path = put(tmp_path / "c.rrf", '|'.join(["C1", "ENG", *"x" * 9, "ATC", "x", "x", 'say "hi', "x", "N", "x"]) + "\nshort|row\n")
    assert [tuple(r) for r in readers.concepts(spark, path).collect()] == [("C1", "ENG", "ATC", 'say "hi', "N")]


def test_abbreviations_last_wins(spark, tmp_path):
    path = put(tmp_path / "a.tsv", "# c\nBP\told\n\nBP\tnew\tmore\nx\n")
    assert [tuple(r) for r in readers.abbreviations(spark, path).collect()] == [("BP", "new\tmore")]


def test_annotations(spark, tmp_path):
    put(tmp_path / "x_annotations.json", '{"classes":["Disease "],"annotations":[["😀 flu here",{"entities":[[2,5,"disease"]]}],["😀 flu here",{"entities":[]}]]}')
    classes, spans = readers.annotations(spark, str(tmp_path / "*.json"))
    assert classes.first()["classes"] == ["DISEASE"]
    assert [tuple(r) for r in spans.collect()] == [("x_annotations.json", 0, 2, 5, "DISEASE", "flu")]


BLOCKS = """*   **Concept 1:** Hypertension
    *   **Type:** Condition
    *   **ICD-10 CM Code:** I10
    *   **ATC Code:** N/A
*   **Concept 2:** flu
    *   **Type:** a
    *   **Type:** b
"""


def test_concept_blocks_and_their_mentions(spark):
    name = "cardiovascular_arterial hypertension_26_modelx_NER.txt"
    files = spark.createDataFrame([(name, "**Type:** stray\n" + BLOCKS), ("odd.txt", BLOCKS)], "source_file string, text string")
    rows = {(r["source_file"], r["block"]): r for r in readers.concept_blocks(files).collect()}
    first = rows[name, 1]
    assert (first["specialty"], first["condition"], first["note_index"], first["model"]) == ("cardiovascular", "arterial hypertension", "26", "modelx")
    assert (first["concept"], first["type"], first["icd10_code"], first["atc_code"]) == ("Hypertension", "Condition", "I10", "")
    assert rows[name, 2]["type"] == "b" and rows["odd.txt", 1]["model"] == ""
    texts = spark.createDataFrame([("cardiovascular_arterial hypertension/cardiovascular_arterial hypertension_26.txt", "No HYPERTENSION, flu. hypertension")], "filename string, text string")
    spans = pipelines.expanded_spans(readers.concept_blocks(files), texts).collect()
    assert sorted((r["entity_label"], r["start_span"], r["text"]) for r in spans) == [("Condition", 3, "HYPERTENSION"), ("Condition", 22, "hypertension"), ("b", 17, "flu")]


def test_cache_and_report(spark, tmp_path):
    texts = spark.createDataFrame([("a",), ("b",), ("b",)], "text string")
    cache = writers.write_cached(texts.filter("text = 'a'").withColumn("vec", F.array(F.lit(1.0))), str(tmp_path / "cache"))
    assert [r["text"] for r in writers.missing_from_cache(texts, cache).collect()] == ["b"]
    assert "| a | 1 |" in writers.report(spark.createDataFrame([("a", 1, None)], "metric string, n int, x string"), "T")


def test_flat_table_folder(spark, tmp_path):
    (tmp_path / "below").mkdir()
    for name, body in (("a.txt", "| x |"), ("b.md", "no"), ("below/c.txt", "no")):
        (tmp_path / name).write_text(body)
    assert [tuple(r) for r in readers.table_files(spark, str(tmp_path)).collect()] == [("a.txt", "| x |")]
    with pytest.raises(FileNotFoundError):
        readers.table_files(spark, str(tmp_path), "*.csv")


def test_run_folders(spark, tmp_path):
    head = "filename\tentity_label\tstart_span\tend_span\ttext"
    for run, name, cui in (("gliner_a", "predictions_en_ner.tsv", ""), ("gliner_a", "predictions_en_umls.tsv", "\tC1"), ("gliner_a", "predictions_bg_ner.tsv", ""), ("gliner_b", "predictions_bg_ner.tsv", ""), ("other", "predictions_en_ner.tsv", "")):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / name).write_text(head + ("\tumls_cui_1" if cui else "") + "\n" + f"case_1.txt\tdisease\t0\t3\tflu{cui}\n")
    rows = readers.ner_runs(spark, str(tmp_path)).collect()
    assert sorted((r["model"], r["language"], r["umls_cui"]) for r in rows) == [("gliner_a", "bg", None), ("gliner_a", "en", "C1"), ("gliner_b", "bg", None)]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.tsv").write_text(head)
    with pytest.raises(FileNotFoundError, match=r"No gliner_\* folders found"):
        readers.ner_runs(spark, str(tmp_path / "empty"))


def test_linked_and_relation_files(spark, tmp_path):
    (tmp_path / "el.tsv").write_text("filename\tentity_label\tstart_span\tend_span\ttext\ttranslated_text\tumls_cui_1\n a.txt \td\t007\t9\tx\t\t C1 \n\td\t1\t2\ty\tz\t\n")
    rows = readers.linked_rows(spark, str(tmp_path / "el.tsv")).orderBy("id").collect()
    assert [(r["doc_id"], r["start"], r["text"], r["translated"], r["cui"]) for r in rows] == [("a.txt", 7, "x", "", "C1"), ("", 1, "y", "z", "")]
    (tmp_path / "re.tsv").write_text("filename\tsubject_start\tsubject_end\trelation\tobject_start\tobject_end\na.txt\t1\t2\thas\t3\t4\n")
    row = readers.relation_rows(spark, str(tmp_path / "re.tsv")).first()
    assert tuple(row)[2:] == ("has", 1, 2, 3, 4)


def test_dataset_options_and_abbreviation_table(spark, tmp_path):
    spark.createDataFrame([("a_b_7", "text")], "id string, text string").write.parquet(str(tmp_path / "d"))
    assert tuple(readers.dataset(spark, str(tmp_path / "d")).first()) == ("a_b_7", "text", "a_b", "7", 4)
    assert readers.label_paths(["Drug Name=x, y", "drug name=z"]) == {"drug name": ["x", "y", "z"]}
    with pytest.raises(ValueError):
        readers.label_paths(["no sign"])
    (tmp_path / "c.tsv").write_text("C1\tone\nC2\ttwo\n")
    assert sorted(map(tuple, readers.typed_candidates(spark, [f"Disease={tmp_path}/c.tsv"]).collect())) == [("C1", "one", "disease"), ("C2", "two", "disease")]
    (tmp_path / "abbr.tsv").write_text("# head\nАН\tналягане\tpressure\nshort\n")
    assert [tuple(r) for r in readers.abbreviation_table(spark, str(tmp_path / "abbr.tsv")).collect()] == [("АН", "налягане", "pressure")]


def test_knowledge_base_folders(spark, tmp_path):
    kb = spark.createDataFrame([("drug name", "C2", "b"), ("drug name", "C1", "z"), ("drug name", "C1", "a"), ("x/y", "C1", "a")], "label string, cui string, name string")
    writers.write_knowledge_base(kb, str(tmp_path))
    files = sorted(tmp_path.glob("labels/label=drug_name/*.csv"))
    assert "".join(f.read_text() for f in files) == "C1\ta\nC1\tz\nC2\tb\n" and list(tmp_path.glob("labels/label=x_y/*.csv"))
    assert "".join(f.read_text() for f in sorted(tmp_path.glob("kb_all/*.csv"))) == "C1\ta\nC1\tz\nC2\tb\n"


def test_one_json_object(spark, tmp_path):
    import json

    documents = spark.createDataFrame([("b.txt", 1.5, None), ('a "q"\\.txt', 2.0, 1)], "file string, score double, n int")
    writers.write_object(spark.createDataFrame([(2, 1.75)], "n_documents int, mean double"), documents, "file", str(tmp_path / "o"))
    found = json.loads("".join(f.read_text() for f in sorted((tmp_path / "o").glob("*.txt"))))
    assert found["summary"] == {"n_documents": 2, "mean": 1.75}
    assert found["documents"] == {"b.txt": {"file": "b.txt", "score": 1.5, "n": None}, 'a "q"\\.txt': {"file": 'a "q"\\.txt', "score": 2.0, "n": 1}}


def test_cache_does_not_repeat_rows(spark, tmp_path):
    rows = lambda *names: spark.createDataFrame([(n, "e1", "drug") for n in names], "text string, encoder string, label string")
    writers.write_cached(rows("a", "b", "b"), str(tmp_path / "c"), by=["label"])
    assert writers.write_cached(rows("b", "c"), str(tmp_path / "c"), by=["label"]).count() == 3
    assert writers.write_cached(rows("b").withColumn("encoder", F.lit("e2")), str(tmp_path / "c"), by=["label"]).count() == 4


def test_corpus_report_has_both_tables(spark):
    summary = spark.createDataFrame([("words", 2.0)], "metric string, mean double")
    text = writers.corpus_report(summary, 9, spark.createDataFrame([("flu", 2, 5)], "disease string, documents long, sentences long"))
    assert "| Documents | 2 |" in text and "| words | 2.0 |" in text and "## Notes" in text
