import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.functions import backends as B
from lexigrid.functions import vocab as V
from lexigrid.operators import alignment, matching, metrics
from lexigrid.plans import pipelines


def brute_greedy(cands):
    used_i, used_j, out = set(), set(), []
    for score, i, j in sorted(cands, reverse=True):
        if i not in used_i and j not in used_j:
            out.append((score, i, j))
            used_i.add(i)
            used_j.add(j)
    return sorted(out)


def test_greedy_ties_go_to_larger_indices(spark):
    rng = random.Random(2)
    cands = {(g, i, j): rng.choice([0.5, 0.8, 0.9]) for g in range(4) for i in range(7) for j in range(6) if rng.random() < 0.7}
    df = spark.createDataFrame([(g, i, j, s) for (g, i, j), s in cands.items()], "g int, i long, j long, score double")
    got = matching.greedy_pairs(df, ["g"]).collect()
    for g in range(4):
        assert sorted((r["score"], r["i"], r["j"]) for r in got if r["g"] == g) == brute_greedy([(s, i, j) for (x, i, j), s in cands.items() if x == g])


def brute_cascade(src, hyp):
    out = []
    for key, kind in ((1, "CUI"), (2, "text")):
        groups = {}
        for side, rows in ((0, src), (1, hyp)):
            for r in rows:
                if r[key] is not None:
                    groups.setdefault(r[key], ([], []))[side].append(r)
        for a, b in groups.values():
            if a and b:
                for n in range(max(len(a), len(b))):
                    out.append((a[n][0] if n < len(a) else None, b[n][0] if n < len(b) else None, kind))
        src = [r for r in src if r[0] not in {o[0] for o in out}]
        hyp = [r for r in hyp if r[0] not in {o[1] for o in out}]
    return out + [(r[0], None, "none") for r in src] + [(None, r[0], "none") for r in hyp]


def test_cascade_surplus_faces_null(spark):
    rng = random.Random(7)
    make = lambda n: [(i, rng.choice([None, "a", "b", "c"]), rng.choice([None, "x", "y"])) for i in range(n)]
    for a, b in ((make(30), make(20)), (make(1), []), ([], make(3))):
        schema = "id long, c string, t string"
        df = lambda rows: spark.createDataFrame([("d", *r) for r in rows], "doc string, " + schema)
        got = matching.match_cascade(df(a), df(b), ["doc"], [("CUI", "c"), ("text", "t")]).drop("doc")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_cascade(a, b), key=str)


def test_labels_count_only_if_asked(spark):
    df = lambda label: spark.createDataFrame([("d", 1, 0, 1, "t", label, "C1")], "doc_id string, id long, start long, end long, text string, label string, cui string")
    assert pipelines.entity_matches(df("a"), df("b"), ["doc_id"]).count() == 1
    assert pipelines.entity_matches(df("a"), df("b"), ["doc_id"], enforce_label=True).count() == 2


def test_band_pairs_against_brute_force(spark):
    rng = random.Random(5)
    labels = ["disease", "symptom", "drug name", "drug dosage", "body site"]
    ents = [(d, n, rng.choice(labels), s, s + rng.randrange(1, 90)) for d in range(3) for n, s in enumerate(sorted(rng.randrange(4000) for _ in range(60)))]
    table = matching.relation_table(spark, V.RELATIONS, V.TEMPLATES["en"])
    got = matching.band_pairs(spark.createDataFrame(ents, "doc int, ent int, label string, start int, end int"), "doc", table, 200)
    want = sorted((a[0], a[1], b[1], seq) for a in ents for b in ents if a[0] == b[0] and a[1] != b[1] and max(a[3], b[3]) - min(a[4], b[4]) <= 200 for seq, (_, s, o) in enumerate(V.RELATIONS) if a[2] in s and b[2] in o)
    assert sorted((r["doc"], r["s_ent"], r["o_ent"], r["seq"]) for r in got.collect()) == want


@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_greedy_rounds_are_the_walk(spark, most):
    rng = random.Random(most)
    rows = [(g, rng.randint(0, 14), rng.randint(0, 14), rng.choice([0.5, 0.5, rng.random()])) for g in ("a", "b", "c") for _ in range(60)]
    rows += [("d", i, i + d, 1.0 - (2 * i + d) / 1000) for i in range(7) for d in (0, 1)]  # a chain: each pair waits for the one before
    rows = list({(g, i, j): s for g, i, j, s in rows}.items())
    df = spark.createDataFrame([(g, i, j, s) for (g, i, j), s in rows], "g string, i long, j long, score double")
    got = matching.greedy_pairs(df, ["g"], most=most).collect()
    for g in "abcd":
        assert sorted((r["score"], r["i"], r["j"]) for r in got if r["g"] == g) == brute_greedy([(s, i, j) for (x, i, j), s in rows if x == g])
    assert matching.greedy_pairs(df.limit(0), ["g"], most=most).count() == 0


def test_a_large_scope(spark):
    df = spark.range(1_000_000).selectExpr("'g' AS g", "id % 1000 AS i", "(id div 1000 + id * 7) % 1000 AS j", "xxhash64(id) % 1000 / 1000 AS score")
    got = matching.greedy_pairs(df, ["g"])
    assert got.select("i").distinct().count() == got.count() > 900
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_best_relation_keeps_the_first_of_equals(spark):
    rows = [("d", 0, 1, 2, 3, 1, 2, 5, 0.9, "late"), ("d", 0, 1, 2, 3, 1, 2, 1, 0.9, "early"), ("d", 0, 1, 4, 5, 1, 3, 0, 0.1, "low")]
    df = spark.createDataFrame(rows, "doc string, s_start int, s_end int, o_start int, o_end int, s_ent int, o_ent int, seq int, score double, relation string")
    assert [r["relation"] for r in matching.best_relation(df, "doc", 0.5).collect()] == ["early"]


def test_nearest_bead(spark):
    beads = spark.createDataFrame([("d", i, t) for i, t in enumerate(["flu a", "cold", "flu b"])], "doc string, bead int, t string")
    beads = matching.bead_offsets(beads, "doc", "bead", "t", "at")
    ents = spark.createDataFrame([(1, "d", "flu", "0"), (2, "d", "flu", "9"), (3, "d", "flu", "?"), (4, "d", "none", "1"), (5, "d", " ", "1"), (6, "d", "flu", "4")], "id int, doc string, text string, start string")
    got = {r["id"]: r["bead_idx"] for r in matching.nearest_bead(ents, beads, "doc", "text", "start", "t", "bead", "at").collect()}
    assert got == {1: 0, 2: 2, 3: 0, 4: None, 6: 0}


def test_top_candidates_are_exact(spark):
    rng = random.Random(3)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    queries, kb = [(q, vec()) for q in range(5)], [(f"c{i}", f"n{i % 9}", vec()) for i in range(40)]
    got = matching.top_candidates(spark.createDataFrame(queries, "q int, vec array<double>"), spark.createDataFrame(kb, "cui string, name string, vec array<double>"), 3, -9.0, digits=4).collect()
    for q, v in queries:
        want = sorted((-round(sum(a * b for a, b in zip(v, w)), 4), n, c) for c, n, w in kb)[:3]
        assert [(r["name"], r["cui"]) for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == [(n, c) for _, n, c in want]
    small = matching.top_candidates(spark.createDataFrame(queries, "q int, vec array<double>"), spark.createDataFrame(kb, "cui string, name string, vec array<double>"), 3, -9.0, digits=4, cell=3)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, got))


def test_overlap_of_empty_and_equal_sets(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "d int, k string")
    assert tuple(metrics.overlap(rows, rows, ["d", "k"]).first()) == (2, 0, 0, 1.0, 1.0, 1.0)
    assert tuple(metrics.overlap(rows.limit(0), rows.limit(0), ["d", "k"]).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_lenient_scores_have_no_document(spark):
    schema = "doc_id int, start int, end int, label string, text string"
    gold, pred = spark.createDataFrame([(1, 0, 1, "A", "X"), (2, 0, 1, "A", "x")], schema), spark.createDataFrame([(3, 5, 6, "A", "x")], schema)
    got = {r["kind"]: (r["tp"], r["fp"], r["fn"]) for r in pipelines.ner_scores(gold, pred).collect()}
    assert got == {"strict": (0, 1, 2), "span": (0, 1, 2), "lenient": (1, 0, 0)}


def test_summary_interpolates(spark):
    row = metrics.summary(spark.createDataFrame([(1,), (2,), (3,), (10,)], "x int"), ["x"]).first()
    assert (row["p25"], row["median"], row["std"], row["max"], row["count"]) == (1.75, 2.5, 3.54, 10.0, 4)


# sentences, alignment, context


def test_sentence_spans():
    text = "  Dr. Smith came. He left?\nд-р Иванов, ул. Х 5 г. София. Край\n\n3.5 mg now!"
    got = alignment.sentence_spans(text)
    assert [t for t, _, _ in got] == ["Dr. Smith came.", "He left?", "д-р Иванов, ул. Х 5 г. София.", "Край", "3.5 mg now!"]
    assert all(text[s:e] == t for t, s, e in got)


def test_equal_lengths_align_one_to_one():
    assert alignment.align_lengths([20, 35, 50], [22, 33, 51]) == [(0, 0), (1, 1), (2, 2)]
    assert alignment.align_lengths([], [5]) == [] == alignment.align_lengths([], [])


def test_a_split_sentence_is_one_bead():
    links = alignment.align_lengths([100, 40], [48, 50, 41])
    assert alignment.group_links(links) == [([0], [0, 1]), ([1], [2])]


def test_two_to_two_links_overlap_where_both_change():
    assert alignment.group_links([(0, 0), (0, 1), (1, 0), (1, 1)]) == [([0], [0, 1]), ([1], [0, 1])]


def test_beads_cover_spans(spark):
    df = spark.createDataFrame([("f", "One two three. Four five six.", "Uno dos tres. Cuatro cinco seis."), ("empty", "", "x")], "filename string, source string, hypothesis string")
    rows = alignment.align_documents(df).collect()
    assert [(r["bead_idx"], r["source"], r["hyp_start"]) for r in rows] == [(0, "One two three.", 0), (1, "Four five six.", 14)]


def test_context_grows_by_sentences(spark):
    text = "Aaa bbb. Ccc ddd. Eee fff. Ggg hhh."

    def context(s1, e1, s2, e2, most, body=text):
        pairs = spark.createDataFrame([(1, s1, e1, s2, e2)], "doc_id int, s_start int, s_end int, o_start int, o_end int")
        return alignment.contexts(pairs, spark.createDataFrame([(1, body)], "doc_id int, body string"), most=most).first()["context"]

    assert context(9, 12, 13, 16, 10) == "Ccc ddd."
    assert context(13, 16, 9, 12, 20) == "Aaa bbb. Ccc ddd."
    assert context(9, 12, 13, 16, 27) == "Aaa bbb. Ccc ddd. Eee fff."
    assert context(18, 21, 22, 25, 18) == "Ccc ddd. Eee fff."
    assert context(0, 3, 4, 7, 27) == "Aaa bbb. Ccc ddd. Eee fff."
    assert context(0, 3, 31, 34, 5) == text
    assert context(27, 30, 31, 34, 1000) == text
    assert context(2, 3, 4, 5, 512, "no break at all") == "no break at all"


# pipelines with offline backends


def test_relations_end_to_end(spark):
    ents = spark.createDataFrame([(1, 0, 0, 3, "disease", "flu"), (1, 9, 9, 14, "symptom", "cough"), (1, 50, 50, 53, "symptom", "far")], "doc_id int, ent int, start int, end int, label string, text string")
    texts = spark.createDataFrame([(1, "flu with cough. " + "x" * 60)], "doc_id int, text string")
    got = pipelines.extracted_relations(ents, texts, B.TokenEntailment(), threshold=0.3, max_distance=20).collect()
    assert [(r["subject_text"], r["relation"], r["object_text"], r["score"]) for r in got] == [("flu", "has_finding", "cough", 0.75)]


def test_entities_from_a_lexicon(spark):
    docs = spark.createDataFrame([("a", "Flu. " * 3 + "fever and flu")], "filename string, text string")
    got = pipelines.found_entities(docs, B.Lexicon({"flu": "disease", "fever": "symptom"}), most=6).collect()
    assert sorted((r["start_span"], r["entity_label"], r["entity_kind"]) for r in got) == [(0, "disease", "concept"), (5, "disease", "concept"), (10, "disease", "concept"), (15, "symptom", "concept"), (25, "disease", "concept")]


def test_knowledge_base_checks_vocabulary_before_language(spark):
    conso = spark.createDataFrame([("C1", "BUL", "ATC", "x", "O"), ("C1", "ENG", "OTHER", "name", "N"), ("C1", "ENG", "OTHER", "old", "O"), ("C2", "ENG", "OTHER", "n2", "N")], "cui string, lat string, sab string, str string, suppress string")
    types = spark.createDataFrame([("C1", "T033"), ("C2", "T033")], "cui string, tui string")
    labels = spark.createDataFrame([(k, t) for k, v in V.SEMANTIC_TYPES.items() for t in v], "label string, tui string")
    got = pipelines.knowledge_base(conso, types, labels, V.ALLOWED_VOCABULARIES, "ENG", V.SUPPRESSED)
    assert {(r["cui"], r["name"]) for r in got.collect()} == {("C1", "name")} and got.count() == sum("T033" in v for v in V.SEMANTIC_TYPES.values())


def test_translation_scores_have_all_columns(spark):
    pairs = spark.createDataFrame([("f", "One two. Three four.", "One two. Three five.")], "filename string, source string, hypothesis string")
    row = pipelines.translation_scores(pairs, B.TokenOverlap(), B.HashedNgrams()).first()
    assert tuple(row.asDict()) == V.EVAL_COLUMNS and row["doc_bs_f1"] == 0.75 and row["n_aligned_sentences"] == 2 and row["kg_entity_f1"] is None


def test_failed_translation_gives_blanks(spark):
    class Broken:
        def translate(self, texts):
            raise OSError("down")

    got = pipelines.translated_entities(spark.createDataFrame([("a",)], "text string"), Broken()).first()
    assert got["translated_text"] == "" and got["expanded_text"] == "a"


def test_a_failed_batch_goes_text_by_text(spark):
    class Fussy:
        def translate(self, texts):
            if "bad" in texts:
                raise OSError("refused")
            return [t.upper() for t in texts if t != "lost"]

    rows = spark.createDataFrame([(t,) for t in ("a", "bad", "lost", "b")], "text string").coalesce(1)
    got = {r["text"]: r["translated_text"] for r in pipelines.translated_entities(rows, Fussy()).collect()}
    assert got == {"a": "A", "bad": "", "lost": "", "b": "B"}
    docs = pipelines.translated_documents(rows, Fussy()).collect()
    assert sorted(r["translation"] for r in docs) == ["A", "B"]


def test_prompted_translation():
    import json

    asked = []

    def ask(prompt):
        asked.append(prompt)
        texts = json.loads(prompt.splitlines()[-1])["texts"]
        return "Sure: " + json.dumps({"translations": [t + "!" for t in texts[:2]]})

    model = B.PromptedTranslator(ask)
    assert B.each_or_blank(model, ["x", "y"]) == ["x!", "y!"] and len(asked) == 1
    assert B.each_or_blank(model, ["x", "y", "z"]) == ["x!", "y!", "z!"] and len(asked) == 5


def test_mean_pooling_skips_padding():
    states = np.array([[[1.0, 3.0], [3.0, 5.0], [100.0, 100.0]], [[1.0, 1.0]] * 3])
    assert np.allclose(B.mean_pooled(states, np.array([[1, 1, 0], [0, 0, 0]])), [[2, 4], [0, 0]])


@pytest.mark.parametrize("text, want", [("Пациентът е приет", "bg"), ("The patient", "en"), ("", "en")])
def test_language_detector(text, want):
    assert B.CyrillicShare().detect(text) == want


def test_vectors_are_unit_or_zero(spark):
    df = spark.createDataFrame([("abc",), ("",)], "t string").select(F.aggregate(B.encode(F.col("t"), B.HashedNgrams()), F.lit(0.0), lambda s, x: s + x * x).alias("n"))
    assert sorted(round(r["n"], 5) for r in df.collect()) in ([0.0, 1.0], [1.0, 1.0])
