import re

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import text as T


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'int'}" for n, v in zip(names, values))
    return spark.createDataFrame([tuple(values)], schema).select(expr(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize("value", ["", "  a b ", " x ", " \tq\n", "a\n"])
def test_strip_is_unicode(spark, value):
    assert one(spark, T.strip, value) == value.strip()


@pytest.mark.parametrize("value", ["One. Two? three! 4 Five", "Първо. Второ. Third. X", "", "no end", "A.  \n B.C"])
def test_sentences_need_ascii_capitals(spark, value):
    body = re.sub(r"\s+", " ", value.strip())
    assert one(spark, T.sentences, value) == [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", body) if s]


@pytest.mark.parametrize("value", ["д-р Иван's x-y 3,5 _a", "", "a--b '' c'd-e", "naïve 漢字"])
def test_words_are_unicode(spark, value):
    assert one(spark, T.words, value) == re.findall(r"\b\w+(?:[-']\w+)*\b", value)


@pytest.mark.parametrize("value", ["", "a", "a\nb", "a\r\nb\rc", "a b\x0bc\x85d", "\n", "a\n\n"])
def test_line_count(spark, value):
    assert one(spark, T.line_count, value) == len(value.splitlines())


@pytest.mark.parametrize("stem, want", [("cardio_heart failure_26_x", "cardio_heart failure"), ("abc", "abc"), ("a_1_2", "a"), ("_1", "_1")])
def test_category(spark, stem, want):
    assert one(spark, T.category, stem) == want


@pytest.mark.parametrize("path, want", [("x/predictions_en_ner.tsv", "en"), ("EN/pred_BG.tsv", "bg"), ("a_en_bg_x.tsv", "bg"), ("plain.tsv", "unknown")])
def test_language_of_path(spark, path, want):
    assert one(spark, T.language_of_path, path) == want


@pytest.mark.parametrize("name, want", [("a/b.txt", "a/b_BGgpt.txt"), ("noext", "noext_BGgpt"), ("a.b.txt", "a.b_BGgpt.txt"), ("a.d/b", "a.d/b_BGgpt")])
def test_with_suffix(spark, name, want):
    assert one(spark, lambda c: T.with_suffix(c, "_BGgpt"), name) == want


def test_prediction_name(spark):
    assert one(spark, T.prediction_name, "cardiovascular_arterial hypertension_26_BGgpt_annotations (4).json") == "cardiovascular_arterial hypertension_26.txt"


@pytest.mark.parametrize("value, want", [("042", "42"), (" 7 ", "7"), ("x1", "x1"), ("1.5", "1.5")])
def test_span_text(spark, value, want):
    assert one(spark, T.span_text, value) == want


def test_span_number_truncates(spark):
    assert one(spark, T.span_number, "12.9") == 12 and one(spark, T.span_number, "x") is None


def test_mentions_are_whole_words_with_offsets(spark):
    got = one(spark, T.mentions, "BP was bp; BPX bp 😀bp", "Bp")
    assert [(m["start"], m["end"], m["text"]) for m in got] == [(0, 2, "BP"), (7, 9, "bp"), (15, 17, "bp"), (19, 21, "bp")]


@pytest.mark.parametrize("value", ["One. Two!\n\nThree", "a\n", "", "x.  ", "no", ". . ."])
def test_break_spans(spark, value):
    want, prev = [], 0
    for m in re.finditer(r"(?<=[.!?])\s+|\n+", value):
        want.append((prev, m.end()))
        prev = m.end()
    if prev < len(value):
        want.append((prev, len(value)))
    assert [tuple(s) for s in one(spark, T.break_spans, value)] == want


@pytest.mark.parametrize("most", [1, 8, 12, 100])
def test_chunks_cover_the_text(spark, most):
    value = "Aa bb. Cc dd! Ee ff gg hh ii? J.\nK. L"
    got = [tuple(c) for c in one(spark, lambda c: T.chunks(c, most), value)]
    assert "".join(value[s:e] for s, e in got) == value
    assert all(e - s <= most or len(re.findall(r"(?<=[.!?])[ \t]+|\n+", value[s:e])) <= 1 for s, e in got)
    assert all(b[1] - a[0] > most for a, b in zip(got, got[1:]))


def test_known_words_are_replaced_once(spark):
    known = {"АХ": "хипертония", "ИБС": "исх АХ", "АХ-2": "x"}
    assert one(spark, lambda c: T.replace_known(c, known), "АХ и ИБС. АХИ АХ-2") == "хипертония и исх АХ. АХИ x"
    assert one(spark, lambda c: T.annotate_known(c, {"BMI": "индекс"}), "bmi, BMI-x BMI") == "bmi (индекс), BMI-x BMI (индекс)"
    assert one(spark, lambda c: T.lookup(c, {"BMI": "i"}), "bmi") == "i" and one(spark, lambda c: T.lookup(c, {"BMI": "i"}), "x") is None


def test_normalised_and_cosine(spark):
    v = spark.sql("SELECT array(3.0f, 4.0f) v, array(0f, 0f) z").select(T.normalised(F.col("v")).alias("v"), T.normalised(F.col("z")).alias("z"))
    row = v.select("v", "z", T.cosine(F.col("v"), F.col("v")).alias("c")).first()
    assert row["v"] == pytest.approx([0.6, 0.8]) and row["z"] == [0, 0] and row["c"] == pytest.approx(1.0)
