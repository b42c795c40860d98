import random

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import backends as B
from lexigrid.functions import text as T
from lexigrid.operators import dictionary
from lexigrid.plans import pipelines as P


@pytest.mark.parametrize("template", ["{expansion}", "{token} ({expansion})"])
def test_equal_to_one_pattern(spark, template):
    rng = random.Random(3)
    parts = ["АХ", "ИБС", "д-р", "ж.к", "a", "b", "a/b", " ", "  ", "-", ".", "\n", "x1", "и", "(a)", "."]
    known = {"АХ": "хипертония", "ИБС": "исх АХ", "д-р": "доктор", "ж.к": "жк", "a/b": "ab", "a": "1", "a b": "2 a", "(a)": "p", "a.b.a": "3", "x": "никога", "ИБС и АХ": "all"}
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for k in range(300)] + [(900, None), (901, ""), (902, "АХ"), (903, "ИБС и АХ")]
    df = spark.createDataFrame(rows + rows[:5], "id int, text string").repartition(3)
    table = spark.createDataFrame(list(known.items()) + [("АХ", "хипертония"), ("", "blank"), ("none", None)], "phrase string, expansion string")
    got = dictionary.replace_from_table(df, "text", table, "new", template).withColumn("want", T.replace_known(F.col("text"), known, template))
    rows = got.collect()
    assert len(rows) == df.count() and all(r["new"] == r["want"] for r in rows) and got.columns == ["id", "text", "new", "want"]


def test_many_phrases(spark):
    table = spark.range(100_000).select(F.concat(F.lit("k"), "id", F.lit(" v")).alias("phrase"), F.concat(F.lit("e"), "id").alias("expansion"))
    df = spark.range(2000).select("id", F.concat(F.lit("see k"), F.col("id") * 40, F.lit(" v, k"), "id", F.lit(" w and k5 v.")).alias("text"))
    got = dictionary.replace_from_table(df, "text", table, "new")
    assert got.filter(F.col("new") == F.concat(F.lit("see e"), F.col("id") * 40, F.lit(", k"), "id", F.lit(" w and e5."))).count() == 2000


def test_a_text_of_many_matches(spark):
    df = spark.createDataFrame([(1, "a b " * 20_000)], "id int, text string")
    got = dictionary.replace_from_table(df, "text", spark.createDataFrame([("a", "x")], "phrase string, expansion string"), "new").first()["new"]
    assert got == "x b " * 20_000


def test_translation_with_a_table_of_phrases(spark):
    ents = spark.createDataFrame([(1, "АХ от 2010"), (2, "без")], "id int, text string")
    known = {"АХ": "хипертония"}
    table = spark.createDataFrame(list(known.items()), "phrase string, expansion string")
    run = lambda k: sorted(map(tuple, P.translated_entities(ents, B.Dictionary({"хипертония от 2010": "hypertension"}), k).collect()))
    assert run(table) == run(known) and ("hypertension" in run(table)[0])
