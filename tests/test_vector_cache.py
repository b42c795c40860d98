import re

from lexigrid.functions import backends as B
from lexigrid.plans import pipelines as P
from lexigrid.sources import vector_cache as C


class Counting:
    """An encoder that counts the texts it is asked for."""

    def __init__(self, spark):
        self.asked = spark.sparkContext.accumulator(0)

    def encode(self, texts):
        self.asked.add(len(texts))
        return B.LetterCounts().encode(texts)


def texts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "text string")


def test_only_missing_texts_are_encoded(spark, tmp_path):
    encoder, path = Counting(spark), str(tmp_path / "cache")
    got = {r["text"]: list(r["vec"]) for r in C.cached_vectors(texts(spark, "heart", "lung", "heart", None, ""), encoder, "letters", path, 4).collect()}
    assert encoder.asked.value == 3 and set(got) == {"heart", "lung", ""}
    again = C.cached_vectors(texts(spark, "lung", "liver"), encoder, "letters", path, 4)
    assert {r["text"] for r in again.collect()} == {"lung", "liver"} and encoder.asked.value == 4
    C.cached_vectors(texts(spark, "lung"), encoder, "another", path, 4).collect()
    assert encoder.asked.value == 5
    assert C.cached_vectors(texts(spark).limit(0), encoder, "letters", path, 4).count() == 0


def test_two_writers_and_a_new_session(spark, tmp_path):
    encoder, path = Counting(spark), str(tmp_path / "cache")
    C.cached_vectors(texts(spark, "a", "b"), encoder, "letters", path, 4)
    spark.table(C.cache_table(spark, path, 4)).filter("text = 'a'").write.insertInto(C.cache_table(spark, path, 4))  # the same text again
    spark.sql(f"DROP TABLE {C.cache_table(spark, path, 4)}")  # forgets the table, not its files
    assert sorted(r["text"] for r in C.cached_vectors(texts(spark, "a", "b"), encoder, "letters", path, 4).collect()) == ["a", "b"] and encoder.asked.value == 2


def test_the_cache_is_not_moved(spark, tmp_path):
    path = str(tmp_path / "cache")
    found = C.cached_vectors(texts(spark, *(f"t{i}" for i in range(50))), B.LetterCounts(), "letters", path, 4)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    scan = plan.index("FileScan parquet")
    assert "Bucketed: true" in plan[scan:] and not re.search(r"Exchange hashpartitioning\(text#\d+, 4\)[^\n]*\n[^\n]*FileScan", plan)
    above = plan[:scan].rsplit("\n", 12)
    assert "SortMergeJoin" in plan and not any("Exchange" in line for line in above[-4:])


def test_a_second_run_of_linking_encodes_nothing(spark, tmp_path):
    encoder, cache = Counting(spark), ("letters", str(tmp_path / "cache"))
    ents = spark.createDataFrame([("d", "heart", "x"), ("d", "earth", "x"), ("e", "lung", "y")], "doc string, text string, entity_label string")
    kb = spark.createDataFrame([("C1", "hearth", "x"), ("C2", "lungs", "y")], "cui string, name string, label string")
    run = lambda: sorted((r["doc"], r["text"], tuple(map(tuple, r["candidates"] or ()))) for r in P.linked_entities(ents, kb, encoder, threshold=0.5, cache=cache).collect())
    first, asked = run(), encoder.asked.value
    assert asked == 5 and run() == first and encoder.asked.value == asked
    plain = P.linked_entities(ents, kb, B.LetterCounts(), threshold=0.5)
    assert sorted((r["doc"], r["text"], tuple(map(tuple, r["candidates"] or ()))) for r in plain.collect()) == first
