import re

import pytest

from lexigrid.operators import dictionary
from lexigrid.operators.durable import BATCH_ROWS, bound_batches
from lexigrid.plans import standins as S
from lexigrid.plans.files import QUERIES


@pytest.mark.parametrize("name", ["entity_match_rows", "concept_scores", "translation_evaluation", "document_alignment_entities", "document_alignment_relations"])
def test_composites_read_their_inputs_once(spark, sf, name):
    """What several branches read is cut, so that a plan does not multiply scans."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall(r"FileScan", plan)) <= 20


def scans(df):
    return len(re.findall(r"FileScan", df._jdf.queryExecution().sparkPlan().toString()))


@pytest.mark.parametrize("name, most", [("entity_linking", 0), ("relations_extracted", 5), ("cross_lingual_matching", 0), ("entity_match_rows", 0)])
def test_mentions_are_looked_up_once(spark, sf, name, most):
    assert scans(QUERIES[name](spark, sf)) <= most


def test_a_text_is_split_once(spark, sf):
    for side in ("gold", "pred"):
        assert S.mentions(spark, sf, side)._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1


def test_tokens_of_texts_with_odd_ends(spark):
    rows = [(1, "thon thon  qui\nthon thon\n"), (2, "für"), (3, ""), (4, None), (5, "\U0001f600 für \U0001f600thon für"), (6, " thon "), (None, "thin")]
    got = S.found_tokens(spark.createDataFrame(rows, "k int, text string").coalesce(1), "k", "text", "gold").collect()
    assert {tuple(r)[:4] for r in got} == {(1, 0, 4, "thon"), (1, 5, 9, "thon"), (2, 0, 3, "für"), (5, 2, 5, "für"), (5, 12, 15, "für"), (6, 1, 5, "thon"), (None, 0, 4, "thin")}
    assert len(got) == 7 and {r["label"] for r in got if r["text"] == "thin"} == {"medication"}


def test_few_first_units_are_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b, c"), (2, "c a b")], "id int, text string")
    table = spark.createDataFrame([("a b", "x"), ("c", "y")], "phrase string, expansion string")
    run = lambda: dictionary.replace_from_table(df, "text", table, "new")
    joined = lambda out: "BroadcastHashJoin [first" in out._jdf.queryExecution().sparkPlan().toString()
    few = run()
    monkeypatch.setattr(dictionary, "HEADS", 0)
    many = run()
    assert joined(few) and not joined(many)
    assert sorted(r["new"] for r in few.collect()) == sorted(r["new"] for r in many.collect()) == ["x, y", "y x"]


def test_batches_are_bounded_where_they_are_not_lower(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for now, then in (("10000", str(BATCH_ROWS)), ("0", str(BATCH_ROWS)), ("7", "7")):
            spark.conf.set(key, now)
            bound_batches(spark)
            assert spark.conf.get(key) == then
    finally:
        spark.conf.set(key, before)
