import random

import numpy as np
import pytest

from lexigrid.operators import nearest


def brute(queries, kb, k, threshold, digits):
    out = []
    for q, kind, v in queries:
        scored = [(round(float(np.dot(v, w)), digits), n, c) for c, n, t, w in kb if t == kind]
        best = sorted((-s, n, c) for s, n, c in scored if s >= threshold)[:k]
        out += [(q, kind, c, n, -s, r + 1) for r, (s, n, c) in enumerate(best)]
    return sorted(out)


def clustered(rng, n, spread=0.05, dim=6, groups=12):
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    rows = []
    for _ in range(n):
        v = np.array([x + rng.gauss(0, spread) for x in rng.choice(middles)])
        rows.append([float(x) for x in v / np.linalg.norm(v)])
    return rows


@pytest.mark.parametrize("cell, threshold, unit", [(4096, -9.0, True), (20, -9.0, True), (20, 0.8, True), (3, 0.2, False), (20, -9.0, False)])
def test_equal_to_brute_force(spark, cell, threshold, unit):
    rng = random.Random(cell)
    kb = [(f"c{i}", f"n{i % 37}", rng.choice("xxy"), v) for i, v in enumerate(clustered(rng, 300))]
    queries = [(q, rng.choice("xyz"), v) for q, v in enumerate(clustered(rng, 60))]
    if not unit:
        kb = [(c, n, t, [x * (i % 5) for x in v]) for i, (c, n, t, v) in enumerate(kb)]
        queries = [(q, t, [-2 * x for x in v] if q % 3 else v) for q, t, v in queries]
    kb.append(("c0", "n0", "x", kb[0][3]))  # a repeated row
    got = nearest.top_candidates(
        spark.createDataFrame(queries, "q long, label string, vec array<double>"), spark.createDataFrame(kb, "cui string, name string, label string, vec array<double>").repartition(3), 4, threshold, ["label"], digits=4, cell=cell
    )
    assert sorted((r["q"], r["label"], r["cui"], r["name"], r["score"], r["rank"]) for r in got.collect()) == brute(queries, kb, 4, threshold, 4)


def test_most_blocks_are_skipped(spark):
    rng = random.Random(11)
    kb = [(f"c{i}", f"n{i}", v) for i, v in enumerate(clustered(rng, 2000, groups=40))]
    queries = spark.createDataFrame([(q, v) for q, v in enumerate(clustered(random.Random(11), 200, groups=40))], "q long, vec array<double>")
    base = spark.createDataFrame(kb, "cui string, name string, vec array<double>")
    centres, dealt, blocks = nearest.blocks_of(base, [], 50)
    first = nearest.visits(queries, [], centres, blocks, 5, -9.0)
    local = nearest.compared(first, dealt, [], 5, None, 50)
    ranked = nearest.top_per(local, ["q"], [nearest.F.col("score").desc(), "name", "cui"], 5)
    others = nearest.visits(queries, [], centres, blocks, 5, -9.0, ranked.filter("rank = 5").select("q", nearest.F.col("score").alias("kth")))
    met = first.count() + others.count()
    assert len(blocks) >= 40 and met < 0.3 * 200 * len(blocks)


def test_empty_sides(spark):
    queries, kb = spark.createDataFrame([(1, [1.0, 0.0])], "q long, vec array<double>"), spark.createDataFrame([("c", "n", [0.0, 0.0])], "cui string, name string, vec array<double>")
    assert nearest.top_candidates(queries, kb.limit(0), 3, -1.0).count() == 0 == nearest.top_candidates(queries.limit(0), kb, 3, -1.0).count()
    assert [r["score"] for r in nearest.top_candidates(queries, kb, 3, -1.0).collect()] == [0.0]


@pytest.mark.parametrize("cell, threshold, unit", [(4096, -9.0, True), (20, -9.0, True), (20, 0.8, True), (3, 0.2, False), (20, -9.0, False)])
def test_blocks_equal_brute_force(spark, monkeypatch, cell, threshold, unit):
    """The same where queries are too many for every task to get them."""
    monkeypatch.setattr(nearest, "FEW", 0)
    test_equal_to_brute_force(spark, cell, threshold, unit)
    test_empty_sides(spark)


@pytest.mark.parametrize("rows", [7, 20_000])
def test_few_queries_go_to_the_base(spark, monkeypatch, rows):
    """The base is neither placed nor shuffled, and stretches of it give the same as the whole."""
    monkeypatch.setattr(nearest, "TASK_ROWS", rows)
    rng = random.Random(rows)
    kb = [(f"c{i}", f"n{i % 5}", v) for i, v in enumerate(clustered(rng, 90))]
    queries = [(q, v) for q, v in enumerate(clustered(rng, 9))]
    got = nearest.top_candidates(spark.createDataFrame(queries, "q long, vec array<double>"), spark.createDataFrame(kb, "cui string, name string, vec array<double>").repartition(2), 4, 0.1, digits=1)
    assert "CoGroup" not in got._jdf.queryExecution().sparkPlan().toString()
    want = brute([(q, "x", v) for q, v in queries], [(c, n, "x", v) for c, n, v in kb], 4, 0.1, 1)
    assert sorted((r["q"], "x", r["cui"], r["name"], r["score"], r["rank"]) for r in got.collect()) == want


@pytest.mark.parametrize("by_type", [True, False])
def test_a_name_is_searched_once_for_all_its_concepts(spark, monkeypatch, by_type):
    from lexigrid.functions import backends as B
    from lexigrid.operators import matching
    from lexigrid.plans import pipelines

    searched, whole = [], matching.top_candidates
    monkeypatch.setattr(matching, "top_candidates", lambda queries, kb, *rest: searched.append(kb.count()) or whole(queries, kb, *rest))
    names = ["abc", "cab", "abd", "xyz"]
    kb = [(t, f"c{i:03}", n) for t in "xy" for n in names for i in range(40)] + [("x", "c001", "abc"), ("z", "c1", "abc")]
    asked = [(1, "abc", "x"), (2, "abc", "y"), (3, "bd", "x"), (4, "q", "x"), (5, None, "x"), (6, "abc", "none")]
    encoder = B.LetterCounts()
    out = pipelines.linked_entities(spark.createDataFrame(asked, "id int, text string, entity_label string"), spark.createDataFrame(kb, "label string, cui string, name string"), encoder, k=3, threshold=0.3, by_type=by_type, digits=4)
    got = {r["id"]: [(c["rank"], c["cui"], c["name"], c["score"]) for c in r["candidates"] or []] for r in out.collect()}
    rows = kb if by_type else sorted({("", c, n) for _, c, n in kb})
    want = {}
    for i, text, label in asked:
        scored = sorted((-round(float(np.dot(*encoder.encode([text, n]))), 4), n, c) for t, c, n in rows if text is not None and t == (label if by_type else ""))
        want[i] = [(r + 1, c, n, -s) for r, (s, n, c) in enumerate([x for x in scored if -x[0] >= 0.3][:3])]
    assert got == want and searched == [8 if by_type else 4]
