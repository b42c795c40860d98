import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import backends as B
from lexigrid.operators import setjoin
from lexigrid.plans import pipelines as P


def texts(rng, n):
    words = ["a", "b", "heart", "lung", "pain", "acute", "chronic", "left", "right", "ärztlich"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85, 1.0])
def test_candidates_hold_every_pair(spark, threshold):
    rng, scorer = random.Random(4), B.TokenOverlap()
    left, right = [(d, t) for d in range(4) for t in set(texts(rng, 40))], [(d, t) for d in range(1, 5) for t in set(texts(rng, 40))]
    frame = lambda rows, c: spark.createDataFrame(rows, f"doc_id int, {c} string")
    got = {tuple(r) for r in P.covered_pairs(frame(left, "s"), frame(right, "h"), scorer, threshold).select("doc_id", "s", "h").collect()}
    want = {(d, s, h) for d, s in left for e, h in right if d == e and scorer.score([h], [s])[0][2] >= threshold}
    assert got == want
    sets = lambda rows, c: frame(rows, c).withColumn("tokens", B.token_sets(F.col(c), scorer))
    met = setjoin.overlap_candidates(sets(left, "s"), sets(right, "h"), ["doc_id"], "s", "h", threshold)
    assert want <= {tuple(r) for r in met.select("doc_id", "s", "h").collect()}


def test_pairs_fall_on_documents(spark, sf):
    """Sentences of the corpus's documents against those of the document with the next id."""
    d = spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL")
    side = lambda shift, c: d.select((F.col("doc_id") - shift).alias("doc_id"), F.explode(F.split("text", r"[.\n]+")).alias(c)).filter(f"length({c}) > 20").distinct()
    a, b = side(0, "s"), side(1, "h")
    sets = lambda df, c: df.withColumn("tokens", B.token_sets(F.col(c), B.TokenOverlap()))
    met = setjoin.overlap_candidates(sets(a, "s"), sets(b, "h"), ["doc_id"], "s", "h", 0.85).count()
    assert met * 10 < a.join(b, "doc_id").count()


def test_text_cover_against_brute_force(spark):
    rng, scorer = random.Random(9), B.TokenOverlap()
    src, hyp = [(d, t) for d in range(3) for t in texts(rng, 30)], [(d, t) for d in range(1, 4) for t in texts(rng, 30)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, text string")

    class Plain:  # a scorer that tells no token sets
        score = staticmethod(scorer.score)

    want = {}
    for d in range(1, 3):
        a, b = ([t for e, t in rows if e == d and t] for rows in (src, hyp))
        reached = lambda mine, other, swap: sum(any(scorer.score(*(([y], [x]) if swap else ([x], [y])))[0][2] >= 0.6 for y in other) for x in mine) / len(mine)
        want[d] = (reached(b, a, False), reached(a, b, True))
    for one in (scorer, Plain()):
        got = {r["doc_id"]: (round(r["precision"], 9), round(r["recall"], 9)) for r in P.text_cover(frame(src), frame(hyp), one, 0.6).collect()}
        assert got == {d: tuple(round(x, 9) for x in v) for d, v in want.items()}


def test_cross_lingual_matches_against_brute_force(spark):
    rng, encoder = random.Random(6), B.LetterCounts()
    words = ["heart", "earth", "hart", "lung", "lungs", "pain", ""]
    row = lambda k: (f"f{rng.randint(0, 2)}", rng.choice([0, 1, None]), k, rng.choice("XY"), rng.choice(words))
    src, hyp = [row(k) for k in range(40)], [row(k) for k in range(40)]
    frame = lambda rows, c: spark.createDataFrame(rows, f"filename string, bead_idx int, {c} long, label string, text string")
    for same in (False, True):
        got = Counter((r["filename"], r["bead_idx"], r["i"], r["j"]) for r in P.cross_lingual_matches(frame(src, "i"), frame(hyp, "j"), encoder, 0.8, same, digits=6).collect())
        vec = {w: encoder.encode([w])[0].astype("float32").astype(float) for w in words}
        cands = defaultdict(list)
        for f, b, i, la, x in src:
            for g, c, j, lb, y in hyp:
                s = round(float(vec[x] @ vec[y]), 6)
                if (f, b) == (g, c) and x and y and s >= 0.8 and (not same or la == lb):
                    cands[f, -1 if b is None else b].append((s, i, j))
        want = Counter()
        used_i, used_j = set(), set()
        for (f, b), rows in cands.items():
            for s, i, j in sorted(rows, reverse=True):
                if i not in used_i and j not in used_j:
                    used_i.add(i)
                    used_j.add(j)
                    want[f, b, i, j] += 1
        want.update((f, -1 if b is None else b, i, None) for f, b, i, _, _ in src if i not in used_i)
        want.update((f, -1 if b is None else b, None, j) for f, b, j, _, _ in hyp if j not in used_j)
        assert got == want
