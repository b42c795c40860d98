import numpy as np
import pytest
import xxhash

from lexigrid.llm import decontaminate, simhash, syncmers
from lexigrid.llm.components import components
from lexigrid.llm.queries import QUERIES
from tests.llm.conftest import ROWS, documents


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(prints):
    """prints: [(doc, fp)] to the smallest doc reachable at 4 bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        r = find(i)
        least[r] = min(x for x in (least.get(r), doc) if x is not None) if (least.get(r), doc) != (None, None) else None
    return [least[find(i)] for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A b C d", "a b c d e f g a b c d e", "é É ß\u00a0x y z w v", "x " * 40_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_simhash_query_against_brute_force(spark, sf):
    rows = [(d, simhash.fingerprint(t)) for d, t, _, _ in documents(spark, sf)]
    assert rows[3][1] == brute_fingerprint(documents(spark, sf)[3][1])
    want = {d: (f"{fp:016x}", c) for (d, fp), c in zip(rows, brute_components(rows))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op2_simhash_dedup"](spark, sf).collect()}
    assert got == want and len(set(c for _, c in want.values())) < len(want)


def test_simhash_edges(spark, docs, no_docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by_text = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_text[1]["component_id"] == by_text[2]["component_id"] == 1
    assert by_text[3]["fingerprint"] == "0" * 16 and by_text[3]["component_id"] == by_text[4]["component_id"] == 3
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 5, 6, 7, 8, None]))


def test_keep_one_takes_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a b c", 5, 6, 7), (2, "a b c", 5, 6, 7)], "doc_id long, text string, id_of_row int, mark_of_row int, id_kept int")
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c", 5, 6, 7)]


def test_keep_one_keeps_one_row_of_each_group(spark):
    text = lambda k: " ".join(f"{k}word{i * i % 53}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (1, text("c")), (7, text("d")), (7, text("e")), (6, text("e")), (8, text("f")), (8, text("f"))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=lambda r: r[1]) == [(None, text("a")), (None, text("b")), (1, text("c")), (7, text("d")), (6, text("e")), (8, text("f"))]


@pytest.mark.parametrize("n", [2, 700, 10**6, 10**9, 10**12])
def test_blocks_leave_no_pair_out(n):
    masks = simhash.block_masks(n)
    rng = np.random.default_rng(n % 97)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(m & flips == 0 for m in masks)


@pytest.mark.parametrize("n", [6, 7, 20, 38, 51])
def test_splits_leave_no_pair_out(n):
    rng = np.random.default_rng(n)
    bits = [int(b) for b in rng.choice(64, n, replace=False)]
    masks = simhash.split_masks(sum(1 << b for b in bits))
    assert len(masks) == 15 and all(m and m & ~sum(1 << b for b in bits) == 0 for m in masks)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(bits, 4, replace=False))
        assert any(m & flips == 0 for m in masks)


def test_pivots_choose_pairs_of_a_run():
    """Links within runs equal all pairs compared bit by bit; runs are in order of their pivot rows."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ np.array([sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(60)], dtype=np.uint64) for b in base]))
    run, table = rng.integers(0, 3, len(fps)), simhash.pivot_table(fps)
    order = np.lexsort((*table.T[::-1], run))
    run, fps, table = run[order], fps[order], table[order]
    child, root = simhash.linked(run, fps, table)
    label = np.arange(len(fps))
    label[child] = root
    for r in range(3):
        inside = np.flatnonzero(run == r)
        want = brute_components([(int(i), int(fps[i])) for i in inside])
        assert [want[list(inside).index(i)] for i in label[inside]] == want and len(set(want)) == len(set(label[inside]))


def test_hot_bucket_keeps_every_link(spark):
    rng = np.random.default_rng(5)
    base = 0x0123456789ABCDEF
    fps = {base}
    while len(fps) < 400:  # a dense group, whose buckets are split
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    rows = [(i, fp) for i, fp in enumerate(sorted(fps))]
    df = spark.createDataFrame([(simhash._signed(fp),) for _, fp in rows], "fp long")
    found = components(simhash.links(df, most=64)).collect()
    number = {simhash._signed(fp): i for i, fp in rows}
    label = {number[r["node"]]: r["label"] for r in found}
    groups = {}
    for i, _ in rows:
        groups.setdefault(label.get(i, ("own", i)), []).append(i)
    want = {}
    for (i, _), c in zip(rows, brute_components(rows)):
        want.setdefault(c, []).append(i)
    assert sorted(groups.values()) == sorted(want.values())


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_leaks(texts, items):
    out = set()
    for d, text in texts:
        words = decontaminate.words_of(text)
        for i, item in items:
            iw = decontaminate.words_of(item)
            if len(iw) < decontaminate.LEAST_WORDS:
                continue
            row = [0] * (len(words) + 1)
            for a, w in enumerate(iw, 1):
                last, row = row, [a]
                for b, x in enumerate(words, 1):
                    row.append(min(last[b - 1] + (w != x), last[b] + 1, row[b - 1] + 1))
            if min(row) <= decontaminate.edits_allowed(len(iw)):
                out.add((d, i))
    return out


def test_leaks_and_recall_against_brute_force(spark, sf):
    rng = np.random.default_rng(3)
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [(d, t) for d, t, _, _ in documents(spark, sf)][:40]
    texts = [(d, (t or "")[:1500]) for d, t in clean]
    for n in range(80):
        words = decontaminate.words_of(items[n % len(items)][1])
        for _ in range(rng.integers(0, len(words) // 4 + 1)):
            at = int(rng.integers(0, len(words)))
            kind = rng.integers(0, 3)
            words[at : at + (kind != 1)] = [] if kind == 2 else [f"new{rng.integers(0, 50)}"]
        around = texts[n % 40][1].split(" ")
        texts.append((1000 + n, " ".join(around[:50] + [w.upper() + "##" for w in words] + around[50:90])))
    want = brute_leaks(texts, items)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(want) > 40 and len(got) >= 0.95 * len(want)


def test_decontamination_edges(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "THE cat; sat on the mat, and the dog ran"), (2, None), (3, "the"), (None, "")], "item_id long, text string")
    got = decontaminate.find_leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["start"], r["end"], r["edits"]) for r in got) == [(1, 1, 0, 10, 0), (2, 1, 0, 10, 0), (2, 1, 0, 10, 0)]
    assert decontaminate.find_leaks(no_docs, items).count() == 0 == decontaminate.find_leaks(docs, items.limit(0)).count()
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3


def test_short_items_match_as_they_are(spark):
    items = [(1, "alpha beta gamma delta"), (2, "alpha beta"), (3, "omega"), (4, "kappa lambda mu nu xi")]
    texts = [(1, "x alpha, beta GAMMA delta y"), (2, "alpha beta gamma other delta"), (3, "omega"), (4, "the omega point"), (5, "kappa lambda mu nu"), (6, "q kappa lambda mu nu q")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["start"], r["end"], r["edits"]) for r in decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(1, 1, 1, 5, 0), (1, 2, 1, 3, 0), (2, 2, 0, 2, 0), (3, 3, 0, 1, 0), (5, 4, 0, 4, 1), (6, 4, 1, 5, 1)]


def test_the_index_alone_finds_items_at_the_limit_of_edits(spark, sf):
    """Recall of the LSH where each item has as many edits as are allowed; the best match is that of a cell-by-cell table."""
    rng = np.random.default_rng(11)
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    index = decontaminate.Items(items)
    found = total = 0
    for n in range(300):
        number = n % len(items)
        words = decontaminate.words_of(items[number][1])
        for _ in range(decontaminate.edits_allowed(len(words))):
            at, kind = int(rng.integers(0, len(words))), rng.integers(0, 3)
            words[at : at + (kind != 1)] = [] if kind == 2 else [f"new{rng.integers(0, 50)}"]
        found += any(index.ids[h[1]] == items[number][0] for h in index.search(["before it " + " ".join(words) + " after it"]))
        total += 1
    assert found >= 0.95 * total


def brute_best(item, stretch):
    row = [(0, j, j) for j in range(len(stretch) + 1)]
    for i, word in enumerate(item, 1):
        last, row = row, [(i, 0, 0)]
        for j, other in enumerate(stretch, 1):
            a, b, c = last[j - 1], last[j], row[j - 1]
            row.append((*min((a[0] + (word != other), a[1]), (b[0] + 1, b[1]), (c[0] + 1, c[1])), j))
    return min(row)


def test_best_match_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item, stretch = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        assert decontaminate.best_match(item, stretch) == brute_best(item.tolist(), stretch.tolist())


def test_blocks_of_a_large_benchmark_find_the_same(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = lambda: sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    once = rows()
    monkeypatch.setattr(decontaminate, "item_blocks", lambda b, i, t, f=decontaminate.item_blocks: f(b, i, t, 3000))
    assert rows() == once



def test_syncmer_query(spark, sf):
    rows = sorted(((d, t or "") for d, t, _, _ in documents(spark, sf)), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in QUERIES["op6_syncmers"](spark, sf).collect()}
    import hashlib

    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    long = [got[d] for d, t in rows if len(t) > 500]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.5 > 0.2 > sum(r["near_next"] for r in long) / len(long)
    by_text = {}
    for d, t in rows:
        assert by_text.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]


def brute_anchors(text):
    """The anchors by the rule, one k-mer after the other."""
    import re

    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else signed(p).to_bytes(8, "little", signed=True), seed)
        return seed

    short = lambda x: x >> 32

    def closed(units):
        h = [chain(u) for u in units]
        out = []
        for i in range(len(h) - 4):
            inner = [chain(h[j], h[j + 1]) for j in range(i, i + 4)]
            if signed(min(inner, key=signed)) in (signed(inner[0]), signed(inner[3])):
                out.append(short(chain(inner[0], inner[2], h[i + 4])))
        return out

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    n, found = len(words), []
    if n >= 20:
        found += closed([u for w in words for u in (list(w) if len(w) > 64 else [w])])
    if n < 40:
        letters = list(" ".join(words))
        h = [chain(u) for u in letters]
        found += closed(letters) if len(letters) >= 32 else [short(chain(chain(h[i], h[i + 1]), h[i + 2])) for i in range(len(h) - 2)]
    return found or ([short(chain(*words))] if words else [])


def brute_likeness(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_syncmer_query_against_brute_force(spark, sf):
    rows = sorted(((d, t or "") for d, t, _, _ in documents(spark, sf)), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in QUERIES["op6_syncmers"](spark, sf).collect()}
    anchors = {d: brute_anchors(t) for d, t in rows}
    hexed = lambda found: "".join(f"{x:08x}" for x in found)
    for (d, t), (after, following) in zip(rows, rows[1:] + rows[:1]):
        third = len(t) // 3
        edited = brute_anchors(t[: len(t) - third] + following[:third])
        assert (got[d]["fingerprint"], got[d]["edited_fingerprint"]) == (hexed(anchors[d]), hexed(edited))
        assert got[d]["near_edited"] == pytest.approx(brute_likeness(anchors[d], edited))
        assert got[d]["near_next"] == pytest.approx(brute_likeness(anchors[d], anchors[after]))


def test_one_id_of_most_rows_has_many_ranges(spark):
    df = spark.createDataFrame([(None, i * 7919 % 9973, i) for i in range(3000)] + [(i, 0, -i) for i in range(500)], "k long, tie long, v long")
    starts = syncmers.range_starts(df.select(syncmers.in_order("k", "tie").alias("o")), 16)
    sizes = [r["count"] for r in df.groupBy(syncmers.range_of(syncmers.in_order("k", "tie"), starts).alias("p")).count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 900
    got = {r["v"]: r["next_v"] for r in syncmers.with_next(df, "k", "tie", ["v"], 16).collect()}
    order = sorted(df.collect(), key=lambda r: (r["k"] is None, -(r["k"] or 0), r["tie"]))
    assert got == {a["v"]: b["v"] for a, b in zip(order, order[1:] + order[:1])}


def test_syncmers_are_closed_and_context_free(spark):
    words = [f"w{i * i % 31}" for i in range(60)]
    texts = [(1, " ".join(words)), (2, " ".join(["other", "start"] + words)), (3, "a b"), (4, ""), (5, "a\tb")]
    df = syncmers.with_anchors(spark.createDataFrame(texts, "doc_id long, text string"), "text", "anchors")
    got = {r["doc_id"]: r["anchors"] for r in df.collect()}
    assert got[1] == got[2][-len(got[1]) :] and len(got[1]) > 10
    assert len(got[3]) == 1 and got[4] == [] and got[5] == got[3]
    hashed = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").selectExpr("i", "xxhash64(w) h").orderBy("i").collect()
    h = [r["h"] for r in hashed]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(h, h[1:]))], "i int, a long, b long").selectExpr("i", "xxhash64(a, b) g").orderBy("i").collect()
    g = [r["g"] for r in pairs]
    closed = [i for i in range(len(words) - 4) if min(g[i : i + 4]) in (g[i], g[i + 3])]
    assert len(got[1]) == len(closed)


def test_edited_short_texts_stay_alike(spark):
    spaceless = "".join(chr(0x4E00 + i * i * 7 % 2003) for i in range(900))
    sizes = [2, 4, 7, 12, 19, 20, 21, 39, 40, 41]
    whole = [" ".join(f"{'abcdefgh'[(n + i * i) % 8]}or{i * n % 89}en" for i in range(n)) for n in sizes] + [spaceless]
    after = ["xq zu " * 400]
    rows = [(2 * i, t) for i, t in enumerate(whole)] + [(2 * i - 1, after[0]) for i in range(len(whole))]
    got = {r["doc_id"]: r for r in syncmers.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i]["near_edited"] > 0.1 > got[2 * i]["near_next"] for i in range(len(whole)))


def test_syncmer_edges(spark, docs, no_docs):
    got = syncmers.compare_edits(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["fingerprint"] == "" and by_id[3]["n_chars"] == 0 and by_id[4]["near_next"] == 1.0
    assert syncmers.compare_edits(no_docs).count() == 0
    one = syncmers.compare_edits(docs.filter("doc_id = 1")).first()
    assert one["near_next"] == 1.0


def test_syncmer_plan_has_no_python(spark, sf):
    import re

    plan = QUERIES["op6_syncmers"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


@pytest.mark.parametrize("keys", [[], [None], [None, None, 3], [5, 5, 5], list(range(50)), [1, 1000, 10**15, -7, None, 2]])
def test_next_row_across_buckets(spark, keys):
    df = spark.createDataFrame([(k, f"{k}-{i}", i) for i, k in enumerate(keys)], "k long, v string, tie int")
    got = {r["v"]: r["next_v"] for r in syncmers.with_next(df, "k", "tie", ["v"], 8).collect()}
    order = sorted(((k, f"{k}-{i}", i) for i, k in enumerate(keys)), key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    assert got == {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}
