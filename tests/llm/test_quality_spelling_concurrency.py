import datetime
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexigrid.llm import concurrency, quality, shared, spelling
from lexigrid.llm.queries import QUERIES
from tests.llm.conftest import documents

SPACE = r"[^\x20\x09-\x0D]+"


# --- quality rules ---


def brute_counts(text):
    words = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("text", ["", "a", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 30, "é ü \x0b\x0c\r\n\n \n$$ ñ\U0001f600", "a\nb\na\n a\n\n\n", " a\x1cb\x85c", "q " + "a b c d e f g h i j k l m n " * 2])
def test_counts_of_a_text(text):
    assert quality.counted(text.encode()) == brute_counts(text)


def brute_grams(text):
    pieces = [p.encode() for p in re.findall(r"(?:[A-Za-z0-9_]|[^\x00-\x7f])+|[^A-Za-z0-9_\x80-\U0010ffff\x20\x09-\x0d]+", text)]
    codes = [zlib.crc32(p) for p in pieces]
    one = [(c * 0x9E3779B1 + 1) % 2**32 for c in codes]
    two = [((a * 0x85EBCA6B) % 2**64 ^ (b * 0xC2B2AE35 + 7) % 2**64) % 2**32 for a, b in zip(codes, codes[1:])]
    return [x >> (32 - quality.LOG_BUCKETS) for x in one + two]


def test_quality_query_against_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op11_quality_rules"](spark, sf).collect()}
    labels = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels[r["doc_id"]].add((r["quality"], r["toxic"]))
    texts = {d: t or "" for d, t, _, _ in documents(spark, sf)}
    assert set(got) == set(texts)
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    good = {d for d, v in labels.items() if v == {(1, 0)}}
    raw, target = Counter(), Counter()
    for d, t in texts.items():
        grams = brute_grams(t)
        raw.update(grams)
        if d in good and not held(d):
            target.update(grams)
    whole, buckets = sum(raw.values()), 2**quality.LOG_BUCKETS
    for d, t in texts.items():
        n_words, chars, symbols, dup, repeated = brute_counts(t)
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n_words, chars, symbols, dup, repeated)
        assert r["base_failed"] == (n_words < 20 or 100 * repeated > 30 * n_words)
        logs = [np.log((target[g] * (whole + buckets) / (raw[g] + 1) + quality.LEAN) / (sum(target.values()) + quality.LEAN)) for g in brute_grams(t)]
        assert r["ratio"] == pytest.approx(np.mean(logs) if logs else 0.0, abs=1e-9)
    ratios = [(r["ratio"], r["kept"]) for r in got.values() if not r["base_failed"]]
    assert all(k for x, k in ratios if x >= min((x for x, k in ratios if k), default=9)) and not any(r["kept"] for r in got.values() if r["base_failed"])


def test_quality_parts_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op11_quality_rules"](spark, sf).collect()
    held = [r for r in got if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    good = [r["kept"] for r in held if labels[r["doc_id"]] == (1, 0) and not r["base_failed"]]
    bad = [r["kept"] for r in held if labels[r["doc_id"]][0] == 0]
    assert len(good) > 40 and sum(good) / len(good) >= 0.97
    assert len(bad) > 5 and sum(bad) / len(bad) <= 0.1


def test_quality_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, None), (5, 0, 0), (None, 1, 0), (6, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count() and sum(r["doc_id"] == 2 for r in got) == 2
    empty = [r for r in got if r["doc_id"] in (3, 4)]
    assert all((r["n_words"], r["word_chars"], r["ratio"], r["base_failed"], r["kept"]) == (0, 0, 0.0, True, False) for r in empty)
    assert quality.quality(no_docs, labels).collect() == []
    none = quality.quality(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] and abs(r["ratio"]) < 1e-9 for r in none)  # nothing to learn from: the base decides


def test_labels_are_bounded_and_agree(spark):
    rows = [(i % 50, 1, 0) for i in range(1000)] + [(100 + i, 0, 0) for i in range(40)] + [(7, 0, 0), (8, 1, 1)]
    got = quality.labelled_ids(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), 30).collect()
    assert Counter(r["good"] for r in got) == {True: 30, False: 30} and len({r["id"] for r in got}) == 60
    assert not {7, 8} & {r["id"] for r in got}


def test_every_label_counts(spark):
    labels = spark.range(90_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic")
    got = quality.labelled_ids(labels).groupBy("good").count().collect()
    assert {r["good"]: r["count"] for r in got} == {True: 45_000, False: 45_000}


# --- spelling variants ---


def brute_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    keyed = defaultdict(set)  # by what one deletion leaves, and by the word with a hole
    for w in words:
        for i in range(len(w)):
            keyed[w[:i] + w[i + 1 :]].add(w)
            keyed[w[:i] + "\0" + w[i + 1 :]].add(w)
    near = {w: {x for i in range(len(w)) for k in (w[:i] + w[i + 1 :], w[:i] + "\0" + w[i + 1 :]) for x in keyed[k] | {k} if x in words and brute_near(w, x)} for w in words}
    for w in words:
        for x in near[w]:
            near[x].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def variants_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_query_against_brute_force(spark, sf):
    got = variants_of(QUERIES["op12_spelling_variants"](spark, sf))
    assert got == brute_variants([(d, t) for d, t, _, _ in documents(spark, sf)]) and any(v[0] for v in got.values())


def neighbours_of(word, alphabet):
    letters = np.array([ord(a) for a in alphabet], dtype=np.uint64)
    words = spelling.Words(["other", word, "zz"])
    every = words.neighbours(letters, lambda h: np.ones(h.shape, dtype=bool))
    return [s for k, s in (words.spelt(kind, place, alphabet[a] if kind else "") for kind, place, a in every) if k == 1], words


@pytest.mark.parametrize("word", ["aabbaa", "abcabc", "aaaaaa", "éàüzzz", "a"])
def test_a_neighbourhood_is_full_and_distinct(word):
    alphabet = "abcéz"
    got, _ = neighbours_of(word, alphabet)
    want = {word[:i] + word[i + 1 :] for i in range(len(word))}
    want |= {word[:i] + a + word[i + 1 :] for i in range(len(word)) for a in alphabet if a != word[i]}
    want |= {word[:i] + a + word[i:] for i in range(len(word) + 1) for a in alphabet}
    assert len(got) == len(set(got)) and set(got) == want


def test_hashed_edits_are_the_hashes_of_the_edited_words():
    alphabet, word = "abcü", "abcabüc"
    got, words = neighbours_of(word, alphabet)
    letters, seen = np.array([ord(a) for a in alphabet], dtype=np.uint64), []

    def note(h):
        seen.append(h.ravel())
        return np.ones(h.shape, dtype=bool)

    list(spelling.Words([word]).neighbours(letters, note))
    assert set(spelling.Words(got).hashes().tolist()) <= set(np.concatenate(seen).tolist())


def test_spelling_edges(spark, docs, no_docs):
    assert variants_of(spelling.spelling_variants(no_docs)) == {}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert variants_of(spelling.spelling_variants(docs)) == brute_variants(rows)
    long = "ab" * 3000  # a very long word, its variant, a chain of forms and a tie
    texts = [(i, f"{long} " * 5) for i in range(5)] + [(9, (long[:-1] + " ") * 5)]
    texts += [(None, "zabcde " * 5), (10, "zabcdf " * 30), (11, "zabcgf " * 200), (12, "zabcdef " * 30), (13, "Éabcdef éabcdef " * 6)]
    got = variants_of(spelling.spelling_variants(spark.createDataFrame(texts, "doc_id long, text string")))
    assert got == brute_variants(texts)
    assert got["zabcde"] == ("zabcdef", "zabcdef", 5, 2, 30) and got["zabcdf"][1] == "zabcgf"


def test_filter_lets_all_words_through(spark):
    words = [f"wörd{i}xyz" for i in range(3000)]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long").repartition(3)
    held = spelling.filter_of(df, 3000)
    one, two = spelling.positions(spelling.Words(words).hashes(), len(held) * 8)
    for at in (one, two):
        assert ((held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all()


# --- peak concurrency ---


def brute_open(rows, step=900):
    """Group by group and moment by moment, over (group, start, end, cents)."""
    held = defaultdict(list)
    for g, s, e, c in rows:
        held[g].append((s, e, c))
        held[-2].append((s, e, c))
    out = []
    for g, spans in held.items():
        last, high, mine = (0, 0), 0, []
        for t in sorted({s for s, _, _ in spans} | {e for _, e, _ in spans if e is not None}):
            now = [c for s, e, c in spans if s <= t and (e is None or e > t)]
            starts = [c for s, _, c in spans if s == t]
            ends = [c for _, e, c in spans if e == t]
            if len(starts) != len(ends) or sum(starts) != sum(ends):
                high = max(high, len(now))
                mine.append([g, t, None, len(now), sum(now), high])
        for a, b in zip(mine, mine[1:]):
            a[2] = b[1]
        peak = max((m[3] for m in mine), default=0)
        out += [tuple([*m, m[3] == peak]) for m in mine]
    return sorted(out)


def swept(df):
    return sorted(tuple(r[c] for c in ("group", "from_s", "to_s", "n_open", "open_cents", "high_open", "is_peak")) for r in df.collect())


@pytest.mark.parametrize("per_range", [1, 3, 1024])
def test_sweep_against_brute_force(spark, per_range):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(300):
        s = int(rng.integers(-40, 60)) * 900
        rows.append((int(rng.integers(0, 3)), s, None if rng.random() < 0.1 else s + 900 * int(rng.integers(1, 30)), int(rng.integers(0, 5)) * 100))
    rows += [(7, 0, 900, 5), (7, 900, 1800, 5), (8, 0, 900, 5), (8, 900, None, 6)]
    df = spark.createDataFrame(rows, "`group` int, start long, end long, cents long")
    assert swept(concurrency.concurrency(df, per_range=per_range)) == brute_open(rows)
    assert concurrency.concurrency(df.limit(0)).collect() == []


def test_open_sales_edges(spark):
    t = datetime.datetime
    sales = [
        (1, 1, 10.005, t(2024, 1, 1, 0, 14, 59, 999999)), (1, 1, 10.005, t(2024, 1, 1, 0, 14, 59)), (2, None, None, t(2024, 1, 1, 1)),
        (3, 9, float("nan"), t(2024, 1, 1, 1)), (4, 2, 1e300, t(1969, 12, 31, 23, 59)), (5, 3, -1.5, None), (6, 3, 1.0, t(2024, 1, 1, 0, 1)), (None, 3, 2.0, t(2024, 3, 31, 2, 30)),
    ]
    lines = [(1, t(2024, 1, 1, 1)), (1, t(2024, 1, 1, 2, 1)), (1, None), (2, None), (6, t(2024, 1, 1, 0, 14)), (None, t(2024, 1, 9)), (4, t(1970, 1, 1, 0, 15))]
    clients = [(1, 5), (2, None), (3, 4), (3, 6), (None, 8)]
    args = (
        spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz").withColumn("salt", F_lit()),
        spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz"),
        spark.createDataFrame(clients, "client_id long, nation_id int"),
    )
    first = 1704067200
    want = sorted([(5, first, first + 7200, 1001), (5, first, first + 7200, 1001), (-1, first + 3600, None, 0), (-1, first + 3600, None, 0), (-1, -900, 900, 0), (6, 1711852200, None, 200)], key=str)
    for zone in ("UTC", "Europe/Berlin"):
        before = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = concurrency.open_sales(*args).select("group", "start", "end", "cents").collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
        assert sorted(map(tuple, got), key=str) == want
    assert concurrency.open_sales(*(a.limit(0) for a in args)).collect() == []


def F_lit():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_sweep_query_against_brute_force(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").collect()
    seconds = lambda x: (x - datetime.datetime(1970, 1, 1)) // datetime.timedelta(seconds=900) * 900
    ends, nations = {}, {r["client_id"]: r["nation_id"] for r in read("clients")}
    for r in read("sale_lines"):
        if r["shipped_at"] is not None:
            ends[r["sale_id"]] = max(ends.get(r["sale_id"], r["shipped_at"]), r["shipped_at"])
    rows = []
    for r in read("sales"):
        if r["sold_at"] is not None:
            s, e = seconds(r["sold_at"]), seconds(ends[r["sale_id"]]) if r["sale_id"] in ends else None
            nation = nations.get(r["client_id"])
            if e is None or e > s:
                rows.append((-1 if nation is None else nation, s, e, int(np.floor(100 * (r["total"] or 0) + 0.5))))
    got = QUERIES["op13_peak_concurrency"](spark, sf).withColumnRenamed("nation_id", "group")
    assert swept(got) == brute_open(rows)


# --- spreading hot keys ---


def test_hot_keys_have_an_absolute_limit(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 50)
    assert shared.key_limit(10**12) == 50 and shared.key_limit(1024) == 2 and shared.key_limit(0) == 1
    # a key just under total / HOT, which no part of the whole would call hot
    rows = spark.range(40_000).selectExpr("CASE WHEN id < 75 THEN -1 ELSE id END AS k", "id").coalesce(2)
    total = rows.count()
    assert 75 < total // shared.HOT
    hot = shared.hot_keys(rows, ["k"], total)
    assert [(r["k"], r["times"]) for r in hot.collect()] == [(-1, 75)]
    per = rows.groupBy("k").count().withColumnRenamed("count", "times")
    for how, n in (("inner", 40_000), ("left", 40_000), ("left_semi", 40_000), ("left_anti", 0)):
        assert shared.join_spread(rows, per, ["k"], "times", total, how).count() == n
    assert shared.join_spread(rows, per.filter("k > 10000"), ["k"], "times", total, "left", hot=hot).count() == 40_000
