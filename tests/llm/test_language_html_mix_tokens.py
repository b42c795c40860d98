import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexigrid.llm import html, language, mixing, tokens
from lexigrid.llm.queries import QUERIES
from tests.llm.conftest import ROWS, documents


# language


def all_cuts(word, index, probs, at=0):
    """Sum over every segmentation, by recursion."""
    places = language.cuts(word, index, max(map(len, index)))

    def go(i):
        return 1.0 if i == len(places) else sum((probs[k] if k >= 0 else language.UNKNOWN) * go(j) for j, k in places[i])

    return go(0)


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "abc", "b", "bc", "c", "▁a", "▁ab", "▁b"]
    index = {p: i for i, p in enumerate(pieces)}
    rng = random.Random(4)
    probs = np.array([[rng.random(), rng.random()] for _ in pieces] + [[language.UNKNOWN] * 2])
    words = ["a", "abc", "abcabc", "bcax", "xyz", "cab"]
    got = language.log_likelihoods(words, index, language.prefixes(pieces), probs)
    for r, word in enumerate(words):
        for c in range(2):
            assert got[r, c] == pytest.approx(np.log(all_cuts(word, index, probs[:, c])))


def test_expected_counts_match_enumeration():
    pieces = ["a", "b", "ab", "▁a", "▁ab", "ba"]
    index, probs = {p: i for i, p in enumerate(pieces)}, {i: 0.1 + 0.07 * i for i in range(6)}

    def paths(places, i=0):
        if i == len(places):
            yield 1.0, []
            return
        for j, k in places[i]:
            for p, rest in paths(places, j):
                yield (probs[k] if k >= 0 else language.UNKNOWN) * p, [k] + rest

    found = list(paths(language.cuts("abab", index, 3)))
    total = sum(p for p, _ in found)
    want = {k: sum(p * path.count(k) for p, path in found) / total for k in range(6)}
    got = language.expected_counts({"abab": 2.0}, index, 3, probs)
    for k in range(6):
        assert got.get(k, 0.0) == pytest.approx(2 * want[k])


def test_language_query_on_held_out_rows(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op3_language_id"](spark, sf).collect()}
    rows = [(d, lang) for d, t, lang, _ in documents(spark, sf)]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _ in rows)
    held = [(d, lang) for d, lang in rows if got[d]["held_out"]]
    assert sum(got[d]["lang_pred"] == lang for d, lang in held) >= 0.97 * len(held) > 20
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_predictions_against_enumeration(spark):
    """Languages and scores equal those of summing every segmentation of every word, letter by letter."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat on the mat", "en"), ("der hund im haus", "de"), ("le chat est la", "fr"), ("the house of man", "en"), ("das haus und er", "de"), ("la rue et le ciel", "fr")] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = language.train(df)
    index = {p: i for i, p in enumerate(language.vocabulary())}
    marked = language.START

    def summed(word, probs, rest):
        whole, total = marked + word, {0: 1.0}
        for i in range(len(whole)):
            for j in range(i + 1, len(whole) + 1) if i in total else ():
                k = index.get(whole[i:j])
                single = j == (2 if i == 0 else i + 1)
                p = probs.get(k, rest) if k is not None else language.UNKNOWN if single else 0.0
                if p:
                    total[j] = total.get(j, 0.0) + total[i] * p
        return total[len(whole)]

    tables = [(lang, dict(zip(ids, values)), rest) for lang, ids, values, rest in learnt]
    for r in language.identify(df).collect():
        words = re.findall("[a-z]+", rows[r["doc_id"]][1])
        logs = np.array([sum(np.log(summed(w, probs, rest)) for w in words) for _, probs, rest in tables])
        assert r["lang_pred"] == tables[int(np.argmax(logs))][0] == rows[r["doc_id"]][2]
        assert r["score"] == pytest.approx(1 / np.exp(logs - logs.max()).sum())


@pytest.mark.parametrize("text", ["\u00b2\u00bd", "\u216b 12", "\u2460 _ \u0301", "\u200b", " "])
def test_what_is_no_letter_has_no_language(spark, text):
    df = spark.createDataFrame([(1, "some text", "en"), (2, text, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df).collect()}
    assert got == {1: "en", 2: "und"}


def test_the_sample_is_bounded_whatever_repeats(spark):
    rows = [(i, "a b", "en") for i in range(3000)] + [(7, "a b", "en")] * 5000 + [(i, "x", "de") for i in range(5)]
    rows += [(8, f"text {i}", "fr") for i in range(3000)] + [(None, "no id", "es")] * 50 + [(9, "again", "it")] * 4000
    df = spark.createDataFrame(rows, "doc long, text string, lang string")
    got = language.sample_of(df, 100)
    assert {r["lang"]: r["count"] for r in got.groupBy("lang").count().collect()} == {"de": 5, "en": 100, "fr": 100, "es": 1, "it": 1}
    least = sorted(r[0] for r in df.filter("lang = 'en'").selectExpr("xxhash64(doc, text)").distinct().collect())[:100]
    assert sorted(r[0] for r in got.filter("lang = 'en'").selectExpr("xxhash64(doc, text)").collect()) == least
    assert language.sample_of(df.limit(0), 100).count() == 0


def test_rows_without_an_id_teach_nothing(spark):
    rows = [(None, "das ist der text und die katze", "de"), (1, "the cat and the dog in the house", "en"), (2, "the man and the mouse", "en")]
    learnt = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [x[0] for x in learnt] == ["en"]


def test_language_edges(spark, docs, no_docs):
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert len(got) == len({r[0] for r in ROWS}) and {got[d]["lang_pred"] for d in (3, 4, 6)} == {"und"}
    assert language.identify(no_docs).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.identify(unlabelled).first()["lang_pred"] == "und"
    kept = language.known_language(docs)
    assert kept.columns == docs.columns and not {3, 4, 6} & {r["doc_id"] for r in kept.collect()}


# pages

PROSE = "This is the text of the article that we have in the page, and it is long enough for all of the rules to see that it is good, because there are many of the words that stop in it and not so many links to other pages at all."


def page(body):
    return f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("plain", ""), ("<p", ""),
    (page(f"<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{PROSE}<br>Next &amp; last</p><div class='ad'>Buy</div><p>Short.</p><section class='comments'><p>{PROSE}</p></section></article><footer>f</footer>"), f"Title\n{PROSE} Next & last\nShort."),
    (page(f"<div id=main><p>{PROSE}</p><p>End.</p></div><div class='sidebar'><p>{PROSE}</p></div>"), f"{PROSE}\nEnd."),
    (page(f"<p>{PROSE}<p><b>Bold</b>&nbsp;word\n\n x<form><p>{PROSE}</p></form>"), f"{PROSE}\nBold word x"),
    (page(f"<article><p>One &lt;tag&gt; &#233; &hearts;</p></article>"), "One <tag> é ♥"),
    (page(f"<div><p>{PROSE}</p></div><div><a href=1>{PROSE}</a></div><!-- <p>{PROSE}</p> --><style>p{{}}</style>"), PROSE),
    (f"<article><p>{PROSE}</p><p>cut off", f"{PROSE}\ncut off"),
    (page(f"<header>Site</header><main><p>{PROSE}</p><aside>{PROSE}</aside></main><div role='contentinfo'>{PROSE}</div>"), PROSE),
])
def test_main_text(source, want):
    assert html.main_text(source) == want


@pytest.mark.parametrize("inside, kept", [
    (f'<a href="x"><div><h3>Other story</h3><p>{PROSE} Card.</p></div></a>', []),
    (f'<div class="recipe-menu"><p>{PROSE} Menu.</p></div>', ["Menu."]),
    (f'<section class="related-work"><p>{PROSE} Earlier.</p></section>', ["Earlier."]),
    (f'<div class="discussion"><p>{PROSE} Discussed.</p></div>', ["Discussed."]),
    (f'<div class="comments"><p>{PROSE} Comment.</p></div>', []),
    (f'<ol class="comment-list"><li class="comment-body">{PROSE} Comment.</li></ol>', []),
    ('<div class="share-buttons"><p>Share this</p></div>', []),
    ('<div class="recipe-share"><p>Share it</p></div>', []),
    (f'<p>{PROSE} where <math><mi>x</mi></math> is <svg><title>t</title><text>y</text></svg>.</p>', ["where x is y."]),
    (f'<p>{PROSE}<a href=x> open<p>{PROSE} after.', ["open", "after."]),
])
def test_names_and_links_inside_an_article(inside, kept):
    got = html.main_text(page(f"<article><p>{PROSE} First.</p>{inside}<p>{PROSE} Last.</p></article>"))
    assert [line.removeprefix(PROSE).strip() for line in got.split("\n")] == ["First.", *kept, "Last."]



def test_stop_words_decide_unmarked_blocks():
    words = " ".join(f"xq{i}" for i in range(80))
    assert html.main_text(page(f"<div><p>{words}</p></div><div><p>{PROSE}</p></div>")) == PROSE


def test_articles_survive_without_their_tags(spark, sf):
    kept = total = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        marked = [x for x in html.main_text(r["html"]).split("\n") if len(x) >= html.SHORT]
        bare = html.main_text(re.sub("</?article>", "", r["html"])).split("\n")
        kept, total = kept + sum(x in bare for x in marked), total + len(marked)
    assert kept >= 0.95 * total > 100


def test_rules_judge_text_outside_the_article():
    few = "Ware words stand here the crowd of nouns runs over many lines of print before a verb turns up in it"
    body = f"<article><p>{PROSE}</p></article><div><p>{few}.</p><p>{PROSE} More.</p></div><div class='related'><p>{PROSE}</p></div><div><a href=1>{PROSE}</a></div><p>Short.</p>"
    assert html.main_text(page(body)) == f"{PROSE}\n{few}.\n{PROSE} More."
    table = " | ".join(f"cell{'abcdefgh'[i % 8]}" for i in range(60))
    assert html.main_text(page(f"<h1>Head</h1><p>{table}</p>")) == f"Head\n{table}"


@pytest.mark.parametrize(
    "source",
    [
        f'<article class="post comments-open"><p>{PROSE}</p></article>',
        f'<div class="layout has-sidebar"><article><p>{PROSE}</p></article></div>',
        f"<video src=x><p>{PROSE}</p>",
        f"<svg><select><p>{PROSE}</p>",
        f'<div class="sidebar"><p>{PROSE} {PROSE} {PROSE}</p></div>',
    ],
)
def test_names_and_open_elements_do_not_empty_a_page(source):
    assert html.main_text(page(source)).startswith(PROSE)


def test_named_containers_go_where_there_is_other_text():
    for name in ("comments", "ad", "cookie-banner", "related posts", "sidebar"):
        assert html.main_text(page(f'<div><p>{PROSE}</p></div><div class="{name}"><p>{PROSE} Not this.</p></div>')) == PROSE


def test_pages_without_article_elements_keep_their_text(sf):
    """The rules decide each block: without the article's element whole texts stay equal, but for pages of rows of cells."""
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist()
    same = empty = 0
    for source in pages:
        marked, bare = html.main_text(source), html.main_text(re.sub(r"<(/?)article\b", r"<\1div", source))
        same += marked == bare
        empty += bool(marked) and not bare
    assert same >= 0.9 * len(pages) and empty == 0


def test_html_query_and_edges(spark, sf):
    import re
    from html import unescape

    got = {r["page_id"]: r for r in QUERIES["op7_html_extract"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S).group(1)
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", " ", b.replace("<b>", ""))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    df = spark.createDataFrame([(1, None, None, "z"), (1, "u", "", "z"), (None, "u", page(f"<article>{PROSE}</article>"), "z")], "page_id long, url string, html string, text string")
    assert sorted(r["n_chars"] for r in html.extract(df).collect()) == [0, 0, len(PROSE)]
    assert html.extract(df.limit(0)).count() == 0


# mixing


def brute_targets(sizes, share=1.5, most=2.0):
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in sizes if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in sizes}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 500, None: 300}, {"x": 5}, {"b": 0, "a": 7, "c": 900}, {f"s{i}": 37 * i * i % 101 + 1 for i in range(40)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, v, 1) for s, v in sizes.items()], "source string, source_size long, docs long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


@pytest.mark.parametrize("n, p", [(0, 0.5), (1, 0.3), (2, 0.5), (500, 0.37), (501, 0.98)])
def test_flight_keeps_both_totals(n, p):
    rng = random.Random(n)
    sizes = [rng.choice([0, 1, 5, 5, 300, 9000]) for _ in range(n)]
    out = mixing.fly(sizes, [p] * n, random.Random(1))
    assert sum(0 < x < 1 for x in out) <= 2 and all(0 <= x <= 1 for x in out)
    assert sum(out) == pytest.approx(p * n) and sum(a * b for a, b in zip(sizes, out)) == pytest.approx(p * sum(sizes))


def test_flight_keeps_inclusion_probabilities():
    sizes, hits = [3, 8, 2, 9, 4, 7, 1, 6], np.zeros(8)
    for seed in range(3000):
        hits += np.array(mixing.fly(sizes, [0.4] * 8, random.Random(seed))) 
    assert np.abs(hits / 3000 - 0.4).max() < 0.05


def test_mix_query(spark, sf):
    rows = documents(spark, sf)
    got = {r["doc_id"]: r for r in QUERIES["op8_mix_sources"](spark, sf).collect()}
    assert sorted(map(tuple, got.values())) == sorted(map(tuple, QUERIES["op8_mix_sources"](spark, sf).collect()))
    import re

    sizes, taken, per = {}, {}, {}
    for d, t, _, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert got[d]["size"] == n and got[d]["taken"] in (0, n, 2 * n)
        sizes[s] = sizes.get(s, 0) + n
        taken[s] = taken.get(s, 0) + got[d]["taken"]
        per.setdefault(s, []).append(n)
    want = brute_targets(sizes)
    for s in sizes:
        assert got[next(d for d, _, _, x in rows if x == s)]["target"] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(per[s])


def test_mix_in_rounds_is_balanced(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 50)
    rows = [(i, "w " * (i * 7 % 40 + 1), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 900
    by = {}
    for r in got:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - target) <= 3 for (_, target), v in by.items())


def test_small_sources_land_well_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 50)
    rng = random.Random(6)
    units = [(i, 1 + (i >= 30) + (i >= 60), rng.randrange(1000, 90_000), rng.getrandbits(60), 0.37) for i in range(260)]
    drawn = dict(mixing.cube_sample(spark.createDataFrame(units, "rid long, sid int, size long, order long, p double")).collect())
    assert len(drawn) == 260 and set(drawn.values()) <= {0.0, 1.0}
    for sid in (1, 2):
        assert abs(sum(size * (drawn[rid] - p) for rid, s, size, _, p in units if s == sid)) < 500


def test_mix_edges(spark, docs, no_docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(no_docs).count() == 0
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


# token ids


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 257], [2**32 - 1, 0, 65535, 65536], list(range(3000))])
def test_direct_access(ids):
    levels = tokens.dac_encode(np.array(ids, dtype=np.uint32))
    assert tokens.dac_decode(levels).tolist() == ids
    assert [tokens.dac_get(levels, i) for i in range(len(ids))] == ids


HARD = ["", " ", "a  b", "a \n b", "a\n b", "x \t", " lead", "tab\tand nbsp  x", "it's we'll I'd", "<|endoftext|> here", "é" * 100 + " 漢字 　 x", "a" * 200 + " b", "12 345\r\n\r\n  z ", "\n\n", "a  b"]


def test_encoder_agrees_with_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
    rng = random.Random(8)
    texts = HARD + ["".join(rng.choice(["a", "B", " ", "  ", "\n", "'s", "9", ".", "é", " ", "\t", "\x1c"]) for _ in range(40)) for _ in range(400)]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_memory_is_bounded_and_keeps_what_is_used():
    made = []
    memory = tokens.Memory(lambda k: made.append(k) or k.encode(), 10)
    for i in range(200):
        assert memory["often"] == b"often" and memory[f"w{i}"] == f"w{i}".encode()
        assert len(memory) + len(memory.old) <= 21
    assert made.count("often") == 1


def test_token_query_round_trip(spark, sf, monkeypatch):
    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in QUERIES["op5_token_output"](spark, sf).collect()}
    for d, t, _, _ in sorted(documents(spark, sf)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [tokens.END_ID]
        assert tuple(got[d]) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_edges(docs, no_docs):
    got = tokens.token_output(docs).collect()
    assert len(got) == len(ROWS) and {r["n_tokens"] for r in got if r["doc_id"] in (3, 4)} == {1}
    ordered = sorted(got, key=lambda r: r["start"])
    assert ordered[0]["doc_id"] is None and [r["doc_id"] for r in ordered[1:]] == sorted(r["doc_id"] for r in ordered[1:])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:]))
    assert tokens.token_output(no_docs).count() == 0


def test_mixed_rows_take_columns_of_any_name(spark):
    rows = [(i, f"word {i} " * (i % 5 + 1), "ab"[i % 2], 1, 2, 3, 4, 5) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row_hash int, mix_doc int, mix_copies int, mix_copy int, row_turn int")
    got = mixing.mixed_rows(df)
    assert got.columns == df.columns and {tuple(r)[3:] for r in got.collect()} == {(1, 2, 3, 4, 5)}
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    from collections import Counter

    assert Counter(r["doc_id"] for r in got.collect()) == Counter({d: n for d, n in taken.items() if n})
