import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lexigrid.llm import decontaminate, mixing, simhash
from lexigrid.llm.shared import WRITTEN, cut, drop_cuts, table


def test_stages_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == columns
        steps[name], docs = (docs, out), out
    first, second = steps["language ID"]
    assert second.count() == before
    first, second = steps["SimHash near-dedup"]
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(first).collect()}
    assert {r["doc_id"] for r in second.collect()} == set(groups.values())
    first, second = steps["benchmark decontamination"]
    leaked = {r["doc_id"] for r in decontaminate.find_leaks(first, table(spark, sf, "benchmark")).collect()}
    assert {r["doc_id"] for r in first.collect()} - {r["doc_id"] for r in second.collect()} == leaked and leaked
    first, second = steps["mixing sources to target weights"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(first).collect() if r["copies"]}
    counted = {r["doc_id"]: r["count"] for r in second.groupBy("doc_id").count().collect()}
    assert counted == copies and set(counted.values()) <= {1, 2}


def test_run_gives_the_tokens_of_the_mix(spark, sf):
    got = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r["start"])
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got) and len(got) > 50
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_rows_without_ids_pass_through_all_stages(spark, sf, tmp_path):
    """Different texts without an id stay apart; copies among them, and of a row with an id, go; cuts do not stay behind."""
    whole = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    bench = table(spark, sf, "benchmark")
    long = [r for r in whole if r[1] and 300 < len(r[1]) < 3000]
    from collections import Counter

    found = simhash.near_duplicates(table(spark, sf, "documents")).collect()
    sizes = Counter(r["component_id"] for r in found)
    alone = {r["doc_id"] for r in found if sizes[r["component_id"]] == 1} - {r["doc_id"] for r in decontaminate.find_leaks(table(spark, sf, "documents"), bench).collect()}
    spare = [r for r in long if r[0] in alone][:6]
    rows = [r for r in whole if r[0] not in {x[0] for x in spare}]
    rows += [(None, *r[1:]) for r in spare] + [(None, *spare[0][1:]), (None, bench.first()["text"] + " " + spare[1][1][:200], "en", "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    before = len(WRITTEN)
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path)).cache()
    assert sorted(r["text"] for r in docs.filter("doc_id IS NULL").collect()) == sorted(r[1] for r in spare)
    drop_cuts(spark, before)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.filter("doc_id IS NULL").count() > 0
    names = [w.rsplit("/", 1)[1].rsplit("-", 1)[0] for w in WRITTEN[before:]]
    assert names == ["stage-3", "tokens"]


def test_cuts_can_be_dropped(spark):
    import os

    kept = len(WRITTEN)
    df = cut(spark.range(5).toDF("id"), "test")
    where = WRITTEN[-1].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(where)
    drop_cuts(spark, kept)
    assert not os.path.exists(where) and len(WRITTEN) == kept
