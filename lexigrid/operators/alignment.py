"""Sentences, their alignment by length, and the context of two mentions: sequential by nature, one document at a time."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lexigrid.functions import text as T
from lexigrid.functions.vocab import MAX_CONTEXT, NEVER_SPLIT
from lexigrid.operators.lengths import align_lengths

LINES = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
END = re.compile(r"[.!?…]+[\"'»”)\]]*(?=\s|\Z)")
NEVER = re.compile("(?:^|(?<=[\\s(\\[\"'«„]))(?:" + "|".join(re.escape(a) for a in sorted(NEVER_SPLIT, key=len, reverse=True)) + r")\Z")


def sentence_spans(text: str) -> list[tuple[str, int, int]]:
    """(text, start, end) of sentences: lines are hard breaks, known abbreviations end none."""
    out, at = [], 0
    bounds = [(m.start(), m.end()) for m in LINES.finditer(text)] + [(len(text), len(text))]
    for stop, following in bounds:
        line = text[at:stop]
        begin = 0
        for m in END.finditer(line):
            if m.group().startswith(".") and NEVER.search(line[begin : m.start()]):
                continue
            _put(out, line, begin, m.end(), at)
            begin = m.end()
        _put(out, line, begin, len(line), at)
        at = following
    return out


def _put(out, line, begin, end, offset):
    body = line[begin:end]
    left = len(body) - len(body.lstrip())
    body = body.strip()
    if body:
        out.append((body, offset + begin + left, offset + begin + left + len(body)))


def group_links(links: list[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
    """Beads: a new one begins where both indices differ from the link before."""
    beads: list[list[tuple[int, int]]] = []
    for link in links:
        if beads and (link[0] == beads[-1][-1][0] or link[1] == beads[-1][-1][1]):
            beads[-1].append(link)
        else:
            beads.append([link])
    return [(sorted({i for i, _ in b}), sorted({j for _, j in b})) for b in beads]


BEAD = "filename string, bead_idx int, source string, hypothesis string, src_start int, src_end int, hyp_start int, hyp_end int"


def beads_of(source: str, target: str) -> list[tuple[str, str, int, int, int, int]]:
    src, hyp = sentence_spans(source or ""), sentence_spans(target or "")
    out = []
    for left, right in group_links(align_lengths([len(s[0]) for s in src], [len(s[0]) for s in hyp])):
        a, b = [src[i] for i in left], [hyp[j] for j in right]
        out.append((" ".join(s[0] for s in a), " ".join(s[0] for s in b), a[0][1], a[-1][2], b[0][1], b[-1][2]))
    return out


def align_documents(pairs: DataFrame, doc: str = "filename", source: str = "source", target: str = "hypothesis") -> DataFrame:
    """Aligned beads of each row's two texts. A row is one document pair, so no grouping is needed."""
    rows = pairs.select(F.col(doc).cast("string").alias("filename"), F.col(source).alias("source"), F.col(target).alias("hypothesis"))

    def run(frames):
        for pdf in frames:
            out = [(f, k, *bead) for f, s, h in pdf.itertuples(index=False) for k, bead in enumerate(beads_of(s, h))]
            yield pd.DataFrame(out, columns=["filename", "bead_idx", "source", "hypothesis", "src_start", "src_end", "hyp_start", "hyp_end"])

    return rows.mapInPandas(run, BEAD)


def context_bounds(spans: Column, low: Column, high: Column, most: int = MAX_CONTEXT) -> Column:
    """struct<start,end> of the context of two mentions that reach from ``low`` to ``high``, given the spans of a text's sentences.

    It begins with the sentence that ``low`` is in and ends with the one of ``high``. While it is shorter than ``most`` it
    takes, as far as each whole sentence leaves it within ``most``: the one before it, then those after it, then those before it.
    """
    first = lambda found, c, other: F.coalesce(F.get(found, F.lit(0))[c], other)
    start = first(F.filter(spans, lambda s: (s["start"] <= low) & (low < s["end"])), "start", low)
    end = first(F.filter(spans, lambda s: (s["start"] < high) & (high <= s["end"])), "end", high)

    def grown(w):
        one = first(F.filter(spans, lambda s: (s["end"] == w["start"]) & (w["end"] - s["start"] <= most)), "start", w["start"])
        right = T.let(one, lambda b: F.struct(b.alias("start"), F.greatest(w["end"], F.array_max(F.transform(F.filter(spans, lambda s: (s["start"] >= w["end"]) & (s["end"] - b <= most)), lambda s: s["end"]))).alias("end")))
        return T.let(right, lambda r: F.struct(F.least(r["start"], F.array_min(F.transform(F.filter(spans, lambda s: (s["end"] <= r["start"]) & (r["end"] - s["start"] <= most)), lambda s: s["start"]))).alias("start"), r["end"].alias("end")))

    return T.let(F.struct(start.alias("start"), end.alias("end")), lambda w: F.when(w["end"] - w["start"] < most, grown(w)).otherwise(w))


def contexts(pairs: DataFrame, texts: DataFrame, doc: str = "doc_id", most: int = MAX_CONTEXT) -> DataFrame:
    """``pairs`` with ``context``, the stripped context of each row's two mentions (s_start, s_end, o_start, o_end) in ``texts(doc, body)``.

    A text goes to no pair: pairs get the spans of its sentences, and the distinct windows of a document are cut out of it together.
    """
    spans = texts.select(doc, T.break_spans(F.col("body")).alias("__spans"))
    bounds = context_bounds(F.col("__spans"), F.least("s_start", "o_start").cast("int"), F.greatest("s_end", "o_end").cast("int"), most)
    placed = pairs.join(spans, doc).withColumn("__window", bounds).drop("__spans")
    windows = placed.select(doc, "__window").distinct().groupBy(doc).agg(F.collect_list("__window").alias("__windows"))
    cut = lambda w: F.struct(w.alias("window"), T.strip(F.substring(F.col("body"), w["start"] + 1, w["end"] - w["start"])).alias("context"))
    found = texts.join(windows, doc).select(doc, F.explode(F.transform("__windows", cut)).alias("w")).select(doc, F.col("w.window").alias("__window"), F.col("w.context").alias("context"))
    return placed.join(found, [doc, "__window"]).drop("__window")


def split_sentences(text: str | Column) -> Column:
    @pandas_udf("array<struct<text:string,start:int,end:int>>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"text": t, "start": s, "end": e} for t, s, e in sentence_spans(x or "")] for x in texts])

    return split(text)
