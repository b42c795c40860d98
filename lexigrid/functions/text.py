"""Text expressions: each takes and gives Columns and stays inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that the results are defined by, in Java's syntax.
WORD = r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9])"
SPAN_BREAK = r"(?<=[.!?])\s+|\n+"
CHUNK_BREAK = r"(?<=[.!?])[ \t]+|\n+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
TOKEN = r"(?U)\b[\w\-]+\b"
SEPARATOR_ROW = r"^\|[-| :]+\|$"
STEM = r"^(.+?)_\d+.*$"


def strip(c: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def non_blank(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def sentences(c: Column) -> Column:
    """Sentences end at . ! or ? before white space and an ASCII capital or a digit."""
    return F.filter(F.split(collapse(c), SENTENCE_BREAK), lambda s: s != "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def tokens(c: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def line_count(c: Column) -> Column:
    """Lines of a text; a break at its end begins no line."""
    body = F.regexp_replace(c, f"(?:{LINE_BREAK})\\z", "")
    return F.when(c == "", 0).otherwise(F.size(F.split(body, LINE_BREAK, -1)))


def category(stem: Column) -> Column:
    """What stands before the first number of a file stem; the stem itself without one."""
    found = F.regexp_extract(stem, STEM, 1)
    return F.when(found == "", stem).otherwise(found)


def document_id(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.txt\z", "")


def language_of_path(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    has = lambda lang: name.contains(f"_{lang}_") | name.contains(f"_{lang}.")
    return F.when(has("bg"), "bg").when(has("en"), "en").otherwise("unknown")


def is_linked_file(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1)).contains("umls")


def with_suffix(filename: Column, suffix: str) -> Column:
    """The suffix before the extension, or at the end without one."""
    return F.regexp_replace(filename, r"^(.*?)(\.[^./]+)?\z", "$1" + re.sub(r"([\\$])", r"\\\1", suffix) + "$2")


def prediction_name(gold: Column) -> Column:
    """A gold annotation's file name to that of its predictions."""
    stem = F.regexp_replace(gold, r"(?i)_annotations.*\z", "")
    for suffix in ("_BGgpt", "_shortest", "_BGGpt"):
        stem = F.regexp_replace(stem, suffix + r"\z", "")
    return F.concat(stem, F.lit(".txt"))


def span_text(c: Column) -> Column:
    """A span bound as text: integers without leading zeros, all else trimmed."""
    return F.coalesce(strip(c).try_cast("int").cast("string"), strip(c))


def span_number(c: Column) -> Column:
    return c.try_cast("double").cast("int")


def id_parts(c: Column) -> list[Column]:
    """category and document id of ``a_b_c`` ids."""
    parts = F.split(c, "_")
    return [F.concat_ws("_", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))), F.get(parts, F.lit(2))]


def preferred(translated: Column, own: Column) -> Column:
    return F.coalesce(non_blank(translated), strip(own))


def pieces(c: Column, pattern: str | Column) -> tuple[Column, Column]:
    """(gaps, matches) of a pattern over a text; there is one gap more than matches."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.split(c, regex, -1), F.regexp_extract_all(c, regex, F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(lengths: Column, block: int = 64) -> Column:
    """Sums of an array up to and with each element. Blocks are summed apart, so that long arrays are not copied over and over."""

    def fold(values, step):
        return F.aggregate(values, F.expr("cast(array() as array<int>)"), lambda out, x: F.array_append(out, F.coalesce(F.get(out, F.size(out) - 1), F.lit(0)) + step(x)))

    def joined(blocks):
        before = fold(blocks, lambda b: F.get(b, F.size(b) - 1))
        shifted = F.concat(F.array(F.lit(0)), before)
        return F.flatten(F.zip_with(blocks, shifted, lambda b, at: F.transform(F.coalesce(b, F.expr("cast(array() as array<int>)")), lambda x: x + at)))

    def summed(values):
        numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
        blocks = F.transform(numbers, lambda k: fold(F.slice(values, k * block + 1, F.lit(block)), lambda x: x))
        return F.when(F.size(values) == 0, F.expr("cast(array() as array<int>)")).otherwise(let(blocks, joined))

    return let(lengths, summed)


def match_spans(c: Column, pattern: str | Column) -> Column:
    """array<struct<start,end,text>> of all matches that do not overlap, in code points."""
    gaps, found = pieces(c, pattern)
    pairs = F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda x: x["m"].isNotNull())

    def placed(ps):
        ends = running(F.transform(ps, lambda x: F.length(x["g"]) + F.length(x["m"])))
        return F.zip_with(ends, ps, lambda e, x: F.struct((e - F.length(x["m"])).alias("start"), e.alias("end"), x["m"].alias("text")))

    return let(pairs, placed)


def mentions(c: Column, phrase: Column) -> Column:
    """Whole-word occurrences of a phrase, whatever its case, with offsets."""
    return match_spans(c, F.concat(F.lit(r"(?iU)\b\Q"), phrase, F.lit(r"\E\b")))


def stretches(c: Column, pattern: str) -> Column:
    """Lengths of the stretches of a text that end with their break; the last one may have none."""
    gaps, found = pieces(c, pattern)
    return F.filter(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))), lambda n: n > 0)


def break_spans(c: Column, pattern: str = SPAN_BREAK) -> Column:
    """array<struct<start,end>>: stretches that end with their break; the last one may have none."""
    return let(stretches(c, pattern), lambda ns: F.zip_with(running(ns), ns, lambda e, n: F.struct((e - n).alias("start"), e.alias("end"))))


def replace_known(c: Column, known: dict[str, str], template: str = "{expansion}") -> Column:
    """Replace whole words of ``known`` in one pass, the longest first, with no second look at what was put in."""
    if not known:
        return c
    keys = "|".join(r"\Q" + k.replace("\\E", "\\E\\\\E\\Q") + r"\E" for k in sorted(known, key=len, reverse=True))
    gaps, found = pieces(c, rf"(?<![\p{{L}}\p{{N}}_])(?:{keys})(?![\p{{L}}\p{{N}}_])")
    table = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, template.format(token=k, expansion=v))])
    return F.array_join(F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(g, F.coalesce(F.element_at(table, m), F.lit(""))))), "")


def lookup(c: Column, known: dict[str, str]) -> Column:
    """The entry of a token, or of its upper case."""
    if not known:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.element_at(table, c), F.element_at(table, F.upper(c)))


def annotate_known(c: Column, known: dict[str, str]) -> Column:
    """``TOKEN (expansion)`` for each known token, found as it is or in upper case."""
    if not known:
        return c
    gaps, found = pieces(c, TOKEN)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def put(g, m):
        entry = F.coalesce(F.element_at(table, m), F.element_at(table, F.upper(m)))
        return F.array(g, F.when(m.isNull(), F.lit("")).when(entry.isNull(), m).otherwise(F.concat(m, F.lit(" ("), entry, F.lit(")"))))

    return F.array_join(F.flatten(F.zip_with(gaps, found, put)), "")


def chunks(c: Column, most: int) -> Column:
    """array<struct<start,end>>: sentences packed greedily up to ``most`` characters; a longer one stands alone."""
    empty = F.expr("named_struct('start', 0, 'end', 0, 'out', cast(array() as array<struct<start:int,end:int>>))")
    closed = lambda s: F.array_append(s["out"], F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def step(s, n):
        close = (s["end"] > s["start"]) & (s["end"] + n - s["start"] > most)
        return F.struct(F.when(close, s["end"]).otherwise(s["start"]).alias("start"), (s["end"] + n).alias("end"), F.when(close, closed(s)).otherwise(s["out"]).alias("out"))

    return F.aggregate(stretches(c, CHUNK_BREAK), empty, step, lambda s: F.when(s["end"] > s["start"], closed(s)).otherwise(s["out"]))


def cells(line: Column) -> Column:
    """Non-empty cells of a markdown row."""
    return F.filter(F.transform(F.split(line, r"\|"), strip), lambda x: x != "")


def gap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Characters between two spans, negative where they overlap."""
    return F.greatest(start_a, start_b) - F.least(end_a, end_b)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")).cast("float"))
