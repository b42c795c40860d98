"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Every language has a probability for each piece of the vocabulary. A word's likelihood is the sum
over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its
words. The probabilities are learnt by expectation-maximisation from the forward-backward counts.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrid.llm.shared import bound_batches, release, resident, table

#: A word is a run of letters, in learning and in prediction; longer runs are taken in parts of so many letters.
LETTERS = regex.compile(r"\p{L}{1,32}")
#: Stands before a word in the vocabulary.
START = "▁"
#: Of each language at most so many labelled documents are learnt from: those with the lowest hash.
TRAIN_DOCS = 400
ROUNDS = 2
#: What a letter that no piece covers, and a piece that a language never had, count for.
UNKNOWN, PSEUDO = 1e-7, 0.05
#: The posterior is that of a text of at most so many words, so that it stays comparable.
EVIDENCE = 30
REMEMBERED = 200_000
UNDETERMINED = "und"


def vocabulary(model: str = "piece_bpe_32k.model") -> list[str]:
    """Pieces of letters only, lower-cased, with or without the word mark; sorted and distinct."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    found = set()
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i).lower()
        body = piece.removeprefix(START)
        if body.isalpha() and (LETTERS.fullmatch(body) or len(body) > 32):
            found.add(piece)
            found.add(body)
    return sorted(found)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def cuts(word: str, index: dict[str, int], longest: int) -> list[list[tuple[int, int]]]:
    """For each place of a marked word, the (next place, piece) that may follow; piece -1 is a letter without one."""
    marked = START + word
    n, out = len(marked), []
    for i in range(n):
        here = []
        for j in range(i + 1, min(n, i + longest) + 1):
            k = index.get(marked[i:j])
            if k is not None:
                here.append((j, k))
        if not here:
            here.append((i + 2 if i == 0 else i + 1, -1))
        elif i and here[0][0] != i + 1:
            here.append((i + 1, -1))
        elif i == 0 and here[0][0] != 2:
            here.append((2, -1))
        out.append(here)
    return out


def prefixes(pieces) -> set[str]:
    """Every beginning of a piece: where a stretch is none, no longer one is a piece."""
    return {p[:n] for p in pieces for n in range(1, len(p) + 1)}


def log_likelihoods(words: list[str], index: dict[str, int], begun: set[str], probs: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations: a row for each word, a column for each language.

    ``probs`` is piece by language; its last row is that of a letter without a piece. The forward steps
    of all words go together, by start and length, so that each word occurs once in a step.
    """
    n = len(words)
    size = max(map(len, words), default=0) + 1
    steps: list[list[tuple[list[int], list[int]]]] = [[([], []) for _ in range(size + 1)] for _ in range(size)]
    get, unknown = index.get, len(probs) - 1
    for r, word in enumerate(words):
        marked = START + word
        end = len(marked)
        for i in range(end):
            first = 2 if i == 0 else i + 1
            row = steps[i]
            bare = True
            for j in range(i + 1, end + 1):
                stretch = marked[i:j]
                k = get(stretch)
                if k is not None:
                    rows, ids = row[j - i]
                    rows.append(r)
                    ids.append(k)
                    if j == first:
                        bare = False
                elif stretch not in begun:
                    break
            if bare:
                rows, ids = row[first - i]
                rows.append(r)
                ids.append(unknown)
    alpha = np.zeros((size + 2, n, probs.shape[1]))
    alpha[0] = 1.0
    for i, row in enumerate(steps):
        for length, (rows, ids) in enumerate(row):
            if rows:
                alpha[i + length][rows] += alpha[i][rows] * probs[ids]
    ends = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=n)
    return np.log(np.maximum(alpha[ends, np.arange(n)], 1e-300))


def expected_counts(words: dict[str, float], index: dict[str, int], longest: int, probs: dict[int, float] | None) -> dict[int, float]:
    """Forward-backward: how often each piece is expected. Without ``probs`` all cuts weigh alike."""
    total: dict[int, float] = defaultdict(float)
    for word, times in words.items():
        places = cuts(word, index, longest)
        n = len(places)
        weight = [[(j, k, (UNKNOWN if k < 0 else 0.01 if probs is None else probs.get(k, UNKNOWN))) for j, k in here] for here in places]
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        alpha[0] = beta[n] = 1.0
        for i in range(n):
            if alpha[i]:
                for j, _, p in weight[i]:
                    alpha[j] += alpha[i] * p
        for i in range(n - 1, -1, -1):
            beta[i] = sum(p * beta[j] for j, _, p in weight[i])
        if alpha[n] <= 0:
            continue
        for i in range(n):
            if alpha[i]:
                for j, k, p in weight[i]:
                    if k >= 0:
                        total[k] += times * alpha[i] * p * beta[j] / alpha[n]
    return total


def _learn(model: str, rounds: int):
    """One group is one language's bounded sample of words."""

    def learn(pdf):
        import pandas as pd

        release()
        pieces = vocabulary(model)
        index, longest = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))
        words = dict(zip(pdf["word"], pdf["times"].astype(float)))
        probs = None
        for _ in range(rounds):
            counts = expected_counts(words, index, longest, probs)
            whole = sum(counts.values()) + PSEUDO * len(pieces)
            probs = {k: (c + PSEUDO) / whole for k, c in counts.items()}
        whole = whole if probs else PSEUDO * len(pieces)
        ids = list(probs or {})
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "pieces": [ids], "probs": [[probs[k] for k in ids]], "rest": PSEUDO / whole})

    return learn


def held_out(doc):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_of(labelled: DataFrame, train_docs: int) -> DataFrame:
    """Of ``labelled(doc, text, lang)`` at most ``train_docs`` rows a language: those of the lowest hashes of id and text together.

    Rows that agree in id, text and language count as one, and an id on many texts as as many rows. A language's share of the range
    of hashes that should hold four times as many rows is ranked and no more; where repeated rows leave too few in it, a range sixteen
    times as wide is, which then holds at most some sixty times ``train_docs`` distinct ones.
    """
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return labelled
    hashed = labelled.withColumn("__h", F.xxhash64("doc", "text"))
    most, share, found = {}, {lang: 4 * train_docs / n for lang, n in counts.items()}, {}
    short = list(counts)

    def below(limits: dict):
        return F.col("__h") <= F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("lang"))

    while short:
        limits = {lang: min(2**63 - 1, -(2**63) + int(2**64 * min(1.0, share[lang]))) for lang in short}
        rows = hashed.select("lang", "__h").filter(below(limits)).distinct()
        places = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("__h"))).filter(F.col("place") <= train_docs)
        found = {r["lang"]: (r["n"], r["most"]) for r in places.groupBy("lang").agg(F.count("*").alias("n"), F.max("__h").alias("most")).collect()}
        most |= {lang: top for lang, (n, top) in found.items()}
        short = [lang for lang in short if found.get(lang, (0, 0))[0] < train_docs and share[lang] < 1]
        share |= {lang: share[lang] * 16 for lang in short}
    return hashed.filter(below(most)).dropDuplicates(["lang", "__h"]).drop("__h")


def _count_words(batches):
    """(lang, word, times) of each batch of a bounded number of characters."""
    for batch in batches:
        langs, at = batch.column("lang").to_pylist(), 0
        for part in _parts(batch.column("text")):
            found: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(langs[at : at + len(part)], part):
                found[lang].update(words_of(text))
            at += len(part)
            rows = [(lang, w, n) for lang, words in found.items() for w, n in words.items()]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["lang", "word", "times"])


def train(df: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS, vocab: str = "piece_bpe_32k.model"):
    """[(lang, pieces, probabilities, rest)] learnt from labelled rows that are not held out.

    The sample is bounded by ``train_docs`` distinct rows a language; which it has depends on their ids and texts alone. Rows without an
    id, which can be neither held out nor not, teach nothing.
    """
    labelled = df.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc").isNotNull() & ~held_out(F.col("doc")))
    sample = sample_of(labelled, train_docs)
    words = sample.select("lang", "text").mapInArrow(_count_words, "lang string, word string, times bigint").groupBy("lang", "word").agg(F.sum("times").alias("times")).repartition(32, "lang")
    learnt = words.groupBy("lang").applyInPandas(_learn(vocab, rounds), "lang string, pieces array<int>, probs array<double>, rest double")
    return sorted((r["lang"], r["pieces"], r["probs"], r["rest"]) for r in learnt.collect())  # a row a language


class Scorer:
    """Predictions for texts; remembers a bounded number of words."""

    #: Words whose forward steps are taken together.
    TOGETHER = 4000

    def __init__(self, learnt, vocab: str = "piece_bpe_32k.model"):
        pieces = vocabulary(vocab)
        self.index, self.begun = {p: i for i, p in enumerate(pieces)}, prefixes(pieces)
        self.langs = [x[0] for x in learnt]
        self.probs = np.full((len(pieces) + 1, len(learnt)), UNKNOWN)
        for c, (_, ids, values, rest) in enumerate(learnt):
            self.probs[:-1, c] = rest
            self.probs[ids, c] = values
        self.place: dict[str, int] = {}
        self.rows = np.empty((0, len(learnt)))

    def learn_words(self, asked: set[str]) -> None:
        if len(self.place) > REMEMBERED:
            self.place, self.rows = {}, self.rows[:0]
        new = sorted(asked.difference(self.place), key=len)
        parts = [log_likelihoods(new[i : i + self.TOGETHER], self.index, self.begun, self.probs) for i in range(0, len(new), self.TOGETHER)]
        self.place.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate([self.rows, *parts])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [words_of(t or "") for t in texts]
        if not self.langs:
            return [(UNDETERMINED, 0.0)] * len(texts)
        self.learn_words(set().union(*found))
        place, out = self.place, []
        for words in found:
            if not words:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.rows[[place[w] for w in words]].sum(axis=0)
            best = int(np.argmax(total))
            scaled = (total - total[best]) * min(1.0, EVIDENCE / len(words))
            out.append((self.langs[best], 1.0 / sum(math.exp(max(x, -700.0)) for x in scaled)))
        return out


def scorer_of(learnt, vocab: str = "piece_bpe_32k.model") -> Scorer:
    name, value = learnt.value
    return resident(("language", name, vocab), lambda: Scorer(value, vocab))


def _parts(column, chars: int = 1_000_000):
    """A batch's texts in parts of a bounded number of characters, or one text."""
    part, held = [], 0
    for t in column:
        part.append(t.as_py())
        held += len(part[-1] or "")
        if held > chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def _predict(learnt, vocab: str):
    def predict(batches):
        scorer = scorer_of(learnt, vocab)
        for batch in batches:
            found = [f for part in _parts(batch.column("text")) for f in scorer.predict(part)]
            arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def identify(df: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", vocab: str = "piece_bpe_32k.model", **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of ``df``.

    ``und`` and 0 where the text is null or has no letter, or where nothing was learnt; otherwise a
    learnt language (the first by name on a tie) and its posterior. Null ids are not held out;
    repeated rows are alike; an empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    bound_batches(spark)
    learnt = spark.sparkContext.broadcast((uuid.uuid4().hex, train(df, doc, text, lang, vocab=vocab, **how)))  # languages times the fixed vocabulary at most
    rows = df.select(F.col(doc).cast("long").alias("doc_id"), held_out(F.col(doc)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_predict(learnt, vocab), "doc_id bigint, held_out boolean, lang_pred string, score double")


#: A document whose language is less likely than this is rejected.
LEAST = 0.5


def known_language(df: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", least: float = LEAST, **how) -> DataFrame:
    """The rows of ``df``, all columns, whose text has a language with a score of at least ``least``."""
    spark = df.sparkSession
    bound_batches(spark)
    learnt = spark.sparkContext.broadcast((uuid.uuid4().hex, train(df, doc, text, lang, **how)))
    at = df.columns.index(text)

    def keep(batches):
        scorer = scorer_of(learnt)
        for batch in batches:
            found = [f for part in _parts(batch.column(at)) for f in scorer.predict(part)]
            yield batch.filter(pa.array([f[0] != UNDETERMINED and f[1] >= least for f in found], pa.bool_()))

    return df.mapInArrow(keep, df.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
