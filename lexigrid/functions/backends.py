"""Model steps as protocols, with deterministic offline stand-ins that need no download.

The stand-ins have the models' signatures, not their quality. A remote translator can be passed in
where one is wanted; none is used by default.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

WORDS = re.compile(r"\w+")


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def score(self, premises: list[str], hypotheses: list[str]) -> list[float]: ...


class SimilarityScorer(Protocol):
    def score(self, candidates: list[str], references: list[str]) -> list[tuple[float, float, float]]: ...


class Translator(Protocol):
    def translate(self, texts: list[str]) -> list[str]: ...


class NerModel(Protocol):
    def predict(self, text: str, labels: list[str], threshold: float) -> list[dict]: ...


class LanguageDetector(Protocol):
    def detect(self, text: str) -> str: ...


class HashedNgrams:
    """Unit vectors of hashed character trigrams."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for r, t in enumerate(texts):
            padded = f"  {(t or '').lower()} "
            for i in range(len(padded) - 2):
                h = zlib.crc32(padded[i : i + 3].encode())
                out[r, h % self.dim] += 1 if h >> 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


class LetterCounts:
    """Unit vectors of how often each of a to z stands in a text."""

    def encode(self, texts: list[str]) -> np.ndarray:
        counts = np.array([[t.count(chr(97 + k)) for k in range(26)] for t in ((t or "").lower() for t in texts)], dtype=np.float64).reshape(-1, 26)
        norms = np.linalg.norm(counts, axis=1, keepdims=True)
        return counts / np.where(norms > 0, norms, 1)


class TokenEntailment:
    """Share of the hypothesis's words that the premise has."""

    def score(self, premises: list[str], hypotheses: list[str]) -> list[float]:
        out = []
        for p, h in zip(premises, hypotheses):
            have, want = set(WORDS.findall(p.lower())), WORDS.findall(h.lower())
            out.append(sum(w in have for w in want) / len(want) if want else 0.0)
        return out


class TokenOverlap:
    """Precision, recall and F1 of word multisets."""

    def tokens(self, text: str) -> list[str]:
        """The multiset as a set: words with how often each has been there before. F1 is that of these sets, so that
        pairs below a threshold need not be scored."""
        seen: Counter = Counter()
        out = []
        for w in WORDS.findall((text or "").lower()):
            out.append(f"{w} {seen[w]}")
            seen[w] += 1
        return out

    def score(self, candidates: list[str], references: list[str]) -> list[tuple[float, float, float]]:
        out = []
        for c, r in zip(candidates, references):
            a, b = Counter(WORDS.findall((c or "").lower())), Counter(WORDS.findall((r or "").lower()))
            same = sum((a & b).values())
            p, q = (same / sum(x.values()) if x else 0.0 for x in (a, b))
            out.append((p, q, 2 * p * q / (p + q) if p + q else 0.0))
        return out


class Dictionary:
    """Translation by look-up; what is not known stays."""

    def __init__(self, known: dict[str, str] | None = None):
        self.known = {k.lower(): v for k, v in (known or {}).items()}

    def translate(self, texts: list[str]) -> list[str]:
        return [self.known.get((t or "").lower(), t or "") for t in texts]


class Lexicon:
    """Longest whole-word matches of a phrase list, one label each."""

    def __init__(self, phrases: dict[str, str]):
        self.labels = {k.lower(): v for k, v in phrases.items()}
        keys = "|".join(re.escape(k) for k in sorted(self.labels, key=len, reverse=True))
        self.pattern = re.compile(rf"(?<!\w)(?:{keys})(?!\w)", re.IGNORECASE) if keys else None

    def predict(self, text: str, labels: list[str], threshold: float) -> list[dict]:
        found = self.pattern.finditer(text) if self.pattern else ()
        hits = ({"start": m.start(), "end": m.end(), "label": self.labels[m.group().lower()], "text": m.group(), "score": 1.0} for m in found)
        return [h for h in hits if h["label"] in labels and h["score"] >= threshold]


class CyrillicShare:
    """bg where at least a third of the first 2000 characters' letters are Cyrillic, else en."""

    def detect(self, text: str) -> str:
        letters = [c for c in (text or "")[:2000] if c.isalpha()]
        return "bg" if letters and sum("Ѐ" <= c <= "ӿ" for c in letters) * 3 >= len(letters) else "en"


def encode(text: Column, encoder: Encoder, batch: int = 128) -> Column:
    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        rows = [v for i in range(0, len(texts), batch) for v in encoder.encode(list(texts[i : i + batch]))]
        return pd.Series(rows, dtype=object)

    return run(text)


def entail(premise: Column, hypothesis: Column, scorer: PairScorer, batch: int = 16) -> Column:
    @pandas_udf("double")
    def run(p: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([s for i in range(0, len(p), batch) for s in scorer.score(list(p[i : i + batch]), list(h[i : i + batch]))], dtype="float64")

    return run(premise, hypothesis)


def similarity(candidate: Column, reference: Column, scorer: SimilarityScorer) -> Column:
    @pandas_udf("struct<p:double,r:double,f1:double>")
    def run(c: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(scorer.score(list(c), list(r)), columns=["p", "r", "f1"], dtype="float64")

    return run(candidate, reference)


def token_sets(text: Column, scorer) -> Column:
    """The token sets of a scorer that has them."""

    @pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([scorer.tokens(t) for t in texts], dtype=object)

    return run(text)


def each_or_blank(translator: Translator, texts: list[str]) -> list[str]:
    """Translations of a batch; where the service fails or gives another number of them, each text goes alone and a failing one is blank."""
    try:
        out = translator.translate(texts)
        if len(out) == len(texts):
            return list(out)
    except Exception:  # the remote service's own errors
        pass
    if len(texts) == 1:
        return [""]
    return [t for one in texts for t in each_or_blank(translator, [one])]


def translate(text: Column, translator: Translator, batch: int = 64) -> Column:
    """Texts in batches; a failing text is an empty string, not a failed job."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([t for i in range(0, len(texts), batch) for t in each_or_blank(translator, list(texts[i : i + batch]))], dtype=object)

    return run(text)


def batch_request(texts: list[str], source: str, target: str) -> str:
    """The prompt that asks a language model for a batch: numbered texts, and one JSON object back."""
    import json

    listed = json.dumps({"texts": texts}, ensure_ascii=False)
    return f'Translate each text from {source} to {target}. Answer with JSON alone, {{"translations": [...]}}, one for each text in the same order.\n{listed}'


def batch_answer(answer: str, n: int) -> list[str]:
    """The translations of a model's answer; an error where it is no such JSON or has not ``n`` of them."""
    import json

    found = json.loads(answer[answer.index("{") : answer.rindex("}") + 1])["translations"]
    if not isinstance(found, list) or len(found) != n:
        raise ValueError(f"{n} translations were asked for")
    return [str(t).strip() for t in found]


class PromptedTranslator:
    """Translation by a language model that ``ask`` reaches: a prompt in, its answer out. None is reached unless it is passed in."""

    def __init__(self, ask, source: str = "Bulgarian", target: str = "English"):
        self.ask, self.source, self.target = ask, source, target

    def translate(self, texts: list[str]) -> list[str]:
        return batch_answer(self.ask(batch_request(texts, self.source, self.target)), len(texts))


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means of token vectors (text, token, dimension) over the tokens that the mask keeps."""
    kept = mask[:, :, None].astype(states.dtype)
    return (states * kept).sum(axis=1) / np.maximum(kept.sum(axis=1), 1e-9)


def detect_language(text: Column, detector: LanguageDetector) -> Column:
    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([detector.detect(t) for t in texts], dtype=object)

    return run(text)
