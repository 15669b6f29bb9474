"""Pluggable embedding, language-model, OCR and segmentation, and deterministic stand-ins.

Hooks are batch-oriented and picklable. ``embed_column`` and ``complete_column`` turn them into Arrow-batched columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.config import EMBED_BATCH


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LanguageModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class Ocr(Protocol):
    def extract(self, images: list[bytes]) -> list[str | None]: ...


class Segmenter(Protocol):
    def segment(self, text: str) -> list[str]: ...


class ByteEmbedder:
    """Bytes over 255, padded; the Column form is functions.vector.byte_embedding."""

    def __init__(self, dimensions: int = 768, pad: float = 0.0) -> None:
        self.dimensions, self.pad = dimensions or 768, pad

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            head = [b / 255 for b in (text or "").encode()[: self.dimensions]]
            out.append(head + [self.pad] * (self.dimensions - len(head)))
        return out


class NoOcr:
    """Reads nothing."""

    def extract(self, images: list[bytes]) -> list[str | None]:
        return [None] * len(images)


_RUN = re.compile(r"[㐀-鿿]+|[^\W_]+|[^\w\s]|_")
_HAN = re.compile("[㐀-鿿]")


class WordSegmenter:
    """ASCII words, and Han runs cut by a dictionary (longest match) or, without one, into pairs of characters."""

    def __init__(self, dictionary: frozenset[str] = frozenset()) -> None:
        self.dictionary = dictionary
        self.longest = max(map(len, dictionary), default=2)

    def segment(self, text: str) -> list[str]:
        runs = _RUN.findall(text or "")
        if not _HAN.search(text or ""):
            return runs
        out: list[str] = []
        for run in runs:
            if not "㐀" <= run[0] <= "鿿" or len(run) == 1:
                out.append(run)
            elif self.dictionary:
                at = 0
                while at < len(run):
                    size = next((n for n in range(min(self.longest, len(run) - at), 1, -1) if run[at : at + n] in self.dictionary), 1)
                    out.append(run[at : at + size])
                    at += size
            else:
                out += [run[i : i + 2] for i in range(len(run) - 1)]
        return out

    def tokens(self, text: str) -> str:
        """Joined by single spaces; the text itself if nothing is found."""
        return " ".join(self.segment(text)) or (text or "")


#: What the stand-in model extracts: (words that all must occur, low-level, high-level), later rows win.
KEYWORD_RULES = [
    (("sqliteai",), ["SQLiteAI"], None), (("golang",), ["Golang"], None), (("database",), None, ["Database"]), (("javascript",), ["JavaScript"], None),
    (("apple",), ["Apple"], None), (("fruit",), None, ["Fruit"]), (("ecosystem",), None, ["Ecosystem"]), (("capital",), None, ["Capital"]),
    (("mockentity",), ["MockEntity"], None), (("fox",), ["Fox"], None), (("french",), ["Paris"], ["Capital", "City"]), (("paris",), ["Paris"], ["Capital", "City"]),
    (("eiffel",), ["Eiffel Tower"], ["Landmark", "Architecture"]), (("tower",), ["Eiffel Tower"], ["Landmark", "Architecture"]),
]
#: (words that all must occur in the text, entity, relationship), the first wins.
ENTITY_RULES = [
    (("SQLiteAI",), ("SQLiteAI", "Database", "SQLite AI driver"), ("Golang", "BUILT_FOR", "Used in Go")),
    (("Apple", "fruit"), ("Apple", "Fruit", "A type of fruit"), None),
    (("Apple",), ("Apple", "Company", "Technology company"), None),
    ((), ("MockEntity", "MockType", "MockDesc"), ("OtherEntity", "MOCK_REL", "MockRelDesc")),
]


class RuleModel:
    """A deterministic stand-in that answers the package's own prompts from word rules."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        lower = prompt.lower()
        if "low-level" in lower and "high-level" in lower:
            asked = lower.rpartition("-query-")[2]
            found: dict[str, list[str]] = {"low_level": [], "high_level": []}
            for words, low, high in KEYWORD_RULES:
                if all(w in asked for w in words):
                    found["low_level"] = low or found["low_level"]
                    found["high_level"] = high or found["high_level"]
            return json.dumps(found)
        if "-text-" in lower and "entities" in lower:
            text = prompt[lower.rindex("-text-") + 6 :]
            _, (name, kind, about), rel = next(r for r in ENTITY_RULES if all(w in text for w in r[0]))
            rels = [{"source": name, "target": rel[0], "relation": rel[1], "description": rel[2]}] if rel else []
            return json.dumps({"entities": [{"name": name, "type": kind, "description": about}], "relationships": rels})
        if "Question:" in prompt:
            context = prompt.partition("Context:")[2].partition("Question:")[0].strip()
            question = prompt.partition("Question:")[2].strip().split("\n")[0]
            return f"I am a simple LLM. Question: {question}. Context: {context}"
        return "Simple LLM response"


KEYWORD_PROMPT = "List the low-level keywords (things, names) and the high-level keywords (themes) of the query as JSON with the lists low_level and high_level.\n-Query-\n{query}"
EXTRACT_PROMPT = 'List the entities (name, type, description) and relationships (source, target, relation, description) of the text as JSON with the lists "entities" and "relationships".\n-Text-\n{text}'
ANSWER_PROMPT = "Answer the question from the context alone.\nContext:\n{context}\nQuestion: {query}\n"


def embed_column(embedder: Embedder, batch: int = EMBED_BATCH) -> Callable[[Column], Column]:
    @F.pandas_udf("array<float>")
    def embedded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            known = series.dropna().tolist()
            vectors = [v for k in range(0, len(known), batch) for v in embedder.embed(known[k : k + batch])]
            found = iter(vectors)
            yield pd.Series([None if pd.isna(t) else next(found) for t in series], dtype=object)

    return embedded


def complete_column(model: LanguageModel) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def completed(prompts: pd.Series) -> pd.Series:
        return pd.Series(model.complete(prompts.fillna("").tolist()))

    return completed


def segment_column(segmenter: Segmenter) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(segmenter.segment(t)) or t)

    return tokens


def ocr_column(ocr: Ocr | None = None) -> Callable[[Column], Column]:
    reader = ocr or NoOcr()

    @F.pandas_udf("string")
    def read(images: pd.Series) -> pd.Series:
        return pd.Series(reader.extract(images.tolist()), dtype=object)

    return read


def transform_documents(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Documents through transformers, in order."""
    for step in steps:
        df = df.transform(step)
    return df
