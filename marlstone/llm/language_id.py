"""Language identification, word first with back-off to character n-grams.

A word that the model knows is scored by its log frequency in each language. A word it does not know is scored by its
character n-grams of the greatest length of which the model knows any, down to single characters, with a cost for each
shorter length. The language with the largest sum over a text wins; the score is its share of probability.

The model is fitted on a sample of labelled rows of about ``SAMPLE`` documents and holds all words of these;
a language has its share of the sample, but about ``LEAST`` documents if it has as many, and one in any case;
rows whose crc32 of the id modulo ``FOLDS`` is 0 are never in it. Prediction reads whole texts and nothing but the text.
A word is a run of letters, characters of Unicode's category L, in lower case; marks, numbers and all else part words.

Defined cases: null text and text without a letter are ``und`` with score 0; a model without languages (no labelled rows)
calls every text ``und``; equal scores go to the language that comes first by name; rows with a null id are held in for
training, their remainder being null counts as not 0; repeated rows get the same result each; texts of any length are read
whole; an empty table gives an empty result. Extra columns are kept by ``identify`` and ``keep_identified``; a column of a
result column's name gives way to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import table

SAMPLE = 12_000
#: Documents of a language in the sample, whatever its share of the rows.
LEAST = 200
FOLDS = 5
LONGEST = 4
#: Cost, in log probability, of each step to shorter n-grams.
STEP = math.log(0.4)
CACHE = 200_000
UNKNOWN = "und"
#: Letters, and numeric signs such as fractions; the latter are parted from them afterwards.
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _logs(counts: dict[str, list[int]]) -> np.ndarray:
    """Smoothed log share of each entry in its language, a row an entry."""
    table = np.array(list(counts.values()), np.float64)
    return np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table))) if counts else table


class Model:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, counts: dict[str, dict[str, int]]) -> None:
        self.langs = sorted(counts)
        k = len(self.langs)
        rows: dict[str, list[int]] = {}
        grams: list[dict[str, list[int]]] = [{} for _ in range(LONGEST + 1)]
        for j, lang in enumerate(self.langs):
            own: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
            for word, n in counts[lang].items():
                rows.setdefault(word, [0] * k)[j] += n
                padded = f"^{word}$"
                for size in range(1, LONGEST + 1):
                    of = own[size]
                    for i in range(len(padded) - size + 1):
                        g = padded[i : i + size]
                        of[g] = of.get(g, 0) + n
            for of, found in zip(grams, own, strict=True):
                for g, n in found.items():
                    of.setdefault(g, [0] * k)[j] = n
        self.words = {w: i for i, w in enumerate(rows)}
        self.table = _logs(rows).astype(np.float32)
        self.grams = [dict(zip(g, map(tuple, _logs(g).tolist()), strict=True)) for g in grams]

    def unseen(self, word: str) -> list[float]:
        padded = f"^{word}$"
        for size in range(min(LONGEST, len(padded)), 0, -1):
            known = self.grams[size]
            found = [known[x] for i in range(len(padded) - size + 1) if (x := padded[i : i + size]) in known]
            if found:
                cost = STEP * (LONGEST + 1 - size)
                return [sum(logs) / len(found) + cost for logs in zip(*found, strict=True)]
        return [0.0] * len(self.langs)


class Predictor:
    """A model with the scores of words in one table: those that it knows, then unseen ones as they come, ``CACHE`` at most."""

    def __init__(self, model: Model) -> None:
        self.model, self.slot = model, dict(model.words)
        self.table = np.zeros((len(model.words) + CACHE, max(1, len(model.langs))), np.float32)
        if model.words:
            self.table[: len(model.words)] = model.table

    def __call__(self, text: str | None) -> tuple[str, float]:
        langs = self.model.langs
        found = LETTERS.findall((text or "").lower())
        if not found or not langs:
            return UNKNOWN, 0.0
        times = Counter(found)
        for word in [w for w in times if w not in self.slot and not w.isalpha()]:
            n = times.pop(word)
            for part in "".join(c if c.isalpha() else " " for c in word).split():
                times[part] += n
        if not times:
            return UNKNOWN, 0.0
        total = np.zeros(len(langs))
        for word in [w for w in times if w not in self.slot]:
            row = self.model.unseen(word)
            if len(self.slot) < len(self.table):
                self.table[len(self.slot)] = row
                self.slot[word] = len(self.slot)
            else:
                total += np.array(row) * times.pop(word)
        n = np.fromiter(times.values(), np.float64, len(times))
        at = np.fromiter(map(self.slot.__getitem__, times), np.int64, len(times))
        total += n @ self.table[at].astype(np.float64)
        best = int(total.argmax())
        return langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Counts of all words of a sample: at most about ``sample`` documents."""
    # A row's draw is by its id, by its text where it has none; the smallest draw of each language is always in.
    draw = F.pmod(F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col), F.lit("sample"))).otherwise(F.xxhash64(F.col(id_col), F.lit("sample"))), F.lit(1 << 20))
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).withColumn("__ms_draw", draw)
    of = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.min("__ms_draw").alias("first")).collect()
    n = sum(r["n"] for r in of)
    shares = {r["lang"]: 1.0 if n <= sample else min(1.0, max(sample / n, LEAST / r["n"])) for r in of}
    bounds = [(r["lang"], max(int(shares[r["lang"]] * (1 << 20)), r["first"] + 1)) for r in of]
    bounds = docs.sparkSession.createDataFrame(bounds, "__ms_of string, __ms_bound long")
    rows = rows.join(F.broadcast(bounds), F.col(lang_col).cast("string") == F.col("__ms_of")).where("__ms_draw < __ms_bound")
    found = rows.select(F.col(lang_col).cast("string").alias("lang"), F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("word")).where("word != ''")
    counted = found.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in zip(*map(pa.ChunkedArray.to_pylist, counted.toArrow().columns), strict=True):  # the words of the sample
        counts.setdefault(lang, {})[word] = n
    return Model(counts)


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = Predictor(shared.value)
        for batch in texts:
            yield pd.DataFrame([predict(t) for t in batch], columns=["lang", "score"])

    return docs.withColumn("__ms_lang", predicted(F.col(text_col))).withColumns({out[0]: F.col("__ms_lang.lang"), out[1]: F.col("__ms_lang.score")}).drop("__ms_lang")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is identified with at least that score, unchanged."""
    found = identify(docs, fit(docs), out=("__ms_pred", "__ms_score"))
    return found.where((F.col("__ms_pred") != UNKNOWN) & (F.col("__ms_score") >= least)).select(docs.columns)


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
