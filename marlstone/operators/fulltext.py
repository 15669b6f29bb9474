"""Full-text search: an inverted index as a DataFrame, BM25, and substring fallbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.config import SEARCH_LIMIT
from marlstone.functions import json as J
from marlstone.functions import text as X
from marlstone.operators.fusion import positional
from marlstone.operators.hooks import Segmenter, segment_column
from marlstone.session import cut

K1, B = 1.2, 0.75


def tokenized(df: DataFrame, segmenter: Segmenter, content: str = "content", out: str = "content_tokens") -> DataFrame:
    """Adds or renews the tokens column."""
    return df.withColumn(out, segment_column(segmenter)(F.col(content)))


def index(df: DataFrame, key: str = "id", content: str = "content", terms: Callable[[Column], Column] = X.ascii_tokens) -> tuple[DataFrame, DataFrame]:
    """Postings (term, key, tf) and lengths (key, len)."""
    tokens = df.select(key, terms(F.col(content)).alias("__terms"))
    postings = tokens.select(key, F.explode("__terms").alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
    return postings, tokens.select(key, F.size("__terms").cast("long").alias("len")).where("len > 0")


def _times(tokens: str, word: str) -> Column:
    """How often a word is in an array of tokens."""
    return (F.size(tokens) - F.size(F.array_remove(F.col(tokens), word))).cast("long")


def bm25(df: DataFrame, query_terms: list[str], key: str = "id", content: str = "content", k: int | None = SEARCH_LIMIT, terms: Callable[[Column], Column] = X.ascii_tokens) -> DataFrame:
    """BM25 scores of documents that hold a term.

    One scan of the texts: each document's length and term frequencies are array expressions over its own tokens, and are
    written as a narrow table that statistics and scores read. Corpus statistics are a row for each term.
    """
    wanted = sorted(set(query_terms))
    tokens = df.select(key, terms(F.col(content)).alias("__t")).select(key, F.size("__t").cast("long").alias("len"), *[_times("__t", w).alias(f"__tf{i}") for i, w in enumerate(wanted)]).where("len > 0")
    tokens = cut(tokens, "bm25")
    tf = [F.col(f"__tf{i}") for i in range(len(wanted))]
    stats = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(x > 0).alias(f"df{i}") for i, x in enumerate(tf)]).first()
    if not stats["n"] or not wanted:
        return tokens.select(key, F.lit(0.0).alias("score")).limit(0)
    n, score = stats["n"], F.lit(0.0)
    for i, x in enumerate(tf):
        d = stats[f"df{i}"]
        idf = F.log(F.lit((n - d + 0.5) / (d + 0.5) + 1))
        score = score + F.when(x > 0, idf * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("len") / F.lit(float(stats["avg"]))))).otherwise(0.0)
    hits = tokens.select(key, score.alias("score"), F.greatest(*tf, F.lit(0)).alias("__any")).where("__any > 0").drop("__any")
    return hits if k is None else hits.orderBy(F.desc("score"), key).limit(k)


def bm25_from_index(postings: DataFrame, lengths: DataFrame, query_terms: list[str], key: str = "id", k: int = SEARCH_LIMIT) -> DataFrame:
    """The same from a stored index: only the query's postings are read."""
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()
    hits = postings.where(F.col("term").isin(sorted(set(query_terms))))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(df), "term").join(lengths, key)  # a row for each query term
    n = F.lit(stats["n"])
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(stats["avg"] or 1.0))))
    return rows.groupBy(key).agg(F.sum(part).alias("score")).orderBy(F.desc("score"), key).limit(k)


def substring_any(df: DataFrame, query_terms: list[str], columns: tuple[str, ...] = ("content",), key: str = "id", k: int | None = SEARCH_LIMIT) -> DataFrame:
    """Documents with any term in any column, by id."""
    hits = df.where(X.like_any([F.col(c) for c in columns], query_terms))
    return hits if k is None else hits.orderBy(key).limit(k)


def substring_phrase(df: DataFrame, phrase: str, column: str = "content", key: str = "id", k: int = SEARCH_LIMIT, fallback: str = "data") -> DataFrame:
    """Documents with the phrase as it is, score 1; ``fallback`` is searched where the column is not there."""
    column = column if column in df.columns else fallback
    return df.where(F.col(column).contains(phrase)).orderBy(key).limit(k).withColumn("score", F.lit(1.0))


def all_words(df: DataFrame, query: str, content: str = "content", key: str = "id", k: int = SEARCH_LIMIT, any_word: bool = False) -> DataFrame:
    """Documents with all words (or any), scored by the share of words found."""
    words = query.lower().split()
    test = X.like_any([F.col(content)], words) if any_word else X.has_all(F.col(content), words)
    hits = df.where(test).withColumn("score", X.coverage(F.col(content), words))
    return hits.orderBy(F.desc("score"), key).limit(k)


def search(df: DataFrame, query: str, segmenter: Segmenter | None = None, key: str = "id", content: str = "content", k: int = SEARCH_LIMIT) -> DataFrame:
    """Ids by BM25; if that finds none, by substring."""
    tokens = " ".join(segmenter.segment(query)) if segmenter else None
    terms = X.search_terms(query, tokens)
    source = "content_tokens" if "content_tokens" in df.columns else content
    how = (lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), " ")) if source != content else X.ascii_tokens
    ranked = bm25(df, [t.lower() for t in terms], key, source, k, how)
    if terms and not ranked.isEmpty():
        return ranked
    columns = tuple(dict.fromkeys([content, source]))
    return substring_any(df, terms or [query], columns, key, k).select(key, F.lit(0.0).alias("score"))


def find_with_scores(df: DataFrame, query: str, filters: dict | None = None, segmenter: Segmenter | None = None, key: str = "id", k: int = SEARCH_LIMIT) -> DataFrame:
    """Documents of a search, filtered first, scored by 1 / position."""
    rows = df.where(J.matches(filters, F.col("metadata"))) if filters else df
    hits = positional(search(rows, query, segmenter, key, k=k).withColumnRenamed("score", "__bm25"), [F.desc("__bm25"), key]).drop("__bm25")
    return rows.join(F.broadcast(hits), key).orderBy(F.desc("score"), key)  # hits: at most k rows
