"""Exact vector search: one scan, one score, one top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.config import MEDIA_WEIGHTS, SEARCH_LIMIT
from marlstone.functions import json as J
from marlstone.functions import vector as V
from marlstone.operators.fusion import weighted


def ready(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a finished embedding."""
    df = df.where(F.col(vector).isNotNull())
    return df.where(F.col("embedding_status") == "completed") if "embedding_status" in df.columns else df


def scored(df: DataFrame, query: list[float], vector: str = "embedding", name: str = "score") -> DataFrame:
    return df.withColumn(name, V.cosine_to(F.col(vector), query))


def top_k(df: DataFrame, k: int = SEARCH_LIMIT, key: str = "id", by: str = "score") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), key).limit(k if k > 0 else SEARCH_LIMIT)


def search(df: DataFrame, query: list[float], k: int = SEARCH_LIMIT, filters: dict | None = None, threshold: float | None = None, vector: str = "embedding", key: str = "id", where: Column | None = None, metadata: tuple[str, ...] = ("metadata",)) -> DataFrame:
    """The k rows nearest to the query among those that pass status, filters and threshold, all before the cut."""
    rows = ready(df, vector)
    if filters:
        rows = rows.where(J.matches(filters, *[F.col(c) for c in metadata]))
    if where is not None:
        rows = rows.where(where)
    rows = scored(rows, query, vector)
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    return top_k(rows.withColumn("distance", V.distance(F.col("score"))), k, key)


def search_postfiltered(df: DataFrame, query: list[float], k: int, filters: dict, key: str = "id") -> DataFrame:
    """Compatible form: filters what twice the limit fetched, so it may return fewer."""
    fetched = top_k(scored(ready(df), query), 2 * k, key)
    return top_k(fetched.where(J.matches(filters, F.col("metadata"))), k, key)


def search_many(df: DataFrame, queries: DataFrame, k: int = SEARCH_LIMIT, key: str = "id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """Nearest k for each row of a stated query set (query_id, query_vector), by blocks of queries against all rows.

    A block of queries is a matrix that is broadcast, and one scan multiplies each Arrow batch of rows by it. A task keeps the
    best k of each query, so only these leave it. Scores are compared to twelve digits, then by key. Vectors of another
    length than the query's, and zero ones, score 0.
    """
    rows, found, batch = ready(df, vector).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")), None, []
    kind = rows.schema["key"].dataType.simpleString()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), key))

    def scan() -> DataFrame:
        ids = df.sparkSession.createDataFrame([(i, q["query_id"]) for i, q in enumerate(batch)], f"at int, query_id {queries.schema['query_id'].dataType.simpleString()}")
        shared = df.sparkSession.sparkContext.broadcast(_by_length([q["query_vector"] for q in batch]))
        best = rows.mapInArrow(_nearest(shared, len(batch), k), f"at int, key {kind}, score double").join(F.broadcast(ids), "at")
        return best.select("query_id", F.col("key").alias(key), "score").withColumn("rank", rank).where(F.col("rank") <= k)

    for q in queries.toLocalIterator():
        batch.append(q)
        if len(batch) == block:
            found, batch = scan() if found is None else found.unionByName(scan()), []
    if batch or found is None:
        found = scan() if found is None else found.unionByName(scan())
    return found


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(length > 0, length, 1.0)[:, None]


#: Scores that a task holds at once.
SCORES = 1 << 20


def _by_length(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of queries, by length."""
    asked: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        asked.setdefault(len(v), []).append(i)
    return {n: (np.array(at), _unit(np.array([vectors[i] for i in at], np.float64).reshape(len(at), n))) for n, at in asked.items()}


def _nearest(queries, count: int, k: int):
    """The best k rows of each query in a task; rows are scored ``SCORES`` at a time, whatever the size of their batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = queries.value, None
        floor = np.full(count, -np.inf)  # the k-th score of each query so far

        def best(found: pa.Table) -> pa.Table:
            """The best k of each query."""
            found = found.append_column("r", pc.round(found["score"], 12)).sort_by([("at", "ascending"), ("r", "descending"), ("key", "ascending")])
            at = found["at"].to_numpy()
            place = np.arange(len(at)) - np.searchsorted(at, at)
            last = place == k - 1
            floor[at[last]] = found["score"].to_numpy()[last]
            return found.filter(pa.array(place < k)).drop_columns(["r"])

        step = max(1, SCORES // max(count, 1))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            v = batch.column("v")
            size = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            scores = np.zeros((batch.num_rows, count))
            for n in np.unique(size):
                if n in of and n:
                    at, q = of[int(n)]
                    mine = np.flatnonzero(size == n)
                    m = np.array(v.take(pa.array(mine)).flatten(), np.float64).reshape(len(mine), int(n))
                    scores[np.ix_(mine, at)] = _unit(m) @ q.T
            scores = scores.round(12) + 0.0
            # Ties with the k-th stay until keys decide.
            good = scores >= floor
            if len(scores) > k and np.count_nonzero(good) > 2 * k * count:
                good &= scores >= np.partition(scores, -k, axis=0)[-k]
            row, col = np.nonzero(good)
            if len(row):
                new = pa.table({"at": pa.array(col.astype(np.int32)), "key": batch.column("key").take(pa.array(row)), "score": pa.array(scores[row, col])})
                held = best(new if held is None else pa.concat_tables([held, new]))
        if held is not None:
            yield from held.combine_chunks().to_batches(10_000)

    return run


def search_media(df: DataFrame, text_query: list[float] | None, image_query: list[float] | None, k: int = SEARCH_LIMIT, images_first: bool = False, key: str = "id") -> DataFrame:
    """Text and image hits together, by score, or images before texts in the compatible form."""
    arms = [search(df, q, k, vector=f"{kind}_embedding", key=key).select(key, "content", "score", F.lit(kind).alias("source"), F.lit(rank).alias("__rank")) for rank, kind, q in ((0, "image", image_query), (1, "text", text_query)) if q]
    both = arms[0] if len(arms) == 1 else arms[0].unionByName(arms[1])
    order = ["__rank"] if images_first else []
    return both.orderBy(*order, F.desc("score"), key).limit(k).drop("__rank")


def search_hybrid(df: DataFrame, text_query: list[float], image_query: list[float], k: int = SEARCH_LIMIT, weights: tuple[float, float] = MEDIA_WEIGHTS, key: str = "id") -> DataFrame:
    """Weighted sum of both arms' scores; source is hybrid where a row is in both."""
    text = search(df, text_query, 2 * k, vector="text_embedding", key=key).select(key, "score", F.lit("text").alias("source"))
    image = search(df, image_query, 2 * k, vector="image_embedding", key=key).select(key, "score", F.lit("image").alias("source"))
    return top_k(weighted([(text, weights[0]), (image, weights[1])], key), k, key)


def search_inverted(df: DataFrame, query: list[float], k: int = SEARCH_LIMIT, key: str = "id") -> DataFrame:
    """Compatible form that takes similarity for distance: least similar first."""
    rows = scored(ready(df), query).withColumn("distance", V.distance(F.col("score")))
    return rows.orderBy("score", key).limit(k)
