"""Fusion of ranked lists: all are unions and one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.config import RRF_K


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rrf(lists: list[DataFrame], key: str = "id", k: int = RRF_K) -> DataFrame:
    """Sum over lists of 1 / (rank + k), ranks from 0 by falling score; scores count to nine digits. Lists are top-k results."""
    rank = F.row_number().over(W.partitionBy("__list").orderBy(F.desc(F.round("score", 9)), key)) - 1
    rows = _union([x.select(key, "score", F.lit(i).alias("__list")) for i, x in enumerate(lists)]).withColumn("__rank", rank)
    return rows.groupBy(key).agg(F.sum(1.0 / (F.col("__rank") + k)).alias("score"))


def weighted(lists: list[tuple[DataFrame, float]], key: str = "id") -> DataFrame:
    """Weighted sum of scores; with sources, the row's own or hybrid if they differ."""
    rows = _union([x.withColumn("score", F.col("score") * w) for x, w in lists])
    out = [F.sum("score").alias("score")]
    if "source" in rows.columns:
        out.append(F.when(F.count_distinct("source") > 1, "hybrid").otherwise(F.first("source")).alias("source"))
    return rows.groupBy(key).agg(*out)


def additive(lists: list[DataFrame], key: str = "id") -> DataFrame:
    """Sum of scores."""
    return _union([x.select(key, "score") for x in lists]).groupBy(key).agg(F.sum("score").alias("score"))


def first_wins(lists: list[DataFrame], key: str = "id", triples: str = "recalled_triples") -> DataFrame:
    """Each key's row from the first list that has it; triples of all lists are put together."""
    rows = _union([x.withColumn("__list", F.lit(i)) for i, x in enumerate(lists)])
    rest = [c for c in rows.columns if c not in (key, triples, "__list")]
    agg = [F.min_by(F.struct(*rest), "__list").alias("__row")]
    if triples in rows.columns:
        agg.append(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__list", F.col(triples).alias("t")))), lambda x: x.t)).alias(triples))
    return rows.groupBy(key).agg(*agg).select(key, "__row.*", *([triples] if triples in rows.columns else []))


def positional(df: DataFrame, order: list, name: str = "score") -> DataFrame:
    """1 / position in a ranked (bounded) result, taken before later filters."""
    return df.withColumn(name, F.lit(1.0) / F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """Citation numbers from 1."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))
