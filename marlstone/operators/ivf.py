"""An approximate vector index: rows in lists by their nearest centroid, searched list by list.

Centroids are fitted by k-means on a sample of at most about ``SAMPLE`` rows, the one bounded thing here; every row is indexed,
by a matrix product in its task, into a table partitioned by list. A search looks at the ``probes`` lists whose centroids are nearest to the
query, so it reads that share of the table, and ranks their rows exactly. With as many probes as lists it is the exact scan.
How many probes a search takes if it does not say is measured on the sample: the fewest that find ``RECALL`` of the ten nearest.
Vectors without clusters need most lists for that, and the index then saves little.
Vectors of another length than the centroids', and zero ones, are in a list of their own, which every search looks at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.config import SEARCH_LIMIT
from marlstone.operators import vector as V

SAMPLE = 20_000
ROUNDS = 12
RECALL = 0.95
#: Rows of the sample that are searched for in it, to measure probes.
ASKED = 500
ODD = -1


@dataclass(frozen=True)
class Ivf:
    path: str
    centroids: np.ndarray
    key: str
    vector: str
    probes: int
    schema: T.StructType

    def table(self, df_or_spark) -> DataFrame:
        spark = df_or_spark.sparkSession if isinstance(df_or_spark, DataFrame) else df_or_spark
        return spark.read.schema(self.schema).parquet(self.path)

    def search(self, spark, query: list[float], k: int = SEARCH_LIMIT, probes: int | None = None, **how) -> DataFrame:
        """The k nearest rows of the probed lists; ``how`` is passed to the exact search."""
        if len(query) == self.centroids.shape[1]:
            near = np.argsort(-(self.centroids @ V._unit(np.array([query], np.float64))[0]), kind="stable")[: probes or self.probes]
        else:
            near = []
        lists = [ODD, *map(int, near)]
        return V.search(self.table(spark).where(F.col("list").isin(lists)), query, k, vector=self.vector, key=self.key, **how)


def centroids(sample: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; fewer than ``lists`` if there are fewer distinct vectors."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    at = distinct[rng.choice(len(distinct), min(lists, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        near = np.argmax(sample @ at.T, axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        empty = ~np.any(sums, axis=1)
        sums[empty] = at[empty]
        at = V._unit(sums)
    return at


def _listed(shared, names: list[str], vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            v = batch.column(batch.schema.get_field_index(vector))
            size = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
            mine = np.flatnonzero(size == at.shape[1])
            found = np.full(batch.num_rows, ODD, np.int32)
            if len(mine):
                m = np.array(v.take(pa.array(mine)).flatten(), np.float64).reshape(len(mine), at.shape[1])
                found[mine] = np.where(np.any(m, axis=1), np.argmax(m @ at.T, axis=1), ODD)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*names, "list"])

    return run


def build(df: DataFrame, path: str, lists: int, key: str = "id", vector: str = "embedding", sample: int = SAMPLE) -> Ivf:
    """Fits centroids, and writes all rows with their list to the path."""
    spark = df.sparkSession
    rows = df.where(F.col(vector).isNotNull())
    share = min(1.0, sample / max(rows.count(), 1))
    drawn = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("ivf")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + (share == 1.0)))
    found = [np.array(r[0], np.float64) for r in drawn.select(vector).toLocalIterator()]  # about ``sample``
    length = max((len(x) for x in found), key=[len(x) for x in found].count, default=1)
    of = V._unit(np.array([x for x in found if len(x) == length and np.any(x)], np.float64).reshape(-1, length))
    at = centroids(of, lists) if len(of) else np.zeros((1, length))
    shared = spark.sparkContext.broadcast(at)
    schema = T.StructType([*df.schema.fields, T.StructField("list", T.IntegerType())])
    listed = df.mapInArrow(_listed(shared, df.columns, vector), schema)
    listed.write.mode("overwrite").partitionBy("list").parquet(path)
    return Ivf(path, at, key, vector, probes_for(of, at), schema)


def probes_for(sample: np.ndarray, at: np.ndarray, recall: float = RECALL, k: int = 10) -> int:
    """The fewest probes by which rows of the sample find that share of their k nearest in it."""
    asked, scores = sample[:ASKED], sample[:ASKED] @ sample.T
    if len(sample) <= k:
        return len(at)
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    home = np.argmax(sample @ at.T, axis=1)
    place = np.argsort(np.argsort(-(asked @ at.T), axis=1, kind="stable"), axis=1)  # of each list for each query
    needed = np.sort(np.take_along_axis(place, home[nearest], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
