"""Streams: the embedding worker, and windowed aggregates with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.config import WORKER_BATCH
from marlstone.operators.collections import COMPLETED, FAILED, PENDING, backlog
from marlstone.operators.hooks import Embedder, embed_column


def embed_pending(batch: DataFrame, embedder: Embedder, content: str = "content", vector: str = "embedding") -> DataFrame:
    """Embeds pending rows and completes them; a row without a vector fails, others pass through."""
    pending = F.col("embedding_status") == PENDING
    made = F.when(pending, embed_column(embedder)(F.col(content))).otherwise(F.col(vector))
    out = batch.withColumn(vector, made)
    return out.withColumn("embedding_status", F.when(~pending, F.col("embedding_status")).when(F.col(vector).isNull(), FAILED).otherwise(COMPLETED))


def embed_backlog(df: DataFrame, embedder: Embedder, limit: int = WORKER_BATCH, key: str = "id") -> DataFrame:
    """The synchronous form: the next version of a collection with at most ``limit`` more rows embedded."""
    done = embed_pending(backlog(df, limit, key), embedder)
    return df.join(done.select(key), key, "left_anti").unionByName(done)


def embedding_worker(spark: SparkSession, staging: str, out: str, checkpoint: str, schema, embedder: Embedder, interval: str | None = "2 seconds") -> StreamingQuery:
    """Embeds rows that arrive in a staging folder and appends them to a Parquet folder; without interval, what is there
    and then stops. Each micro-batch is idempotent: it writes the folder of its own number."""

    def write(batch: DataFrame, number: int) -> None:
        embed_pending(batch, embedder).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", WORKER_BATCH).parquet(staging)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def wait(query: StreamingQuery, timeout: float | None = None) -> bool:
    """Until all that has arrived is processed; for a query that stops by itself, until it has."""
    if timeout is None:
        query.processAllAvailable() if query.isActive else None
        return True
    return bool(query.awaitTermination(timeout))


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def windowed(df: DataFrame, size: str, slide: str | None = None, late: str | None = None, by: tuple[str, ...] = (), time: str = "ts", **aggs: Column) -> DataFrame:
    """Tumbling or sliding windows; with ``late`` a watermark, for streams."""
    rows = event_time(df, time)
    rows = rows.withWatermark(time, late) if late else rows
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = rows.groupBy(w.alias("w"), *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *aggs)


def sessions(df: DataFrame, gap: str, by: tuple[str, ...], late: str | None = None, time: str = "ts", **aggs: Column) -> DataFrame:
    rows = event_time(df, time)
    rows = rows.withWatermark(time, late) if late else rows
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *aggs)


def joined(left: DataFrame, right: DataFrame, on: Column, within: Column, late: str, how: str = "inner", left_time: str = "ts", right_time: str = "at") -> DataFrame:
    """Two streams (or tables) joined by a key condition and a bound between their event times, so that state can be let go."""
    sides = event_time(left, left_time).withWatermark(left_time, late), event_time(right, right_time).withWatermark(right_time, late)
    return sides[0].join(sides[1], on & within, how)


def running(df: DataFrame, by: str, value: str) -> DataFrame:
    """A stateful operator: per key, after each micro-batch in which it had rows, its number of rows and sum so far."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch[value].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({by: [key[0]], "n": [n], "total": [total]})

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, F.col(value).cast("double").alias(value)).groupBy(by).applyInPandasWithState(step, f"{by} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def throttled(rate: float):
    """Wraps an embedder's ``embed`` so that a task makes at most ``rate`` calls a second."""

    def wrap(embedder: Embedder) -> Embedder:
        class Slow:
            dimensions = embedder.dimensions

            def embed(self, texts: list[str]) -> list[list[float]]:
                import time

                time.sleep(1 / rate)
                return embedder.embed(texts)

        return Slow()

    return wrap
