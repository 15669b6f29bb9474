"""SQL passthrough and table files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, prefix: str = "", names: tuple[str, ...] = NAMES) -> None:
    """Registers tables as views, under a prefix that is their namespace."""
    for name in names:
        parquet(spark, sf_dir, name).createOrReplaceTempView(f"{prefix}{name}")


def sql(spark: SparkSession, text: str, **args) -> DataFrame:
    """A parameterised statement (:name)."""
    return spark.sql(text, args=args or None)


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Parquet, CSV, JSON, ORC or text by extension; JDBC tables by kind, with the driver's jar supplied."""
    kind = kind or path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.options(**options)
    if kind == "jdbc":
        return reader.format("jdbc").load()
    if kind in ("csv", "tsv"):
        return reader.option("header", "true").option("inferSchema", "true").option("sep", "\t" if kind == "tsv" else ",").csv(path)
    if kind in ("json", "jsonl"):
        return reader.json(path)
    if kind in ("txt", "text", "md"):
        return reader.text(path, wholetext=True)
    return reader.format(kind if kind in ("parquet", "orc", "avro") else "parquet").load(path)


def snapshot(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """A Parquet copy of a collection, partitioned by one of its columns if asked for."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
