"""What the operators of this subpackage share: scratch tables and text expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import remove, remove_at_exit, shared_folder, spread

#: White space of all operators: U+0020 and U+0009 to U+000D, nothing else.
WS = r"[\x20\x09-\x0D]"


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, in the shared one; it goes when the interpreter ends."""
    own = f"{shared_folder(spark)}/marlstone-{spark.sparkContext.applicationId}"
    remove_at_exit(spark, own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and no lost executor can take it along."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the scratch table that ``df`` reads, once nothing reads it any more; other tables are left alone."""
    spark = df.sparkSession
    own = scratch_root(spark).split(":", 1)[-1].replace("//", "/")
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].replace("//", "/").lstrip("/").startswith(own.lstrip("/") + "/"):
            remove(spark, folder)


def no_space(text: Column) -> Column:
    """The text without any white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", "")


def turned(key: Column) -> Column:
    """A long in another form. Joining on it makes Spark shuffle both sides anew, even one that is grouped by the key
    already; only such joins let adaptive execution split a hot key's partition."""
    return F.bitwise_not(key)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of the given folder, over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))
