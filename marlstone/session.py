"""Session with the settings that the plans expect, and shared scratch tables."""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: For sessions whose executors run in the driver's process and that name no folder.
LOCAL_SCRATCH = "file:///tmp/checkpoints"

#: Tables up to this size are spread over all cores if their files are few.
SPREAD_BYTES = 256 << 20

_removed: set[str] = set()


def session(master: str | None = None, name: str = "marlstone", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, for tables between steps.

    Where it is unset, a folder of this machine will do if executors run in the driver's process; on a cluster it would
    not be seen by the others, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        root = LOCAL_SCRATCH
    return root.rstrip("/")


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the interpreter ends, once however often it is asked for."""
    if path not in _removed:
        _removed.add(path)
        atexit.register(remove, spark, path)


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session is gone already
        return
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except (Py4JError, OSError):  # so is its other half
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so loops keep a short lineage. The table goes when the interpreter ends."""
    spark = df.sparkSession
    own = f"{shared_folder(spark)}/marlstone-core-{spark.sparkContext.applicationId}"
    remove_at_exit(spark, own)
    path = f"{own}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is a small table in fewer files than there are cores; else ``df`` as it is.

    A file of one row group is one task however many cores there are. Above ``SPREAD_BYTES`` a table has row groups enough,
    so large inputs are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not 0 < len(df.inputFiles()) < cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES else df
