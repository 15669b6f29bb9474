"""Attachments: files under a folder by date, and their metadata as a DataFrame."""

from __future__ import annotations

import datetime as dt
import hashlib
import mimetypes
import os
import secrets
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.schemas import ATTACHMENTS
from marlstone.sources.files import files


class AttachmentStore:
    """Writes files on the driver's file system, as single uploads come in; lists and reads through Spark."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def store(self, name: str, data: bytes, metadata: str | None = None, now: dt.datetime | None = None) -> dict:
        """Stores a file as YYYYMMDD/xxxxxx_name and returns its metadata row. A failed write leaves no file."""
        now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
        prefix = "".join(secrets.choice(string.ascii_lowercase + string.digits) for _ in range(6))
        relative = f"{now:%Y%m%d}/{prefix}_{os.path.basename(name)}"
        path = os.path.join(self.root, relative)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            with open(path, "wb") as f:
                f.write(data)
        except OSError:
            if os.path.exists(path):
                os.remove(path)
            raise
        kind = mimetypes.guess_type(name)[0] or "application/octet-stream"
        return {"file_id": relative, "relative_path": relative, "absolute_path": os.path.abspath(path), "file_size": len(data), "mime_type": kind, "md5": hashlib.md5(data).hexdigest(), "metadata": metadata, "created_at": now, "updated_at": now}

    def store_file(self, source: str, metadata: str | None = None) -> dict:
        with open(source, "rb") as f:
            return self.store(source, f.read(), metadata)

    def table(self, rows: list[dict]) -> DataFrame:
        return self.spark.createDataFrame([[r[f.name] for f in ATTACHMENTS.fields] for r in rows], ATTACHMENTS)

    def listing(self, date_dir: str | None = None) -> DataFrame:
        """file_id, file_size, modified, date_dir of the stored files, of one date or all."""
        found = files(self.spark, self.root).select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
        parts = F.regexp_extract("path", r"([0-9]{8})/[^/]+$", 1)
        found = found.select(F.regexp_extract("path", r"([0-9]{8}/[^/]+)$", 1).alias("file_id"), "file_size", "modified", parts.alias("date_dir")).where("file_id != ''")
        return found.where(F.col("date_dir") == date_dir) if date_dir else found

    def contents(self, metadata: DataFrame) -> DataFrame:
        """Metadata with the bytes of each file; where metadata lacks a fact, the file system's is taken."""
        found = files(self.spark, self.root).select(F.regexp_extract("path", r"([0-9]{8}/[^/]+)$", 1).alias("file_id"), F.col("path").alias("__path"), F.col("length").alias("__size"), "content")
        joined = metadata.join(found, "file_id", "left")
        return joined.withColumns({"file_size": F.coalesce("file_size", "__size"), "absolute_path": F.coalesce("absolute_path", "__path")}).drop("__path", "__size")

    def delete(self, metadata: DataFrame, file_id: str) -> DataFrame:
        """Metadata without the file, which goes too."""
        left = metadata.where(F.col("file_id") != file_id)
        path = os.path.join(self.root, file_id)
        if os.path.exists(path):
            os.remove(path)
        return left
