"""Collections: DataFrame in, DataFrame out. Writers return the collection's next version; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.config import PAGE_LIMIT, SHORT_TEXT
from marlstone.functions import json as J
from marlstone.functions import text as X

PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"


def create(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """The table of that name, created empty if it is not there."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.saveAsTable(name, mode="ignore")
    return spark.table(name)


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def column_type(df: DataFrame, name: str) -> str | None:
    return dict(df.dtypes).get(name)


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Adds the schema's missing columns as nulls."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns})


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    return evolve(df, schema).select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def find_by_id(df: DataFrame, doc_id, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == F.lit(doc_id))


def find_by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def page(df: DataFrame, limit: int = PAGE_LIMIT, offset: int = 0, by: str = "created_at", key: str = "id") -> DataFrame:
    """Newest first; ids order equals. Limit 0 or less is the default."""
    return df.orderBy(F.desc_nulls_last(by), key).offset(max(0, offset)).limit(limit if limit > 0 else PAGE_LIMIT)


def total(df: DataFrame, condition: Column | None = None) -> DataFrame:
    return (df if condition is None else df.where(condition)).agg(F.count(F.lit(1)).alias("n"))


def collections(df: DataFrame, by: str = "collection_name") -> DataFrame:
    return df.select(by).distinct()


def last_of_batch(batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The last row of each key, and in ``__n`` how many rows the batch had of it.

    Rows that ``order`` does not tell apart, all of a key's without one, are in the order of their JSON, so reruns agree.
    """
    by = F.struct(*([F.col(order)] if order else []), F.to_json(F.struct(*batch.columns)).alias("__json"))
    last = batch.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*batch.columns), by).alias("__row"), F.count(F.lit(1)).alias("__n"))
    return last.select("__row.*", "__n")


def prepare(batch: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Derived columns of new documents: those of short text are left out."""
    made = batch.where(~X.short(F.col("content"), SHORT_TEXT))
    return made.withColumns({
        "metadata": J.without(F.col("metadata"), "id", "content", "_rev"),
        "content_tokens": tokens if tokens is not None else F.array_join(X.ascii_tokens(F.col("content")), " "),
        "embedding_status": F.lit(PENDING),
        "chunk_length": F.char_length("content"),
    })


def upsert(old: DataFrame, batch: DataFrame, key: str = "id", order: str | None = None, now: Column | None = None, status: str = PENDING) -> DataFrame:
    """The next version: new content wins and raises ``_rev`` by the rows that the batch has of the id; others stay."""
    new = last_of_batch(batch, key, order)
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    changed = F.col(f"n.{key}").isNotNull()
    out = []
    for f in old.schema.fields:
        if f.name == "_rev":
            value = F.when(changed, F.coalesce(F.col("o._rev"), F.lit(0)) + F.col("n.__n")).otherwise(F.col("o._rev"))
        elif f.name == "embedding_status":
            value = F.when(changed, F.lit(status)).otherwise(F.col("o.embedding_status"))
        elif f.name == "created_at":
            value = F.coalesce(F.col("o.created_at"), F.col("n.created_at") if "created_at" in new.columns else (now if now is not None else F.current_timestamp()))
        elif f.name == "updated_at":
            value = F.when(changed, now if now is not None else F.current_timestamp()).otherwise(F.col("o.updated_at"))
        elif f.name in new.columns:
            value = F.when(changed, F.col(f"n.{f.name}")).otherwise(F.col(f"o.{f.name}"))
        else:
            value = F.col(f"o.{f.name}")
        out.append(value.cast(f.dataType).alias(f.name))
    return joined.select(out)


def replace(old: DataFrame, batch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Insert or replace, without revisions: of equal ids in the batch the last wins."""
    new = last_of_batch(batch, key, order).drop("__n")
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).select(old.columns)


def upsert_vectors(old: DataFrame, batch: DataFrame, dimensions: int, key: str = "id") -> DataFrame:
    """Upsert of completed embeddings; a vector of another length is an error."""
    checked = batch.withColumn("embedding", F.when(F.size("embedding") == dimensions, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("embedding of length "), F.size("embedding").cast("string"), F.lit(f" where {dimensions} is expected"))).cast("array<float>")))
    return upsert(old, checked, key, status=COMPLETED)


def append(old: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Append with generated ids where they are missing or blank."""
    new = batch if key in batch.columns else batch.withColumn(key, F.lit(None).cast("string"))
    new = new.withColumn(key, F.coalesce(F.when(F.trim(F.col(key)) != "", F.col(key)), F.uuid()))
    return old.unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return old.join(ids.select(key), key, "left_anti")


def delete_cascade(old: DataFrame, quads: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Also removes the edges that link entities to the documents."""
    gone = ids.select(F.col(key).alias("object"), F.lit("APPEARS_IN").alias("predicate"))
    return delete(old, ids, key), quads.join(gone, ["object", "predicate"], "left_anti").select(quads.columns)


def update_json(old: DataFrame, changes: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Shallow merges of ``data``; text and tokens follow, and the embedding is the new one or null. Of several changes of an
    id the last counts."""
    n = last_of_batch(changes, key, order).select(F.col(key), F.col("data").alias("__new"), (F.col("embedding") if "embedding" in changes.columns else F.lit(None).cast("array<float>")).alias("__vector"))
    merged = old.join(n, key, "left").withColumn("data", F.when(F.col("__new").isNotNull(), J.merge(F.col("data"), F.col("__new"))).otherwise(F.col("data")))
    content = F.when(F.col("__new").isNotNull(), J.extract_text(F.col("data"))).otherwise(F.col("content"))
    return merged.withColumns({
        "content": content,
        "content_tokens": F.when(F.col("__new").isNotNull(), F.array_join(X.ascii_tokens(content), " ")).otherwise(F.col("content_tokens")),
        "embedding": F.when(F.col("__new").isNotNull(), F.col("__vector")).otherwise(F.col("embedding")),
        "updated_at": F.when(F.col("__new").isNotNull(), F.current_timestamp()).otherwise(F.col("updated_at")),
    }).select(old.columns)


def create_json(old: DataFrame, batch: DataFrame, collection: str) -> DataFrame:
    """Appends JSON documents (``data``); the id is the document's own, or a new one. An id that is there is an error, as
    ``unique`` raises it when the result is read."""
    given = F.get_json_object("data", "$.id")
    made = batch.select(
        F.coalesce(F.when(F.trim(given) != "", given), F.uuid()).alias("id"), F.lit(collection).alias("collection_name"), "data",
        (F.col("embedding") if "embedding" in batch.columns else F.lit(None).cast("array<float>")).alias("embedding"), J.extract_text(F.col("data")).alias("content"),
    )
    made = made.withColumns({"content_tokens": F.array_join(X.ascii_tokens(F.col("content")), " "), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    return unique(old.unionByName(made, allowMissingColumns=True), made.select("id").where(F.length("id") > 0), old)


def unique(after: DataFrame, new: DataFrame, old: DataFrame, key: str = "id") -> DataFrame:
    """``after``, which cannot be read if a key of ``new`` is twice there or in ``old``. Only keys are shuffled."""
    keys = new.select(F.col(key).alias("__key"), F.lit(1).alias("__n")).unionAll(old.join(new.select(key), key, "left_semi").select(key, F.lit(1)))
    twice = keys.groupBy("__key").agg(F.sum("__n").alias("__n")).where("__n > 1").agg(F.min("__key").alias("__twice"))
    message = F.concat(F.lit("an id is there already: "), F.col("__twice").cast("string"))
    checked = after.withColumn("__one", F.lit(1)).join(F.broadcast(twice.withColumn("__one", F.lit(1))), "__one")  # one row
    return checked.where(F.when(F.col("__twice").isNull(), True).otherwise(F.raise_error(message).cast("boolean"))).select(after.columns)


def backlog(df: DataFrame, limit: int, key: str = "id") -> DataFrame:
    return df.where(F.col("embedding_status") == PENDING).orderBy(key).limit(limit)


def unfinished(df: DataFrame) -> DataFrame:
    return total(df, F.col("embedding_status").isin(PENDING, PROCESSING))


def tags(df: DataFrame, data: str = "data") -> DataFrame:
    """Distinct tags, sorted."""
    found = df.select(F.explode(F.from_json(F.get_json_object(data, "$.tags"), "array<string>")).alias("tag"))
    return found.select(F.trim("tag").alias("tag")).where("tag != ''").distinct().orderBy("tag")


def page_number(offset: int, limit: int, rows: int) -> tuple[int, int]:
    """The page at an offset, from 1, and the number of pages."""
    return offset // limit + 1, -(-rows // limit)


def prepare_tokens(df: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Fills tokens of rows that have none."""
    made = tokens if tokens is not None else F.array_join(X.ascii_tokens(F.col("content")), " ")
    return df.withColumn("content_tokens", F.when(F.coalesce(F.col("content_tokens"), F.lit("")) == "", made).otherwise(F.col("content_tokens")))


def nonblank(df: DataFrame, content: str = "content") -> DataFrame:
    """Trimmed content; blank rows go."""
    return df.withColumn(content, F.trim(content)).where(F.coalesce(F.col(content), F.lit("")) != "")
