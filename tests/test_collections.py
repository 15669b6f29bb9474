import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.operators import collections as C
from marlstone.operators import rag


@pytest.fixture
def old(spark):
    return C.conform(spark.createDataFrame([("1", "first content here", 1, "completed"), ("2", "second content", 3, "completed")], "id string, content string, _rev int, embedding_status string"), schemas.DOCUMENTS)


def test_upsert(spark, old):
    batch = spark.createDataFrame([("2", "new second", 0), ("3", "third early", 0), ("3", "third late", 1)], "id string, content string, n int")
    got = {r["id"]: r for r in C.upsert(old, batch, order="n").collect()}
    assert {k: (r["content"], r["_rev"], r["embedding_status"]) for k, r in got.items()} == {"1": ("first content here", 1, "completed"), "2": ("new second", 4, "pending"), "3": ("third late", 2, "pending")}
    assert got["3"]["created_at"] is not None


def test_insert(spark, old):
    batch = spark.createDataFrame([("9", "a text of length", '{"id": "9", "k": 1}'), (None, "text without an id", None), ("8", "short", None)], "id string, content string, metadata string")
    got = {r["id"]: r for r in rag.insert(old, batch).collect()}
    assert len(got) == 4 and json.loads(got["9"]["metadata"]) == {"k": 1} and got["9"]["chunk_length"] == 16
    with pytest.raises(PySparkException):
        rag.insert(old, spark.createDataFrame([("7", None, None)], "id string, content string, metadata string")).collect()


def test_delete_replace_append(spark, old):
    ids = spark.createDataFrame([("1",)], "id string")
    assert [r["id"] for r in C.delete(old, ids).collect()] == ["2"]
    quads = spark.createDataFrame([("E", "APPEARS_IN", "1"), ("E", "APPEARS_IN", "2")], "subject string, predicate string, object string")
    assert C.delete_cascade(old, quads, ids)[1].count() == 1
    assert C.replace(old, spark.createDataFrame([("1", "x")], "id string, content string")).where("id = '1'").first()["content"] == "x"
    assert C.append(old, spark.createDataFrame([("fresh",)], "content string")).where("content = 'fresh'").first()["id"]
    with pytest.raises(PySparkException):
        C.upsert_vectors(old, spark.createDataFrame([("1", [1.0])], "id string, embedding array<float>"), 2).collect()


def test_json_documents(spark):
    empty = spark.createDataFrame([], schemas.REST_DOCUMENTS)
    made = C.create_json(empty, spark.createDataFrame([('{"id": "a", "title": "T", "tags": ["x", " y "]}',), ('{"title": "U"}',)], "data string"), "articles")
    rows = made.collect()
    assert {r["collection_name"] for r in rows} == {"articles"} and all(r["id"] for r in rows)
    assert [r["tag"] for r in C.tags(made).collect()] == ["x", "y"]
    made = spark.createDataFrame(rows, schemas.REST_DOCUMENTS)
    got = C.update_json(made, spark.createDataFrame([("a", '{"title": "V"}')], "id string, data string")).where("id = 'a'").first()
    assert json.loads(got["data"])["title"] == "V" and got["content"] == "x  y  V"


def test_paging_and_backlog(spark, old):
    rows = old.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert [r["id"] for r in C.page(rows, 1, 1).collect()] == ["2"] and C.page(rows, 0).count() == 2
    assert C.total(old).first()["n"] == 2 and C.unfinished(old).first()["n"] == 0
    assert C.backlog(old.withColumn("embedding_status", F.lit("pending")), 1).count() == 1
    assert C.page_number(20, 10, 45) == (3, 5)
    assert C.has_column(old, "id") and C.column_type(old, "_rev") == "int" and C.column_type(old, "zz") is None
    assert C.prepare_tokens(old).where("id = '2'").first()["content_tokens"] == "second content"
    assert C.nonblank(spark.createDataFrame([(" a ",), (" ",), (None,)], "content string")).collect()[0][0] == "a"


def test_table(spark):
    spark.sql("DROP TABLE IF EXISTS marl_t")
    assert C.create(spark, "marl_t", schemas.QUADS).count() == 0 and C.create(spark, "marl_t", schemas.QUADS).columns == schemas.QUADS.names
    spark.sql("DROP TABLE marl_t")
