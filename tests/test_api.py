import json

import pytest
from pyspark.sql import functions as F

from marlstone import api, schemas
from marlstone.operators import rag
from marlstone.operators.hooks import ByteEmbedder
from marlstone.operators.store import TableStore


def test_service(spark, tmp_path):
    s = api.Service(spark, f"file://{tmp_path}/db", ByteEmbedder(8))
    e = ByteEmbedder(8)
    a = s.create("articles", {"id": "a", "title": "Capital cities", "tags": ["geo"], "embedding": e.embed(["Capital"])[0]})
    b = s.create("articles", {"title": "Fruit and vegetables"})
    assert a == "a" and b and s.collections() == ["articles"] and s.collection("articles")["count"] == 2
    assert s.get("articles", "a")["title"] == "Capital cities"
    assert [r["id"] for r in s.list("articles", tag="geo").collect()] == ["a"] and s.list("articles", 1, 1).count() == 1
    assert [r["id"] for r in s.fulltext("articles", "capital")["results"]] == ["a"]
    assert [r["id"] for r in s.vector("articles", "Capital")["results"]] == ["a"]
    assert s.vector("articles", e.embed(["Capital"])[0], threshold=1.1)["results"] == []
    assert s.update("articles", "a", {"title": "New"})["title"] == "New" and s.vector("articles", "Capital")["results"] == []
    with pytest.raises(Exception, match="an id is there already: a"):
        s.create("other", {"id": "a", "title": "Twice"})
    with pytest.raises(Exception, match="an id is there already"):
        s.create_many("other", [{"id": "p", "title": "One"}, {"id": "p", "title": "Two"}])
    assert s.create_many("other", [{"id": "o", "title": "Other things"}, {"title": "And more"}])[0] == "o" and s.collection("other")["count"] == 2
    with pytest.raises(api.NotFound):
        s.delete("articles", "o")
    assert s.chunk("other", "o") == ["Other things"] and s.list("articles").count() == 2
    for r in s.list("other").collect():
        s.delete("other", r["id"])
    s.delete("articles", b)
    with pytest.raises(api.NotFound):
        s.get("articles", b)
    for t in (("u1", "follows", "u2"), ("u2", "follows", "u3"), ("u2", "follows", "u3")):
        s.link(*t)
    assert s.neighbors("u1") == ["u2"] and s.neighbors("u3", incoming=True) == ["u2"]
    assert s.path("u1", "u3") == ["u1", "u2", "u3"] and s.path("u3", "u1") is None and s.query("V('u1').Out('follows')") == ["u2"]
    for t in (("u1", "TYPE", "User"), ("u1", "APPEARS_IN", "a")):
        s.link(*t)
    assert s.entity("u1") == {"name": "u1", "type": "User", "description": "", "documents": ["a"], "relations": [("u1", "follows", "u2")]}
    assert s.subgraph("u3", 1) == {"nodes": ["u2", "u3"], "links": [("u2", "follows", "u3")]}
    for t in (("u1", "TYPE", "User"), ("u1", "APPEARS_IN", "a")):
        s.unlink(*t)
    s.unlink("u1", "follows", "u2")
    assert s.info() == {"tables": ["documents", "quads"], "documents": 1, "triples": 1}


def test_store(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s", "ns_")
    assert store.names() == [] and store.read("t", schemas.QUADS).count() == 0
    with pytest.raises(KeyError):
        store.read("t")
    store.write("t", spark.range(3))
    store.change("t", lambda df: df.where("id > 0"))
    assert store.read("t").count() == 2 and store.versions("t") == [1, 2] and store.names() == ["t"]
    store.vacuum("t")
    assert store.versions("t") == [2] and store.read("t").count() == 2


def test_insert_batch_and_retriever(spark):
    docs = spark.createDataFrame([], "id string, content string, metadata string, embedding array<float>, embedding_status string")
    quads = spark.createDataFrame([], "subject string, predicate string, object string")
    batch = spark.createDataFrame([("1", "Paris is a capital", '{"k": 1}'), ("2", "Apples are fruit", None)], "id string, content string, metadata string")
    docs, quads = rag.insert_batch(docs, quads, batch, ByteEmbedder(8))
    assert {tuple(r) for r in quads.collect()} == {("1", "is_document", "1"), ("2", "is_document", "2")}
    find = rag.retriever(rag.KnowledgeBase(docs, quads, ByteEmbedder(8)), "fulltext", 2, lambda df: df.where(F.col("id") == "1"))
    row = find("capital").first()
    assert json.loads(row["metadata"])["k"] == 1 and json.loads(row["metadata"])["score"] == 1.0
    assert rag.fields_to_embed(batch, ["content", "metadata"], 10).count() == 3
    with pytest.raises(ValueError):
        rag.fields_to_embed(batch, ["content", "metadata"], 1)
