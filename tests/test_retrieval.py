import json

import pytest

from marlstone.operators import fulltext, graph, rag
from marlstone.operators.hooks import ByteEmbedder, RuleModel, WordSegmenter

DOCS = [("d1", "The Great Wall is in China."), ("d2", "The capital of France is Paris, a capital city."), ("d3", "The Eiffel Tower is a landmark of architecture."), ("d4", "JavaScript is a scripting language of the web."), ("d5", "SQLiteAI is a database built for Golang.")]
ZH = [("doc1", "自然语言处理是人工智能的重要分支"), ("doc2", "机器学习算法可以用于文本分类"), ("doc3", "深度学习在计算机视觉领域有广泛应用"), ("doc4", "中文分词是自然语言处理的基础")]


@pytest.fixture(scope="module")
def base(spark):
    e = ByteEmbedder(64)
    rows = [(i, t, json.dumps({"n": i}), e.embed([t])[0], "completed") for i, t in DOCS]
    docs = spark.createDataFrame(rows, "id string, content string, metadata string, embedding array<float>, embedding_status string")
    kb = rag.KnowledgeBase(docs, None, e, RuleModel())
    quads = graph.from_extraction(kb.extract()).unionByName(spark.createDataFrame([("Eiffel Tower", "APPEARS_IN", "d3"), ("Eiffel Tower", "IN", "Paris"), ("Paris", "APPEARS_IN", "d2")], "subject string, predicate string, object string"))
    rows = [tuple(r) for r in quads.collect()]
    return rag.KnowledgeBase(docs, spark.createDataFrame(rows, "subject string, predicate string, object string"), e, RuleModel())


@pytest.mark.parametrize("mode", [*rag.MODES, "no such mode"])
def test_modes(base, mode):
    got = base.retrieve("Tell me about the Eiffel Tower in French Paris", mode, 2).collect()
    assert 0 < len(got) <= 2
    if mode in ("fulltext", "local", "hybrid", "graph"):
        assert {"d2", "d3"} & {r["id"] for r in got}
    scores = [r["score"] for r in got]
    assert scores == sorted(scores, reverse=True)


def test_filters_and_answers(base, spark):
    assert {r["id"] for r in base.retrieve("capital", "vector", 5, {"n": "d2"}).collect()} == {"d2"}
    assert base.query("sqliteai database", "graph", 1).startswith("I am a simple LLM. Question: sqliteai database. Context: Knowledge Graph recalled:")
    bare = rag.KnowledgeBase(base.documents, base.quads, base.embedder)
    assert bare.query("capital", "fulltext", 1) == "Relevant Documents:\n[1] The capital of France is Paris, a capital city.\n"
    assert bare.query("zzzz qqqq", "fulltext") == "No relevant information found."
    assert bare.retrieve("capital", "fulltext", 5, threshold=2.0).count() == 0


def test_broken_replies(base):
    class Broken:
        def complete(self, prompts):
            return ["not a json {"] * len(prompts)

    kb = rag.KnowledgeBase(base.documents, base.quads, base.embedder, Broken())
    assert kb.retrieve("capital of France", "hybrid", 2).count() == 2


def test_presets(base, spark):
    edges = spark.createDataFrame([("d5", "related", "d1")], "subject string, predicate string, object string")
    assert {r["id"] for r in base.preset("golang", "graph", edges=edges).collect()} == {"d1", "d5"}
    assert [r["id"] for r in base.preset("capital france", "fulltext").collect()] == ["d2"]
    assert base.preset("capital", "hybrid", 3).count() == 3 and base.preset("capital", "vector", 3).count() == 3
    with pytest.raises(ValueError):
        base.preset("x", "other")


def test_graph_search(base, spark):
    near = {tuple(r) for r in base.search_graph("eiffel").collect()}
    assert ("Eiffel Tower", "IN", "Paris") in near
    assert base.by_related(["Paris"], 5).first()["retrieval_method"] == "graph"
    e = spark.createDataFrame([("Paris", "Paris", ByteEmbedder(64).embed(["Paris"])[0])], "entity_id string, entity_name string, embedding array<float>")
    assert base.semantic_search(e, "Paris", 1).first()["triples"]
    assert "Relevant Documents" in base.graph_context("eiffel tower")


def test_chinese(spark):
    seg = WordSegmenter()
    docs = fulltext.tokenized(spark.createDataFrame(ZH, "id string, content string"), seg)
    ids = lambda q, k=10: {r["id"] for r in fulltext.search(docs, q, seg, k=k).collect()}
    assert ids("自然语言") == {"doc1", "doc4"} and ids("机器学习") and ids("没有的词语啊") == set()
    assert len(ids("学习", 1)) == 1
    assert seg.tokens("") == "" and seg.tokens("ab 中文字!") == "ab 中文 文字 !"
    assert WordSegmenter(frozenset({"自然语言", "处理"})).segment("自然语言处理的") == ["自然语言", "处理", "的"]


def test_substrings(spark):
    docs = spark.createDataFrame([("1", "100% sure"), ("2", "100 percent")], "id string, content string")
    assert [r["id"] for r in fulltext.substring_any(docs, ["100%"]).collect()] == ["1"]
    assert fulltext.all_words(docs, "100 PERCENT").first()["score"] == 1.0
    assert fulltext.bm25(docs, ["nothing"]).count() == 0 and fulltext.bm25(docs.limit(0), ["a"]).count() == 0
    assert fulltext.substring_phrase(docs.withColumnRenamed("content", "data"), "100 p").first()["id"] == "2"


def test_arms_choose_by_ids_and_run_once(spark, sf):
    """Documents are scanned once for all keywords' vectors, and their texts are in no shuffle."""
    from marlstone.operators import hooks
    from marlstone.plans import services

    kb = services._base(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, _ = kb.by_keywords(["Paris", "Capital", "City"], 5)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "zip_with" not in plan  # scores are a table already
        joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(id" in line]
        assert joins and not any("content" in line or "text" in line for line in joins)
        physical = found._jdf.queryExecution().executedPlan().toString()
        assert physical.count("text#") and "BroadcastHashJoin [id" in physical
        for mode in ("mix", "hybrid"):
            got = kb.retrieve(services.ASKED, mode)
            assert "documents.parquet" not in got._jdf.queryExecution().executedPlan().toString()
            assert got.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert isinstance(kb.embedder, hooks.ByteEmbedder)
