import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import vector as V
from marlstone.operators import ivf, vector
from marlstone.operators.hooks import ByteEmbedder


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [1.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([], [], 0.0), ([-1.0, 0.0], [1.0, 0.0], -1.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    row = df.select(V.cosine(F.col("a"), F.col("b")).alias("x"), V.cosine_to(F.col("a"), b).alias("y")).first()
    assert row["x"] == pytest.approx(want) and row["y"] == pytest.approx(want)


def test_byte_embedding_is_the_embedder(spark):
    texts = ["hello", "", "é", "a longer text than ten bytes"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.byte_embedding(F.col("t"), 10).alias("v"))
    want = dict(zip(texts, ByteEmbedder(10).embed(texts), strict=True))
    assert all(r["v"] == pytest.approx(want[r["t"]]) for r in df.collect())
    assert len(ByteEmbedder(0).embed([""])[0]) == 768


def test_float_codec(spark):
    df = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>")
    back = df.select("v", V.unpack_floats(V.pack_floats(F.col("v"))).alias("w"))
    assert all(r["v"] == r["w"] for r in back.collect())


def test_json_vector(spark):
    df = spark.createDataFrame([("[1, 2.5]",), ('["a"]',), ("{}",), (None,)], "j string")
    assert [r["v"] for r in df.select(V.json_vector(F.col("j")).alias("v")).collect()] == [[1.0, 2.5], None, None, None]


def _store(spark):
    e = ByteEmbedder(128, 0.1)
    rows = [(str(i), t, json.dumps({"country": c}), e.embed([t])[0], s) for i, (t, c, s) in enumerate([("The capital of France is Paris.", "France", "completed"), ("The capital of Germany is Berlin.", "Germany", "completed"), ("Pending text here.", "France", "pending")])]
    return spark.createDataFrame(rows, "id string, content string, metadata string, embedding array<float>, embedding_status string"), e


def test_search_filters_before_the_cut(spark):
    df, e = _store(spark)
    q = e.embed(["capital"])[0]
    got = vector.search(df, q, 1, {"country": "Germany"}).collect()
    assert [r["id"] for r in got] == ["1"] and 0 <= got[0]["score"] <= 1.000001
    assert got[0]["distance"] == pytest.approx(1 - got[0]["score"])
    assert vector.search(df, q, 0).count() == 2
    assert vector.search(df, q, 10, threshold=1.1).count() == 0
    assert vector.search_postfiltered(df, q, 1, {"country": "Germany"}).count() <= 1


def test_media(spark):
    df, e = _store(spark)
    df = df.withColumns({"text_embedding": F.col("embedding"), "image_embedding": F.when(F.col("id") == "1", F.col("embedding"))})
    q = e.embed(["The capital of Germany is Berlin."])[0]
    got = {r["id"]: r for r in vector.search_hybrid(df, q, q, 5).collect()}
    assert got["1"]["source"] == "hybrid" and got["1"]["score"] == pytest.approx(1.0) and got["0"]["source"] == "text"
    first = vector.search_media(df, q, q, 3, images_first=True).collect()
    assert first[0]["source"] == "image" and len(first) == 3


def test_many_queries(spark):
    df, e = _store(spark)
    queries = spark.createDataFrame([(i, e.embed([t])[0]) for i, t in enumerate(["Paris", "Berlin", "x"])], "query_id int, query_vector array<double>")
    many = {(r["query_id"], r["rank"]): r["id"] for r in vector.search_many(df, queries, 2, block=2).collect()}
    for q in queries.collect():
        one = [r["id"] for r in vector.search(df, q["query_vector"], 2).collect()]
        assert one == [many[q["query_id"], k] for k in (1, 2)]


def test_ivf(spark, tmp_path):
    """Recall of ten nearest against the exact scan over a stated query set, ids divisible by 50; all rows are indexed."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    extra = spark.createDataFrame([(100_000, [0.0] * 64), (100_001, [1.0, 2.0]), (100_002, None)], "id long, embedding array<float>")
    index = ivf.build(rows.unionByName(extra), f"file://{tmp_path}/ivf", 16)
    assert index.table(spark).count() == rows.count() + 3 and index.table(spark).select("list").distinct().count() <= 17
    queries = rows.where("id % 50 = 0").limit(8).collect()
    exact = {q["id"]: {r["id"] for r in vector.search(rows, list(q["embedding"]), 10).collect()} for q in queries}
    recall = lambda probes: sum(len(exact[q["id"]] & {r["id"] for r in index.search(spark, list(q["embedding"]), 10, probes).collect()}) for q in queries) / (10 * len(queries))
    assert recall(None) >= 0.9 and recall(16) == 1.0 and index.probes < 16
    assert [r["id"] for r in index.search(spark, [1.0, 2.0], 1).collect()] == [100_001]
    assert ivf.build(rows.limit(0), f"file://{tmp_path}/empty", 4).search(spark, [1.0], 3).count() == 0


def test_ivf_of_clusters():
    """Where vectors have clusters, few lists are enough."""
    rng = np.random.default_rng(2)
    sample = vector._unit(np.repeat(rng.normal(size=(20, 16)), 50, axis=0) + 0.05 * rng.normal(size=(1000, 16)))
    assert ivf.probes_for(sample, ivf.centroids(sample, 20)) <= 2


def test_search_many_equals_search(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=4).round(1).tolist()) for k in range(300)] + [(300, [0.0] * 4), (301, [1.0]), (302, None), (303, [])] + [(400 + k, [1.0, 1.0, 1.0, 1.0]) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    asked = [("a", [1.0, 1.0, 1.0, 1.0]), ("b", rows[3][1]), ("c", [1.0]), ("d", [0.0] * 4)]
    got = vector.search_many(df, spark.createDataFrame(asked, "query_id string, query_vector array<double>"), 7, block=2).collect()
    for name, q in asked:
        want = [(r["id"], round(r["score"], 9) + 0.0) for r in vector.search(df, q, 7).collect()]
        assert [(r["id"], round(r["score"], 9) + 0.0) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == name] == want


def test_scores_are_held_a_slice_at_a_time(monkeypatch):
    """However large a batch is, and however many of its rows tie."""
    import types

    import numpy as np
    import pyarrow as pa

    held = []
    real = np.zeros
    monkeypatch.setattr(vector, "SCORES", 600, raising=False)
    rng = np.random.default_rng(5)
    rows = rng.integers(-2, 3, (500, 3)).astype(float)
    asked = rng.integers(-2, 3, (20, 3)).astype(float)
    monkeypatch.setattr(np, "zeros", lambda shape, *a, **b: held.append(np.prod(shape)) or real(shape, *a, **b))
    run = vector._nearest(types.SimpleNamespace(value=vector._by_length(asked.tolist())), 20, 4)
    batch = pa.RecordBatch.from_pydict({"key": list(range(500)), "v": rows.tolist()})
    got = sorted((r["at"], r["key"]) for b in run(iter([batch])) for r in b.to_pylist())
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
    scores = (unit(rows) @ unit(asked).T).round(12)
    assert got == sorted((q, k) for q in range(20) for k in sorted(range(500), key=lambda i: (-scores[i, q], i))[:4])
    assert max(held) <= 600
