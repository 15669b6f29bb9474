"""The query catalogue: name -> plan, name -> SQL that checks it. Each query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import json as J
from marlstone.functions import text as X
from marlstone.functions import vector as V
from marlstone.operators import chunk, collections, fulltext, fusion, graph, gremlin, hooks, vector
from marlstone.plans import inherited, services
from marlstone.session import cut, spread
from marlstone.sources import files
from marlstone.sources.tables import parquet
from marlstone.streaming import embedding as streaming

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- vectors --

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {i})"
_COS = "list_cosine_similarity(embedding::DOUBLE[], " + _Q + ")"


def _embeddings(spark, sf_dir) -> DataFrame:
    return parquet(spark, sf_dir, "embeddings")


def _vector_of(spark, sf_dir, i: int) -> list[float]:
    return [float(x) for x in _embeddings(spark, sf_dir).where(F.col("vec_id") == i).select("embedding").first()[0]]


def _rounded(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("vec_id", *extra, F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, label, round({_COS.format(i=0)}, 6) AS score FROM embeddings ORDER BY {_COS.format(i=0)} DESC, vec_id LIMIT 10")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vector.search(_embeddings(spark, sf_dir), _vector_of(spark, sf_dir, 0), 10, key="vec_id"), "label")


@query(f"SELECT vec_id, label, round({_COS.format(i=0)}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {_COS.format(i=0)} DESC, vec_id LIMIT 10")
def vec_topk_label_filter(spark, sf_dir):
    return _rounded(vector.search(_embeddings(spark, sf_dir), _vector_of(spark, sf_dir, 0), 10, where=F.col("label") == 3, key="vec_id"), "label")


@query(f"SELECT vec_id, label, round({_COS.format(i=0)}, 6) AS score, round(1 - {_COS.format(i=0)}, 6) AS distance FROM embeddings WHERE {_COS.format(i=0)} >= 0.3 ORDER BY {_COS.format(i=0)} DESC, vec_id LIMIT 20")
def vec_threshold(spark, sf_dir):
    hits = vector.search(_embeddings(spark, sf_dir), _vector_of(spark, sf_dir, 0), 20, threshold=0.3, key="vec_id")
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, round({_COS.format(i=0)}, 6) AS score, round(1 - {_COS.format(i=0)}, 6) AS distance FROM embeddings ORDER BY {_COS.format(i=0)}, vec_id LIMIT 10")
def vec_inverted(spark, sf_dir):
    hits = vector.search_inverted(_embeddings(spark, sf_dir), _vector_of(spark, sf_dir, 0), 10, key="vec_id")
    return hits.select("vec_id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


@query(f"""WITH m AS (SELECT vec_id, to_json({{'label': label}}) AS metadata, {_COS.format(i=0)} AS score FROM embeddings)
SELECT vec_id, round(score, 6) AS score FROM m WHERE json_extract_string(metadata, '$.label') = '4' ORDER BY score DESC, vec_id LIMIT 10""")
def vec_json_filter(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("label")))
    return _rounded(vector.search(rows, _vector_of(spark, sf_dir, 0), 10, {"label": 4}, key="vec_id"))


_ARM = "(SELECT vec_id, {cos} AS score FROM embeddings ORDER BY {cos} DESC, vec_id LIMIT 20)"
_A, _B = _ARM.format(cos=_COS.format(i=0)), _ARM.format(cos=_COS.format(i=1))


def _arms(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = _embeddings(spark, sf_dir)
    return tuple(vector.search(e, _vector_of(spark, sf_dir, i), 20, key="vec_id").select("vec_id", "score") for i in (0, 1))


@query(f"""WITH u AS (SELECT vec_id, score * 0.5 AS score, 'text' AS source FROM {_A} UNION ALL SELECT vec_id, score * 0.5, 'image' FROM {_B})
SELECT vec_id, round(sum(score), 6) AS score, CASE WHEN count(DISTINCT source) > 1 THEN 'hybrid' ELSE min(source) END AS source FROM u GROUP BY vec_id ORDER BY sum(score) DESC, vec_id LIMIT 10""")
def vec_hybrid_weighted(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).withColumns({"text_embedding": F.col("embedding"), "image_embedding": F.col("embedding")})
    hits = vector.search_hybrid(rows, _vector_of(spark, sf_dir, 0), _vector_of(spark, sf_dir, 1), 10, key="vec_id")
    return _rounded(hits, "source")


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.v) AS score FROM embeddings e CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def vec_topk_many(spark, sf_dir):
    """The five nearest of each vector whose id is divisible by 50."""
    e = _embeddings(spark, sf_dir)
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector.search_many(e, queries, 5, "vec_id").select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH u AS (SELECT vec_id, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) - 1 AS r FROM {_A}
UNION ALL SELECT vec_id, row_number() OVER (ORDER BY round(score, 9) DESC, vec_id) - 1 FROM {_B})
SELECT vec_id, round(sum(1.0 / (r + 60)), 6) AS score FROM u GROUP BY vec_id""")
def rrf_fusion(spark, sf_dir):
    return _rounded(fusion.rrf(list(_arms(spark, sf_dir)), "vec_id"))


@query(f"SELECT vec_id, round(sum(score), 6) AS score FROM (SELECT vec_id, score * 0.6 AS score FROM {_A} UNION ALL SELECT vec_id, score * 0.4 FROM {_B}) GROUP BY vec_id")
def weighted_fusion_06_04(spark, sf_dir):
    a, b = _arms(spark, sf_dir)
    return _rounded(fusion.weighted([(a, 0.6), (b, 0.4)], "vec_id"))


@query(f"""WITH u AS (SELECT vec_id, score, 0 AS l FROM {_A} UNION ALL SELECT vec_id, score, 1 FROM {_B})
SELECT vec_id, round(arg_min(score, l), 6) AS score, string_agg('t' || l, ',' ORDER BY l) AS triples FROM u GROUP BY vec_id""")
def merge_first_wins(spark, sf_dir):
    lists = [x.withColumn("recalled_triples", F.array(F.lit(f"t{i}"))) for i, x in enumerate(_arms(spark, sf_dir))]
    return fusion.first_wins(lists, "vec_id").select("vec_id", F.round("score", 6).alias("score"), F.array_join("recalled_triples", ",").alias("triples"))


@query(f"SELECT vec_id, round(sum(score), 6) AS score FROM (SELECT vec_id, score FROM {_A} UNION ALL SELECT vec_id, 1.0 FROM embeddings WHERE label = 2) GROUP BY vec_id")
def additive_keyword_score(spark, sf_dir):
    links = _embeddings(spark, sf_dir).where("label = 2").select("vec_id", F.lit(1.0).alias("score"))
    return _rounded(fusion.additive([_arms(spark, sf_dir)[0], links], "vec_id"))


# -- full text --


def _docs(spark, sf_dir) -> DataFrame:
    return parquet(spark, sf_dir, "documents")


def _spread(spark, sf_dir) -> DataFrame:
    """Documents over all cores, where work on their texts outweighs that."""
    return spread(_docs(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%tion%' OR text ILIKE '%ière%'")
def ft_ilike_any(spark, sf_dir):
    return fulltext.substring_any(_docs(spark, sf_dir), ["tion", "IÈRE"], ("text",), "doc_id", None).select("doc_id")


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'from') ORDER BY doc_id LIMIT 50")
def ft_all_words(spark, sf_dir):
    return fulltext.all_words(_docs(spark, sf_dir), "the from", "text", "doc_id", 50).select("doc_id", "score")


@query("""SELECT doc_id, round((contains(lower(text), 'the')::INT + contains(lower(text), 'est')::INT + contains(lower(text), 'und')::INT) / 3.0, 6) AS score
FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'est') OR contains(lower(text), 'und')""")
def ft_any_word_coverage(spark, sf_dir):
    hits = _docs(spark, sf_dir).where(X.like_any([F.col("text")], ["the", "est", "und"]))
    return hits.select("doc_id", F.round(X.coverage(F.col("text"), ["the", "est", "und"]), 6).alias("score"))


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(text, 'of the') ORDER BY doc_id LIMIT 10")
def ft_phrase(spark, sf_dir):
    return fulltext.substring_phrase(_docs(spark, sf_dir), "of the", "text", "doc_id", 10).select("doc_id", "score")


@query("""SELECT doc_id, round(1.0 / n, 6) AS score FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS n
FROM (SELECT doc_id, lang FROM documents WHERE text ILIKE '%the%' ORDER BY doc_id LIMIT 20)) WHERE lang = 'en'""")
def ft_positional_score(spark, sf_dir):
    hits = fulltext.substring_any(_docs(spark, sf_dir), ["the"], ("text",), "doc_id", 20).select("doc_id", "lang")
    return fusion.positional(hits, [F.col("doc_id")]).where("lang = 'en'").select("doc_id", F.round("score", 6).alias("score"))


_BM25 = """WITH tok AS (SELECT doc_id, t.term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents), unnest(ts) AS t(term)),
dl AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY doc_id), st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN ('the', 'from') GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT tf.doc_id, round(sum(ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl.len / st.avgdl))), 6) AS score
FROM tf JOIN df ON tf.term = df.term JOIN dl ON tf.doc_id = dl.doc_id CROSS JOIN st GROUP BY tf.doc_id ORDER BY score DESC, tf.doc_id LIMIT 10"""


@query(_BM25)
def ft_bm25(spark, sf_dir):
    return fulltext.bm25(_spread(spark, sf_dir), ["the", "from"], "doc_id", "text", None).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query(_BM25)
def ft_bm25_index(spark, sf_dir):
    postings, lengths = fulltext.index(_spread(spark, sf_dir), "doc_id", "text")
    return fulltext.bm25_from_index(postings, lengths, ["the", "from"], "doc_id", 1000).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query("""SELECT t.term, count(*) AS tf, count(DISTINCT doc_id) AS df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(DISTINCT doc_id))) + 1, 6) AS idf
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents), unnest(ts) AS t(term) GROUP BY t.term""")
def ft_vocabulary(spark, sf_dir):
    docs = _spread(spark, sf_dir)
    postings, _ = fulltext.index(docs, "doc_id", "text")
    n = docs.count()
    terms = postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
    return terms.withColumn("idf", F.round(F.log(F.lit(1 + n) / (1 + F.col("df"))) + 1, 6))


# -- graph --

_T = """t AS (SELECT 'c' || c_custkey AS s, 'IN_NATION' AS p, 'n' || c_nationkey AS o FROM customer
UNION SELECT 'n' || n_nationkey, 'IN_REGION', 'r' || n_regionkey FROM nation
UNION SELECT 's' || s_suppkey, 'IN_NATION', 'n' || s_nationkey FROM supplier
UNION SELECT 'c' || o_custkey, 'PLACED', 'o' || o_orderkey FROM orders)"""


def _quads(spark, sf_dir) -> DataFrame:
    def triple(name, s, p, o):
        rows = parquet(spark, sf_dir, name)
        return rows.select(F.concat(F.lit(s[0]), F.col(s[1]).cast("string")).alias("subject"), F.lit(p).alias("predicate"), F.concat(F.lit(o[0]), F.col(o[1]).cast("string")).alias("object"))

    parts = [triple("customer", ("c", "c_custkey"), "IN_NATION", ("n", "c_nationkey")), triple("nation", ("n", "n_nationkey"), "IN_REGION", ("r", "n_regionkey")), triple("supplier", ("s", "s_suppkey"), "IN_NATION", ("n", "s_nationkey")), triple("orders", ("c", "o_custkey"), "PLACED", ("o", "o_orderkey"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return graph.triples(out)


@query(f"WITH {_T} SELECT s AS subject, p AS predicate, o AS object FROM t")
def kg_triples(spark, sf_dir):
    return _quads(spark, sf_dir)


@query(f"WITH {_T} SELECT DISTINCT o AS node FROM t WHERE s = 'c1' AND p = 'PLACED'")
def graph_out(spark, sf_dir):
    return graph.neighbors(_quads(spark, sf_dir), "c1", "PLACED")


@query(f"WITH {_T} SELECT DISTINCT s AS node FROM t WHERE o = 'n3'")
def graph_in(spark, sf_dir):
    return graph.in_neighbors(_quads(spark, sf_dir), "n3")


@query(f"WITH {_T} SELECT s AS subject, p AS predicate, o AS object FROM t WHERE s = 'n3' UNION ALL SELECT s, p, o FROM t WHERE o = 'n3'")
def graph_both(spark, sf_dir):
    return graph.traverse(_quads(spark, sf_dir)).v("n3").both().all()


@query(f"WITH {_T} SELECT DISTINCT b.o AS node FROM t a JOIN t b ON a.o = b.s WHERE a.s IN ('c1', 'c2', 's1')")
def graph_values_2hop(spark, sf_dir):
    return graph.traverse(_quads(spark, sf_dir)).v("c1", "c2", "s1").out().out().values()


@query(f"WITH {_T} SELECT b.s AS subject, b.p AS predicate, b.o AS object FROM t a JOIN t b ON a.o = b.s WHERE a.s IN ('c1', 'c2', 's1')")
def graph_all_2hop(spark, sf_dir):
    return graph.traverse(_quads(spark, sf_dir)).v("c1", "c2", "s1").out().out().all()


@query(f"WITH {_T} SELECT DISTINCT o AS node FROM t WHERE s = 'c7' AND p = 'PLACED'")
def graph_gremlin(spark, sf_dir):
    return gremlin.run(_quads(spark, sf_dir), "V('c7').Out('PLACED')")


_NEAR = """t2 AS (SELECT * FROM t WHERE p != 'PLACED'), b(node, d) AS (SELECT 'c1', 0 UNION SELECT CASE WHEN t2.s = b.node THEN t2.o ELSE t2.s END, b.d + 1
FROM b JOIN t2 ON t2.s = b.node OR t2.o = b.node WHERE b.d < 2)"""


@query(f"WITH RECURSIVE {_T}, {_NEAR} SELECT DISTINCT s AS subject, p AS predicate, o AS object FROM t2 JOIN b ON (t2.s = b.node OR t2.o = b.node) AND b.d < 2")
def graph_subgraph_d2(spark, sf_dir):
    quads = _quads(spark, sf_dir)
    return graph.subgraph(quads, spark.createDataFrame([("c1",)], "node string"), 2, ("PLACED",))


@query(f"WITH RECURSIVE {_T}, {_NEAR} SELECT node, min(d) AS depth FROM b GROUP BY node")
def graph_related(spark, sf_dir):
    quads = _quads(spark, sf_dir)
    return graph.related(quads, spark.createDataFrame([("c1",)], "node string"), 2, ("PLACED",)).select("node", "depth")


@query(f"""WITH RECURSIVE {_T}, b(node, path, len) AS (SELECT 'c1', ['c1'], 1 UNION ALL SELECT t.o, list_append(b.path, t.o), len + 1 FROM b JOIN t ON t.s = b.node
WHERE NOT list_contains(b.path, t.o) AND len < 10) SELECT array_to_string(path, ' > ') AS path, len::INT AS nodes FROM b WHERE node = (SELECT 'r' || n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 1) ORDER BY len, b.path LIMIT 1""")
def graph_path(spark, sf_dir):
    nation = parquet(spark, sf_dir, "nation").join(parquet(spark, sf_dir, "customer").where("c_custkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"))
    goal = f"r{nation.select('n_regionkey').first()[0]}"
    return graph.find_path(_quads(spark, sf_dir), "c1", goal).select(F.array_join("path", " > ").alias("path"), F.size("path").alias("nodes"))


@query(f"""WITH {_T}, o AS (SELECT s AS node, count(DISTINCT o) AS out_degree FROM t GROUP BY s), i AS (SELECT o AS node, count(DISTINCT s) AS in_degree FROM t GROUP BY o)
SELECT node, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree FROM o FULL JOIN i USING (node) WHERE coalesce(out_degree, 0) > 1 OR coalesce(in_degree, 0) > 1""")
def graph_degree(spark, sf_dir):
    return graph.degrees(_quads(spark, sf_dir)).where("out_degree > 1 OR in_degree > 1")


_KG = """k AS (SELECT 'p' || p_partkey AS s, 'TYPE' AS p, p_type AS o FROM part UNION SELECT 'p' || p_partkey, 'DESCRIPTION', p_name FROM part
UNION SELECT 'p' || l_partkey, 'APPEARS_IN', 'o' || l_orderkey FROM lineitem UNION SELECT 'p' || l_partkey, 'SUPPLIED_BY', 's' || l_suppkey FROM lineitem)"""


def _knowledge(spark, sf_dir) -> DataFrame:
    part, line = parquet(spark, sf_dir, "part"), parquet(spark, sf_dir, "lineitem")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    row = lambda df, s, p, o: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    of = row(part, text("p", "p_partkey"), "TYPE", F.col("p_type")).unionByName(row(part, text("p", "p_partkey"), "DESCRIPTION", F.col("p_name")))
    return graph.triples(of.unionByName(row(line, text("p", "l_partkey"), "APPEARS_IN", text("o", "l_orderkey"))).unionByName(row(line, text("p", "l_partkey"), "SUPPLIED_BY", text("s", "l_suppkey"))))


@query(f"WITH {_KG} SELECT s AS name, coalesce(max(CASE WHEN p = 'TYPE' THEN o END), '') AS type, coalesce(max(CASE WHEN p = 'DESCRIPTION' THEN o END), '') AS description FROM k GROUP BY s")
def graph_export_pivot(spark, sf_dir):
    return graph.entities(_knowledge(spark, sf_dir))


@query(f"""WITH {_KG}, a AS (SELECT DISTINCT s AS node FROM k WHERE p = 'APPEARS_IN' AND o IN ('o1', 'o2', 'o3')),
r AS (SELECT * FROM k WHERE p = 'SUPPLIED_BY'), b AS (SELECT s AS source, p AS relation, o AS target FROM r WHERE s IN (SELECT node FROM a)) SELECT * FROM b""")
def graph_export_docs(spark, sf_dir):
    quads = _knowledge(spark, sf_dir)
    docs = spark.createDataFrame([("o1",), ("o2",), ("o3",)], "id string")
    rels = graph.export_graph(quads)[1]
    return rels.join(graph.entities_of(quads, docs).select(F.col("node").alias("source")), "source", "left_semi").select("source", "relation", "target")


@query(f"WITH {_KG} SELECT count(*) AS n FROM k WHERE p = 'APPEARS_IN'")
def graph_appears_in_count(spark, sf_dir):
    return graph.appears_count(_knowledge(spark, sf_dir))


@query(f"WITH {_KG} SELECT DISTINCT s AS node, o AS id FROM k WHERE p = 'APPEARS_IN' AND s IN ('p1', 'p2')")
def graph_entity_documents(spark, sf_dir):
    return graph.documents_of(_knowledge(spark, sf_dir), spark.createDataFrame([("p1",), ("p2",)], "node string")).select("node", "id")


@query(f"WITH {_T} SELECT * FROM (SELECT s AS subject, p AS predicate, o AS object FROM t WHERE NOT (s LIKE 'c%' AND p = 'PLACED') UNION SELECT 'c1', 'KNOWS', 'c2')")
def graph_link_unlink(spark, sf_dir):
    # Cut, so that no task holds the set of triples, their order and what is taken from them at once.
    quads = cut(_quads(spark, sf_dir), "quads")
    gone = quads.where("predicate = 'PLACED'")
    return graph.link(graph.unlink(quads, gone), spark.createDataFrame([("c1", "KNOWS", "c2"), ("c1", "KNOWS", "c2")], "subject string, predicate string, object string")).select("subject", "predicate", "object")


# -- collections --


@query("SELECT DISTINCT source AS collection_name FROM documents")
def doc_collections(spark, sf_dir):
    return collections.collections(_docs(spark, sf_dir).withColumnRenamed("source", "collection_name"))


@query("SELECT count(*) AS n FROM documents WHERE lang = 'en'")
def doc_count(spark, sf_dir):
    return collections.total(_docs(spark, sf_dir), F.col("lang") == "en")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def doc_page(spark, sf_dir):
    return collections.page(_docs(spark, sf_dir), 20, 20, "n_chars", "doc_id").select("doc_id", "n_chars")


@query("SELECT doc_id, text, lang FROM documents WHERE doc_id = 7")
def doc_find(spark, sf_dir):
    return collections.find_by_id(_docs(spark, sf_dir), 7, "doc_id").select("doc_id", "text", "lang")


@query("SELECT doc_id FROM documents WHERE length(text) > 10")
def doc_short_guard(spark, sf_dir):
    return _docs(spark, sf_dir).where(~X.short(F.col("text"))).select("doc_id")


@query("""WITH o AS (SELECT doc_id AS id, text AS content, 1 AS rev FROM documents WHERE doc_id % 3 != 0), b AS (SELECT doc_id AS id, upper(lang) AS content FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(o.id, b.id) AS id, CASE WHEN b.id IS NULL THEN o.content ELSE b.content END AS content, CASE WHEN b.id IS NULL THEN o.rev ELSE coalesce(o.rev, 0) + 1 END AS _rev,
CASE WHEN b.id IS NULL THEN 'completed' ELSE 'pending' END AS embedding_status FROM o FULL JOIN b ON o.id = b.id""")
def doc_upsert_rev(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    old = docs.where("doc_id % 3 != 0").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(1).alias("_rev"), F.lit("completed").alias("embedding_status"))
    return collections.upsert(old, docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.upper("lang").alias("content")))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def doc_delete(spark, sf_dir):
    gone = parquet(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return collections.delete(_docs(spark, sf_dir), gone, "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'xx' ELSE lang END AS lang FROM documents")
def doc_replace(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "lang")
    return collections.replace(docs, docs.where("doc_id % 2 = 0").withColumn("lang", F.lit("xx")), "doc_id")


# -- JSON and text --


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '5'")
def json_filter(spark, sf_dir):
    return parquet(spark, sf_dir, "events").where(J.matches({"k": 5}, F.col("props"))).select("event_id")


@query("SELECT event_id FROM events WHERE contains(json_extract(props, '$.k')::VARCHAR, '7')")
def json_tag_like(spark, sf_dir):
    return parquet(spark, sf_dir, "events").where(J.tag_like(F.col("props"), "7", "k")).select("event_id")


@query("SELECT event_id, event_type || ' ' || json_extract_string(props, '$.k') AS merged FROM events")
def json_merge(spark, sf_dir):
    merged = J.merge(F.to_json(F.struct(F.col("event_type").alias("type"), F.lit(-1).alias("k"))), F.col("props"))
    rows = parquet(spark, sf_dir, "events").select("event_id", merged.alias("m"))
    return rows.select("event_id", F.concat_ws(" ", F.get_json_object("m", "$.type"), F.get_json_object("m", "$.k")).alias("merged"))


@query("""SELECT doc_id, array_to_string(list_transform(range(8), lambda i: printf('%.6f', coalesce(('0x' || nullif(substr(hex(encode(text)), (2 * i + 1)::INT, 2), ''))::INT, 0) / 255.0)), ' ') AS v FROM documents""")
def simple_embed(spark, sf_dir):
    v = F.transform(V.byte_embedding(F.col("text"), 8), lambda x: F.format_string("%.6f", x))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(v, " ").alias("v"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+', ' ', 'g')) AS text FROM documents")
def text_normalize(spark, sf_dir):
    return _spread(spark, sf_dir).select("doc_id", X.normalize_space(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '[^\p{Han}a-zA-Z\p{Nd}\p{P}\s\x{85}\x{A0}\x{2028}\x{2029}]', '', 'g') AS text FROM documents")
def text_valid_chars(spark, sf_dir):
    return _spread(spark, sf_dir).select("doc_id", X.valid_characters(F.col("text")).alias("text"))


@query("SELECT doc_id, md5(text) AS md5, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars FROM documents")
def text_md5_lengths(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("bytes"), F.char_length("text").cast("long").alias("chars"))


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#{1,6}[ \t]')))::BIGINT AS headers FROM documents")
def md_header_flag(spark, sf_dir):
    return _spread(spark, sf_dir).select("doc_id", F.size(F.filter(F.split("text", "\n"), X.is_header)).cast("long").alias("headers"))


@query(r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|') AND CASE WHEN contains(x, '---') THEN regexp_matches(x, '\|[\s:]*[-:]+[\s:]*\|')
ELSE starts_with(trim(x, chr(32) || chr(9) || chr(13)), '|') END))::BIGINT AS rows FROM documents""")
def md_table_flag(spark, sf_dir):
    return _spread(spark, sf_dir).select("doc_id", F.size(F.filter(F.split("text", "\n"), X.is_table_row)).cast("long").alias("rows"))


@query(r"""WITH t(id, reply) AS (VALUES (1, 'Sure: {"a": 1} done'), (2, 'list [1, 2] end'), (3, 'none'), (4, 'x {"b": [1]} y {"c": 2} z'))
SELECT id, CASE WHEN regexp_extract(reply, '(?s)\{.*\}') != '' THEN regexp_extract(reply, '(?s)\{.*\}') WHEN regexp_extract(reply, '(?s)\[.*\]') != '' THEN regexp_extract(reply, '(?s)\[.*\]') END AS json FROM t""")
def llm_json_slice(spark, sf_dir):
    rows = [(1, 'Sure: {"a": 1} done'), (2, "list [1, 2] end"), (3, "none"), (4, 'x {"b": [1]} y {"c": 2} z')]
    return spark.createDataFrame(rows, "id int, reply string").select("id", X.json_slice(F.col("reply")).alias("json"))


@query("""WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY n_chars, doc_id) AS n FROM documents ORDER BY n_chars, doc_id LIMIT 5)
SELECT 'Knowledge Graph recalled:' || chr(10) || '- c1 -[IN_NATION]-> n1' || chr(10) || chr(10) || 'Relevant Documents:' || chr(10) || string_agg('[' || n || '] ' || text || chr(10), '' ORDER BY n) AS context FROM d""")
def context_assembly(spark, sf_dir):
    top = _docs(spark, sf_dir).orderBy("n_chars", "doc_id").limit(5)
    texts = top.agg(F.array_sort(F.collect_list(F.struct("n_chars", "doc_id", "text"))).alias("r")).select(F.transform("r", lambda x: x.text).alias("texts"))
    triples = F.array(F.struct(F.lit("c1").alias("subject"), F.lit("IN_NATION").alias("predicate"), F.lit("n1").alias("object")))
    return texts.select(X.context(triples, F.col("texts")).alias("context"))


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS dialogue, count(*) AS turns FROM conversations GROUP BY conv_id""")
def conversation_context(spark, sf_dir):
    rows = parquet(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"), F.count(F.lit(1)).alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit(": "), x.text)), "\n").alias("dialogue"), "turns")


# -- not expressible in SQL --


@query()
def chunk_documents(spark, sf_dir):
    docs = _spread(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return chunk.chunk_documents(docs)


@query()
def chunk_stats(spark, sf_dir):
    chunks = chunk_documents(spark, sf_dir)
    return chunks.groupBy("id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.char_length("content")).alias("longest"))


@query()
def html_to_text(spark, sf_dir):
    return parquet(spark, sf_dir, "pages").select("page_id", files.html_column(F.col("html")).alias("text"))


@query("SELECT CASE WHEN text IS NULL THEN 'failed' ELSE 'completed' END AS embedding_status, count(*) AS n FROM documents GROUP BY 1")
def embed_backlog(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(collections.PENDING).alias("embedding_status"))
    done = streaming.embed_pending(rows, hooks.ByteEmbedder(16))
    return done.groupBy("embedding_status").agg(F.count(F.lit(1)).alias("n"))


for _more in (inherited, services):
    QUERIES.update(_more.QUERIES)
    ORACLE.update(_more.ORACLE)
