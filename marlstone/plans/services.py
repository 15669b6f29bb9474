"""Queries of the retrieval modes, graph services, collection writers, chunker rules and vector services, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import json as J
from marlstone.functions import text as X
from marlstone.functions import vector as V
from marlstone.operators import collections, fulltext, graph, hooks, ivf, rag, vector
from marlstone.session import remove_at_exit, shared_folder
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


# -- a knowledge base over documents --

DIMS = 64
EDGES = [("Paris", "IS_A", "Capital"), ("Paris", "SELLS", "Apple"), ("Capital", "TYPE", "Role"), ("Apple", "GROWS_IN", "Orchard")]
ENTITY = "CASE lang WHEN 'fr' THEN 'Paris' WHEN 'de' THEN 'Capital' WHEN 'en' THEN 'Database' ELSE 'Apple' END"
ASKED = "french capital tion"  # low-level Paris; high-level Capital and City


def _docs(spark, sf_dir) -> DataFrame:
    return parquet(spark, sf_dir, "documents")


def _base(spark, sf_dir) -> rag.KnowledgeBase:
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.to_json(F.struct("lang")).alias("metadata"), V.byte_embedding(F.substring("text", 1, DIMS), DIMS).cast("array<float>").alias("embedding"), F.lit("completed").alias("embedding_status"), F.expr(ENTITY).alias("entity"))
    quads = docs.select(F.col("entity").alias("subject"), F.lit("APPEARS_IN").alias("predicate"), F.col("id").alias("object"))
    edges = spark.createDataFrame(EDGES, "subject string, predicate string, object string")
    return rag.KnowledgeBase(docs.drop("entity"), graph.triples(quads.unionByName(edges)), hooks.ByteEmbedder(DIMS), hooks.RuleModel())


_V = "list_transform(range(64), lambda i: coalesce(('0x' || nullif(substr(hex(encode({t})), (2 * i + 1)::INT, 2), ''))::INT, 0) / 255.0)"
_KB = f"""d AS MATERIALIZED (SELECT doc_id::VARCHAR AS id, coalesce(text, '') AS content, lang, {ENTITY} AS entity, {_V.format(t="left(coalesce(text, ''), 64)")}::DOUBLE[] AS v FROM documents),
links AS (SELECT DISTINCT entity AS node, id FROM d), edges(s, p, o) AS (VALUES {", ".join(map(str, EDGES))})"""


def _sql_vector(q: str, k: int, where: str = "true") -> str:
    """id, score of the k nearest documents."""
    v = hooks.ByteEmbedder(DIMS).embed([q])[0]
    return f"(SELECT id, CASE WHEN content = '' THEN 0.0 ELSE list_cosine_similarity(v, {v}::DOUBLE[]) END AS score FROM d WHERE {where} ORDER BY score DESC, id LIMIT {k})"


def _sql_bm25(terms: list[str], k: int, where: str = "true") -> str:
    """id, score by BM25, the best k."""
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""(WITH tok AS (SELECT id, t.term FROM (SELECT id, regexp_extract_all(lower(content), '[a-z0-9]+') AS ts FROM d WHERE {where}), unnest(ts) AS t(term)),
dl AS (SELECT id, count(*) AS len FROM tok GROUP BY id), st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM dl),
tf AS (SELECT id, term, count(*) AS tf FROM tok WHERE term IN ({wanted}) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT tf.id, sum(ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl.len / st.avgdl))) AS score
FROM tf JOIN df ON tf.term = df.term JOIN dl ON tf.id = dl.id CROSS JOIN st GROUP BY tf.id ORDER BY score DESC, tf.id LIMIT {k})"""


def _sql_positions(terms: list[str], k: int, where: str = "true") -> str:
    return f"(SELECT id, 1.0 / row_number() OVER (ORDER BY score DESC, id) AS score FROM {_sql_bm25(terms, k, where)})"


def _sql_arm(words: list[str], k: int) -> str:
    """Documents by keywords: one for each linked entity next to the keyword, and the cosine of vector hits."""
    parts = []
    for w in words:
        near = f"(SELECT '{w}' AS node UNION SELECT CASE WHEN s = '{w}' THEN o ELSE s END FROM edges WHERE '{w}' IN (s, o))"
        parts += [f"SELECT links.id, 1.0 AS score FROM links JOIN {near} USING (node)", f"SELECT id, score FROM {_sql_vector(w, k)}"]
    return f"(SELECT id, sum(score) AS score FROM ({' UNION ALL '.join(parts)}) GROUP BY id ORDER BY score DESC, id LIMIT {k})"


def _sql_rrf(a: str, b: str) -> str:
    ranked = lambda x: f"SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS r FROM {x}"
    return f"(SELECT id, sum(1.0 / (r + 60)) AS score FROM ({ranked(a)} UNION ALL {ranked(b)}) GROUP BY id)"


def _best(of: str, k: int = 5) -> str:
    return f"WITH {_KB} SELECT id, round(score::DOUBLE, 6) AS score FROM {of} ORDER BY round(score, 6) DESC, id LIMIT {k}"


def _answer(found: DataFrame) -> DataFrame:
    return found.select("id", F.round("score", 6).alias("score"))


@query(_best(_sql_vector(ASKED, 5)))
def rag_vector(spark, sf_dir):
    return _answer(_base(spark, sf_dir).retrieve(ASKED, "vector"))


@query(_best(_sql_positions(["tion"], 5)))
def rag_fulltext(spark, sf_dir):
    return _answer(_base(spark, sf_dir).retrieve("the tion of", "fulltext"))


@query(_best(_sql_positions(["est"], 5, "lang = 'fr'")))
def rag_fulltext_filtered(spark, sf_dir):
    return _answer(_base(spark, sf_dir).retrieve("est", "fulltext", filters={"lang": "fr"}))


@query(_best("(SELECT id, 1.0 / row_number() OVER (ORDER BY id) AS score FROM d WHERE contains(lower(content), 'iontion') ORDER BY id LIMIT 5)"))
def rag_fulltext_substring(spark, sf_dir):
    """No word is the term, so its documents are those that hold it within words."""
    return _answer(_base(spark, sf_dir).retrieve("IonTion", "fulltext"))


@query(_best(_sql_rrf(_sql_positions(["tion"], 10), _sql_vector("the tion of and", 10))))
def rag_naive_hybrid(spark, sf_dir):
    return _answer(_base(spark, sf_dir).retrieve("the tion of and", "hybrid", 5))


@query(_best(_sql_arm(["Paris"], 5)))
def rag_local(spark, sf_dir):
    return _answer(_base(spark, sf_dir).retrieve(ASKED, "local"))


@query(_best(_sql_arm(["Capital", "City"], 5)))
def rag_global(spark, sf_dir):
    return _answer(_base(spark, sf_dir).retrieve(ASKED, "global"))


@query(_best(_sql_arm(["Paris", "Capital", "City"], 5)))
def rag_mix(spark, sf_dir):
    return _answer(_base(spark, sf_dir).retrieve(ASKED, "mix"))


@query(_best(f"(SELECT id, arg_min(score, l) AS score FROM (SELECT *, 0 AS l FROM {_sql_arm(['Paris'], 5)} UNION ALL SELECT *, 1 FROM {_sql_arm(['Capital', 'City'], 5)}) GROUP BY id)"))
def rag_hybrid(spark, sf_dir):
    return _answer(_base(spark, sf_dir).retrieve(ASKED, "hybrid"))


@query(f"WITH {_KB} SELECT id, 1.0::DOUBLE AS score FROM links WHERE node IN ('Paris', 'Capital', 'City', 'Apple', 'Role', 'Orchard') ORDER BY id LIMIT 5")
def rag_graph(spark, sf_dir):
    return _answer(_base(spark, sf_dir).retrieve(ASKED, "graph"))


@query(f"WITH {_KB} SELECT id, 1.0::DOUBLE AS score FROM links WHERE node IN ('Apple', 'Paris', 'Orchard', 'Capital') ORDER BY id LIMIT 7")
def rag_related(spark, sf_dir):
    return _answer(_base(spark, sf_dir).by_related(["Apple"], 7))


@query(f"WITH {_KB} SELECT id, round(score::DOUBLE, 6) AS score FROM {_sql_arm(['Paris'], 20)} WHERE score >= 1.5 ORDER BY score DESC, id LIMIT 20")
def rag_local_threshold(spark, sf_dir):
    return _answer(_base(spark, sf_dir).retrieve(ASKED, "local", 20, threshold=1.5))


_WORDS = "(SELECT id, 1.0 AS score FROM d WHERE contains(lower(content), 'the') AND contains(lower(content), 'from') ORDER BY id LIMIT {k})"


@query(_best(f"(SELECT id, sum(score) AS score FROM (SELECT id, score * 0.6 AS score FROM {_sql_vector('the from', 10)} UNION ALL SELECT id, score * 0.4 FROM {_WORDS.format(k=10)}) GROUP BY id)"))
def rag_preset_hybrid(spark, sf_dir):
    return _answer(_base(spark, sf_dir).preset("the from", "hybrid"))


@query(_best(_WORDS.format(k=5)))
def rag_preset_fulltext(spark, sf_dir):
    return _answer(_base(spark, sf_dir).preset("the from", "fulltext"))


@query(f"""WITH {_KB}, w AS (SELECT id, (contains(lower(content), 'the')::INT + contains(lower(content), 'ière')::INT) / 2.0 AS s FROM d WHERE contains(lower(content), 'the') OR contains(lower(content), 'ière') ORDER BY s DESC, id LIMIT 5)
SELECT id, 0.5::DOUBLE AS score FROM d WHERE id IN (SELECT id FROM w UNION SELECT (id::BIGINT + 1)::VARCHAR FROM w) ORDER BY id LIMIT 5""")
def rag_preset_graph(spark, sf_dir):
    kb = _base(spark, sf_dir)
    edges = kb.documents.select(F.col("id").alias("subject"), F.lit("related").alias("predicate"), (F.col("id").cast("long") + 1).cast("string").alias("object"))
    return _answer(kb.preset("the ière", "graph", edges=edges))


_NEAR_TRIPLES = "'- Apple -[GROWS_IN]-> Orchard' || chr(10) || '- Capital -[TYPE]-> Role' || chr(10) || '- Paris -[IS_A]-> Capital' || chr(10) || '- Paris -[SELLS]-> Apple'"


@query(f"""WITH {_KB}, r AS (SELECT id, content, row_number() OVER (ORDER BY id) AS n FROM d WHERE entity IN ('Paris', 'Capital', 'Apple') ORDER BY id LIMIT 3)
SELECT 'Knowledge Graph recalled:' || chr(10) || {_NEAR_TRIPLES} || chr(10) || chr(10) || 'Relevant Documents:' || chr(10) || string_agg('[' || n || '] ' || content || chr(10), '' ORDER BY n) AS context FROM r""")
def rag_context(spark, sf_dir):
    kb = _base(spark, sf_dir)
    return kb.context(kb.by_graph(["Paris"], 3))


@query("SELECT * FROM (VALUES ('Paris', 'IS_A', 'Capital'), ('Paris', 'SELLS', 'Apple'), ('Capital', 'TYPE', 'Role')) AS t(subject, predicate, object)")
def kg_search_graph(spark, sf_dir):
    """Round Paris and Capital; City has no edge, and no document is near enough to stand for it."""
    return _base(spark, sf_dir).search_graph("french capital")


@query(f"""WITH q AS (SELECT vec_id::VARCHAR AS e, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 5)) AS score FROM embeddings ORDER BY score DESC, vec_id::VARCHAR LIMIT 4)
SELECT e AS entity_id, 'v' || e AS entity_name, round(score, 6) AS score, e || ' LABEL L' || label AS triples FROM q""")
def kg_semantic_search(spark, sf_dir):
    """The nearest entities with the triples one step round them."""
    rows = parquet(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("entity_id"), F.concat(F.lit("v"), F.col("vec_id")).alias("entity_name"), "embedding", "label")
    quads = rows.select(F.col("entity_id").alias("subject"), F.lit("LABEL").alias("predicate"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("object"))
    asked = [float(x) for x in rows.where("entity_id = '5'").first()["embedding"]]
    kb = rag.KnowledgeBase(rows, quads, _Constant(asked))
    found = kb.semantic_search(rows.drop("label"), "", 4, 1)
    return found.select("entity_id", "entity_name", F.round("score", 6).alias("score"), F.array_join(F.transform("triples", lambda t: F.concat_ws(" ", t.subject, t.predicate, t.object)), ";").alias("triples"))


class _Constant:
    """An embedder that knows one vector."""

    def __init__(self, v: list[float]) -> None:
        self.v, self.dimensions = v, len(v)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.v for _ in texts]


# -- triples of model replies --


def _replies(spark, sf_dir) -> DataFrame:
    """A constructed reply for each document: its entity, and a relation, left blank for every third."""
    e = F.struct(F.expr(ENTITY).alias("name"), F.upper("lang").alias("type"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("of "), F.col("lang"))).otherwise("").alias("description"))
    r = F.struct(F.expr(ENTITY).alias("source"), F.col("source").alias("target"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("FROM").alias("relation"))
    g = F.to_json(F.struct(F.array(e).alias("entities"), F.array(r).alias("relationships")))
    return _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 7 == 0, "no json here").otherwise(F.concat(F.lit("Sure: "), g, F.lit(" done"))).alias("reply"))


_REPLIED = f"r AS (SELECT doc_id, doc_id::VARCHAR AS id, lang, source, {ENTITY} AS entity FROM documents WHERE doc_id % 7 != 0)"


@query(f"""WITH {_REPLIED} SELECT entity AS subject, 'APPEARS_IN' AS predicate, id AS object FROM r UNION SELECT entity, 'TYPE', upper(lang) FROM r WHERE lang IS NOT NULL
UNION SELECT entity, 'DESCRIPTION', 'of ' || lang FROM r WHERE doc_id % 2 = 0 AND lang IS NOT NULL UNION SELECT entity, CASE WHEN doc_id % 3 = 0 THEN 'RELATED_TO' ELSE 'FROM' END, source FROM r WHERE coalesce(source, '') != ''""")
def kg_extraction(spark, sf_dir):
    return graph.from_extraction(_replies(spark, sf_dir), "RELATED_TO")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 7 != 0) AS success, count(*) FILTER (WHERE doc_id % 7 = 0) AS failure FROM documents")
def kg_extraction_stats(spark, sf_dir):
    return graph.extraction_stats(_replies(spark, sf_dir)).select("total", "success", "failure")


_NATION = "t AS (SELECT 'n' || n_nationkey AS s, 'IN' AS p, 'r' || n_regionkey AS o FROM nation UNION ALL SELECT 'r' || r_regionkey, 'NEXT', 'r' || ((r_regionkey + 1) % 5) FROM region UNION ALL SELECT 'r' || r_regionkey, 'OVER', 'r' || ((r_regionkey + 2) % 5) FROM region)"


def _nations(spark, sf_dir) -> DataFrame:
    n, r = parquet(spark, sf_dir, "nation"), parquet(spark, sf_dir, "region")
    key = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    row = lambda df, s, p, o: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    k = F.col("r_regionkey")
    return row(n, key("n", F.col("n_nationkey")), "IN", key("r", F.col("n_regionkey"))).unionByName(row(r, key("r", k), "NEXT", key("r", (k + 1) % 5))).unionByName(row(r, key("r", k), "OVER", key("r", (k + 2) % 5)))


@query(f"""WITH RECURSIVE {_NATION}, b(node, path) AS (SELECT 'n3', ['n3'] UNION ALL SELECT t.o, list_append(b.path, t.o) FROM b JOIN (SELECT DISTINCT s, o FROM t) t ON t.s = b.node
WHERE NOT list_contains(b.path, t.o) AND b.node != 'r4' AND len(b.path) < 6) SELECT array_to_string(path, ' > ') AS path FROM b WHERE node = 'r4'""")
def kg_all_paths(spark, sf_dir):
    return graph.all_paths(_nations(spark, sf_dir), "n3", "r4", 6).select(F.array_join("path", " > ").alias("path"))


@query(f"""WITH {_NATION}, v AS (SELECT * FROM t WHERE 'r1' IN (s, o)) SELECT 'node' AS kind, id AS a, '' AS b, '' AS c FROM (SELECT s AS id FROM v UNION SELECT o FROM v)
UNION ALL SELECT DISTINCT 'link', s, p, o FROM v""")
def kg_view(spark, sf_dir):
    """Nodes and links round a region, as a drawing takes them."""
    found = graph.subgraph(_nations(spark, sf_dir), spark.createDataFrame([("r1",)], "node string"), 1)
    nodes, links = graph.view(found)
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c")).unionAll(links.select(F.lit("link"), "source", "label", "target"))


@query(f"WITH {_KB} SELECT id FROM d WHERE lang != 'fr' UNION ALL SELECT node || ' ' || links.id FROM links JOIN d USING (id) WHERE lang != 'fr'")
def kg_delete_cascade(spark, sf_dir):
    """Documents of a language go, and the edges that lead to them."""
    kb = _base(spark, sf_dir)
    gone = kb.documents.where(F.get_json_object("metadata", "$.lang") == "fr").select("id")
    docs, quads = collections.delete_cascade(kb.documents, kb.quads, gone)
    return docs.select("id").unionAll(quads.where("predicate = 'APPEARS_IN'").select(F.concat_ws(" ", "subject", "object")))


# -- collections --


def _rows(spark, sf_dir) -> DataFrame:
    """Documents as JSON rows of a collection."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "lang", "source", "n_chars")
    tags = F.array(F.col("lang"), F.col("source"), F.lit(" x "))
    data = F.to_json(F.struct(F.col("id"), F.col("lang").alias("name"), F.col("n_chars").alias("size"), tags.alias("tags"), F.array(F.lit(0.5)).alias("embedding")))
    return docs.select("id", F.col("source").alias("collection_name"), data.alias("data"), F.lit(None).cast("array<float>").alias("embedding"), F.lit("old").alias("content"), F.lit("old").alias("content_tokens"), F.lit(None).cast("timestamp").alias("updated_at"))


@query("""WITH b AS (SELECT doc_id % 100 AS id, count(*) AS n, arg_max(lang || doc_id, doc_id) AS content FROM documents GROUP BY 1)
SELECT coalesce(o.doc_id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'old' ELSE b.content END AS content, CASE WHEN b.id IS NULL THEN 1 ELSE coalesce(o.rev, 0) + b.n END AS _rev
FROM (SELECT doc_id, 1 AS rev FROM documents WHERE doc_id >= 50) o FULL JOIN b ON o.doc_id = b.id""")
def doc_upsert_batch(spark, sf_dir):
    """A batch with ten rows and more of an id: the last wins, and each counts as a revision."""
    docs = _docs(spark, sf_dir)
    old = docs.where("doc_id >= 50").select(F.col("doc_id").alias("id"), F.lit("old").alias("content"), F.lit(1).cast("long").alias("_rev"))
    batch = docs.select((F.col("doc_id") % 100).alias("id"), F.concat("lang", F.col("doc_id").cast("string")).alias("content"), "doc_id")
    return collections.upsert(old, batch, order="doc_id")


@query("""WITH b AS (SELECT doc_id % 100 AS doc_id, arg_max(lang || doc_id, doc_id) AS lang FROM documents GROUP BY 1)
SELECT doc_id, lang FROM b UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b)""")
def doc_replace_batch(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "lang")
    batch = docs.select((F.col("doc_id") % 100).alias("doc_id"), F.concat("lang", F.col("doc_id").cast("string")).alias("lang"), F.col("doc_id").alias("at"))
    return collections.replace(docs, batch, "doc_id", "at").select("doc_id", "lang")


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 4 = 0 THEN 'new ' || n_chars || ' ' || lang || ' ' || source || '  x ' ELSE 'old' END AS content, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE lang END AS name FROM documents""")
def doc_update_json(spark, sf_dir):
    """A merge of new keys; two changes of a row in a batch come in order."""
    rows = _rows(spark, sf_dir)
    some = rows.where("id % 4 = 0").select("id")
    changes = some.withColumns({"data": F.lit('{"name": "draft"}'), "at": F.lit(1)}).unionByName(some.withColumns({"data": F.lit('{"name": "new"}'), "at": F.lit(2)}))
    return collections.update_json(rows, changes, order="at").select("id", "content", F.get_json_object("data", "$.name").alias("name"))


@query("""SELECT 'made' AS collection_name, lang || ' ' || n_chars || ' ' || lang || ' ' || source || '  x ' AS content FROM documents WHERE doc_id % 5 = 0""")
def doc_create_json(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    batch = rows.where("id % 5 = 0").select(J.without(F.col("data"), "id").alias("data"))
    return collections.create_json(rows, batch, "made").where("collection_name = 'made'").select("collection_name", "content")


@query("SELECT trim(tag) AS tag FROM (SELECT lang AS tag FROM documents UNION SELECT source FROM documents UNION SELECT 'x') WHERE trim(tag) != ''")
def doc_tags(spark, sf_dir):
    return collections.tags(_rows(spark, sf_dir))


@query("SELECT doc_id::VARCHAR AS id, lang || ' ' || n_chars || ' ' || lang || ' ' || source || '  x ' AS text FROM documents")
def doc_extract_text(spark, sf_dir):
    return _rows(spark, sf_dir).select("id", J.extract_text(F.col("data")).alias("text"))


@query("SELECT doc_id::VARCHAR AS id, n_chars AS size, doc_id % 2 = 0 AS tagged FROM documents")
def doc_projections(spark, sf_dir):
    """Keys taken out, id and content put in, a tag looked up, and the envelope's text."""
    rows = _rows(spark, sf_dir).withColumn("meta", J.without(F.col("data"), "id", "tags"))
    flat = J.flatten(F.col("id"), F.lit("c"), F.col("meta"))
    tagged = J.has_tag(F.to_json(F.struct(F.array(F.when(F.col("id") % 2 == 0, "even").otherwise("odd")).alias("tags"))), "even")
    return rows.where(J.envelope_text(flat) == "c").where(F.get_json_object("meta", "$.tags").isNull()).select(F.get_json_object(flat, "$.id").alias("id"), F.get_json_object(flat, "$.size").cast("long").alias("size"), tagged.alias("tagged"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE 'p' END AS text FROM documents")
def doc_first_text(spark, sf_dir):
    k = F.col("doc_id") % 3
    return _docs(spark, sf_dir).select("doc_id", J.first_text(F.when(k == 0, F.col("lang")).otherwise(""), F.when(k == 1, F.col("source")), F.lit("p")).alias("text"))


@query("SELECT id, field, text FROM (SELECT doc_id AS id, 'lang' AS field, lang AS text FROM documents UNION ALL SELECT doc_id, 'source', CASE WHEN doc_id % 2 = 0 THEN source ELSE ' ' END FROM documents) WHERE trim(coalesce(text, '')) != ''")
def doc_fields_to_embed(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(" ").alias("source"))
    return rag.fields_to_embed(docs, ["lang", "source"], 2)


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def doc_find_many(spark, sf_dir):
    return collections.find_by_ids(_docs(spark, sf_dir), parquet(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0 ORDER BY doc_id LIMIT 25")
def doc_backlog(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "pending").otherwise("completed").alias("embedding_status"))
    return collections.backlog(rows, 25).select("id")


@query("SELECT count(*) FILTER (WHERE doc_id % 3 != 2) AS n FROM documents")
def doc_unfinished(spark, sf_dir):
    k = F.col("doc_id") % 3
    return collections.unfinished(_docs(spark, sf_dir).select(F.when(k == 0, "pending").when(k == 1, "processing").otherwise("completed").alias("embedding_status")))


@query("SELECT doc_id, trim(CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE ' ' || lang || ' ' END) AS content FROM documents WHERE doc_id % 4 != 0")
def doc_nonblank(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("lang"), F.lit(" "))).alias("content"))
    return collections.nonblank(rows)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') ELSE 'have' END AS content_tokens FROM documents")
def doc_prepare_tokens(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("have").alias("content_tokens"))
    return collections.prepare_tokens(rows).select("doc_id", "content_tokens")


@query("SELECT 'made' AS id, doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id::VARCHAR, doc_id FROM documents WHERE doc_id % 2 = 1")
def doc_append(spark, sf_dir):
    """Missing and blank ids are made; that they are made, and no two alike, is what can be compared."""
    docs = _docs(spark, sf_dir)
    batch = docs.select(F.when(F.col("doc_id") % 4 == 0, " ").when(F.col("doc_id") % 2 == 1, F.col("doc_id").cast("string")).alias("id"), "doc_id")
    out = collections.append(batch.limit(0), batch)
    return out.groupBy("id").agg(F.max("doc_id").alias("doc_id")).select(F.when(F.length("id") == 36, "made").otherwise(F.col("id")).alias("id"), "doc_id")


@query("SELECT doc_id AS id, text AS content, true AS missing FROM documents")
def doc_evolve(spark, sf_dir):
    """A column that the schema has and the table has not comes as null."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("content", T.StringType()), T.StructField("stars", T.IntegerType())])
    return collections.conform(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang"), schema).select("id", "content", F.col("stars").isNull().alias("missing"))


# -- rules of the chunker, as columns --


@query(r"SELECT doc_id, regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]', '', 'g') AS text FROM documents")
def txt_remove_space(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.remove_space(F.col("text")).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\n\r\t\f\x0B\x00\x{85}\x{2028}\x{2029}]', '', 'g'), ' +', ' ', 'g')) AS text FROM documents")
def txt_clean_content(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.clean_content(F.col("text")).alias("text"))


_ROW = r"(contains({x}, '|') AND CASE WHEN contains({x}, '---') THEN regexp_matches({x}, '\|[\s:]*[-:]+[\s:]*\|') ELSE starts_with(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '|') END)"


@query(rf"""WITH l AS (SELECT doc_id, replace(text, chr(10), ' ') AS line, string_split('| ' || text || ' |' || chr(10) || '|---|' || chr(10) || '  ' || text, chr(10)) AS ls FROM (SELECT doc_id, left(text, 40) AS text FROM documents))
SELECT doc_id, array_to_string(list_filter(list_transform(ls, lambda x: CASE WHEN {_ROW.format(x="x")} THEN x ELSE regexp_replace(replace(x, chr(13), ''), '^\s+|\s+$', '', 'g') END), lambda x: {_ROW.format(x="x")} OR x != ''), chr(10)) AS text FROM l""")
def txt_clean_table_chunk(spark, sf_dir):
    t = F.substring("text", 1, 40)
    return _docs(spark, sf_dir).select("doc_id", X.clean_chunk(F.concat(F.lit("| "), t, F.lit(" |\n|---|\n  "), t)).alias("text"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(left(text, 60), '[^ \n]+|.') AS raw FROM documents), w AS (SELECT doc_id, list_filter(list_transform(raw, lambda x: trim(x)), lambda x: x != '' AND x != chr(10)) AS ts FROM t)
SELECT doc_id, CASE WHEN len(ts) = 0 THEN true ELSE len(list_filter(ts, lambda x: length(x) >= 2 AND regexp_matches(x, '[\p{L}\p{N}]'))) / len(ts) < 0.2
OR (len(list_filter(ts, lambda x: length(x) >= 2 AND regexp_matches(x, '[\p{L}\p{N}]'))) / len(ts) < 0.3 AND len(list_filter(ts, lambda x: length(x) = 1)) / len(ts) > 0.5) END AS garbage FROM w""")
def txt_garbage(spark, sf_dir):
    words = F.split(F.substring("text", 1, 60), "[ \n]+")
    return _docs(spark, sf_dir).select("doc_id", X.is_garbage(words).alias("garbage"))


@query("SELECT doc_id, sha256(doc_id || chr(1) || coalesce(lang, '')) AS id, doc_id || '_chunk_' || (doc_id % 9) AS chunk FROM documents")
def txt_stable_ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.stable_id(F.col("doc_id"), F.col("lang")).alias("id"), X.chunk_id(F.col("doc_id").cast("string"), F.col("doc_id") % 9).alias("chunk"))


@query("SELECT doc_id, printf('[%d] (Score: %.4f) %s', doc_id, n_chars / 7.0, lang) AS line, 'Say ' || lang || ' of ' || source AS prompt FROM documents")
def txt_lines_and_prompts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.scored_line(F.col("doc_id"), F.col("n_chars") / 7.0, F.col("lang")).alias("line"), X.fill("Say {a} of {b}", a=F.col("lang"), b=F.col("source")).alias("prompt"))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%eitlich%' OR text ILIKE '%iontion%' OR lang ILIKE '%eitlich%' OR lang ILIKE '%iontion%' ORDER BY doc_id LIMIT 30")
def ft_query_terms(spark, sf_dir):
    """The terms of a question, without its stop words, in any of two columns."""
    terms = X.search_terms("What is the EITLICH or iontion?")
    return fulltext.substring_any(_docs(spark, sf_dir), terms, ("text", "lang"), "doc_id", 30).select("doc_id")


# -- vectors --


def _vectors(spark, sf_dir) -> DataFrame:
    return parquet(spark, sf_dir, "embeddings")


_TO0 = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


def _asked(spark, sf_dir, i: int = 0) -> list[float]:
    return [float(x) for x in _vectors(spark, sf_dir).where(F.col("vec_id") == i).select("embedding").first()[0]]


@query(f"SELECT vec_id, round({_TO0}, 6) AS score FROM embeddings WHERE vec_id % 3 != 0 ORDER BY {_TO0} DESC, vec_id LIMIT 10")
def vec_ready_only(spark, sf_dir):
    """Rows whose embedding is not finished are not searched."""
    rows = _vectors(spark, sf_dir).withColumn("embedding_status", F.when(F.col("vec_id") % 3 == 0, "pending").otherwise("completed"))
    return vector.search(rows, _asked(spark, sf_dir), 10, key="vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, label, {_TO0} AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 40) WHERE label = 4 ORDER BY s DESC, vec_id LIMIT 20")
def vec_postfiltered(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("label")))
    return vector.search_postfiltered(rows, _asked(spark, sf_dir), 20, {"label": 4}, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH t AS (SELECT vec_id, round({_TO0}, 9) AS s, 'text' AS source FROM embeddings WHERE vec_id % 2 = 0 ORDER BY {_TO0} DESC, vec_id LIMIT 8),
i AS (SELECT vec_id, round({_TO0}, 9) AS s, 'image' AS source FROM embeddings WHERE vec_id % 2 = 1 ORDER BY {_TO0} DESC, vec_id LIMIT 8)
SELECT vec_id, source, round(s, 6) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM i) ORDER BY s DESC, vec_id LIMIT 8""")
def vec_media(spark, sf_dir):
    """Texts and images of one search, by score."""
    e, even = F.col("embedding"), F.col("vec_id") % 2 == 0
    rows = _vectors(spark, sf_dir).select("vec_id", F.lit("c").alias("content"), F.when(even, e).alias("text_embedding"), F.when(~even, e).alias("image_embedding"))
    asked = _asked(spark, sf_dir)
    return vector.search_media(rows, asked, asked, 8, key="vec_id").select("vec_id", "source", F.round("score", 6).alias("score"))


@query("""SELECT a.vec_id, round(CASE WHEN a.vec_id % 5 = 0 THEN 0.0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 6) AS score, len(a.embedding) AS size, round(a.embedding[1]::DOUBLE, 5) AS first
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vec_pairs(spark, sf_dir):
    """Cosine of neighbours by id, through a JSON list and packed floats; other lengths compare as 0."""
    e = _vectors(spark, sf_dir)
    cut = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    a = e.select("vec_id", V.json_vector(F.to_json("embedding")).alias("whole"), cut.alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), V.unpack_floats(V.pack_floats(F.col("embedding"))).alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("score"), F.size("whole").cast("long").alias("size"), F.round(F.element_at("whole", 1), 5).alias("first"))


@query("SELECT array_to_string(list_transform(v, lambda x: printf('%.4f', x)), ' ') AS v, doc_id, status FROM (SELECT doc_id, 'completed' AS status, list_transform(range(4), lambda i: coalesce(('0x' || nullif(substr(hex(encode(left(text, 4))), (2 * i + 1)::INT, 2), ''))::INT, 0) / 255.0) AS v FROM documents)")
def vec_insert_batch(spark, sf_dir):
    """Documents put in with embeddings by a hook."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.substring("text", 1, 4).alias("content"))
    old = docs.limit(0).withColumns({"embedding": F.lit(None).cast("array<float>"), "embedding_status": F.lit("")})
    quads = spark.createDataFrame([], "subject string, predicate string, object string")
    made, _ = rag.insert_batch(old, quads, docs, hooks.ByteEmbedder(4))
    shown = F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", x.cast("double"))), " ")
    return made.select(shown.alias("v"), F.col("id").cast("long").alias("doc_id"), F.col("embedding_status").alias("status"))


@query(f"SELECT vec_id, label, round({_TO0}, 6) AS score FROM embeddings ORDER BY {_TO0} DESC, vec_id LIMIT 10")
def vec_ivf_all_lists(spark, sf_dir):
    """Through the approximate index with all lists probed, which finds what the exact scan does."""
    path = f"{shared_folder(spark)}/marlstone-ivf-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    index = ivf.build(_vectors(spark, sf_dir), path, 8, "vec_id")
    return index.search(spark, _asked(spark, sf_dir), 10, 8).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("""SELECT a.event_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR""")
def events_joined_within(spark, sf_dir):
    """Purchases of a click's user within six hours, by the join that streams use."""
    events = parquet(spark, sf_dir, "events")
    right = events.where("event_type = 'purchase'").select(F.col("user_id").alias("other"), F.col("ts").alias("at"), F.col("event_id").alias("right_id"))
    near = F.col("at").between(F.col("ts"), F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    return streaming.joined(events.where("event_type = 'click'"), right, F.col("user_id") == F.col("other"), near, "1 day").select("event_id", "right_id")
