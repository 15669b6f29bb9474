"""Retrieval modes over one knowledge base: documents, triples and hooks.

A mode builds one lazy plan for each arm and joins the arms by fusion; only tests for emptiness and answers run on the
driver. Filters apply before cuts in every arm, and an error in an arm is an error of the mode.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.config import APPEARS_IN, CONTEXT_TRIPLES, EMPTY_ANSWER, ENTITY_MATCH, ENTITY_TOP, HYBRID_WEIGHTS, RETRIEVE_LIMIT
from marlstone.functions import json as J
from marlstone.functions import text as X
from marlstone.functions import vector as V
from marlstone.operators import fulltext, graph, vector
from marlstone.operators.fusion import additive, first_wins, rrf, weighted
from marlstone.operators.hooks import ANSWER_PROMPT, EXTRACT_PROMPT, KEYWORD_PROMPT, Embedder, LanguageModel, Segmenter, complete_column
from marlstone.session import cut

MODES = ("vector", "naive", "fulltext", "local", "global", "graph", "hybrid", "mix")
PRESETS = ("vector", "fulltext", "graph", "hybrid")
TRIPLES = "array<struct<subject:string,predicate:string,object:string>>"


@dataclass
class KnowledgeBase:
    """documents: id, content, metadata, embedding, embedding_status. quads: subject, predicate, object."""

    documents: DataFrame
    quads: DataFrame | None = None
    embedder: Embedder | None = None
    model: LanguageModel | None = None
    segmenter: Segmenter | None = None

    # -- pieces --

    def keywords(self, query: str) -> tuple[list[str], list[str]]:
        """Low-level and high-level keywords by the model; none without one. Broken replies are errors."""
        if self.model is None:
            return [], []
        reply = self.model.complete([KEYWORD_PROMPT.replace("{query}", query)])[0]
        m = re.search(r"\{.*\}", reply, re.S)
        found = json.loads(m[0] if m else reply)
        return list(found.get("low_level") or []), list(found.get("high_level") or [])

    def _filtered(self, filters: dict | None) -> DataFrame:
        return self.documents.where(J.matches(filters, F.col("metadata"))) if filters else self.documents

    def _shaped(self, rows: DataFrame, triples: DataFrame | None = None) -> DataFrame:
        """id, content, score, metadata, recalled_triples (the same for each row)."""
        out = rows.select("id", "content", F.col("score").cast("double").alias("score"), "metadata")
        if triples is None:
            return out.withColumn("recalled_triples", F.array().cast(TRIPLES))
        # What the context of one answer takes of a subgraph of named keywords; a hub has more than one row could hold.
        taken = triples.select(*graph.SPO).distinct().orderBy(*graph.SPO).limit(CONTEXT_TRIPLES)
        gathered = taken.agg(F.array_sort(F.collect_list(F.struct(*graph.SPO))).alias("recalled_triples"))
        return out.withColumn("__one", F.lit(1)).join(F.broadcast(gathered.withColumn("__one", F.lit(1))), "__one").drop("__one")

    def _materialised(self, scores: DataFrame, limit: int, filters: dict | None = None) -> DataFrame:
        """The best scored ids with their documents; ids without a document are left out."""
        docs = self._filtered(filters)
        # The best are chosen by ids alone, so that contents are not shuffled.
        best = docs.select("id").join(scores, "id").orderBy(F.desc("score"), "id").limit(limit).dropDuplicates(["id"])
        return docs.join(F.broadcast(best), "id").orderBy(F.desc("score"), "id").limit(limit)

    def by_vector(self, query: str, limit: int, filters: dict | None = None, threshold: float | None = None) -> DataFrame:
        if self.embedder is None:
            raise ValueError("vector search needs an embedder")
        return vector.search(self.documents, self.embedder.embed([query])[0], limit, filters, threshold)

    def by_fulltext(self, query: str, limit: int, filters: dict | None = None) -> DataFrame:
        return fulltext.find_with_scores(self.documents, query, filters, self.segmenter, k=limit)

    def _seeds(self, words: list[str]) -> DataFrame:
        return self.documents.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(words)], "node string")

    def by_keywords(self, words: list[str], limit: int, filters: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """Sum, over keywords, of 1 for each linked entity near the keyword and the cosine of vector hits; and the triples."""
        if self.quads is None:
            raise ValueError("keyword retrieval needs triples")
        nodes, triples = None, None
        for i, word in enumerate(words):
            seed = self._seeds([word])
            near = graph.subgraph(self.quads, seed, 1, (APPEARS_IN,))
            triples = near if triples is None else triples.unionByName(near)
            of = graph.nodes_of(near, seed).select(F.lit(i).alias("word"), "node")
            nodes = of if nodes is None else nodes.unionByName(of)
        links = self.quads.where(F.col("predicate") == APPEARS_IN).select(F.col("subject").alias("node"), F.col("object").alias("id"))
        linked = links.join(graph.few(cut(nodes, "nodes")), "node").select("word", "node", "id").distinct()
        parts = [linked.select("id", F.lit(1.0).alias("score"))]
        if self.embedder is not None:
            parts += self._by_vectors(words, limit, filters)
        return self._materialised(additive(parts), limit, filters), triples.dropDuplicates(graph.SPO)

    def _by_vectors(self, words: list[str], limit: int, filters: dict | None) -> list[DataFrame]:
        """(id, score) of each word's vector hits, from one scan of the documents."""
        rows = vector.ready(self._filtered(filters))
        scores = [V.cosine_to(F.col("embedding"), q).alias(f"s{i}") for i, q in enumerate(self.embedder.embed(words))]
        scored = cut(rows.select("id", *scores), "scores")
        return [vector.top_k(scored.select("id", F.col(f"s{i}").alias("score")), limit) for i in range(len(words))]

    # -- modes --

    def retrieve(self, query: str, mode: str = "hybrid", limit: int = RETRIEVE_LIMIT, filters: dict | None = None, threshold: float | None = None) -> DataFrame:
        """id, content, score, metadata, recalled_triples, the best first. An unknown mode is full text."""
        limit = limit if limit > 0 else RETRIEVE_LIMIT
        found = self._retrieve(query, mode, limit, filters)
        if threshold is not None:
            found = found.where(F.col("score") >= threshold)
        return found.orderBy(F.desc("score"), "id").limit(limit)

    def _retrieve(self, query: str, mode: str, limit: int, filters: dict | None) -> DataFrame:
        if mode in ("vector", "naive"):
            return self._shaped(self.by_vector(query, limit, filters))
        if mode not in MODES or mode == "fulltext":
            return self._shaped(self.by_fulltext(query, limit, filters))
        try:
            low, high = self.keywords(query)
        except (ValueError, AttributeError):
            low, high = [], []  # a broken reply: the naive hybrid, as without keywords
        if mode == "local":
            return self._arm(low, limit, filters) if low else self.naive_hybrid(query, limit, filters)
        if mode == "global":
            return self._arm(high, limit, filters) if high else self.naive_hybrid(query, limit, filters)
        if mode == "graph":
            return self.by_graph(low + high or [query], limit, filters)
        if mode == "mix":
            found = cut(self._arm(low + high, limit, filters), "hits") if low + high else None
            return found if found is not None and not found.isEmpty() else self._shaped(self.by_vector(query, limit, filters))
        arms = [self._arm(words, limit, filters) for words in (low, high) if words]
        if not arms:
            return self.naive_hybrid(query, limit, filters)
        both = cut(first_wins(arms) if len(arms) > 1 else arms[0], "hits")
        return self.naive_hybrid(query, limit, filters) if both.isEmpty() else both

    def _arm(self, words: list[str], limit: int, filters: dict | None) -> DataFrame:
        return self._shaped(*self.by_keywords(words, limit, filters))

    def naive_hybrid(self, query: str, limit: int, filters: dict | None = None) -> DataFrame:
        """Reciprocal ranks of full text and vector search."""
        arms = [self.by_fulltext(query, 2 * limit, filters).select("id", "score")]
        if self.embedder is not None:
            arms.append(self.by_vector(query, 2 * limit, filters).select("id", "score"))
        return self._shaped(self._materialised(rrf(arms), limit, filters))

    def by_graph(self, words: list[str], limit: int, filters: dict | None = None, depth: int = 2) -> DataFrame:
        """Documents of the entities in the keywords' subgraph, score 1, by id; with the triples."""
        seeds = self._seeds(words)
        near = graph.subgraph(self.quads, seeds, depth, (APPEARS_IN,))
        ids = graph.documents_of(self.quads, graph.nodes_of(near, seeds)).select("id").distinct()
        docs = self._filtered(filters).join(ids, "id", "left_semi").orderBy("id").limit(limit)
        return self._shaped(docs.withColumn("score", F.lit(1.0)), near)

    def by_related(self, words: list[str], limit: int, depth: int = 2) -> DataFrame:
        """Graph retriever: documents of entities related to the keywords, score 1."""
        near = graph.related(self.quads, self._seeds(words), depth)
        ids = graph.documents_of(self.quads, near).select("id").distinct()
        return self.documents.join(ids, "id", "left_semi").orderBy("id").limit(limit).withColumns({"score": F.lit(1.0), "retrieval_method": F.lit("graph")})

    def preset(self, query: str, mode: str = "hybrid", limit: int = RETRIEVE_LIMIT, threshold: float | None = None, edges: DataFrame | None = None) -> DataFrame:
        """The second family of modes: vector, fulltext (all words), graph (words or neighbours), hybrid (0.6 and 0.4)."""
        if mode == "vector":
            return self.by_vector(query, limit, threshold=threshold)
        if mode == "fulltext":
            return fulltext.all_words(self.documents, query, k=limit)
        if mode == "graph":
            direct = fulltext.all_words(self.documents, query, k=limit, any_word=True).select("id")
            near = direct if edges is None else direct.unionByName(direct.join(edges.where(F.col("predicate") == "related").select(F.col("subject").alias("id"), "object"), "id").select(F.col("object").alias("id"))).distinct()
            return self.documents.join(near, "id", "left_semi").orderBy("id").limit(limit).withColumn("score", F.lit(0.5))
        if mode == "hybrid":
            arms = [(self.by_vector(query, 2 * limit).select("id", "score"), HYBRID_WEIGHTS[0]), (fulltext.all_words(self.documents, query, k=2 * limit).select("id", "score"), HYBRID_WEIGHTS[1])]
            return self._materialised(weighted(arms), limit)
        raise ValueError(f"unknown mode {mode}")

    def search_graph(self, query: str, depth: int = 1, expand: bool = True) -> DataFrame:
        """Triples round the query's keywords. A keyword without a real edge stands for the entities of its nearest documents."""
        low, high = self.keywords(query)
        words = low + high or [query]
        seeds = self._seeds(words)
        real = graph.steps_both(self.quads.where(F.col("predicate") != APPEARS_IN)).select("node").distinct()
        known, unknown = seeds.join(real, "node", "left_semi"), [r["node"] for r in seeds.join(real, "node", "left_anti").collect()]
        if expand and self.embedder is not None:
            for word in unknown:  # words of one query
                hits = self.by_vector(word, ENTITY_TOP, threshold=ENTITY_MATCH)
                known = known.unionByName(graph.entities_of(self.quads, hits.select("id")))
        return graph.subgraph(self.quads, known.distinct(), depth, (APPEARS_IN,))

    def semantic_search(self, entities: DataFrame, query: str, limit: int = 10, depth: int = 2) -> DataFrame:
        """Nearest entities (entity_id, entity_name, embedding) with the triples round each of them."""
        hits = cut(vector.search(entities, self.embedder.embed([query])[0], limit, key="entity_id").select("entity_id", "entity_name", "score"), "hits")
        near = graph.subgraph_of_each(self.quads, hits.select(F.col("entity_id").alias("node")), depth)
        rank = F.row_number().over(W.partitionBy("seed").orderBy(*graph.SPO))
        taken = near.withColumn("__n", rank).where(F.col("__n") <= CONTEXT_TRIPLES)
        gathered = taken.groupBy(F.col("seed").alias("entity_id")).agg(F.array_sort(F.collect_list(F.struct(*graph.SPO))).alias("triples"))
        return hits.join(gathered, "entity_id", "left").withColumn("triples", F.coalesce("triples", F.array().cast(TRIPLES)))

    # -- answers --

    def context(self, results: DataFrame) -> DataFrame:
        """One row: the context of an answer, from the (bounded) results of a retrieval."""
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "content", "recalled_triples")))
        rows = results.agg(ordered.alias("r"))
        return rows.select(X.context(F.flatten(F.transform("r", lambda x: x.recalled_triples)), F.transform("r", lambda x: F.coalesce(x.content, F.lit("")))).alias("context"))

    def query(self, query: str, mode: str = "hybrid", limit: int = RETRIEVE_LIMIT, filters: dict | None = None) -> str:
        """The model's answer, or the context without a model."""
        text = self.context(self.retrieve(query, mode, limit, filters)).first()["context"]
        if text == EMPTY_ANSWER or self.model is None:
            return text
        return self.model.complete([ANSWER_PROMPT.replace("{context}", text).replace("{query}", query)])[0]

    def graph_context(self, query: str, depth: int = 3, limit: int = RETRIEVE_LIMIT) -> str:
        """Triples of the query's graph and full-text documents as one context."""
        near = self.search_graph(query, depth)
        return self.context(self._shaped(self.by_fulltext(query, limit), near)).first()["context"]

    def extract(self, docs: DataFrame | None = None) -> DataFrame:
        """Model replies (id, reply) for documents; graph.from_extraction makes triples of them."""
        docs = self.documents if docs is None else docs
        return docs.select("id", complete_column(self.model)(X.fill(EXTRACT_PROMPT, text=F.col("content"))).alias("reply"))


def insert(documents: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert of new documents; missing ids are made from the content, a missing content is an error."""
    from marlstone.operators.collections import prepare, upsert

    checked = batch.withColumn("content", F.coalesce(F.col("content"), F.raise_error(F.lit("document without content"))))
    ids = F.coalesce(F.col("id"), X.stable_id(F.col("content"))) if "id" in batch.columns else X.stable_id(F.col("content"))
    return upsert(documents, prepare(checked.withColumn("id", ids)))


def insert_batch(documents: DataFrame, quads: DataFrame, batch: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """Insert or replace with embeddings, and an ``is_document`` edge of each id with itself."""
    from marlstone.config import IS_DOCUMENT
    from marlstone.operators.collections import COMPLETED, replace
    from marlstone.operators.hooks import embed_column

    made = batch.withColumns({"embedding": embed_column(embedder)(F.col("content")), "embedding_status": F.lit(COMPLETED)})
    edges = batch.select(F.col("id").alias("subject"), F.lit(IS_DOCUMENT).alias("predicate"), F.col("id").alias("object"))
    return replace(documents, made), graph.link(quads, edges)


def retriever(kb: KnowledgeBase, mode: str = "hybrid", limit: int = RETRIEVE_LIMIT, *transformers):
    """A function from a query to documents with the score in their metadata, through optional transformers."""
    from marlstone.operators.hooks import transform_documents

    def retrieve(query: str) -> DataFrame:
        found = kb.retrieve(query, mode, limit)
        scored = J.merge(F.coalesce(F.col("metadata"), F.lit("{}")), F.to_json(F.struct("score")))
        return transform_documents(found.withColumn("metadata", scored), *transformers)

    return retrieve


def fields_to_embed(docs: DataFrame, fields: list[str], batch: int) -> DataFrame:
    """A row for each document and field with a text; more fields than a batch holds is an error."""
    if len(fields) > batch:
        raise ValueError(f"{len(fields)} fields to embed, a batch holds {batch}")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    return docs.select("id", F.explode(pairs).alias("p")).select("id", "p.field", "p.text").where("trim(coalesce(text, '')) != ''")
