"""The service's verbs as Python calls over a versioned store: collections, documents, search and graph."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.config import PAGE_LIMIT, REST_PATH_DEPTH, SEARCH_LIMIT, SUBGRAPH_DEPTH
from marlstone.functions import json as J
from marlstone.operators import collections as C
from marlstone.operators import chunk, fulltext, graph, gremlin, vector
from marlstone.operators.hooks import Embedder
from marlstone.operators.store import TableStore


class NotFound(LookupError):
    """No document of that id."""


class Service:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None) -> None:
        self.spark, self.embedder, self.store = spark, embedder, TableStore(spark, root)

    def _docs(self, collection: str | None = None) -> DataFrame:
        docs = C.evolve(self.store.read("documents", schemas.REST_DOCUMENTS), schemas.REST_DOCUMENTS)
        return docs if collection is None else docs.where(F.col("collection_name") == collection)

    def _quads(self) -> DataFrame:
        return self.store.read("quads", schemas.QUADS)

    # -- collections and documents --

    def info(self) -> dict:
        return {"tables": self.store.names(), "documents": self._docs().count(), "triples": self._quads().count()}

    def collections(self) -> list[str]:
        return sorted(r[0] for r in C.collections(self._docs()).collect())

    def collection(self, name: str) -> dict:
        return {"name": name, "count": self._docs(name).count(), "schema": {f.name: f.dataType.simpleString() for f in schemas.REST_DOCUMENTS.fields}}

    def create(self, collection: str, data: dict) -> str:
        """The new document's id; one that is there already, in any collection, is an error."""
        data = {**data, "id": str(data.get("id") or "").strip() or self.spark.range(1).select(F.uuid()).first()[0]}
        vector_ = data.get("embedding")
        row = self.spark.createDataFrame([(json.dumps(data, ensure_ascii=False), vector_)], "data string, embedding array<float>")
        self.store.change("documents", lambda old: C.create_json(old, row, collection), schemas.REST_DOCUMENTS)
        return data["id"]

    def create_many(self, collection: str, rows: list[dict]) -> list[str]:
        """The new documents' ids, all of them put in or none."""
        made = [{**r, "id": str(r.get("id") or "").strip() or str(uuid.uuid4())} for r in rows]
        batch = self.spark.createDataFrame([(json.dumps(r, ensure_ascii=False), r.get("embedding")) for r in made], "data string, embedding array<float>")
        self.store.change("documents", lambda old: C.create_json(old, batch, collection), schemas.REST_DOCUMENTS)
        return [r["id"] for r in made]

    def chunk(self, collection: str, doc_id: str, config: chunk.ChunkConfig = chunk.ChunkConfig()) -> list[str]:  # noqa: B008
        """The chunks of a document's text."""
        self.get(collection, doc_id)
        return chunk.split_text(C.find_by_id(self._docs(collection), doc_id).first()["content"], config)

    def get(self, collection: str, doc_id: str) -> dict:
        row = C.find_by_id(self._docs(collection), doc_id).first()
        if row is None:
            raise NotFound(doc_id)
        return json.loads(row["data"])

    def list(self, collection: str, limit: int = PAGE_LIMIT, offset: int = 0, tag: str | None = None) -> DataFrame:
        docs = self._docs(collection)
        return C.page(docs.where(J.tag_like(F.col("data"), tag)) if tag else docs, limit, offset)

    def update(self, collection: str, doc_id: str, changes: dict) -> dict:
        self.get(collection, doc_id)
        row = self.spark.createDataFrame([(doc_id, json.dumps(changes, ensure_ascii=False), changes.get("embedding"))], "id string, data string, embedding array<float>")
        self._change(collection, lambda mine: C.update_json(mine, row))
        return self.get(collection, doc_id)

    def delete(self, collection: str, doc_id: str) -> None:
        self.get(collection, doc_id)
        self._change(collection, lambda mine: C.delete(mine, self.spark.createDataFrame([(doc_id,)], "id string")))

    def _change(self, collection: str, step: Callable[[DataFrame], DataFrame]) -> None:
        """A step over the documents of one collection; the others stay as they are."""
        mine = F.coalesce(F.col("collection_name") == collection, F.lit(False))
        self.store.change("documents", lambda old: old.where(~mine).unionByName(step(old.where(mine))))

    # -- search --

    def fulltext(self, collection: str, query: str, limit: int = SEARCH_LIMIT, threshold: float | None = None) -> dict:
        began = time.time()
        hits = fulltext.search(self._docs(collection), query, k=limit)
        hits = hits if threshold is None else hits.where(F.col("score") >= threshold)
        return self._answer(hits, collection, began)

    def vector(self, collection: str, query: str | list[float], limit: int = SEARCH_LIMIT, threshold: float | None = None, field: str = "embedding") -> dict:
        began = time.time()
        if isinstance(query, str):
            if self.embedder is None:
                raise ValueError("a text query needs an embedder")
            query = self.embedder.embed([query])[0]
        hits = vector.search(self._docs(collection), query, limit, threshold=threshold, vector=field).select("id", "score")
        return self._answer(hits, collection, began)

    def _answer(self, hits: DataFrame, collection: str, began: float) -> dict:
        rows = self._docs(collection).select("id", "data").join(F.broadcast(hits), "id").orderBy(F.desc("score"), "id").collect()  # hits: at most the limit
        return {"results": [{"id": r["id"], "score": r["score"], "data": json.loads(r["data"])} for r in rows], "took": round(1000 * (time.time() - began))}

    # -- graph --

    def _triple(self, s: str, p: str, o: str) -> DataFrame:
        return self.spark.createDataFrame([(s, p, o)], "subject string, predicate string, object string")

    def entity(self, name: str) -> dict:
        """An entity's type, description, documents and relations."""
        quads = self._quads()
        own = graph.entities(quads.where(F.col("subject") == name)).first()
        seed = self.spark.createDataFrame([(name,)], "node string")
        relations = graph.export_graph(quads)[1].where((F.col("source") == name) | (F.col("target") == name))
        return {
            "name": name, "type": own["type"] if own else "", "description": own["description"] if own else "",
            "documents": sorted(r["id"] for r in graph.documents_of(quads, seed).collect()), "relations": sorted(tuple(r) for r in relations.collect()),
        }

    def subgraph(self, node: str, depth: int = SUBGRAPH_DEPTH) -> dict:
        """Nodes and links round a node, for drawing."""
        nodes, links = graph.view(graph.subgraph(self._quads(), self.spark.createDataFrame([(node,)], "node string"), depth))
        return {"nodes": sorted(r["id"] for r in nodes.collect()), "links": sorted(tuple(r) for r in links.collect())}

    def link(self, s: str, p: str, o: str) -> None:
        self.store.change("quads", lambda q: graph.link(q, self._triple(s, p, o)), schemas.QUADS)

    def unlink(self, s: str, p: str, o: str) -> None:
        self.store.change("quads", lambda q: graph.unlink(q, self._triple(s, p, o)), schemas.QUADS)

    def neighbors(self, node: str, predicate: str = "", incoming: bool = False) -> list[str]:
        found = (graph.in_neighbors if incoming else graph.neighbors)(self._quads(), node, predicate)
        return sorted(r[0] for r in found.collect())

    def path(self, start: str, goal: str, predicate: str = "", depth: int = REST_PATH_DEPTH) -> list[str] | None:
        row = graph.find_path(self._quads(), start, goal, depth, predicate).first()
        return row["path"] if row else None

    def query(self, text: str) -> list[str]:
        return sorted(r[0] for r in gremlin.run(self._quads(), text).collect())
