"""Triples: neighbours, traversals, subgraphs, paths and exports as joins.

Loops run a fixed number of rounds at most, each an equi-join of a frontier with the triples; visited nodes are left out by
an anti-join, and each round is cut to a table, so lineage stays short. Frontiers are not collected.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.config import APPEARS_IN, BROADCAST_ROWS, PATH_DEPTH, PROPERTY_PREDICATES, SUBGRAPH_DEPTH, TYPE
from marlstone.session import cut

SPO = ["subject", "predicate", "object"]


def triples(df: DataFrame) -> DataFrame:
    """All triples, as a set."""
    return df.select(SPO).dropDuplicates(SPO)


def link(quads: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore. A few new triples are looked for where the others are; only many are joined by a shuffle."""
    fresh, known = new.select(SPO).dropDuplicates(SPO), quads.select(SPO)
    side = few(fresh)
    if side is not fresh:
        known = F.broadcast(known.join(side, SPO, "left_semi").dropDuplicates(SPO))  # no more rows than fresh
    fresh = fresh.join(known, SPO, "left_anti")
    if "created_at" in quads.columns:
        fresh = fresh.withColumn("created_at", F.unix_timestamp())
    return quads.unionByName(fresh, allowMissingColumns=True)


def unlink(quads: DataFrame, gone: DataFrame) -> DataFrame:
    return quads.join(gone.select(SPO), SPO, "left_anti").select(quads.columns)


def _having(quads: DataFrame, predicate: str) -> DataFrame:
    return quads.where(F.col("predicate") == predicate) if predicate else quads


def neighbors(quads: DataFrame, node: str, predicate: str = "") -> DataFrame:
    return _having(quads, predicate).where(F.col("subject") == node).select(F.col("object").alias("node")).distinct()


def in_neighbors(quads: DataFrame, node: str, predicate: str = "") -> DataFrame:
    return _having(quads, predicate).where(F.col("object") == node).select(F.col("subject").alias("node")).distinct()


def steps_both(quads: DataFrame) -> DataFrame:
    """Each triple in both directions: (node, next, and the triple)."""
    out = quads.select(F.col("subject").alias("node"), F.col("object").alias("next"), *SPO)
    return out.unionAll(quads.select(F.col("object").alias("node"), F.col("subject").alias("next"), *SPO))


def few(frontier: DataFrame) -> DataFrame:
    """A frontier is broadcast only if a count shows it small."""
    return F.broadcast(frontier) if frontier.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frontier


@dataclass(frozen=True)
class Traversal:
    """Steps from start nodes. ``values`` dedupes the frontier at each step; ``all`` keeps the multiplicity of paths and
    returns the triples of the last step; ``echo`` writes the requested predicate there, as out and in steps may ask."""

    quads: DataFrame
    starts: tuple[str, ...] | DataFrame | None = None
    steps: tuple[tuple[str, str], ...] = ()

    def v(self, *nodes: str) -> Traversal:
        return replace(self, starts=tuple(nodes))

    def of(self, nodes: DataFrame) -> Traversal:
        return replace(self, starts=nodes)

    def out(self, predicate: str = "") -> Traversal:
        return replace(self, steps=(*self.steps, ("out", predicate)))

    def in_(self, predicate: str = "") -> Traversal:
        return replace(self, steps=(*self.steps, ("in", predicate)))

    def both(self, predicate: str = "") -> Traversal:
        return replace(self, steps=(*self.steps, ("both", predicate)))

    def _start(self) -> DataFrame:
        if self.starts is None or self.starts == ():
            raise ValueError("a traversal starts with v()")
        if isinstance(self.starts, DataFrame):
            return self.starts.select("node")
        return self.quads.sparkSession.createDataFrame([(n,) for n in self.starts], "node string")

    def _moves(self, kind: str, predicate: str) -> DataFrame:
        q = _having(self.quads, predicate)
        if kind == "out":
            return q.select(F.col("subject").alias("node"), F.col("object").alias("next"), *SPO)
        if kind == "in":
            return q.select(F.col("object").alias("node"), F.col("subject").alias("next"), *SPO)
        return steps_both(q)

    def values(self) -> DataFrame:
        at = self._start().distinct()
        for kind, predicate in self.steps:
            at = at.join(self._moves(kind, predicate), "node").select(F.col("next").alias("node")).distinct()
        return at

    def all(self, echo: bool = False) -> DataFrame:
        if not self.steps:
            self._start()
            return self.quads.select(SPO).limit(0)
        at = self._start()
        for kind, predicate in self.steps[:-1]:
            at = at.join(self._moves(kind, predicate), "node").select(F.col("next").alias("node"))
        kind, predicate = self.steps[-1]
        found = at.join(self._moves(kind, predicate), "node").select(SPO)
        return found.withColumn("predicate", F.lit(predicate)) if echo and kind != "both" else found


def traverse(quads: DataFrame) -> Traversal:
    return Traversal(quads)


def reachable(quads: DataFrame, seeds: DataFrame, depth: int = SUBGRAPH_DEPTH, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(node, depth) of all nodes within ``depth`` undirected steps of the seeds, the seeds at 0."""
    moves = steps_both(quads.where(~F.col("predicate").isin(*exclude)) if exclude else quads).select("node", "next")
    seen = frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    for d in range(1, depth + 1):
        reached = moves.join(few(frontier.select("node")), "node").select(F.col("next").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def subgraph(quads: DataFrame, seeds: DataFrame, depth: int = SUBGRAPH_DEPTH, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Distinct triples that a breadth-first walk of ``depth`` steps crosses, in either direction."""
    depth = max(depth, 1)
    inner = cut(reachable(quads, seeds, depth - 1, exclude).select("node"), "inner")
    kept = quads.where(~F.col("predicate").isin(*exclude)) if exclude else quads
    return steps_both(kept).join(few(inner), "node").select(SPO).dropDuplicates(SPO)


def subgraph_of_each(quads: DataFrame, seeds: DataFrame, depth: int = SUBGRAPH_DEPTH) -> DataFrame:
    """(seed and triple) of each seed's own subgraph, in one walk of all seeds."""
    moves = steps_both(quads)
    seen = frontier = cut(seeds.select(F.col("node").alias("seed"), "node").distinct(), "frontier")
    found = None
    for _ in range(max(depth, 1)):
        crossed = cut(moves.join(few(frontier), "node").select("seed", "next", *SPO), "crossed")
        found = crossed if found is None else found.unionByName(crossed)
        frontier = cut(crossed.select("seed", F.col("next").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return found.select("seed", *SPO).distinct()


def nodes_of(found: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Distinct entities of triples, and the seeds even if nothing knows them."""
    out = found.select(F.explode(F.array("subject", "object")).alias("node"))
    return (out if seeds is None else out.unionByName(seeds.select("node"))).distinct()


def related(quads: DataFrame, seeds: DataFrame, depth: int = SUBGRAPH_DEPTH, exclude: tuple[str, ...] = PROPERTY_PREDICATES) -> DataFrame:
    """Entities within reach that have an edge; property edges are not walked unless asked for."""
    near = reachable(quads, seeds, depth, exclude)
    return near.join(steps_both(quads).select("node").distinct(), "node", "left_semi")


def find_path(quads: DataFrame, start: str, goal: str, max_depth: int = PATH_DEPTH, predicate: str = "") -> DataFrame:
    """The shortest directed path of at most ``max_depth`` nodes, the first by node order of the shortest; or no row."""
    spark: SparkSession = quads.sparkSession
    if start == goal:
        return spark.createDataFrame([([start],)], "path array<string>")
    moves = _having(quads, predicate).select(F.col("subject").alias("node"), F.col("object").alias("next")).distinct()
    seen = frontier = cut(spark.createDataFrame([(start, [start])], "node string, path array<string>"), "paths")
    for _ in range(max(max_depth or PATH_DEPTH, 1) - 1):
        grown = moves.join(few(frontier), "node").select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        fresh = grown.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        frontier = cut(fresh, "paths")
        hit = frontier.where(F.col("node") == goal).select("path")
        if not hit.isEmpty():
            return hit
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select("path").limit(0)


def all_paths(quads: DataFrame, start: str, goal: str, max_depth: int = PATH_DEPTH, predicate: str = "", cap: int = 100) -> DataFrame:
    """Simple directed paths of at most ``max_depth`` nodes, the shortest ``cap``. The walk is bounded by depth alone."""
    spark = quads.sparkSession
    moves = _having(quads, predicate).select(F.col("subject").alias("node"), F.col("object").alias("next")).distinct()
    frontier, found = spark.createDataFrame([(start, [start])], "node string, path array<string>"), None
    for _ in range(max_depth - 1):
        grown = frontier.where(F.col("node") != goal).join(moves, "node").where(~F.array_contains("path", F.col("next")))
        frontier = cut(grown.select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path")), "paths")
        hit = frontier.where(F.col("node") == goal).select("path")
        found = hit if found is None else found.unionByName(hit)
        if frontier.isEmpty():
            break
    return (found if found is not None else frontier.select("path").limit(0)).orderBy(F.size("path"), "path").limit(cap)


def degrees(quads: DataFrame) -> DataFrame:
    """node, out_degree, in_degree: distinct neighbours each way."""
    out = quads.groupBy(F.col("subject").alias("node")).agg(F.count_distinct("object").alias("out_degree"))
    into = quads.groupBy(F.col("object").alias("node")).agg(F.count_distinct("subject").alias("in_degree"))
    return out.join(into, "node", "full").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def entities(quads: DataFrame, order: str | None = None) -> DataFrame:
    """Entities with type and description from their property edges; of several the last by ``order``, else the largest."""
    by = F.col(order) if order else F.col("object")
    is_ = lambda p: F.max_by(F.when(F.col("predicate") == p, F.col("object")), F.when(F.col("predicate") == p, by))
    return quads.groupBy(F.col("subject").alias("name")).agg(F.coalesce(is_(TYPE), F.lit("")).alias("type"), F.coalesce(is_("DESCRIPTION"), F.lit("")).alias("description"))


def entities_of(quads: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct entities that appear in the documents (column id)."""
    seen = quads.where(F.col("predicate") == APPEARS_IN)
    return seen.join(docs.select(F.col("id").alias("object")), "object", "left_semi").select(F.col("subject").alias("node")).distinct()


def documents_of(quads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, id) of the documents in which the entities appear."""
    return quads.where(F.col("predicate") == APPEARS_IN).select(F.col("subject").alias("node"), F.col("object").alias("id")).distinct().join(nodes.select("node").distinct(), "node")


def appears_count(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("predicate") == APPEARS_IN).agg(F.count(F.lit(1)).alias("n"))


def export_graph(quads: DataFrame, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities, and relationships between them; of some documents only, both endpoints must appear there."""
    rels = quads.where(~F.col("predicate").isin(*PROPERTY_PREDICATES)).select(F.col("subject").alias("source"), F.col("predicate").alias("relation"), F.col("object").alias("target"))
    named = entities(quads)
    ends = rels.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    known = named.join(ends, "name", "full").select("name", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("description", F.lit("")).alias("description"))
    if docs is None:
        return known, rels
    allowed = entities_of(quads, docs)
    for end in ("source", "target"):
        rels = rels.join(allowed.select(F.col("node").alias(end)), end, "left_semi")
    return known.join(allowed.select(F.col("node").alias("name")), "name", "left_semi"), rels.select("source", "relation", "target")


def from_extraction(replies: DataFrame, default_relation: str = "") -> DataFrame:
    """Triples of model replies (id, reply): appearances, types, descriptions and relations. Blank parts are left out,
    or a blank relation gets the default. A reply without JSON gives none."""
    from marlstone.functions.text import json_slice
    from marlstone.schemas import GRAPH

    g = replies.select("id", F.from_json(json_slice(F.col("reply")), GRAPH).alias("g"))
    e = g.select("id", F.explode("g.entities").alias("e")).where("trim(coalesce(e.name, '')) != ''")
    r = g.select(F.explode("g.relationships").alias("r")).withColumn("rel", F.coalesce(F.when(F.trim("r.relation") != "", F.col("r.relation")), F.lit(default_relation)))
    parts = [
        e.select(F.col("e.name").alias("subject"), F.lit(APPEARS_IN).alias("predicate"), F.col("id").alias("object")),
        e.select(F.col("e.name").alias("subject"), F.lit(TYPE).alias("predicate"), F.col("e.type").alias("object")),
        e.select(F.col("e.name").alias("subject"), F.lit("DESCRIPTION").alias("predicate"), F.col("e.description").alias("object")),
        r.select(F.col("r.source").alias("subject"), F.col("rel").alias("predicate"), F.col("r.target").alias("object")),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    filled = [F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in SPO]
    return found.where(filled[0] & filled[1] & filled[2]).dropDuplicates(SPO)


def extraction_stats(replies: DataFrame) -> DataFrame:
    """One row: total, success, failure, entities, relations, success_rate."""
    from marlstone.functions.text import json_slice
    from marlstone.schemas import GRAPH

    g = replies.select(F.from_json(json_slice(F.col("reply")), GRAPH).alias("g"))
    ok = F.col("g.entities").isNotNull() | F.col("g.relationships").isNotNull()
    n = g.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("success"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failure"), F.coalesce(F.sum(F.greatest(F.size("g.entities"), F.lit(0))), F.lit(0)).alias("entities"), F.coalesce(F.sum(F.greatest(F.size("g.relationships"), F.lit(0))), F.lit(0)).alias("relations"))
    return n.withColumn("success_rate", F.coalesce(F.try_divide("success", "total"), F.lit(0.0)))


def rates(stats: DataFrame, seconds: float, serial_seconds: float | None = None) -> DataFrame:
    """Derived throughput (documents a second), mean milliseconds a document, and speed-up over a serial run."""
    s = F.lit(float(seconds))
    out = stats.withColumns({"per_second": F.coalesce(F.try_divide(F.col("total"), s), F.lit(0.0)), "mean_ms": F.coalesce(F.try_divide(s * 1000, F.col("total")), F.lit(0.0))})
    return out.withColumn("speedup", F.try_divide(F.lit(float(serial_seconds)), s)) if serial_seconds is not None else out


def view(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of triples, for drawing."""
    return nodes_of(found).select(F.col("node").alias("id")), found.select(F.col("subject").alias("source"), F.col("predicate").alias("label"), F.col("object").alias("target")).distinct()


def view_paths(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and consecutive links of paths."""
    nodes = paths.select(F.explode("path").alias("id")).distinct()
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("source"), F.element_at("path", i + 1).alias("target")))
    return nodes, paths.where(F.size("path") > 1).select(F.explode(pairs).alias("p")).select("p.source", "p.target").distinct()
