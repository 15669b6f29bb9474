import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marlstone.operators import graph, gremlin


def quads(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], "subject string, predicate string, object string")


def nodes(df):
    return sorted(r["node"] for r in df.collect())


@pytest.fixture(scope="module")
def chain(spark):
    return quads(spark, [("user1", "follows", "user2"), ("user2", "follows", "user3")])


def test_chain(spark, chain):
    assert nodes(graph.neighbors(chain, "user1", "follows")) == ["user2"]
    assert nodes(graph.in_neighbors(chain, "user2", "follows")) == ["user1"]
    assert [r["path"] for r in graph.find_path(chain, "user1", "user3").collect()] == [["user1", "user2", "user3"]]
    left = graph.unlink(chain, quads(spark, [("user1", "follows", "user2")]))
    assert nodes(graph.neighbors(left, "user1")) == []
    assert graph.link(chain, quads(spark, [("user1", "follows", "user2"), ("a", "b", "c"), ("a", "b", "c")])).count() == 3


def test_predicates(spark):
    q = quads(spark, [("alice", "follows", "bob"), ("alice", "likes", "bob"), ("alice", "follows", "charlie")])
    assert len(nodes(graph.neighbors(q, "alice", "follows"))) == 2
    assert nodes(graph.neighbors(q, "alice", "likes")) == ["bob"]
    assert nodes(graph.neighbors(q, "alice")) == ["bob", "charlie"]


def test_traversal(spark):
    q = quads(spark, [("A", "next", "B"), ("B", "next", "C"), ("C", "next", "D")])
    t = graph.traverse(q).v("A").out("next").out("next")
    assert nodes(t.values()) == ["C"]
    assert [tuple(r) for r in t.all().collect()] == [("B", "next", "C")]
    assert graph.traverse(q).v("A").all().count() == 0
    with pytest.raises(ValueError):
        graph.traverse(q).out().values()
    assert [r["predicate"] for r in graph.traverse(q).v("A").out().all(echo=True).collect()] == [""]


def test_gremlin(spark):
    q = quads(spark, [("A", "next", "B"), ("B", "next", "C")])
    assert nodes(gremlin.run(q, "V('A').Out('next').Out('next')")) == ["B"]
    assert nodes(gremlin.run(q, 'g.V("A").Out("next").Out()', None)) == ["C"]
    assert nodes(gremlin.run(q, "V('C').In('next')")) == ["B"]
    with pytest.raises(ValueError):
        gremlin.parse("Out('x')")


def test_cycles_and_paths(spark):
    q = quads(spark, [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("a", "p", "c")])
    one = spark.createDataFrame([("a",)], "node string")
    assert graph.subgraph(q, one, 5).count() == 4
    assert [r["path"] for r in graph.find_path(q, "a", "c").collect()] == [["a", "c"]]
    assert [r["path"] for r in graph.find_path(q, "a", "a").collect()] == [["a"]]
    assert graph.find_path(q, "a", "nowhere").count() == 0
    assert [r["path"] for r in graph.all_paths(q, "a", "c", 4).collect()] == [["a", "c"], ["a", "b", "c"]]
    assert {(r["node"], r["out_degree"], r["in_degree"]) for r in graph.degrees(q).collect()} == {("a", 2, 1), ("b", 1, 1), ("c", 1, 2)}


edge = st.tuples(st.sampled_from("abcdef"), st.sampled_from(["p", "q"]), st.sampled_from("abcdef"))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(edge, min_size=1, max_size=10), st.integers(1, 3))
def test_subgraph_is_breadth_first(spark, edges, depth):
    want, seen, level = set(), {"a"}, {"a"}
    for _ in range(depth):
        hit = [e for e in edges if e[0] in level or e[2] in level]
        want |= set(hit)
        level = {x for e in hit for x in (e[0], e[2])} - seen
        seen |= level
    got = graph.subgraph(quads(spark, edges), spark.createDataFrame([("a",)], "node string"), depth)
    assert {tuple(r) for r in got.collect()} == want


def test_extraction_and_export(spark):
    reply = 'x {"entities": [{"name": "E", "type": "T", "description": "D"}, {"name": " "}], "relationships": [{"source": "E", "target": "F", "relation": "R"}, {"source": "E", "target": "G", "relation": ""}]} y'
    replies = spark.createDataFrame([("d1", reply), ("d2", "not a json {")], "id string, reply string")
    got = {tuple(r) for r in graph.from_extraction(replies).collect()}
    assert got == {("E", "APPEARS_IN", "d1"), ("E", "TYPE", "T"), ("E", "DESCRIPTION", "D"), ("E", "R", "F")}
    assert ("E", "RELATED_TO", "G") in {tuple(r) for r in graph.from_extraction(replies, "RELATED_TO").collect()}
    s = graph.extraction_stats(replies).first()
    assert (s["total"], s["success"], s["failure"], s["entities"], s["relations"], s["success_rate"]) == (2, 1, 1, 2, 2, 0.5)
    assert graph.rates(graph.extraction_stats(replies), 4.0, 8.0).first()["speedup"] == 2.0
    q = quads(spark, got)
    known, rels = graph.export_graph(q)
    assert {r["name"]: r["type"] for r in known.collect()} == {"E": "T", "F": ""}
    assert [tuple(r) for r in rels.collect()] == [("E", "R", "F")]
    docs = spark.createDataFrame([("d1",)], "id string")
    assert graph.export_graph(q, docs)[1].count() == 0  # F appears nowhere
    assert graph.appears_count(q).first()["n"] == 1
    n, links = graph.view_paths(graph.find_path(q, "E", "F"))
    assert n.count() == 2 and links.count() == 1 and graph.view(q)[1].count() == 4


def test_few_new_triples_shuffle_no_others(spark):
    quads = spark.createDataFrame([("a", "P", "b"), ("a", "P", "c"), (None, "P", "c")], "subject string, predicate string, object string").repartition(3)
    new = spark.createDataFrame([("a", "P", "c"), ("a", "P", "c"), ("x", "P", "y"), ("x", "P", "y"), (None, "P", "c")], quads.schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        linked = graph.link(quads, new)
        assert sorted(map(repr, map(tuple, linked.collect()))) == sorted(map(repr, [("a", "P", "b"), ("a", "P", "c"), (None, "P", "c"), (None, "P", "c"), ("x", "P", "y")]))
        assert "SortMergeJoin" not in linked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_triples_are_a_table_before_they_are_unlinked(spark, sf):
    from marlstone.plans.catalogue import QUERIES

    plan = QUERIES["graph_link_unlink"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "orders" not in plan and "o_orderkey" not in plan
