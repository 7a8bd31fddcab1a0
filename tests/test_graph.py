"""Walks over an adversarial graph: a hub, reciprocal facts, a cycle, a predicate without inverse; overrides."""

import pytest

from lorekeep.operators import curate, graph
from lorekeep.plans import report

EDGES = [("a", "taught_by", "b"), ("b", "taught", "a"), ("b", "taught_by", "c"), ("c", "taught_by", "a"), ("a", "born_in", "town"), ("d", "born_in", "town"), ("c", "wrote", "w"), ("a", "knows", "hub"), ("a", "instance_of", "cat")]
EDGES += [(f"r{i}", "knows", "hub") for i in range(50)]
PREDS = [("taught_by", "was taught by", "taught", 0), ("taught", "taught", "taught_by", 0), ("born_in", "was born in", None, 1), ("wrote", "wrote", None, 0), ("knows", "knows", "knows", 2)]


@pytest.fixture(scope="module")
def kg(spark):
    ids = sorted({x for s, _, o in EDGES for x in (s, o)})
    nodes = spark.createDataFrame([(i, "class" if i == "cat" else "entity", i.upper(), n, None) for n, i in enumerate(ids)], "id string, kind string, label string, page_id long, class string")
    edges = spark.createDataFrame([(n, s, p, o) for n, (s, p, o) in enumerate(EDGES)], "eid long, s string, p string, o string")
    preds = spark.createDataFrame(PREDS, "p string, label string, inverse string, priority int")
    return nodes, edges, preds, graph.adjacency(nodes, edges, preds).cache()


def test_edge_order_and_degrees(kg, spark):
    nodes, edges, _, adj = kg
    got = graph.edges_from(adj, spark.createDataFrame([("a",)], "anchor string")).orderBy("nth").collect()
    assert [(r.dir, r.p, r.other) for r in got] == [("out", "taught_by", "b"), ("in", "taught", "b"), ("in", "taught_by", "c"), ("out", "born_in", "town"), ("out", "knows", "hub")]
    deg = {r.id: r.degree for r in graph.degrees(nodes, edges).collect()}
    assert deg["hub"] == 51 and deg["cat"] == 0 and deg["a"] == 5


def test_facts_are_told_from_the_right_end(kg, spark):
    nodes, _, preds, adj = kg
    got = [r.sentence for r in graph.facts(adj, nodes, preds, spark.createDataFrame([("town",), ("b",)], "anchor string"), 5).orderBy("anchor", "position").collect()]
    assert got == ["B taught A.", "B was taught by C.", "A was born in TOWN.", "D was born in TOWN."]


def test_walk_stops_at_hubs_seeds_and_places(kg, spark):
    nodes, edges, preds, adj = kg
    seeds = spark.createDataFrame([(1, "a")], "qid int, anchor string")
    paths = graph.walk(adj, seeds, graph.degrees(nodes, edges), preds, ["born_in"], [], hops=2).cache()
    rows = {(r.depth, r.node, tuple(r.preds)) for r in paths.collect()}
    assert (1, "hub", ("knows",)) in rows and not any(n.startswith("r") for _, n, _ in rows)
    assert not any(n == "d" for _, n, _ in rows) and (2, "w", ("taught_by", "wrote")) in rows
    assert not any(n == "a" for _, n, _ in rows)
    assert sum(1 for d, n, _ in rows if (d, n) == (1, "b")) == 1  # both statements are one fact
    best = graph.expand(paths, 3).orderBy("position").collect()
    assert [r.depth for r in best][:2] == [1, 2]
    met = graph.connect(paths, spark.createDataFrame([(1, "w")], "qid int, anchor string")).collect()
    assert len(met) == 1 and met[0].depth == 2


def test_neighbours_and_comparison(kg, spark):
    _, _, preds, adj = kg
    seeds = spark.createDataFrame([(1, "a", 1), (1, "d", 2)], "qid int, anchor string, seed_rank int")
    assert graph.neighbour_pages(adj, seeds, 2).count() == 2
    c = graph.compare(adj, spark.createDataFrame([(1, "a", "d")], "qid int, a string, b string"), preds).collect()
    assert [(r.verb, r.shared) for r in c] == [("was born in", ["TOWN"])]


def test_overrides(kg, spark):
    _, edges, _, _ = kg
    rules = spark.createDataFrame([("drop", "a", "born_in", "town"), ("drop", "r1", "knows", None), ("add", "a", "wrote", "w"), ("drop", "zz", "knows", None)], "action string, s string, p string, o string")
    out, rep = curate.apply_overrides(edges.select("s", "p", "o"), rules)
    left = {tuple(r) for r in out.collect()}
    assert ("a", "born_in", "town") not in left and ("r1", "knows", "hub") not in left and ("a", "wrote", "w") in left and len(left) == len(EDGES) - 1
    assert [r.s for r in rep.where("matches = 0").collect()] == ["zz"]
    bad = curate.invalid_rules([{"action": "add", "subject": "a", "predicate": "no", "object": None}], {"knows"})
    assert len(bad) == 3


def test_numbering_and_pages(kg, spark):
    nodes, edges, preds, _ = kg
    got = [r.id for r in curate.numbered(nodes.select("id"), "id", 1).orderBy("n").collect()]
    assert got == sorted(got)
    schema = report.schema_payload(nodes, edges, preds)
    assert ["(unclassed)", "knows", "(unclassed)", 51] in schema["rows"] and schema["unused"] == []
    page = report.html_page("a < b", report.explorer_payload(nodes, edges, 5) | {"x": "</script>"})
    assert page.count("</script>") == 1 and "a &lt; b" in page
