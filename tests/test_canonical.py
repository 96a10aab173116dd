import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomgraph.functions.hashing import hash_fraction
from loomgraph.functions.paths import is_learner_test_scoped, is_test_scoped, parent_directory, path_tail
from loomgraph.operators import canonical as ops
from loomgraph.plans import warehouse
from loomgraph.schema import CONCEPTS, FILES


def modules(*names):
    return [(n, "module", n) for n in names]


def test_centrality_counts_callers_not_calls(graph):
    nodes, edges = graph(
        modules("m") + [(f"m.{n}", "function", "m") for n in ("noisy", "a", "b", "c", "helper", "util")],
        [("m.noisy", "m.helper", "call", True, n) for n in range(5)]
        + [(f"m.{n}", "m.util", "call", n == "a", 1) for n in "abc"]
        + [("m.util", "m.util", "call", True, 9), ("gone", "m.helper", "call", False, 2), ("m.a", "m.util", "import", True, 3)])
    found = dict(rows(ops.centrality(nodes, edges), "id", "centrality"))
    assert found["m.helper"] == 2 and found["m.util"] == 4 and found["m.a"] == 0


def test_pair_is_certain_if_any_and_route_only_if_all(graph):
    nodes, edges = graph(
        modules("a", "b") + [("a.f", "function", "a"), ("b.g", "function", "b")],
        [("a.f", "b.g", "call", True, 1), ("a.f", "b.g", "call", False, 2), ("a", "b", "import", True, 1),
         ("a", "b", "import", False, 2), ("a", "external:os", "import", True, 3, True), ("a", "a", "import", True, 4)])
    assert rows(ops.call_pairs(nodes, edges), "src", "dst", "certain") == [("a.f", "b.g", True)]
    assert rows(ops.region_edges(nodes, edges), "src", "dst", "weight", "certain") == [("a", "b", 2, False)]


def test_home_prefers_source_then_rank_and_is_null_on_a_tie(graph, spark):
    first, _ = graph([("t.x", "module", "t.x", "tests/x.py", 0), ("s.y", "module", "s.y", "src/y.py", 0)], project="source")
    second, _ = graph([("t.x", "module", "t.x", "tests/x.py", 0)], project="all tests")
    third, _ = graph([("a", "module", "a", "a.py", 1), ("b", "module", "b", "b.py", 1)], project="tie")
    fourth, _ = graph([("a", "module", "a", "a.py")], project="none")
    nodes = first.unionByName(second).unionByName(third).unionByName(fourth)
    assert rows(ops.home_select(nodes)) == [("all tests", "t.x"), ("source", "s.y"), ("tie", None)]
    choice = spark.createDataFrame([("tie", "b")], "project string, id string")
    assert ("tie", "b") in rows(ops.home_select(nodes, choice))
    with pytest.raises(Exception, match="not a ranked candidate"):
        ops.home_select(nodes, spark.createDataFrame([("tie", "zzz")], "project string, id string")).collect()


def test_compose_refuses_duplicates(graph, spark):
    one, _ = graph(modules("a"))
    two, _ = graph(modules("b"))
    assert len(rows(ops.compose_nodes([one, two]))) == 2
    with pytest.raises(Exception, match="duplicate node id"):
        ops.compose_nodes([one, one]).collect()
    files = spark.createDataFrame([("p", "f.py", "python", "1"), ("p", "f.py", "python", "2")],
                                  "project string, file string, language string, sha256 string")
    with pytest.raises(Exception, match="conflicting content"):
        ops.compose_files([files]).collect()


def test_rollup_falls_back_to_all_members(graph):
    nodes, edges = graph([("r", "module", "r", "r.py", None, False, 10), ("r.f", "function", "r", "r.py", None, False, 4),
                          ("q.f", "function", "q", "q.py", None, False, 4), ("q.g", "function", "q", "q.py", None, False, 5)])
    found = ops.region_rollup(nodes, ops.centrality(nodes, edges), ops.home_select(nodes))
    assert rows(found, "region", "loc", "node_count", "home") == [("q", 9, 2, False), ("r", 10, 2, False)]


def test_path_rules(spark):
    cases = ["tests/a.py", "a/testing/b.py", "test_a.py", "a_test.go", "conftest.py", "specs/a.py", "tests.py", "a/contest.py"]
    df = spark.createDataFrame([(c,) for c in cases], "f string")
    found = {r.f: (r.g, r.l) for r in df.select("f", is_test_scoped(F.col("f")).alias("g"), is_learner_test_scoped(F.col("f")).alias("l")).collect()}
    assert [found[c] for c in cases] == [
        (True, True), (True, False), (True, False), (True, False), (True, False), (False, True), (False, False), (False, False)]
    tails = df.select(path_tail(F.col("f")), parent_directory(F.col("f"))).collect()
    assert tuple(tails[1]) == ("testing/b.py", "a/testing") and tuple(tails[2]) == ("test_a.py", ".")


def test_hash_fraction_matches_a_direct_computation(spark):
    import hashlib

    got = spark.createDataFrame([("alpha",)], "id string").select(hash_fraction(F.col("id"), "salt")).first()[0]
    want = int.from_bytes(hashlib.sha256(b"salt:alpha").digest()[:8], "big") / float((1 << 64) - 1)
    assert got == want


def test_language_focus_keeps_boxes_by_their_own_language(graph, spark):
    from loomgraph.operators import analytics, reporting

    nodes, edges = graph(
        [("a", "module", "a", "a.py", 0), ("a.t", "function", "a", "a.ts"), ("b", "module", "b", "b.py", None, True), ("c", "module", "c", "c.ts", 1)],
        [("a", "b", "import", True), ("a", "c", "import", True), ("b", "c", "import", True)])
    nodes = nodes.withColumn("language", F.when(F.col("file").endswith(".ts"), "typescript").otherwise("python"))
    homes = ops.home_select(nodes)
    regions, routes = ops.region_rollup(nodes, ops.centrality(nodes, edges), homes), ops.region_edges(nodes, edges)
    boxes = analytics.import_layers(regions, routes, analytics.components(routes))
    # A region that holds a node of the language is kept in the graph, a box only if it is itself of the language.
    assert rows(reporting.focus_regions(boxes, nodes, "typescript"), "region") == [("a",), ("c",)]
    assert rows(reporting.focus_boxes(boxes, regions, "typescript"), "region") == [("c",)]
    assert rows(reporting.focus_box_edges(routes, regions, "python"), "src", "dst") == [("a", "b")]
    assert rows(reporting.focus_candidates(ops.candidates(nodes).select("project", "id"), nodes, "typescript"), "id") == [("c",)]
    assert rows(reporting.focus_home(homes, nodes, "python"), "home") == [("a",)] and rows(reporting.focus_home(homes, nodes, "go"), "home") == [(None,)]
    assert rows(reporting.focus_files(reporting.partial_files(nodes), nodes, "python"), "file") == [("b.py",)]
    flow = analytics.workflow(nodes, edges, homes)
    assert rows(reporting.focus_rows(flow, nodes, "typescript"), "id", "parent") == [("a.t", "a")]
    assert rows(reporting.focus_rows(analytics.unreached_nodes(nodes, flow), nodes, "typescript"), "id") == [("c",)]


def test_graphs_of_languages_are_composed_whole(graph, spark):
    nodes, edges = graph([("a", "module", "a"), ("b", "module", "b", "b.py", None, True)], [("a", "b", "import", True), ("a", "b", "import", True)])
    concepts = spark.createDataFrame([("p", "a", "python", "decorator", 1, 1, "x")] * 2, CONCEPTS)
    files = spark.createDataFrame([("p", f, "python", f) for f in ("a.py", "b.py")], FILES)
    partial = nodes.where("partial").select("project", "file")
    one = ops.Graph(nodes.where("id = 'a'"), edges, concepts, files, partial)
    two = ops.Graph(nodes.where("id = 'b'"), edges, concepts, files.where("file = 'b.py'"), partial)
    whole = ops.compose([one, two])
    assert [t.count() for t in (whole.nodes, whole.edges, whole.concepts, whole.files, whole.partial_files)] == [2, 1, 1, 2, 1]
    tally = spark.createDataFrame([("p", ".c", "C", 2), ("p", ".h", None, 1)], "project string, ext string, language string, count bigint")
    assert rows(ops.compose_unsupported([tally, tally])) == [("p", ".c", "C", 4), ("p", ".h", None, 2)]
    with pytest.raises(Exception, match="duplicate node id"):
        ops.compose([one, one]).nodes.collect()


def test_queries_build_only_the_kinds_of_edges_they_read(spark, monkeypatch):
    """Imports alone give region edges; what needs no centrality needs no edges; the two kinds add up to all edges."""
    monkeypatch.setattr(warehouse, "_BUILT", {})
    folder = "/root/testdata/sf0.001"
    w = warehouse.Warehouse(spark, folder)
    w.visited.count()
    assert not {"imports", "calls", "raw_imports", "raw_calls"} & set(w._tables)
    w.hops.count()
    assert not {"calls", "raw_calls"} & set(w._tables)
    w.layers.count()
    assert "calls" not in w._tables
    assert {r.kind for r in w.imports.select("kind").distinct().toLocalIterator()} == {"import"}
    assert rows(w.edges) == rows(ops.dedup_edges(w.raw_edges))
    assert rows(w.outline) == rows(w.regions.select(*w.outline.columns))
