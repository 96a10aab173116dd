import random

import pytest
from pyspark.sql import functions as F
from conftest import rows

from loomgraph.operators import analytics as ops
from loomgraph.operators import canonical
from loomgraph.plans.ranking import ordered_index


def chain(graph, names, certain=()):
    nodes = [(n, "module", n) for n in names]
    edges = [(a, b, "call", (a, b) not in certain) for a, b in zip(names, names[1:])]
    return graph(nodes, edges)


def starts(nodes, *ids):
    return nodes.where(nodes.id.isin(*ids)).select("project", "id")


def reach(df, start, direction):
    return {r.node: (r.depth, r.certain) for r in df.collect() if r.start == start and r.direction == direction}


def test_reach_and_certainty(graph):
    nodes, edges = graph(
        [(n, "module", n) for n in "abcd"],
        [("a", "c", "call", False), ("a", "b", "call", True), ("b", "c", "call", True), ("c", "d", "import", False),
         ("a", "external:x", "call", True, 1, True), ("c", "a", "call", True)])
    found = ops.blast_radius(starts(nodes, "a", "c"), nodes, edges)
    assert reach(found, "a", "depends_on") == {"c": (1, True), "b": (1, True), "d": (2, False)}
    assert reach(found, "c", "affects") == {"a": (1, True), "b": (1, True)}


def test_cap_is_reported(graph):
    nodes, edges = chain(graph, list("abcdef"))
    found = ops.blast_radius(starts(nodes, "a", "e"), nodes, edges, 2)
    assert reach(found, "a", "depends_on") == {"b": (1, True), "c": (2, True)}
    assert {r.start: r.truncated for r in found.collect()} == {"a": True, "e": True}
    whole = ops.blast_radius(starts(nodes, "a"), nodes, edges, 5)
    assert not any(r.truncated for r in whole.collect())


def regions_of(nodes, edges):
    return (canonical.region_rollup(nodes, canonical.centrality(nodes, edges), canonical.home_select(nodes)),
            canonical.region_edges(nodes, edges))


def test_hops_and_rehome(graph, spark):
    nodes, edges = graph(
        [("app", "module", "app", "app.py", 0), ("far", "module", "far", "far.py", 1)] + [(n, "module", n) for n in ("mid", "side", "island")],
        [("app", "mid", "import", True), ("mid", "far", "import", True), ("side", "app", "import", True)])
    regions, routes = regions_of(nodes, edges)
    assert rows(ops.hops(regions, routes), "region", "hops") == [("app", 0), ("far", 2), ("island", None), ("mid", 1), ("side", 1)]
    choice = spark.createDataFrame([("p", "far")], "project string, id string")
    moved = ops.rehome(choice, nodes, regions, routes)
    assert rows(moved, "region", "hops", "home") == [
        ("app", 2, False), ("far", 0, True), ("island", None, False), ("mid", 1, False), ("side", 3, False)]
    with pytest.raises(Exception, match="not a ranked candidate"):
        ops.rehome(spark.createDataFrame([("p", "mid")], "project string, id string"), nodes, regions, routes).collect()


def test_two_cliques_are_two_communities(graph):
    names = ["a0", "a1", "a2", "b0", "b1", "b2", "z"]
    links = [("a0", "a1"), ("a1", "a2"), ("a0", "a2"), ("b0", "b1"), ("b1", "b2"), ("b0", "b2"), ("a2", "b0")]
    nodes, edges = graph([(n, "module", n) for n in names], [(a, b, "import", True) for a, b in links])
    regions, routes = regions_of(nodes, edges)
    found = dict(rows(ops.communities(regions, routes), "region", "community"))
    assert found == {"a0": 0, "a1": 0, "a2": 0, "b0": 1, "b1": 1, "b2": 1, "z": 2}
    sizes = rows(ops.families(ops.communities(regions, routes)), "community", "size", "family")
    assert sizes == [(0, 3, 0), (1, 3, 1), (2, 1, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_are_those_of_synchronous_rounds_and_fewer_vote(spark, monkeypatch, seed):
    picks = random.Random(seed)
    names = [f"n{i:02d}" for i in range(40)]
    links = {(a, b) for a, b in ((picks.choice(names), picks.choice(names)) for _ in range(70)) if a != b}
    links |= {(b, a) for a, b in links}
    near = {}
    for a, b in sorted(links):
        near.setdefault(a, []).append(b)
    labels = {a: a for a in near}
    for _ in range(ops.LABEL_ROUNDS):
        votes = {a: {} for a in near}
        for a in near:
            for b in near[a]:
                votes[a][labels[b]] = votes[a].get(labels[b], 0) + 1
        labels = {a: min(v, key=lambda x: (-v[x], x)) for a, v in votes.items()}
    voters, write = [], ops.cut

    def cut(df, label="step"):
        table = write(df, label)
        if label == "voters":
            voters.append(table.count())
        return table

    monkeypatch.setattr(ops, "cut", cut)
    pairs = spark.createDataFrame([("p", a, b) for a, b in links], "project string, a string, b string")
    assert dict(rows(ops.propagate_labels(pairs), "region", "label")) == labels
    assert voters[-1] < len(links)


def test_call_layers(graph):
    members = [("m", "module", "m")] + [(f"m.{n}", "function", "m") for n in ("root", "deep", "maybe", "x", "y")]
    nodes, edges = graph(members, [
        ("m.root", "m.deep", "call", True), ("m.root", "m.maybe", "call", False), ("m.x", "m.y", "call", True),
        ("m.y", "m.x", "call", True), ("m.deep", "m.deep", "call", True)])
    found = {r.id: (r.ring, r.call_depth, r.kind) for r in ops.call_layers(nodes, edges).collect()}
    assert found == {
        "m": (0, 0, "origin"), "m.root": (1, 1, "call-root"), "m.maybe": (1, 1, "call-root"), "m.deep": (2, 2, "certain-call"),
        "m.x": (3, None, "unreached"), "m.y": (3, None, "unreached")}
    plan = rows(ops.orbit_plan(ops.call_layers(nodes, edges)), "ring", "call_depth", "label")
    assert plan == [(1, 1, "Layer 1"), (2, 2, "Layer 2"), (3, None, "No proven path")]


def brute_components(names, links):
    after = {n: {n} for n in names}
    for _ in names:
        for a, b in links:
            after[a] |= after[b]
    return {n: min(m for m in names if m in after[n] and n in after[m]) for n in names}, after


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles_and_layers_against_brute_force(graph, seed):
    picks = random.Random(seed)
    names = [f"n{i:02d}" for i in range(18)]
    links = sorted({(a, b) for a, b in ((picks.choice(names), picks.choice(names)) for _ in range(26)) if a != b})
    nodes, edges = graph([(n, "module", n) for n in names], [(a, b, "import", True) for a, b in links])
    regions, routes = regions_of(nodes, edges)
    membership = ops.components(routes)
    component, after = brute_components(names, links)
    inside = {(r.src, r.dst): r.in_cycle for r in ops.import_cycles(routes, membership).collect()}
    assert inside == {(a, b): component[a] == component[b] for a, b in links}
    # No home: longest path over components from those nothing imports.
    crossing = {(component[a], component[b]) for a, b in links if component[a] != component[b]}
    layer = {c: 0 for c in component.values() if not any(b == c for _, b in crossing)}
    for _ in names:
        for a, b in crossing:
            if a in layer:
                layer[b] = max(layer.get(b, 0), layer[a] + 1)
    found = {r.region: (r.layer, r.reachable) for r in ops.import_layers(regions, routes, membership).collect()}
    assert found == {n: (layer[component[n]], True) for n in names}


def linked(spark, links):
    return spark.createDataFrame([("p", a, b) for a, b in links], "project string, src string, dst string")


def counting(monkeypatch, *labels):
    """Counts the tables that a loop writes under the given names."""
    seen = dict.fromkeys(labels, 0)
    write = ops.cut

    def cut(df, label="step"):
        seen[label] = seen.get(label, 0) + 1
        return write(df, label)

    monkeypatch.setattr(ops, "cut", cut)
    return seen


def test_long_chains_and_rings_end_in_logarithmic_rounds(spark, monkeypatch):
    names = [f"n{i:04d}" for i in range(1000)]
    random.Random(3).shuffle(names)
    seen = counting(monkeypatch, "jumped", "offers")
    assert ops.components(linked(spark, list(zip(names, names[1:])))).count() == 0
    # 1,000 is 2^10: about a round for each doubling.
    assert seen["jumped"] <= 14 and seen["offers"] == 0
    ring = [n for n in names if n < "n0016"]
    found = ops.components(linked(spark, list(zip(ring, ring[1:] + ring[:1]))))
    assert rows(found.select("component").distinct()) == [("n0000",)] and found.count() == 16
    assert seen["offers"] <= 2 * 7


def test_rings_end_in_logarithmic_rounds_whatever_the_order_of_their_ids(spark, monkeypatch):
    names = [f"n{i:03d}" for i in range(200)]
    # Against the links, the least id would travel the whole ring; a chain hangs from it, and leads to a node of two predecessors.
    links = [(b, a) for a, b in zip(names, names[1:] + names[:1])] + [("n100", "x0"), ("x0", "x1"), ("x1", "z"), ("n050", "z")]
    seen = counting(monkeypatch, "jumped", "offers")
    found = dict(rows(ops.least_reaching(linked(spark, links)), "id", "label"))
    assert found == dict.fromkeys([*names, "x0", "x1", "z"], "n000")
    assert seen["jumped"] <= 10 and seen["offers"] <= 2


def test_least_reaching_is_that_of_brute_force(spark):
    for seed in (4, 5):
        picks = random.Random(seed)
        names = [f"n{i:02d}" for i in range(30)]
        links = sorted({(a, b) for a, b in ((picks.choice(names), picks.choice(names)) for _ in range(36)) if a != b})
        least = {n: n for n in {n for link in links for n in link}}
        for _ in names:
            for a, b in links:
                least[b] = min(least[a], least[b])
        assert dict(rows(ops.least_reaching(linked(spark, links)), "id", "label")) == least


def test_label_rounds_write_numbers_and_not_ids(spark, monkeypatch):
    written, write = {}, ops.cut

    def cut(df, label="step"):
        written.setdefault(label, []).append(df.dtypes)
        return write(df, label)

    monkeypatch.setattr(ops, "cut", cut)
    names = [f"n{i}" for i in range(9)]
    pairs = [(a, b) for a, b in zip(names, names[1:])]
    found = ops.propagate_labels(spark.createDataFrame([("p", a, b) for a, b in pairs + [(b, a) for a, b in pairs]], "project string, a string, b string"))
    assert found.count() == 9 and len(written["labels"]) > 1
    assert {kind for label in ("links", "labels", "voters") for table in written[label] for _, kind in table} <= {"bigint", "boolean"}


def test_a_star_leaves_no_hot_task(spark, graph):
    from loomgraph.operators.resolve import split_join

    pairs = spark.range(100_000).selectExpr("id + 1 AS src", "0L AS dst", "true AS certain").union(spark.createDataFrame([(0, -1, True)], "src long, dst long, certain boolean"))
    outbound = ops.cut(ops._adjacency(pairs, "src", "dst"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # All have come to the middle, which goes on to one.
        frontier = ops.cut(spark.range(100_000).selectExpr("id + 1 AS start", "0L AS node", "true AS proven"))
        for rows_, links in ((frontier, outbound), (ops.cut(frontier.limit(1)), ops.cut(ops._adjacency(pairs.where("dst = 0"), "dst", "src")))):
            sizes = sorted(r["count"] for r in split_join(rows_, links, ["node"], written=True).groupBy(F.spark_partition_id()).count().collect())
            assert sum(sizes) == 100_000 and len(sizes) == 16 and sizes[-1] <= 3 * sizes[8]
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    reached, short = ops.walk(spark.createDataFrame([(5,), (6,)], "start long"), outbound, 3)
    assert rows(reached, "start", "node", "depth") == [(5, -1, 2), (5, 0, 1), (6, -1, 2), (6, 0, 1)] and short.count() == 0


def test_blast_from_all_nodes_is_that_from_each(graph):
    picks = random.Random(8)
    names = [f"n{i:02d}" for i in range(14)]
    nodes, edges = graph([(n, "module", n) for n in names], [
        (picks.choice(names), picks.choice(names), "call", picks.random() < 0.5, i) for i in range(22)])
    each = ops.blast_radius(nodes.select("project", "id"), nodes, edges)
    everywhere = ops.blast_radius_all(nodes, edges)
    assert rows(each) == rows(everywhere.select(*each.columns))
    summary = each.groupBy("project", "start", "direction", "depth", "certain", "truncated").agg(
        F.count("*").alias("reached"), F.min("node").alias("first_node"), F.max("node").alias("last_node"))
    assert rows(summary) == rows(ops.blast_summary_all(nodes, edges))


def test_intervals_hold_those_of_all_descendants(spark, monkeypatch):
    picks = random.Random(4)
    parent = {"q": None, "r": None}
    for i in range(24):
        parent[f"n{i:02d}"] = picks.choice(sorted(parent)) if i % 2 else list(parent)[-1]
    seen = counting(monkeypatch, "intervals")
    spans = {r.id: (r.entry, r.exit) for r in ops.tree_intervals(spark.createDataFrame(
        [("p" if n != "q" else "o", n, u) for n, u in parent.items() if u != "q"], "project string, id string, parent string")).collect()}

    def above(n):
        return [] if n is None else [n, *above(parent[n])]

    kept = [n for n in parent if "q" not in above(n)]
    for a in kept:
        for b in kept:
            assert (spans[a][0] <= spans[b][0] <= spans[a][1]) == (a in above(b))
    deepest = max(len(above(n)) for n in kept)
    assert seen["intervals"] <= 2 * (deepest.bit_length() + 1)


def brute_workflow(children, home):
    """Breadth first with whole paths."""
    out, placed, frontier, depth = [(home, None, None, 0)], {home}, {home: (home,)}, 0
    while frontier:
        depth += 1
        offers = [(path, parent, child) for parent, path in frontier.items() for child in children.get(parent, ())]
        fresh = {}
        for path, parent, child in sorted(offers):
            if child not in placed and child not in fresh:
                fresh[child] = (path + (child,), parent)
        for path, parent, child in offers:
            out.append((child, parent, "cycle" if child in path else None if fresh.get(child, (0, 0))[1] == parent else "repeat", depth))
        placed |= set(fresh)
        frontier = {child: path for child, (path, _) in fresh.items()}
    return sorted(out, key=repr)


@pytest.mark.parametrize("deep", [False, True])
def test_workflow_matches_paths(graph, deep):
    picks = random.Random(6)
    names = [f"m.f{i:02d}" for i in range(12)]
    calls = {(picks.choice(names), picks.choice(names)) for _ in range(24)} if not deep else set(zip(names[:8], names[1:8])) | {(names[7], names[2]), (names[2], names[6])}
    calls = {(a, b) for a, b in calls if a != b}
    nodes, edges = graph([("m", "module", "m", "m.py", 0)] + [(n, "function", "m") for n in names], [(a, b, "call", b != names[0]) for a, b in calls])
    sure = {b for a, b in calls if b != names[0]}
    children = {"m": sorted(n for n in names if n not in sure)}
    for a, b in sorted(calls):
        children.setdefault(a, []).append(b)
    flow = ops.workflow(nodes, edges, canonical.home_select(nodes))
    assert "array" not in str(flow.dtypes) and rows(flow, "id", "parent", "cut", "depth") == brute_workflow(children, "m")


def test_workflow_places_each_node_once(graph, spark):
    nodes, edges = graph(
        [("m", "module", "m", "m.py", 0)] + [(f"m.{n}", "function", "m") for n in ("a", "b", "c")] + [("lost", "module", "lost")],
        [("m.a", "m.b", "call", True), ("m.b", "m.a", "call", True), ("m.a", "m.c", "call", False), ("m.b", "m.c", "call", True),
         ("m.c", "m.c", "call", True)])
    flow = ops.workflow(nodes, edges, canonical.home_select(nodes))
    # a and b call each other with certainty, so neither is a plain definition; c has a certain caller.
    assert rows(flow, "id", "relation", "cut") == [("m", "root", None)]
    nodes, edges = graph(
        [("m", "module", "m", "m.py", 0)] + [(f"m.{n}", "function", "m") for n in ("a", "b", "c")],
        [("m.a", "m.b", "call", True), ("m.b", "m.a", "call", False), ("m.a", "m.c", "call", False), ("m.b", "m.c", "call", True)])
    flow = ops.workflow(nodes, edges, canonical.home_select(nodes))
    assert rows(flow, "id", "parent", "relation", "cut", "depth") == sorted([
        ("m", None, "root", None, 0), ("m.a", "m", "defines", None, 1), ("m.b", "m.a", "calls", None, 2),
        ("m.c", "m.a", "calls", None, 2), ("m.a", "m.b", "calls", "cycle", 3), ("m.c", "m.b", "calls", "repeat", 3)], key=repr)
    assert rows(ops.unreached_nodes(nodes, flow)) == []


def test_ordered_index_spreads_one_group(spark):
    df = spark.range(5000).selectExpr("'hot' AS project", "id", "hash(id) AS weight")
    found = ordered_index(df, ["project"], [F.col("weight").desc(), F.col("id")])
    got = [r.id for r in sorted(found.collect(), key=lambda r: r.position)]
    assert got == [r.id for r in df.orderBy(df.weight.desc(), df.id).collect()]
    assert found.agg({"position": "max"}).first()[0] == 4999


def test_same_answer_with_other_partitions(graph, spark):
    names = [f"n{i:02d}" for i in range(12)]
    picks = random.Random(5)
    nodes, edges = graph([(n, "module", n) for n in names],
                         [(picks.choice(names), picks.choice(names), "import", True, i) for i in range(20)])
    regions, routes = regions_of(nodes, edges)
    first = rows(ops.communities(regions, routes))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert rows(ops.communities(regions.repartition(5), routes.repartition(3))) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
