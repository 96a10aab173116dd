"""Graph analytics: communities, distances, reach, layers, cycles, expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.canonical import call_pairs, candidates, internal_edges
from loomgraph.operators.resolve import split_join
from loomgraph.plans.iterate import COMPACT_EVERY, expand
from loomgraph.plans.ranking import ordered_index, running_total, top_rows
from loomgraph.session import cut

# Fixed values of the graph model.
LABEL_ROUNDS = 10
FAMILIES = 8
BLAST_DEPTH = 3


def neighbors(region_edges: DataFrame) -> DataFrame:
    """Undirected region pairs, both ways round, each once."""
    both = region_edges.where(F.col("src") != F.col("dst")).select(
        "project", F.explode(F.array(
            F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
            F.struct(F.col("dst").alias("a"), F.col("src").alias("b")),
        )).alias("p"))
    return both.select("project", "p.a", "p.b").distinct()


# ---- communities ---------------------------------------------------------

def propagate_labels(pairs: DataFrame, rounds: int = LABEL_ROUNDS) -> DataFrame:
    """Synchronous label propagation; labels are region ids, so order is theirs.

    Rounds run on numbers in the order of (project, region), so the least
    number is the least id and votes carry eight bytes for a region. In the
    first round every neighbour has a label of its own, and the least wins. A
    region's next label depends on its neighbours' alone, so later on only
    regions with a neighbour that moved vote again; all others would choose as
    before.
    """
    ends = pairs.select("project", F.col("a").alias("region")).distinct()
    # The table is written, so the numbers stay as they are.
    ids = cut(ends.orderBy("project", "region").withColumn("number", F.monotonically_increasing_id()), "numbers")
    links = pairs.join(ids.select("project", F.col("region").alias("a"), F.col("number").alias("node")), ["project", "a"]).join(
        ids.select("project", F.col("region").alias("b"), F.col("number").alias("near")), ["project", "b"])
    links = cut(links.select("node", "near"), "links")
    labels = ids.select(F.col("number").alias("node"), F.col("number").alias("label"))
    if rounds:
        labels = cut(links.groupBy("node").agg(F.min("near").alias("label")), "labels")
    asked = links
    for _ in range(1, rounds):
        votes = asked.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node", "label").agg(F.count("*").alias("votes"))
        chosen = votes.groupBy("node").agg(F.min(F.struct(-F.col("votes"), F.col("label").alias("to")))["to"].alias("to"))
        step = cut(labels.join(chosen, "node", "left").select(
            "node", F.coalesce("to", "label").alias("label"), F.coalesce(F.col("to") != F.col("label"), F.lit(False)).alias("moved")), "labels")
        labels, moved = step.select("node", "label"), step.where("moved")
        if moved.isEmpty():
            break
        near = links.join(moved.select(F.col("node").alias("near")), "near", "left_semi").select("node").distinct()
        asked = cut(links.join(near, "node", "left_semi"), "voters")
    named = ids.select(F.col("number").alias("label"), F.col("region").alias("named"))
    return ids.withColumnRenamed("number", "node").join(labels, "node").join(named, "label").select(
        "project", "region", F.col("named").alias("label"))


def communities(regions: DataFrame, region_edges: DataFrame) -> DataFrame:
    """Community number per region, dense per project by smallest member."""
    pairs = cut(neighbors(region_edges), "neighbors")
    labels = propagate_labels(pairs)
    every = regions.select("project", "region").join(labels, ["project", "region"], "left").select(
        "project", "region", F.coalesce("label", "region").alias("label"))
    firsts = every.groupBy("project", "label").agg(F.min("region").alias("first"))
    numbered = ordered_index(firsts, ["project"], [F.col("first")], "community")
    return every.join(numbered.select("project", "label", "community"), ["project", "label"]).select(
        "project", "region", "community")


def families(membership: DataFrame) -> DataFrame:
    """The eight largest communities of a project get a family, others NULL."""
    sizes = membership.groupBy("project", "community").agg(F.count("*").alias("size"))
    best = top_rows(sizes, ["project"], [F.desc("size"), F.col("community")], FAMILIES).select(
        "project", "community", (F.col("place") - 1).alias("family"))
    return sizes.join(best, ["project", "community"], "left")


# ---- distance from home --------------------------------------------------

def hops_from(start: DataFrame, regions: DataFrame, region_edges: DataFrame) -> DataFrame:
    """Undirected distance from ``start(project, region)``; NULL if unreached."""
    pairs = cut(neighbors(region_edges), "neighbors")

    def step(frontier: DataFrame, number: int) -> DataFrame:
        return (
            frontier.select("project", F.col("region").alias("a")).join(pairs, ["project", "a"])
            .select("project", F.col("b").alias("region")).distinct()
            .withColumn("hops", F.lit(number))
        )

    reached = expand(start.select("project", "region", F.lit(0).alias("hops")), step, ["project", "region"])
    return regions.select("project", "region").join(reached, ["project", "region"], "left")


def hops(regions: DataFrame, region_edges: DataFrame) -> DataFrame:
    return hops_from(regions.where("home"), regions, region_edges)


def rehome(
    choices: DataFrame, nodes: DataFrame, regions: DataFrame, region_edges: DataFrame
) -> DataFrame:
    """Move home to the chosen candidates: new home flag and hops per region."""
    pool = candidates(nodes).select("project", "id", "region", F.lit(True).alias("known"))
    start = choices.join(pool, ["project", "id"], "left").select(
        "project",
        F.when(F.col("known"), F.col("region")).otherwise(
            F.raise_error(F.concat(F.lit("not a ranked candidate: "), F.col("id")))).alias("region"))
    moved = hops_from(start, regions, region_edges)
    return moved.withColumn("home", F.coalesce(F.col("hops") == 0, F.lit(False)))


# ---- blast radius --------------------------------------------------------

def numbered_pairs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``project, id, number`` of every linked node, and ``src, dst, certain`` of the linked pairs by number.

    A pair is certain if any of its edges is. Numbers are unique over all
    projects and in the order of (project, id), so least and greatest numbers
    are least and greatest ids, and walks carry eight bytes for a node.
    """
    inside = internal_edges(edges, nodes).groupBy("project", "src", "dst").agg(F.bool_or("certain").alias("certain"))
    inside = cut(inside, "inside")
    ends = inside.select("project", F.explode(F.array("src", "dst")).alias("id")).distinct()
    # The table is written, so the numbers stay as they are.
    ids = cut(ends.orderBy("project", "id").withColumn("number", F.monotonically_increasing_id()), "numbers")
    pairs = inside.join(ids.select("project", F.col("id").alias("src"), F.col("number").alias("a")), ["project", "src"]).join(
        ids.select("project", F.col("id").alias("dst"), F.col("number").alias("b")), ["project", "dst"])
    return ids, cut(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "certain"), "pairs")


def _adjacency(pairs: DataFrame, at: str, to: str) -> DataFrame:
    return pairs.select(F.col(at).alias("node"), F.col(to).alias("to"), "certain")


def walk(starts: DataFrame, adjacency: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Reach within ``max_depth`` for every ``start``, and the starts cut short.

    ``adjacency(node, to, certain)`` is a written table with one row per
    ordered pair. Each step carries whether the route so far was all certain. A
    node already seen is walked again only when this step is the first to prove
    it, so true distance and true certainty come out of one walk. Nodes with
    very many links, or that very many walks have come to, are spread.
    """
    frontier = cut(starts.select("start", F.col("start").alias("node"), F.lit(True).alias("proven")), "starts")
    levels: list[DataFrame] = []
    for depth in range(1, max_depth + 1):
        stepped = (
            split_join(frontier, adjacency, ["node"], written=True)
            .where(F.col("to") != F.col("start"))
            .groupBy("start", F.col("to").alias("node"))
            .agg(F.bool_or(F.col("proven") & F.col("certain")).alias("proven"))
        )
        if levels:
            seen = reduce(DataFrame.unionByName, levels).groupBy("start", "node").agg(F.bool_or("proven").alias("was_proven"))
            stepped = stepped.join(seen, ["start", "node"], "left").where(
                F.col("was_proven").isNull() | (F.col("proven") & ~F.col("was_proven"))
            ).select("start", "node", "proven")
        frontier = cut(stepped, "reach")
        levels.append(frontier.withColumn("depth", F.lit(depth)))
    reached = cut(reduce(DataFrame.unionByName, levels).groupBy("start", "node").agg(
        F.min("depth").alias("depth"), F.bool_or("proven").alias("certain")), "reached")
    onward = adjacency.select("node").distinct()
    truncated = reached.where(F.col("depth") == max_depth).join(onward, "node", "left_semi").select("start").distinct()
    return reached, truncated


def _by_id(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Numbers replaced by ids, with the project of the last."""
    for n, column in enumerate(columns):
        names = ids.select(F.col("number").alias(column), F.col("id").alias("_id"), *(["project"] if n == 0 else []))
        rows = rows.join(names, column).drop(column).withColumnRenamed("_id", column)
    return rows


def blast_radius(
    starts: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = BLAST_DEPTH
) -> DataFrame:
    """What each start ``(project, id)`` affects (inbound) and depends on (outbound)."""
    ids, pairs = numbered_pairs(nodes, edges)
    begin = cut(starts.select("project", "id").distinct().join(ids, ["project", "id"]).select(F.col("number").alias("start")), "starts")
    affects, cut_in = walk(begin, cut(_adjacency(pairs, "dst", "src"), "inbound"), max_depth)
    depends, cut_out = walk(begin, cut(_adjacency(pairs, "src", "dst"), "outbound"), max_depth)
    rows = affects.withColumn("direction", F.lit("affects")).unionByName(
        depends.withColumn("direction", F.lit("depends_on")))
    return _by_id(_marked(rows, cut_in.unionByName(cut_out)), ids, "start", "node").select(
        "project", "start", "direction", "node", "depth", "certain", "truncated")


def _marked(rows: DataFrame, short: DataFrame) -> DataFrame:
    flagged = short.distinct().withColumn("truncated", F.lit(True))
    return rows.join(flagged, "start", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def _reach_of_all(pairs: DataFrame, max_depth: int) -> DataFrame:
    """Reach of every linked node both ways, by number: what a node affects is what depends on it, so one walk is read twice."""
    outbound = cut(_adjacency(pairs, "src", "dst"), "outbound")
    reached, cut_out = walk(outbound.select(F.col("node").alias("start")).distinct(), outbound, max_depth)
    called = pairs.select(F.col("dst").alias("start")).distinct()
    cut_in = reached.where(F.col("depth") == max_depth).join(called, "start", "left_semi").select(F.col("node").alias("start")).distinct()
    rows = reached.withColumn("direction", F.lit("depends_on")).unionByName(reached.select(
        F.col("node").alias("start"), F.col("start").alias("node"), "depth", "certain", F.lit("affects").alias("direction")))
    return _marked(rows, cut_in.unionByName(cut_out))


def blast_radius_all(nodes: DataFrame, edges: DataFrame, max_depth: int = BLAST_DEPTH) -> DataFrame:
    """``blast_radius`` from every node at once; its rows grow with the pairs within ``max_depth`` steps."""
    ids, pairs = numbered_pairs(nodes, edges)
    return _by_id(_reach_of_all(pairs, max_depth), ids, "start", "node").select(
        "project", "start", "direction", "node", "depth", "certain", "truncated")


def blast_summary_all(nodes: DataFrame, edges: DataFrame, max_depth: int = BLAST_DEPTH) -> DataFrame:
    """The same counted per start, direction, depth and certainty, with the first and last node by id; only those are named."""
    ids, pairs = numbered_pairs(nodes, edges)
    counts = _reach_of_all(pairs, max_depth).groupBy("start", "direction", "depth", "certain", "truncated").agg(
        F.count("*").alias("reached"), F.min("node").alias("first_node"), F.max("node").alias("last_node"))
    return _by_id(counts, ids, "start", "first_node", "last_node").select(
        "project", "start", "direction", "depth", "certain", "truncated", "reached", "first_node", "last_node")


def cite(rows: DataFrame, nodes: DataFrame, column: str = "node") -> DataFrame:
    """Attach name, kind, language and ``file:line`` of the node in ``column``."""
    facts = nodes.select(
        "project", F.col("id").alias(column), "name", "kind", "language",
        F.concat("file", F.lit(":"), F.col("lineno").cast("string")).alias("citation"))
    return rows.join(facts, ["project", column])


# ---- call layers inside a region -----------------------------------------

def call_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ring, depth and kind of every node inside its region."""
    where = nodes.select("project", "id", "region")
    entry = nodes.groupBy("project", "region").agg(
        F.min(F.struct(F.col("kind") != "module", F.col("id")))["id"].alias("id"))
    calls = edges.where(
        (F.col("kind") == "call") & ~F.col("external") & F.col("certain") & (F.col("src") != F.col("dst"))
    ).select("project", "src", "dst").distinct()
    inner = cut(
        calls.join(where.select("project", F.col("id").alias("src"), "region"), ["project", "src"])
        .join(where.select("project", F.col("id").alias("dst"), F.col("region").alias("to_region")), ["project", "dst"])
        .where(F.col("region") == F.col("to_region")).select("project", "region", "src", "dst"),
        "inner_calls",
    )
    origin = entry.select("project", "region", "id", F.lit(0).alias("depth"), F.lit("origin").alias("kind"))
    called_by_entry = inner.join(entry.withColumnRenamed("id", "src"), ["project", "region", "src"], "left_semi").select(
        "project", "region", F.col("dst").alias("id"), F.lit(1).alias("depth"), F.lit("certain-call").alias("kind"))
    uncalled = (
        where.join(entry, ["project", "region", "id"], "left_anti")
        .join(inner.select("project", "region", F.col("dst").alias("id")), ["project", "region", "id"], "left_anti")
        .select("project", "region", "id", F.lit(1).alias("depth"), F.lit("call-root").alias("kind"))
    )

    def step(frontier: DataFrame, number: int) -> DataFrame:
        return (
            frontier.where(F.col("depth") == number).select("project", "region", F.col("id").alias("src"))
            .join(inner, ["project", "region", "src"])
            .select("project", "region", F.col("dst").alias("id")).distinct()
            .select("project", "region", "id", F.lit(number + 1).alias("depth"), F.lit("certain-call").alias("kind"))
        )

    placed = expand(origin.unionByName(called_by_entry).unionByName(uncalled), step, ["project", "region", "id"])
    outer = placed.groupBy("project", "region").agg((F.max("depth") + 1).alias("outer"))
    # Regions are joined to the full node list once; unplaced nodes keep a NULL depth.
    return (
        where.join(placed, ["project", "region", "id"], "left")
        .join(outer, ["project", "region"])
        .select(
            "project", "region", "id", F.coalesce("depth", "outer").alias("ring"),
            F.col("depth").alias("call_depth"), F.coalesce("kind", F.lit("unreached")).alias("kind"))
    )


def orbit_plan(layers: DataFrame) -> DataFrame:
    """One row per ring beyond the origin; kinds are a set of at most three."""
    rings = layers.where(F.col("ring") > 0).groupBy("project", "region", "ring").agg(
        F.min("call_depth").alias("low"), F.max("call_depth").alias("high"),
        F.bool_or(F.col("call_depth").isNull()).alias("gap"),
        F.bool_and(F.col("kind") == "unreached").alias("unproven"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.count("*").alias("members"))
    single = (F.col("low") == F.col("high")) & ~F.col("gap")
    depth = F.when(single, F.col("low"))
    return rings.select(
        "project", "region", "ring", depth.alias("call_depth"), "kinds", "members", "unproven",
        F.when(F.col("unproven"), "No proven path").when(depth.isNull(), "Mixed call evidence")
        .otherwise(F.concat(F.lit("Layer "), depth.cast("string"))).alias("label"))


# ---- cycles and layers of imports ----------------------------------------

def _heads(links: DataFrame) -> DataFrame:
    """``project, id, head, least`` of every node that has one predecessor.

    ``head`` is the first above it that has none or several, ``least`` the
    smallest id from below that on to the node itself. Pointer jumping: every
    node points to its predecessor, and then again and again to what the node
    it points to points to, so chains take rounds in the logarithm of their
    length. Nodes that a ring of such nodes leads to have no head; their
    ``least`` takes in the ring. Only pointers that moved are written and
    followed.
    """
    above = cut(
        links.groupBy("project", F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("up"))
        .where(F.col("n") == 1).select("project", "id", "up", F.col("id").alias("least")), "pointers")
    ended: list[DataFrame] = []
    moving = above
    while True:
        every = reduce(DataFrame.unionByName, [moving, *ended]).select(
            "project", F.col("id").alias("up"), F.col("up").alias("further"), F.col("least").alias("ahead"))
        jumped = cut(moving.join(every, ["project", "up"], "left"), "jumped")
        ended.append(jumped.where(F.col("further").isNull()).select("project", "id", "up", "least"))
        moving = jumped.where(F.col("further").isNotNull()).select(
            "project", "id", F.col("further").alias("up"), F.least("least", "ahead").alias("least"))
        on, off, lower = jumped.agg(F.count("further"), F.count_if(F.col("further").isNull()), F.count_if(F.col("ahead") < F.col("least"))).first()
        # Where a round ends no pointer, only rings are left; where it lowers no least either, none will.
        if not on or not (off or lower):
            break
    rings = moving.withColumn("up", F.lit(None).cast("string"))
    return reduce(DataFrame.unionByName, [rings, *ended]).withColumnRenamed("up", "head")


def _without_trees(links: DataFrame) -> DataFrame:
    """Drop links that cannot be on a cycle: those of sources, and of what only a source leads to, however far."""
    sources = links.select("project", F.col("src").alias("id")).distinct().join(
        links.select("project", F.col("dst").alias("id")).distinct(), ["project", "id"], "left_anti")
    hung = _heads(links).join(sources.withColumnRenamed("id", "head"), ["project", "head"], "left_semi").select("project", "id")
    dead = cut(sources.unionByName(hung), "dead")
    return cut(links.join(dead.withColumnRenamed("id", "src"), ["project", "src"], "left_anti"), "links")


def _turned(links: DataFrame) -> DataFrame:
    return links.select("project", F.col("dst").alias("src"), F.col("src").alias("dst"))


def least_reaching(links: DataFrame) -> DataFrame:
    """``project, id, label``: the smallest id that reaches each node along the links, its own included.

    Chains of nodes with one predecessor are folded into their heads first, so
    chains and rings take rounds in the logarithm of their length, whatever the
    order of their ids. Between the other nodes labels travel along links, and
    jump: what reaches a node's label reaches the node. Every round writes and
    sends on only the labels that moved.
    """
    heads = cut(_heads(links), "heads")
    ends = links.select("project", F.explode(F.array("src", "dst")).alias("id")).distinct()
    into = links.join(heads.select("project", F.col("id").alias("dst")), ["project", "dst"], "left_anti").join(
        heads.select("project", F.col("id").alias("src"), "head", "least"), ["project", "src"], "left").select(
        "project", F.when(F.col("least").isNull(), F.col("src")).otherwise(F.col("head")).alias("src"), "dst", F.coalesce("least", "src").alias("least"))
    into = cut(into.distinct(), "folded")
    nearest = into.groupBy("project", F.col("dst").alias("id")).agg(F.min("least").alias("least"))
    folded = into.where(F.col("src").isNotNull() & (F.col("src") != F.col("dst"))).select("project", "src", "dst").distinct()
    kept = ends.join(heads, ["project", "id"], "left_anti").join(nearest, ["project", "id"], "left")
    labels = [cut(kept.select("project", "id", F.least("id", "least").alias("label")), "labels")]
    moved = labels[0]

    def current(more: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, labels + more).groupBy("project", "id").agg(F.min("label").alias("label"))

    # Where a label's own label stands: with its head, if it is in a chain.
    stands = heads.select("project", F.col("id").alias("label"), "head")
    while True:
        offered = moved.select("project", F.col("id").alias("src"), "label").join(folded, ["project", "src"]).groupBy(
            "project", F.col("dst").alias("id")).agg(F.min("label").alias("offer"))
        lower = cut(current([]).join(offered, ["project", "id"]).where(F.col("offer") < F.col("label")).select(
            "project", "id", F.col("offer").alias("label")), "offers")
        if lower.isEmpty():
            break
        ahead = current([lower]).select("project", F.col("id").alias("head"), F.col("label").alias("further"))
        placed = lower.join(stands, ["project", "label"], "left").withColumn("head", F.coalesce("head", "label"))
        moved = cut(placed.join(ahead, ["project", "head"], "left").select(
            "project", "id", F.least("label", "further").alias("label")), "labels")
        labels.append(moved)
        if len(labels) > COMPACT_EVERY:
            labels[:] = [cut(current([]), "labels")]
    whole = current([])
    below = heads.join(whole.withColumnRenamed("id", "head"), ["project", "head"], "left").select(
        "project", "id", F.least("least", "label").alias("label"))
    return whole.unionByName(below)


def components(region_edges: DataFrame) -> DataFrame:
    """Members of every strongly connected component of two or more regions.

    Each round drops what hangs off sources and sinks, and finds for every
    region the smallest id that reaches it, and the smallest that it reaches
    over regions of the same label. Where both are one region, that region's
    component is whole. All members of a component share both labels, so only
    links inside equal labels go on.
    """
    links = cut(region_edges.where(F.col("src") != F.col("dst")).select("project", "src", "dst").distinct(), "links")
    found: list[DataFrame] = []
    while True:
        links = _turned(_without_trees(_turned(_without_trees(links))))
        if links.isEmpty():
            break
        reached = cut(least_reaching(links), "reached")
        same = cut(_inside_label(links, reached), "same")
        back = least_reaching(_turned(same)).withColumnRenamed("label", "least")
        both = cut(reached.join(back, ["project", "id"], "left").select(
            "project", "id", "label", F.coalesce("least", "id").alias("least")), "both")
        found.append(both.where(F.col("label") == F.col("least")).select("project", F.col("id").alias("region"), F.col("label").alias("component")))
        left = both.where(F.col("label") != F.col("least")).select("project", "id", F.col("least").alias("label"))
        links = cut(_inside_label(same, left), "links")
    if not found:
        return region_edges.limit(0).select("project", F.col("src").alias("region"), F.col("dst").alias("component"))
    whole = reduce(DataFrame.unionByName, found)
    sizes = whole.groupBy("project", "component").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return whole.join(sizes, ["project", "component"], "left_semi").select("project", "region", "component")


def _inside_label(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between two nodes of one label."""
    return (
        links.join(labels.select("project", F.col("id").alias("src"), "label"), ["project", "src"])
        .join(labels.select("project", F.col("id").alias("dst"), F.col("label").alias("to_label")), ["project", "dst"])
        .where(F.col("label") == F.col("to_label")).select("project", "src", "dst")
    )


def _component_of(regions: DataFrame, membership: DataFrame) -> DataFrame:
    return regions.select("project", "region").join(membership, ["project", "region"], "left").select(
        "project", "region", F.coalesce("component", "region").alias("component"))


def import_cycles(region_edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Every region edge with whether it lies inside an import cycle."""
    src = membership.select("project", F.col("region").alias("src"), F.col("component").alias("c1"))
    dst = membership.select("project", F.col("region").alias("dst"), F.col("component").alias("c2"))
    return (
        region_edges.join(src, ["project", "src"], "left").join(dst, ["project", "dst"], "left")
        .select("project", "src", "dst", F.coalesce(F.col("c1") == F.col("c2"), F.lit(False)).alias("in_cycle"))
    )


def import_layers(regions: DataFrame, region_edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Longest import path from home, or from modules nothing imports.

    Components are collapsed first, so the walk runs on an acyclic graph: the
    set at step k holds whatever a path of exactly k links reaches, and a
    component's layer is the last step that held it.
    """
    of = cut(_component_of(regions, membership), "component_of")
    links = cut(
        region_edges.join(of.select("project", F.col("region").alias("src"), F.col("component").alias("a")), ["project", "src"])
        .join(of.select("project", F.col("region").alias("dst"), F.col("component").alias("b")), ["project", "dst"])
        .where(F.col("a") != F.col("b")).select("project", "a", "b").distinct(),
        "component_links")
    homes = regions.where("home").select("project", "region")
    from_home = of.join(homes, ["project", "region"], "left_semi").select("project", "component")
    open_roots = (
        of.join(homes.select("project"), "project", "left_anti").select("project", "component").distinct()
        .join(links.select("project", F.col("b").alias("component")), ["project", "component"], "left_anti")
    )
    frontier = cut(from_home.unionByName(open_roots), "layer")
    steps = [frontier.withColumn("layer", F.lit(0))]
    while not frontier.isEmpty():
        frontier = cut(
            frontier.select("project", F.col("component").alias("a")).join(links, ["project", "a"])
            .select("project", F.col("b").alias("component")).distinct(), "layer")
        steps.append(frontier.withColumn("layer", F.lit(len(steps))))
    layers = reduce(DataFrame.unionByName, steps).groupBy("project", "component").agg(F.max("layer").alias("layer"))
    outer = layers.groupBy("project").agg((F.max("layer") + 1).alias("outer"))
    return (
        of.join(layers, ["project", "component"], "left").join(outer, "project", "left")
        .select("project", "region", F.coalesce("layer", "outer", F.lit(0)).alias("layer"),
                F.col("layer").isNotNull().alias("reachable"))
    )


# ---- expansion of the program from home ----------------------------------

def workflow_children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parent to child rows: a module defines, anything else calls."""
    pairs = cut(call_pairs(nodes, edges), "call_pairs")
    members = nodes.where(F.col("kind") != "module").select("project", "region", "id")
    sure = (
        pairs.where("certain")
        .join(members.select("project", F.col("id").alias("src"), F.col("region").alias("src_region")), ["project", "src"])
        .join(members.select("project", F.col("id").alias("dst"), F.col("region").alias("dst_region")), ["project", "dst"])
        .where(F.col("src_region") == F.col("dst_region")).select("project", F.col("dst").alias("id")).distinct()
    )
    modules = nodes.where(F.col("kind") == "module").select("project", "region", F.col("id").alias("parent"))
    defines = members.join(sure, ["project", "id"], "left_anti").join(modules, ["project", "region"]).select(
        "project", "parent", F.col("id").alias("child"), F.lit(True).alias("certain"), F.lit("defines").alias("relation"))
    calls = pairs.join(modules.select("project", F.col("parent").alias("src")), ["project", "src"], "left_anti").select(
        "project", F.col("src").alias("parent"), F.col("dst").alias("child"), "certain", F.lit("calls").alias("relation"))
    return defines.unionByName(calls)


def tree_intervals(tree: DataFrame) -> DataFrame:
    """``project, id, entry, exit`` of the nodes of trees ``(project, id, parent)``: a node's interval holds its descendants'.

    Sizes of subtrees and sums along the way to the root come from pointer
    jumping, so rounds grow with the logarithm of the depth. Siblings follow
    one another by id; their places are differences of one running total, so a
    parent of very many is not held in one task.
    """

    def jumped(state: DataFrame, update) -> DataFrame:
        """Follow ``up`` by doubling until every node is past its root; ``update`` gets each round's nodes and their pointers."""
        while True:
            ahead = state.select("project", F.col("id").alias("up"), F.col("up").alias("further"), F.col("sum").alias("ahead"))
            state = cut(update(state, ahead), "intervals")
            if state.where(F.col("up").isNotNull()).isEmpty():
                return state

    def gathered(state: DataFrame, ahead: DataFrame) -> DataFrame:
        """Below a node by less than twice as far: what was below it, and what is below those that point to it."""
        gains = state.where(F.col("up").isNotNull()).groupBy("project", F.col("up").alias("id")).agg(F.sum("sum").alias("gain"))
        return state.join(gains, ["project", "id"], "left").join(ahead.drop("ahead"), ["project", "up"], "left").select(
            "project", "id", F.col("further").alias("up"), (F.col("sum") + F.coalesce("gain", F.lit(0))).alias("sum"))

    def added(state: DataFrame, ahead: DataFrame) -> DataFrame:
        return state.join(ahead, ["project", "up"], "left").select(
            "project", "id", F.col("further").alias("up"), (F.col("sum") + F.coalesce("ahead", F.lit(0))).alias("sum"))

    ones = tree.select("project", "id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("sum"))
    sizes = jumped(ones, gathered).select("project", "id", F.col("sum").alias("size"))
    children = tree.where(F.col("parent").isNotNull()).select("project", "id", "parent").join(sizes, ["project", "id"])
    placed = running_total(children, [F.col(c) for c in ("project", "parent", "id")], "size", "until").withColumn("before", F.col("until") - F.col("size"))
    placed = cut(placed, "siblings")
    first = placed.groupBy("project", "parent").agg(F.min("before").alias("first"))
    offsets = placed.join(first, ["project", "parent"]).select(
        "project", "id", F.col("parent").alias("up"), (1 + F.col("before") - F.col("first")).alias("sum"))
    roots = tree.where(F.col("parent").isNull()).select("project", "id", "parent", F.lit(0).cast("long").alias("sum")).withColumnRenamed("parent", "up")
    entries = jumped(offsets.unionByName(roots), added)
    return entries.join(sizes, ["project", "id"]).select(
        "project", "id", F.col("sum").alias("entry"), (F.col("sum") + F.col("size") - 1).alias("exit"))


def workflow(nodes: DataFrame, edges: DataFrame, homes: DataFrame) -> DataFrame:
    """Rows of the expansion from home, breadth first.

    A node is placed once, under the parent whose path comes first at its least
    depth. Every other row for it is cut: ``cycle`` when it is an ancestor of the
    parent, ``repeat`` otherwise. Paths of one depth are ordered by the rank of
    the parent's path and then the id, so a rank stands for the path. Whether a
    node is an ancestor is asked once, of the whole tree's intervals.
    """
    children = cut(workflow_children(nodes, edges), "children")
    none = F.lit(None).cast("string")
    frontier = cut(homes.where(F.col("home").isNotNull()).select(
        "project", F.col("home").alias("id"), none.alias("parent"), F.lit(0).cast("long").alias("rank")), "flow")
    placed, offers = [frontier], []
    while not frontier.isEmpty():
        offered = cut(frontier.select("project", F.col("id").alias("parent"), "rank").join(children, ["project", "parent"]), "offered")
        offers.append(offered.select("project", "parent", "child", "relation", "certain", F.lit(len(placed)).alias("depth")))
        before = reduce(DataFrame.unionByName, placed).select("project", F.col("id").alias("child"))
        winners = offered.join(before, ["project", "child"], "left_anti").groupBy("project", F.col("child").alias("id")).agg(
            F.min(F.struct("rank", "parent")).alias("win"))
        ranked = ordered_index(winners.select("project", "id", F.col("win.parent").alias("parent"), F.col("win.rank").alias("up")),
                               ["project"], [F.col("up"), F.col("id")], "rank")
        frontier = cut(ranked.select("project", "id", "parent", "rank"), "flow")
        placed.append(frontier)
    tree = cut(reduce(DataFrame.unionByName, placed).select("project", "id", "parent"), "tree")
    roots = tree.where(F.col("parent").isNull()).select(
        "project", "id", "parent", F.lit("root").alias("relation"), F.lit(True).alias("certain"), none.alias("cut"), F.lit(0).alias("depth"))
    if not offers:
        return roots
    spans = cut(tree_intervals(tree), "spans")
    child = spans.join(tree, ["project", "id"]).select(
        "project", F.col("id").alias("child"), F.col("parent").alias("under"), F.col("entry").alias("child_entry"), F.col("exit").alias("child_exit"))
    judged = reduce(DataFrame.unionByName, offers).join(child, ["project", "child"]).join(
        spans.select("project", F.col("id").alias("parent"), "entry"), ["project", "parent"])
    loops = F.col("entry").between(F.col("child_entry"), F.col("child_exit"))
    return roots.unionByName(judged.select(
        "project", F.col("child").alias("id"), "parent", "relation", "certain",
        F.when(loops, "cycle").when(F.col("under") == F.col("parent"), none).otherwise("repeat").alias("cut"), "depth"))


def unreached_nodes(nodes: DataFrame, flow: DataFrame) -> DataFrame:
    return nodes.select("project", "id", "language").join(flow.select("project", "id"), ["project", "id"], "left_anti")


def unreached_regions(layers: DataFrame) -> DataFrame:
    return layers.where(~F.col("reachable")).select("project", "region")
