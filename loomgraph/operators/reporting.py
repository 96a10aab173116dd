"""Learner-facing and reporting projections of the graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.paths import directories, is_learner_test_scoped, path_tail, segments, top_directory
from loomgraph.operators.canonical import candidates
from loomgraph.plans.ranking import ordered_index, top_rows

# Fixed values of the projections.
SEARCH_ROWS = 60
OVERVIEW_ROWS = 5
REVEAL_HOPS = 2
TEST_HOP_PENALTY = 1.5
REGION_BRIGHT = 5
NODE_BRIGHT = 2
HOME_WEIGHT, UNDERSTOOD_WEIGHT, CENTRALITY_WEIGHT = 3_000_000, 1_000_000, 1_000


# ---- language focus ------------------------------------------------------

def focus_nodes(nodes: DataFrame, language: str) -> DataFrame:
    return nodes.where(F.col("language") == language)


def focus_edges(nodes: DataFrame, edges: DataFrame, language: str) -> DataFrame:
    """Edges whose source is kept and whose target is kept, external, or no node."""
    kept = focus_nodes(nodes, language).select("project", F.col("id").alias("src"))
    others = nodes.where(F.col("language") != language).select(
        "project", F.col("id").alias("dst"), F.lit(True).alias("other"))
    return (
        edges.join(kept, ["project", "src"], "left_semi").join(others, ["project", "dst"], "left")
        .where(F.col("external") | F.col("other").isNull()).select(*edges.columns)
    )


def focus_regions(rows: DataFrame, nodes: DataFrame, language: str) -> DataFrame:
    """Region-keyed rows (regions, map boxes) that hold a node of the language."""
    kept = focus_nodes(nodes, language).select("project", "region").distinct()
    return rows.join(kept, ["project", "region"], "left_semi").select(*rows.columns)


def focus_region_edges(region_edges: DataFrame, nodes: DataFrame, language: str) -> DataFrame:
    kept = focus_nodes(nodes, language).select("project", "region").distinct()
    return region_edges.join(kept.withColumnRenamed("region", "src"), ["project", "src"], "left_semi").join(
        kept.withColumnRenamed("region", "dst"), ["project", "dst"], "left_semi").select(*region_edges.columns)


def focus_concepts(concepts: DataFrame, nodes: DataFrame, language: str) -> DataFrame:
    kept = focus_nodes(nodes, language).select("project", F.col("id").alias("node_id"))
    return concepts.where(F.col("language") == language).join(kept, ["project", "node_id"], "left_semi")


def focus_files(files: DataFrame, nodes: DataFrame, language: str) -> DataFrame:
    kept = focus_nodes(nodes, language).select("project", "file").distinct()
    return files.join(kept, ["project", "file"], "left_semi").select(*files.columns)


def focus_candidates(candidate_rows: DataFrame, nodes: DataFrame, language: str) -> DataFrame:
    """Entry candidates that are nodes of the language."""
    kept = focus_nodes(nodes, language).select("project", "id")
    return candidate_rows.join(kept, ["project", "id"], "left_semi").select(*candidate_rows.columns)


def focus_home(homes: DataFrame, nodes: DataFrame, language: str) -> DataFrame:
    """The chosen home of every project, or NULL where it is of another language."""
    kept = focus_nodes(nodes, language).select("project", F.col("id").alias("home"), F.lit(True).alias("kept"))
    return homes.join(kept, ["project", "home"], "left").select("project", F.when(F.col("kept"), F.col("home")).alias("home"))


def partial_files(nodes: DataFrame) -> DataFrame:
    return nodes.where("partial").select("project", "file").distinct()


def focus_boxes(boxes: DataFrame, regions: DataFrame, language: str) -> DataFrame:
    """Map boxes whose own region is of the language; what survives keeps its place."""
    kept = regions.where(F.col("language") == language).select("project", "region")
    return boxes.join(kept, ["project", "region"], "left_semi").select(*boxes.columns)


def focus_box_edges(region_edges: DataFrame, regions: DataFrame, language: str) -> DataFrame:
    """Map edges between two boxes that are kept."""
    kept = regions.where(F.col("language") == language).select("project", "region")
    return region_edges.join(kept.withColumnRenamed("region", "src"), ["project", "src"], "left_semi").join(
        kept.withColumnRenamed("region", "dst"), ["project", "dst"], "left_semi").select(*region_edges.columns)


def focus_rows(rows: DataFrame, nodes: DataFrame, language: str) -> DataFrame:
    """Rows by node id (of the expansion, or of what it leaves out) whose node is of the language; parents may be gone."""
    kept = focus_nodes(nodes, language).select("project", "id")
    return rows.join(kept, ["project", "id"], "left_semi").select(*rows.columns)


def language_options(regions: DataFrame) -> DataFrame:
    """Regions per language, and a total row named ``all``."""
    return regions.rollup("project", "language").agg(
        F.count("*").alias("regions"), F.grouping("language").alias("total"), F.grouping("project").alias("grand")
    ).where(F.col("grand") == 0).select(
        "project", F.when(F.col("total") == 1, "all").otherwise(F.col("language")).alias("language"), "regions")


# ---- concepts ------------------------------------------------------------

def concept_chart(concepts: DataFrame, studied: DataFrame, understood_nodes: DataFrame) -> DataFrame:
    """Occurrences and distinct, studied and understood nodes per concept.

    Counting happens per (concept, node) first, so a concept found everywhere
    is spread over its nodes before the last, small aggregation.
    """
    per_node = concepts.groupBy("project", "language", "concept", "node_id").agg(F.count("*").alias("times"))
    marks = per_node.join(
        studied.select("project", "node_id").distinct().withColumn("s", F.lit(1)), ["project", "node_id"], "left"
    ).join(
        understood_nodes.select("project", "node_id").distinct().withColumn("u", F.lit(1)), ["project", "node_id"], "left")
    return marks.groupBy("project", "language", "concept").agg(
        F.sum("times").alias("occurrences"), F.count("*").alias("nodes"),
        F.count("s").alias("studied_nodes"), F.count("u").alias("understood_nodes"))


# ---- project overview ----------------------------------------------------

def _listing(rows: DataFrame, order: list, name: str, shown: Column) -> DataFrame:
    best = top_rows(rows, ["project"], order, OVERVIEW_ROWS)
    return best.groupBy("project").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", shown.alias("shown")))),
                                 lambda r: r["shown"]), "|").alias(name))


def project_overview(
    regions: DataFrame, nodes: DataFrame, understood_regions: DataFrame, unsupported: DataFrame | None = None
) -> DataFrame:
    """One row per project: sizes, languages, largest and busiest regions."""
    totals = regions.groupBy("project").agg(
        F.count("*").alias("modules"), F.sum("loc").alias("lines"), F.max(F.when(F.col("home"), F.col("region"))).alias("home"))
    inside = nodes.groupBy("project").agg(
        F.count("*").alias("structures"),
        F.count_distinct(F.when(F.col("partial"), F.col("file"))).alias("unreadable"))
    by_language = regions.groupBy("project", "language").agg(F.count("*").alias("n"))
    languages = by_language.groupBy("project").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "language"))),
            lambda r: F.concat(r["language"], F.lit(":"), (-r["n"]).cast("string"))), "|").alias("languages"))

    def shown(value: str) -> Column:
        return F.concat("region", F.lit(":"), F.col(value).cast("string"))

    biggest = _listing(regions, [F.desc("loc"), F.col("region")], "biggest", shown("loc"))
    busiest = _listing(regions, [F.desc("centrality"), F.col("region")], "busiest", shown("centrality"))
    lit = understood_regions.select("project", "region").distinct().join(
        regions.select("project", "region"), ["project", "region"], "left_semi"
    ).groupBy("project").agg(F.count("*").alias("understood"))
    whole = totals.join(inside, "project").join(languages, "project").join(biggest, "project").join(
        busiest, "project").join(lit, "project", "left")
    if unsupported is not None:
        left_out = unsupported.groupBy("project").agg(F.sum("count").alias("unsupported"))
        whole = whole.join(left_out, "project", "left")
    else:
        whole = whole.withColumn("unsupported", F.lit(None).cast("long"))
    return whole.select(
        "project", "modules", "structures", "lines", "languages", "home", "biggest", "busiest", "unreadable",
        F.coalesce("unsupported", F.lit(0)).alias("unsupported"), F.coalesce("understood", F.lit(0)).alias("understood"))


# ---- module lists --------------------------------------------------------

def region_files(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project", "region").agg(F.min_by("file", "id").alias("file"))


def module_index(
    regions: DataFrame, nodes: DataFrame, communities: DataFrame, hops: DataFrame, understood_regions: DataFrame
) -> DataFrame:
    """One searchable row per region."""
    lit = understood_regions.select("project", "region").distinct().withColumn("lit", F.lit(True))
    keys = ["project", "region"]
    return (
        regions.join(region_files(nodes), keys).join(communities, keys).join(hops, keys).join(lit, keys, "left")
        .select("project", "region", "file", path_tail(F.col("file")).alias("label"), "language", "community",
                F.coalesce("lit", F.lit(False)).alias("understood"), "home", "hops", "centrality", "loc")
    )


def module_search(index: DataFrame, query: str) -> DataFrame:
    """First matches per project; an empty query lists the most useful rows."""
    needle = query.strip().lower()
    if needle:
        rows = index.where(F.lower("label").contains(needle) | F.lower("file").contains(needle))
        order = [F.col("label"), F.col("region")]
    else:
        rows = index
        order = [F.desc("home"), F.desc("understood"), F.desc("centrality"), F.col("label"), F.col("region")]
    return top_rows(rows, ["project"], order, SEARCH_ROWS)


def community_groups(index: DataFrame) -> DataFrame:
    """Members of every community under the directory they all share.

    The shared prefix of a whole group equals that of its smallest and largest
    directory list, so two aggregates replace a pass over the members.
    """
    spans = index.groupBy("project", "community").agg(
        F.min(directories(F.col("file"))).alias("low"), F.max(directories(F.col("file"))).alias("high"),
        F.count("*").alias("size"))
    agree = F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.slice("low", 1, F.coalesce(
        F.when(F.array_position(agree, False) > 0, F.array_position(agree, False) - 1), F.size("low")).cast("int"))
    plain = F.concat(F.col("size").cast("string"), F.when(F.col("size") == 1, " module").otherwise(" modules"))
    named = spans.withColumn("prefix", F.array_join(shared, "/")).select(
        "project", "community", "size",
        F.when(F.col("prefix") != "", F.concat("prefix", F.lit("/"))).otherwise(plain).alias("name"))
    return index.select("project", "community", "region", "file").join(named, ["project", "community"]).select(
        "project", "community", "size", "name", "region",
        F.when(F.col("name").endswith("/") & F.startswith("file", "name"), F.substring(F.col("file"), F.length("name") + 1, F.length("file")))
        .otherwise(F.col("file")).alias("display"))


def revealed(
    regions: DataFrame, region_edges: DataFrame, hops: DataFrame, seeds: DataFrame, show_all: bool = False
) -> DataFrame:
    """Regions on the map: near home, earned, or next to earned.

    ``seeds(project, region)`` are understood, visited and selected regions.
    Projects without a home show everything.
    """
    every = regions.select("project", "region")
    if show_all:
        return every
    homes = regions.where("home").select("project").distinct()
    open_projects = every.join(homes, "project", "left_anti")
    near = hops.where(F.col("hops") <= REVEAL_HOPS).select("project", "region")
    seed = seeds.select("project", "region").distinct().join(homes, "project", "left_semi")
    ends = region_edges.select("project", "src", "dst")
    after = ends.join(seed.withColumnRenamed("region", "src"), ["project", "src"]).select("project", F.col("dst").alias("region"))
    before = ends.join(seed.withColumnRenamed("region", "dst"), ["project", "dst"]).select("project", F.col("src").alias("region"))
    return open_projects.unionByName(near).unionByName(seed).unionByName(after).unionByName(before).distinct()


def next_hint(regions: DataFrame, nodes: DataFrame, hops: DataFrame, understood_regions: DataFrame) -> DataFrame:
    """The nearest region not yet understood; tests count as further away.

    NULL distances sort last but are reported as NULL.
    """
    open_rows = regions.join(understood_regions.select("project", "region").distinct(), ["project", "region"], "left_anti")
    keyed = open_rows.join(region_files(nodes), ["project", "region"]).join(hops, ["project", "region"]).withColumn(
        "biased", F.when(is_learner_test_scoped(F.col("file")), F.col("hops") + TEST_HOP_PENALTY).otherwise(
            F.col("hops").cast("double")))
    best = F.struct(F.col("biased").isNull().alias("far"), F.col("biased"), (-F.col("node_count")).alias("n"), F.col("region"))
    return keyed.groupBy("project").agg(F.min(F.struct(best.alias("key"), F.col("hops"), F.col("node_count"))).alias("h")).select(
        "project", F.col("h.key.region").alias("region"), F.col("h.hops").alias("hops"), F.col("h.node_count").alias("structures"))


def shared_top(files: DataFrame) -> DataFrame:
    """The first path segment all files of a project share, or NULL."""
    seg = F.element_at(segments(F.col("file")), 1)
    return files.groupBy("project").agg(F.min(seg).alias("low"), F.max(seg).alias("high"), F.count("*").alias("n"), F.count(seg).alias("k")).select(
        "project", F.when((F.col("low") == F.col("high")) & (F.col("n") == F.col("k")), F.col("low")).alias("shared"))


def name_rank(rows: DataFrame) -> DataFrame:
    """Order of names on the map, 0 first. Needs home, understood, centrality."""
    weight = (
        F.when(F.col("home"), HOME_WEIGHT).otherwise(0) + F.when(F.col("understood"), UNDERSTOOD_WEIGHT).otherwise(0)
        + F.col("centrality") * CENTRALITY_WEIGHT)
    weighed = rows.select("project", "id", weight.cast("long").alias("weight"))
    return ordered_index(weighed, ["project"], [F.desc("weight"), F.col("id")], "name_rank")


def tier(understood: Column, partial: Column, centrality: Column, bright_at: int) -> Column:
    """Brightness class of a region or node."""
    return F.when(understood, "understood").when(partial, "partial").when(centrality >= bright_at, "bright").when(
        centrality >= 1, "mid").otherwise("dim")


def _scoped(nodes: DataFrame) -> DataFrame:
    scope = top_directory(F.col("file"), "")
    return candidates(nodes).withColumn("scope", F.when(scope == "", "project root").otherwise(F.concat(scope, F.lit("/"))))


def candidate_members(nodes: DataFrame) -> DataFrame:
    """One row per candidate: its scope, the scope's place by best rank, its rank, and whether the scope starts opened.

    Scopes are top-level directories; their places are per project, so only they are ordered in one group.
    """
    place = F.row_number().over(Window.partitionBy("project").orderBy("best_rank", "scope")).cast("int")
    scopes = candidate_scopes(nodes).select("project", "scope", place.alias("scope_place"), "open")
    return _scoped(nodes).join(scopes, ["project", "scope"]).select("project", "scope", "scope_place", "id", "entrypoint_rank", "open")


def candidate_scopes(nodes: DataFrame) -> DataFrame:
    """Candidates by top-level directory; which groups start opened."""
    groups = _scoped(nodes).groupBy("project", "scope").agg(
        F.min("entrypoint_rank").alias("best_rank"), F.count("*").alias("candidates"))
    leading = groups.groupBy("project").agg(F.min(F.struct("best_rank", "scope"))["scope"].alias("leading"))
    return groups.join(leading, "project").select(
        "project", "scope", "best_rank", "candidates",
        ((F.col("scope") == F.col("leading")) | (F.col("best_rank") == 0)).alias("open"))


def certainty_share(edges: DataFrame) -> DataFrame:
    """Call edges per project and how many of them are only possible."""
    return edges.where(F.col("kind") == "call").groupBy("project").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("certain")).alias("unproven")
    ).withColumn("unproven_share", F.col("unproven") / F.col("calls"))
