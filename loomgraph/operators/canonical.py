"""Canonical nodes and edges, and the roll-ups built on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import is_test_scoped, parent_directory
from loomgraph.schema import CONCEPT_COLUMNS, EDGE_COLUMNS, NODE_COLUMNS


def _sole(count: Column, value: Column, message: str) -> Column:
    """``value`` when its key occurred once; the job fails otherwise."""
    return F.when(count == 1, value).otherwise(F.raise_error(F.concat(F.lit(message), value)))


def compose_nodes(parts: Sequence[DataFrame]) -> DataFrame:
    """Union node tables; a node id defined twice in a project is an error.

    The guard rides on the grouping key, so one shuffle both merges and checks.
    """
    whole = reduce(DataFrame.unionByName, parts)
    rest = [c for c in NODE_COLUMNS if c not in ("project", "id")]
    merged = whole.groupBy("project", "id").agg(
        F.count("*").alias("_n"), F.min(F.struct(*rest)).alias("_row")
    )
    return merged.select(
        "project", _sole(F.col("_n"), F.col("id"), "duplicate node id: ").alias("id"), "_row.*"
    ).select(*NODE_COLUMNS)


def compose_files(parts: Sequence[DataFrame]) -> DataFrame:
    """Union file tables; two different hashes for one file are an error."""
    whole = reduce(DataFrame.unionByName, parts)
    merged = whole.groupBy("project", "file").agg(
        F.min("language").alias("language"), F.min("sha256").alias("sha256"),
        F.max("sha256").alias("_other"),
    )
    clash = F.when(F.col("sha256") == F.col("_other"), 1).otherwise(2)
    return merged.select(
        "project", _sole(clash, F.col("file"), "conflicting content for file: ").alias("file"),
        "language", "sha256",
    )


def dedup_edges(edges: DataFrame) -> DataFrame:
    return edges.select(*EDGE_COLUMNS).distinct()


def dedup_concepts(concepts: DataFrame) -> DataFrame:
    return concepts.select(*CONCEPT_COLUMNS).distinct()


@dataclass(frozen=True)
class Graph:
    """What one language's extraction gives: its nodes, edges, concepts, files, and the files it could not read in full."""

    nodes: DataFrame
    edges: DataFrame
    concepts: DataFrame
    files: DataFrame
    partial_files: DataFrame


def compose_edges(parts: Sequence[DataFrame]) -> DataFrame:
    """Union edge tables; an edge that several parts saw is one."""
    return dedup_edges(reduce(DataFrame.unionByName, [p.select(*EDGE_COLUMNS) for p in parts]))


def compose_concepts(parts: Sequence[DataFrame]) -> DataFrame:
    return dedup_concepts(reduce(DataFrame.unionByName, [p.select(*CONCEPT_COLUMNS) for p in parts]))


def compose_partial_files(parts: Sequence[DataFrame]) -> DataFrame:
    """A file is partial if any part found it so."""
    return reduce(DataFrame.unionByName, [p.select("project", "file") for p in parts]).distinct()


def compose_unsupported(parts: Sequence[DataFrame]) -> DataFrame:
    """Unsupported files by extension, added up over separate scans."""
    whole = reduce(DataFrame.unionByName, [p.select("project", "ext", "language", "count") for p in parts])
    return whole.groupBy("project", "ext", "language").agg(F.sum("count").alias("count"))


def compose(graphs: Sequence[Graph]) -> Graph:
    """One graph of several languages' graphs. Repeated node ids and files with two contents are errors."""
    return Graph(
        compose_nodes([g.nodes for g in graphs]), compose_edges([g.edges for g in graphs]), compose_concepts([g.concepts for g in graphs]),
        compose_files([g.files for g in graphs]), compose_partial_files([g.partial_files for g in graphs]))


def internal_edges(edges: DataFrame, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """Edges that stay in the project: not external, and both ends are nodes."""
    kept = edges.where(~F.col("external"))
    if kind is not None:
        kept = kept.where(F.col("kind") == kind)
    ids = nodes.select("project", "id")
    return kept.join(
        ids.withColumnRenamed("id", "dst"), ["project", "dst"], "left_semi"
    ).join(ids.withColumnRenamed("id", "src"), ["project", "src"], "left_semi")


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct callers of every node; certainty is ignored, self-calls count.

    Callers are made distinct first on (dst, src), so a target with very many
    call sites is spread over its callers before it is counted.
    """
    calls = edges.where((F.col("kind") == "call") & ~F.col("external"))
    counted = (
        calls.select("project", F.col("dst").alias("id"), "src").distinct()
        .groupBy("project", "id").agg(F.count("*").alias("centrality"))
    )
    return (
        nodes.select("project", "id").join(counted, ["project", "id"], "left")
        .select("project", "id", F.coalesce("centrality", F.lit(0)).alias("centrality"))
    )


def candidates(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("entrypoint_rank").isNotNull()).select(
        "project", "id", "region", "file", "entrypoint_rank",
        is_test_scoped(F.col("file")).alias("is_test"),
    )


def home_select(nodes: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """One row per project with a candidate: the home node, or NULL on a tie.

    ``choices(project, id)`` overrides the ranking and must name a candidate.
    """
    pool = candidates(nodes)
    key = F.struct("is_test", "entrypoint_rank")
    tied = pool.groupBy("project", "is_test", "entrypoint_rank").agg(
        F.count("*").alias("n"), F.min("id").alias("id")
    )
    best = tied.groupBy("project").agg(F.min_by(F.struct("n", "id"), key).alias("best"))
    ranked = best.select("project", F.when(F.col("best.n") == 1, F.col("best.id")).alias("home"))
    if choices is None:
        return ranked
    wanted = choices.select("project", F.col("id").alias("chosen"))
    known = pool.select("project", F.col("id").alias("chosen"), F.lit(True).alias("known"))
    checked = wanted.join(known, ["project", "chosen"], "left").select(
        "project",
        F.when(F.col("known"), F.col("chosen")).otherwise(
            F.raise_error(F.concat(F.lit("not a ranked candidate: "), F.col("chosen")))
        ).alias("chosen"),
    )
    return ranked.join(checked, "project", "full_outer").select(
        "project", F.coalesce("chosen", "home").alias("home")
    )


def _region_totals(rows: DataFrame, nodes: DataFrame, homes: DataFrame, *more: Column) -> DataFrame:
    """Per region of ``rows`` (nodes): language, loc, ``more``, node_count and whether it holds the home."""
    module = F.col("kind") == "module"
    totals = rows.groupBy("project", "region").agg(
        F.min_by("language", F.struct(~module, F.col("id"))).alias("language"),
        F.sum(F.when(module, F.col("loc")).otherwise(0)).alias("module_loc"),
        F.sum("loc").alias("all_loc"),
        *more,
        F.count("*").alias("node_count"),
    )
    home_region = homes.where(F.col("home").isNotNull()).join(
        nodes.select("project", F.col("id").alias("home"), "region"), ["project", "home"]
    ).select("project", "region", F.lit(True).alias("is_home"))
    added = totals.columns[5:-1]
    return totals.join(home_region, ["project", "region"], "left").select(
        "project", "region", "language",
        F.when(F.col("module_loc") != 0, F.col("module_loc")).otherwise(F.col("all_loc")).alias("loc"),
        *added, "node_count", F.coalesce("is_home", F.lit(False)).alias("home"),
    )


def region_rollup(nodes: DataFrame, central: DataFrame, homes: DataFrame) -> DataFrame:
    return _region_totals(nodes.join(central, ["project", "id"]), nodes, homes, F.sum("centrality").alias("centrality"))


def region_outline(nodes: DataFrame, homes: DataFrame) -> DataFrame:
    """``region_rollup`` without centrality, which alone needs the edges."""
    return _region_totals(nodes, nodes, homes)


def region_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Imports between regions; a route is certain only if every import is."""
    where = nodes.select("project", "id", "region")
    imports = edges.where((F.col("kind") == "import") & ~F.col("external")).select(
        "project", "src", "dst", "certain"
    )
    ends = imports.join(
        where.select("project", F.col("id").alias("src"), F.col("region").alias("src_region")), ["project", "src"]
    ).join(
        where.select("project", F.col("id").alias("dst"), F.col("region").alias("dst_region")), ["project", "dst"]
    )
    return (
        ends.where(F.col("src_region") != F.col("dst_region"))
        .groupBy("project", F.col("src_region").alias("src"), F.col("dst_region").alias("dst"))
        .agg(F.count("*").alias("weight"), F.bool_and("certain").alias("certain"))
    )


def call_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per calling pair; a pair is certain as soon as one call is."""
    pairs = (
        edges.where((F.col("kind") == "call") & ~F.col("external") & (F.col("src") != F.col("dst")))
        .groupBy("project", "src", "dst").agg(F.bool_or("certain").alias("certain"))
    )
    ids = nodes.select("project", "id")
    return pairs.join(ids.withColumnRenamed("id", "dst"), ["project", "dst"], "left_semi").join(
        ids.withColumnRenamed("id", "src"), ["project", "src"], "left_semi"
    ).select("project", "src", "dst", "certain")


def degree(edges: DataFrame) -> DataFrame:
    """Edge counts per end: one pass, both ends counted in the same shuffle."""
    ends = edges.select(
        "project",
        F.explode(F.array(
            F.struct(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")),
            F.struct(F.col("dst").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")),
        )).alias("e"),
    )
    return ends.groupBy("project", F.col("e.id").alias("id")).agg(
        F.sum("e.in").alias("used_by"), F.sum("e.out").alias("uses")
    )


def node_degree(edges: DataFrame) -> DataFrame:
    return degree(edges.where(~F.col("external")))


def directory_groups(nodes: DataFrame) -> DataFrame:
    """Region membership by directory, as rows so a large directory stays spread.

    A region without a module node is grouped by its own id, read as a path.
    """
    regions = nodes.groupBy("project", "region").agg(
        F.max_by(
            F.when(F.col("kind") == "module", F.col("file")),
            F.when(F.col("kind") == "module", F.col("id")),
        ).alias("file")
    )
    return regions.select(
        "project", parent_directory(F.coalesce("file", "region")).alias("directory"), "region"
    )
