"""Queries l1 to l14."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import progress, reporting as ops
from loomgraph.operators.analytics import import_layers, unreached_nodes, unreached_regions
from loomgraph.operators.canonical import candidates
from loomgraph.plans import views
from loomgraph.plans.oracle_base import (
    CANDIDATES, CENTRAL, CONCEPT_ROWS, EDGES, FILES, HOPS, NEIGHBORS, NODES, PROGRESS, REGION_EDGES, REGIONS,
    SIGNATURES, with_tables,
)
from loomgraph.plans.queries.analytics import _CYCLES, _IMPORT_LAYERS, _workflow, COMMUNITIES
from loomgraph.plans.warehouse import Warehouse
from loomgraph.sources.corpus import unsupported_tally

LANGUAGE = "typescript"


def l1_focus_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return ops.focus_nodes(Warehouse(spark, folder).nodes, LANGUAGE).select("project", "id", "region", "file")


def l1_focus_edges(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.focus_edges(w.nodes, w.edges, LANGUAGE)


def l1_focus_region_edges(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.focus_region_edges(w.region_edges, w.nodes, LANGUAGE)


def l1_focus_concepts(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.focus_concepts(w.concepts, w.nodes, LANGUAGE)


def l1_focus_files(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.focus_files(w.files, w.nodes, LANGUAGE)


def l1_focus_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Of Go, as no TypeScript module is a candidate here."""
    w = Warehouse(spark, folder)
    return ops.focus_candidates(candidates(w.nodes).select("project", "id"), w.nodes, "go")


def l1_focus_home(spark: SparkSession, folder: str) -> DataFrame:
    """Under every language: homes are of one, so other foci have none."""
    w = Warehouse(spark, folder)
    return ops.focus_home(w.homes, w.nodes, "python").withColumn("focus", F.lit("python")).unionByName(
        ops.focus_home(w.homes, w.nodes, LANGUAGE).withColumn("focus", F.lit(LANGUAGE)))


def l1_focus_partial_files(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.focus_files(ops.partial_files(w.nodes), w.nodes, LANGUAGE)


def _layers(w: Warehouse) -> DataFrame:
    return import_layers(w.outline, w.region_edges, w.components)


def l1_focus_map(spark: SparkSession, folder: str) -> DataFrame:
    """Map boxes keep their layer; only other languages' boxes go."""
    w = Warehouse(spark, folder)
    return ops.focus_boxes(_layers(w), w.outline, LANGUAGE)


def l1_focus_map_edges(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.focus_box_edges(w.region_edges, w.outline, LANGUAGE).select("project", "src", "dst", "weight")


def l1_focus_map_unreachable(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.focus_boxes(unreached_regions(_layers(w)), w.outline, LANGUAGE)


def l1_focus_workflow(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.focus_rows(w.workflow, w.nodes, LANGUAGE)


def l1_focus_workflow_unreachable(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.focus_rows(unreached_nodes(w.nodes, w.workflow), w.nodes, LANGUAGE)


def l2_language_options(spark: SparkSession, folder: str) -> DataFrame:
    return ops.language_options(Warehouse(spark, folder).outline)


def l3_concept_chart(spark: SparkSession, folder: str) -> DataFrame:
    """Studied: nodes of visited regions; understood: nodes of understood ones."""
    w = Warehouse(spark, folder)
    ids = w.nodes.select("project", "region", F.col("id").alias("node_id"))
    return ops.concept_chart(
        w.concepts, ids.join(w.visited, ["project", "region"], "left_semi"),
        ids.join(w.understood, ["project", "region"], "left_semi"))


def l4_project_overview(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.project_overview(w.regions, w.nodes, w.understood, unsupported_tally(views.other_files(spark, folder)))


def module_index(w: Warehouse) -> DataFrame:
    return ops.module_index(w.regions, w.nodes, w.communities, w.hops, w.understood)


def l5_module_index(spark: SparkSession, folder: str) -> DataFrame:
    return module_index(Warehouse(spark, folder))


def l6_module_search(spark: SparkSession, folder: str) -> DataFrame:
    return ops.module_search(module_index(Warehouse(spark, folder)), " Order_1").select(
        "project", "region", "label", "place")


def l6_module_search_empty(spark: SparkSession, folder: str) -> DataFrame:
    return ops.module_search(module_index(Warehouse(spark, folder)), "").select(
        "project", "region", "label", "place")


def l7_community_groups(spark: SparkSession, folder: str) -> DataFrame:
    return ops.community_groups(module_index(Warehouse(spark, folder)))


def l8_revealed(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    seeds = w.understood.select("project", "region").unionByName(w.visited.select("project", "region"))
    return ops.revealed(w.outline, w.region_edges, w.hops, seeds)


def l9_next_hint(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.next_hint(w.outline, w.nodes, w.hops, w.understood)


def l10_shared_top(spark: SparkSession, folder: str) -> DataFrame:
    """Over the files of each language of each project."""
    files = Warehouse(spark, folder).files
    keyed = files.select(F.concat_ws(":", "project", "language").alias("project"), "file")
    return ops.shared_top(keyed)


def _hydrated_regions(w: Warehouse) -> DataFrame:
    return progress.hydrate(w.regions, w.understood)


def l11_name_rank(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.name_rank(_hydrated_regions(w).withColumnRenamed("region", "id"))


def l12_region_tier(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    broken = w.nodes.where("partial").select("project", "region").distinct().withColumn("broken", F.lit(True))
    rows = _hydrated_regions(w).join(broken, ["project", "region"], "left")
    return rows.select("project", "region", ops.tier(
        F.col("understood"), F.col("broken"), F.col("centrality"), ops.REGION_BRIGHT).alias("tier"))


def l12_node_tier(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    rows = progress.hydrate(w.nodes.join(w.central, ["project", "id"]), w.understood)
    return rows.select("project", "id", ops.tier(
        F.col("understood"), F.col("partial"), F.col("centrality"), ops.NODE_BRIGHT).alias("tier"))


def l13_candidate_scopes(spark: SparkSession, folder: str) -> DataFrame:
    return ops.candidate_scopes(Warehouse(spark, folder).nodes)


def l13_candidate_members(spark: SparkSession, folder: str) -> DataFrame:
    return ops.candidate_members(Warehouse(spark, folder).nodes)


def l14_certainty_share(spark: SparkSession, folder: str) -> DataFrame:
    return ops.certainty_share(Warehouse(spark, folder).edges)


QUERIES = {
    "l1_focus_nodes": l1_focus_nodes,
    "l1_focus_edges": l1_focus_edges,
    "l1_focus_region_edges": l1_focus_region_edges,
    "l1_focus_concepts": l1_focus_concepts,
    "l1_focus_files": l1_focus_files,
    "l1_focus_candidates": l1_focus_candidates,
    "l1_focus_home": l1_focus_home,
    "l1_focus_partial_files": l1_focus_partial_files,
    "l1_focus_map": l1_focus_map,
    "l1_focus_map_edges": l1_focus_map_edges,
    "l1_focus_map_unreachable": l1_focus_map_unreachable,
    "l1_focus_workflow": l1_focus_workflow,
    "l1_focus_workflow_unreachable": l1_focus_workflow_unreachable,
    "l2_language_options": l2_language_options,
    "l3_concept_chart": l3_concept_chart,
    "l4_project_overview": l4_project_overview,
    "l5_module_index": l5_module_index,
    "l6_module_search": l6_module_search,
    "l6_module_search_empty": l6_module_search_empty,
    "l7_community_groups": l7_community_groups,
    "l8_revealed": l8_revealed,
    "l9_next_hint": l9_next_hint,
    "l10_shared_top": l10_shared_top,
    "l11_name_rank": l11_name_rank,
    "l12_region_tier": l12_region_tier,
    "l12_node_tier": l12_node_tier,
    "l13_candidate_scopes": l13_candidate_scopes,
    "l13_candidate_members": l13_candidate_members,
    "l14_certainty_share": l14_certainty_share,
}

_ROLL = (NODES, EDGES, CENTRAL, CANDIDATES, REGION_EDGES, REGIONS)
_FULL = (*_ROLL, NEIGHBORS, HOPS, COMMUNITIES, SIGNATURES, PROGRESS)

_INDEX = """
lit AS MATERIALIZED (SELECT DISTINCT project, region FROM understood),
idx AS MATERIALIZED (SELECT r.project, r.region, f.file, regexp_extract(f.file, '([^/]+/)?[^/]+$') AS label, r.language,
    c.community, u.region IS NOT NULL AS understood, r.home, h.hops, r.centrality, r.loc
  FROM regions r JOIN (SELECT project, region, arg_min(file, id) AS file FROM nodes GROUP BY ALL) f
    ON f.project = r.project AND f.region = r.region
  JOIN communities c ON c.project = r.project AND c.region = r.region
  LEFT JOIN hops h ON h.project = r.project AND h.region = r.region
  LEFT JOIN lit u ON u.project = r.project AND u.region = r.region)"""

_LIT = """
lit AS MATERIALIZED (SELECT DISTINCT project, region FROM understood)"""

_I = with_tables(*_FULL, _INDEX)
_SEARCH = "SELECT project, region, label, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY "

SQL = {
    "l1_focus_nodes": with_tables(NODES) + "SELECT project, id, region, file FROM nodes WHERE language = 'typescript'",
    "l1_focus_edges": with_tables(NODES, EDGES) + """
      SELECT e.* FROM edges e JOIN nodes s ON s.project = e.project AND s.id = e.src AND s.language = 'typescript'
      LEFT JOIN nodes d ON d.project = e.project AND d.id = e.dst
      WHERE d.id IS NULL OR d.language = 'typescript' OR e.external""",
    "l1_focus_region_edges": with_tables(NODES, EDGES, REGION_EDGES) + """
      SELECT * FROM region_edges e
      WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.project = e.project AND n.region = e.src AND n.language = 'typescript')
        AND EXISTS (SELECT 1 FROM nodes n WHERE n.project = e.project AND n.region = e.dst AND n.language = 'typescript')""",
    "l1_focus_concepts": with_tables(NODES, CONCEPT_ROWS) + """
      SELECT c.* FROM concepts c JOIN nodes n ON n.project = c.project AND n.id = c.node_id
      WHERE c.language = 'typescript' AND n.language = 'typescript'""",
    "l1_focus_files": with_tables(NODES, FILES) + """
      SELECT f.* FROM files f WHERE EXISTS (
        SELECT 1 FROM nodes n WHERE n.project = f.project AND n.file = f.file AND n.language = 'typescript')""",
    "l1_focus_candidates": with_tables(NODES, CANDIDATES) + """
      SELECT c.project, c.id FROM candidates c JOIN nodes n ON n.project = c.project AND n.id = c.id WHERE n.language = 'go'""",
    "l1_focus_home": with_tables(NODES, CANDIDATES) + """
      SELECT h.project, CASE WHEN n.language = focus THEN h.home END AS home, focus
      FROM home h LEFT JOIN nodes n ON n.project = h.project AND n.id = h.home, (VALUES ('python'), ('typescript')) f(focus)""",
    "l1_focus_partial_files": with_tables(NODES) + """
      SELECT DISTINCT project, file FROM nodes WHERE partial AND language = 'typescript'""",
    "l1_focus_map": with_tables(*_ROLL, _CYCLES, _IMPORT_LAYERS, recursive=True) + """
      SELECT l.* FROM import_layers l JOIN regions r ON r.project = l.project AND r.region = l.region WHERE r.language = 'typescript'""",
    "l1_focus_map_edges": with_tables(*_ROLL) + """
      SELECT e.project, e.src, e.dst, e.weight FROM region_edges e
      JOIN regions a ON a.project = e.project AND a.region = e.src AND a.language = 'typescript'
      JOIN regions b ON b.project = e.project AND b.region = e.dst AND b.language = 'typescript'""",
    "l1_focus_map_unreachable": with_tables(*_ROLL, _CYCLES, _IMPORT_LAYERS, recursive=True) + """
      SELECT l.project, l.region FROM import_layers l JOIN regions r ON r.project = l.project AND r.region = l.region
      WHERE r.language = 'typescript' AND NOT l.reachable""",
    "l1_focus_workflow": with_tables(NODES, EDGES, CANDIDATES, _workflow()) + """
      SELECT w.* FROM workflow w JOIN nodes n ON n.project = w.project AND n.id = w.id WHERE n.language = 'typescript'""",
    "l1_focus_workflow_unreachable": with_tables(NODES, EDGES, CANDIDATES, _workflow()) + """
      SELECT n.project, n.id, n.language FROM nodes n WHERE n.language = 'typescript'
      AND NOT EXISTS (SELECT 1 FROM workflow w WHERE w.project = n.project AND w.id = n.id)""",
    "l2_language_options": with_tables(*_ROLL) + """
      SELECT project, language, count(*) AS regions FROM regions GROUP BY ALL
      UNION ALL SELECT project, 'all', count(*) FROM regions GROUP BY project""",
    "l3_concept_chart": with_tables(NODES, CONCEPT_ROWS, SIGNATURES, PROGRESS) + """
      SELECT c.project, c.language, c.concept, count(*) AS occurrences, count(DISTINCT c.node_id) AS nodes,
        count(DISTINCT CASE WHEN v.region IS NOT NULL THEN c.node_id END) AS studied_nodes,
        count(DISTINCT CASE WHEN u.region IS NOT NULL THEN c.node_id END) AS understood_nodes
      FROM concepts c LEFT JOIN nodes n ON n.project = c.project AND n.id = c.node_id
      LEFT JOIN (SELECT DISTINCT project, region FROM visited) v ON v.project = n.project AND v.region = n.region
      LEFT JOIN (SELECT DISTINCT project, region FROM understood) u ON u.project = n.project AND u.region = n.region
      GROUP BY ALL""",
    "l4_project_overview": with_tables(*_ROLL, SIGNATURES, PROGRESS, _LIT) + """
      SELECT r.project, r.modules, n.structures, r.lines, g.languages, r.home, b.biggest, y.busiest, n.unreadable,
        coalesce(x.unsupported, 0) AS unsupported, coalesce(u.understood, 0) AS understood
      FROM (SELECT project, count(*) AS modules, CAST(sum(loc) AS BIGINT) AS lines, max(CASE WHEN home THEN region END) AS home
        FROM regions GROUP BY project) r
      JOIN (SELECT project, count(*) AS structures, count(DISTINCT CASE WHEN partial THEN file END) AS unreadable
        FROM nodes GROUP BY project) n ON n.project = r.project
      JOIN (SELECT project, string_agg(language || ':' || k, '|' ORDER BY k DESC, language) AS languages FROM (
        SELECT project, language, count(*) AS k FROM regions GROUP BY ALL) GROUP BY project) g ON g.project = r.project
      JOIN (SELECT project, string_agg(region || ':' || loc, '|' ORDER BY loc DESC, region) AS biggest FROM (
        SELECT *, row_number() OVER (PARTITION BY project ORDER BY loc DESC, region) AS p FROM regions) WHERE p <= 5
        GROUP BY project) b ON b.project = r.project
      JOIN (SELECT project, string_agg(region || ':' || centrality, '|' ORDER BY centrality DESC, region) AS busiest FROM (
        SELECT *, row_number() OVER (PARTITION BY project ORDER BY centrality DESC, region) AS p FROM regions) WHERE p <= 5
        GROUP BY project) y ON y.project = r.project
      LEFT JOIN (SELECT r_name AS project, count(*) AS unsupported FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE') GROUP BY r_name) x ON x.project = r.project
      LEFT JOIN (SELECT l.project, count(*) AS understood FROM lit l JOIN regions r ON r.project = l.project AND r.region = l.region
        GROUP BY l.project) u ON u.project = r.project""",
    "l5_module_index": _I + "SELECT * FROM idx",
    "l6_module_search": _I + _SEARCH + """label, region) AS place FROM idx
      WHERE contains(lower(label), 'order_1') OR contains(lower(file), 'order_1')) WHERE place <= 60""",
    "l6_module_search_empty": _I + _SEARCH + """home DESC, understood DESC, centrality DESC, label, region) AS place FROM idx)
      WHERE place <= 60""",
    "l7_community_groups": _I + """,
      dirs AS (SELECT *, list_slice(string_split(file, '/'), 1, len(string_split(file, '/')) - 1) AS d FROM idx),
      spans AS (SELECT project, community, min(d) AS lo, max(d) AS hi, count(*) AS size FROM dirs GROUP BY ALL),
      named AS (SELECT project, community, size, CASE WHEN prefix <> '' THEN prefix || '/'
          ELSE size || CASE WHEN size = 1 THEN ' module' ELSE ' modules' END END AS name
        FROM (SELECT *, array_to_string(list_slice(lo, 1, coalesce(list_position(
            [lo[i] IS NOT DISTINCT FROM hi[i] FOR i IN range(1, greatest(len(lo), len(hi)) + 1)], false) - 1, len(lo))), '/') AS prefix
          FROM spans))
      SELECT i.project, i.community, n.size, n.name, i.region,
        CASE WHEN n.name LIKE '%/' AND starts_with(i.file, n.name) THEN substr(i.file, length(n.name) + 1) ELSE i.file END AS display
      FROM idx i JOIN named n ON n.project = i.project AND n.community = i.community""",
    "l8_revealed": with_tables(*_ROLL, NEIGHBORS, HOPS, SIGNATURES, PROGRESS) + """,
      homed AS (SELECT DISTINCT project FROM regions WHERE home),
      seeds AS (SELECT project, region FROM understood UNION SELECT project, region FROM visited)
      SELECT project, region FROM regions WHERE project NOT IN (SELECT project FROM homed)
      UNION SELECT project, region FROM hops WHERE hops <= 2
      UNION SELECT project, region FROM seeds WHERE project IN (SELECT project FROM homed)
      UNION SELECT n.project, n.b FROM seeds s JOIN neighbors n ON n.project = s.project AND n.a = s.region
        WHERE s.project IN (SELECT project FROM homed)""",
    "l9_next_hint": _I + """
      SELECT project, region, hops, node_count AS structures FROM (
        SELECT r.project, r.region, i.hops, r.node_count, row_number() OVER (PARTITION BY r.project ORDER BY
          i.hops + CASE WHEN regexp_matches(i.file, '(^|/)(tests|test|__tests__|spec|specs)/') THEN 1.5 ELSE 0 END NULLS LAST,
          r.node_count DESC, r.region) AS p
        FROM regions r JOIN idx i ON i.project = r.project AND i.region = r.region WHERE NOT i.understood) WHERE p = 1""",
    "l10_shared_top": with_tables(NODES, FILES) + """
      SELECT project || ':' || language AS project, CASE WHEN count(DISTINCT split_part(file, '/', 1)) = 1
        THEN min(split_part(file, '/', 1)) END AS shared FROM files GROUP BY project, language""",
    "l11_name_rank": with_tables(*_ROLL, SIGNATURES, PROGRESS, _LIT) + """
      SELECT project, id, weight, row_number() OVER (PARTITION BY project ORDER BY weight DESC, id) - 1 AS name_rank FROM (
        SELECT r.project, r.region AS id, CAST(CASE WHEN home THEN 3000000 ELSE 0 END
          + CASE WHEN l.region IS NOT NULL THEN 1000000 ELSE 0 END + centrality * 1000 AS BIGINT) AS weight
        FROM regions r LEFT JOIN lit l ON l.project = r.project AND l.region = r.region)""",
    "l12_region_tier": with_tables(*_ROLL, SIGNATURES, PROGRESS, _LIT) + """
      SELECT r.project, r.region, CASE WHEN l.region IS NOT NULL THEN 'understood'
        WHEN EXISTS (SELECT 1 FROM nodes n WHERE n.project = r.project AND n.region = r.region AND n.partial) THEN 'partial'
        WHEN centrality >= 5 THEN 'bright' WHEN centrality >= 1 THEN 'mid' ELSE 'dim' END AS tier
      FROM regions r LEFT JOIN lit l ON l.project = r.project AND l.region = r.region""",
    "l12_node_tier": with_tables(*_ROLL, SIGNATURES, PROGRESS, _LIT) + """
      SELECT n.project, n.id, CASE WHEN l.region IS NOT NULL THEN 'understood' WHEN n.partial THEN 'partial'
        WHEN centrality >= 2 THEN 'bright' WHEN centrality >= 1 THEN 'mid' ELSE 'dim' END AS tier
      FROM nodes n JOIN central c ON c.project = n.project AND c.id = n.id
      LEFT JOIN lit l ON l.project = n.project AND l.region = n.region""",
    "l13_candidate_scopes": with_tables(NODES, CANDIDATES) + """,
      groups AS (SELECT project, CASE WHEN file LIKE '%/%' THEN split_part(file, '/', 1) || '/' ELSE 'project root' END AS scope,
        min(entrypoint_rank) AS best_rank, count(*) AS candidates FROM candidates GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY project ORDER BY best_rank, scope) = 1 OR best_rank = 0 AS open FROM groups""",
    "l13_candidate_members": with_tables(NODES, CANDIDATES) + """,
      scoped AS (SELECT *, CASE WHEN file LIKE '%/%' THEN split_part(file, '/', 1) || '/' ELSE 'project root' END AS scope FROM candidates),
      groups AS (SELECT project, scope, min(entrypoint_rank) AS best FROM scoped GROUP BY ALL),
      placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY best, scope) AS INTEGER) AS scope_place FROM groups)
      SELECT s.project, s.scope, p.scope_place, s.id, s.entrypoint_rank, p.scope_place = 1 OR p.best = 0 AS open
      FROM scoped s JOIN placed p ON p.project = s.project AND p.scope = s.scope""",
    "l14_certainty_share": with_tables(NODES, EDGES) + """
      SELECT project, count(*) AS calls, count(*) FILTER (NOT certain) AS unproven,
        count(*) FILTER (NOT certain) / count(*) AS unproven_share FROM edges WHERE kind = 'call' GROUP BY project""",
}
