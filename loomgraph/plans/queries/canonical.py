"""Queries g1 to g12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.functions.hashing import hash_fraction
from loomgraph.operators import canonical as ops
from loomgraph.plans import views
from loomgraph.plans.warehouse import Warehouse
from loomgraph.plans.oracle_base import (
    CANDIDATES, CENTRAL, CONCEPT_ROWS, EDGES, NODES, REGION_EDGES, REGIONS, with_tables,
)
from loomgraph.sources.corpus import unsupported_tally


def g1_compose(spark: SparkSession, folder: str) -> DataFrame:
    nodes = Warehouse(spark, folder).nodes
    return ops.compose_nodes([nodes.where(F.pmod(F.hash("project", "id"), F.lit(3)) == part) for part in range(3)])


def g1_compose_files(spark: SparkSession, folder: str) -> DataFrame:
    files = Warehouse(spark, folder).files
    return ops.compose_files([files.where(F.pmod(F.hash("project", "file"), F.lit(3)) == part) for part in range(3)])


def _languages(w: Warehouse) -> ops.Graph:
    """The graph composed of one part per language; edges belong to the language of their source."""
    parts = []
    for language in ("python", "typescript", "go"):
        nodes = w.nodes.where(F.col("language") == language)
        own = nodes.select("project", F.col("id").alias("src"))
        partial = nodes.where("partial").select("project", "file")
        parts.append(ops.Graph(nodes, w.raw_edges.join(own, ["project", "src"], "left_semi"), w.concepts.where(F.col("language") == language),
                               w.files.where(F.col("language") == language), partial))
    return ops.compose(parts)


def g1_compose_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _languages(Warehouse(spark, folder)).edges


def g1_compose_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return _languages(Warehouse(spark, folder)).concepts


def g1_compose_partial_files(spark: SparkSession, folder: str) -> DataFrame:
    return _languages(Warehouse(spark, folder)).partial_files


def g1_compose_unsupported(spark: SparkSession, folder: str) -> DataFrame:
    """Two scans of other files, by extension, added up."""
    files = views.other_files(spark, folder)
    return ops.compose_unsupported([unsupported_tally(files.where(F.pmod(F.hash("path"), F.lit(2)) == part)) for part in range(2)])


def g2_dedup_edges(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dedup_edges(Warehouse(spark, folder).raw_edges)


def g2_dedup_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dedup_concepts(Warehouse(spark, folder).concepts)


def g3_centrality(spark: SparkSession, folder: str) -> DataFrame:
    return ops.centrality(Warehouse(spark, folder).nodes, Warehouse(spark, folder).raw_calls)


def g4_test_scope(spark: SparkSession, folder: str) -> DataFrame:
    files = Warehouse(spark, folder).files
    return files.select(
        "project", "file", paths.is_test_scoped(F.col("file")).alias("graph_test"),
        paths.is_learner_test_scoped(F.col("file")).alias("learner_test"),
    )


def g5_home_select(spark: SparkSession, folder: str) -> DataFrame:
    return ops.home_select(Warehouse(spark, folder).nodes)


def g6_region_rollup(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.region_rollup(w.nodes, ops.centrality(w.nodes, w.raw_calls), ops.home_select(w.nodes))


def g7_region_edges(spark: SparkSession, folder: str) -> DataFrame:
    return ops.region_edges(Warehouse(spark, folder).nodes, Warehouse(spark, folder).imports)


def g8_call_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return ops.call_pairs(Warehouse(spark, folder).nodes, Warehouse(spark, folder).raw_calls)


def g9_degree(spark: SparkSession, folder: str) -> DataFrame:
    return ops.degree(ops.region_edges(Warehouse(spark, folder).nodes, Warehouse(spark, folder).imports))


def g9_node_degree(spark: SparkSession, folder: str) -> DataFrame:
    return ops.node_degree(Warehouse(spark, folder).edges)


def g10_directory_groups(spark: SparkSession, folder: str) -> DataFrame:
    return ops.directory_groups(Warehouse(spark, folder).nodes)


def g11_path_tail(spark: SparkSession, folder: str) -> DataFrame:
    files = Warehouse(spark, folder).files
    return files.select("project", "file", paths.path_tail(F.col("file")).alias("label"))


def g12_hash_fraction(spark: SparkSession, folder: str) -> DataFrame:
    nodes = Warehouse(spark, folder).nodes
    return nodes.select("project", "id", hash_fraction(F.col("id"), "sample").alias("fraction"))


QUERIES = {
    "g1_compose": g1_compose,
    "g1_compose_files": g1_compose_files,
    "g1_compose_edges": g1_compose_edges,
    "g1_compose_concepts": g1_compose_concepts,
    "g1_compose_partial_files": g1_compose_partial_files,
    "g1_compose_unsupported": g1_compose_unsupported,
    "g2_dedup_edges": g2_dedup_edges,
    "g2_dedup_concepts": g2_dedup_concepts,
    "g3_centrality": g3_centrality,
    "g4_test_scope": g4_test_scope,
    "g5_home_select": g5_home_select,
    "g6_region_rollup": g6_region_rollup,
    "g7_region_edges": g7_region_edges,
    "g8_call_pairs": g8_call_pairs,
    "g9_degree": g9_degree,
    "g9_node_degree": g9_node_degree,
    "g10_directory_groups": g10_directory_groups,
    "g11_path_tail": g11_path_tail,
    "g12_hash_fraction": g12_hash_fraction,
}

from loomgraph.plans.oracle_base import CONCEPT_ROWS, FILES  # noqa: E402

_N = with_tables(NODES)
_NE = with_tables(NODES, EDGES)

SQL = {
    "g1_compose": _N + "SELECT * FROM nodes",
    "g1_compose_files": with_tables(NODES, FILES) + "SELECT * FROM files",
    "g1_compose_edges": with_tables(NODES, EDGES) + "SELECT * FROM edges",
    "g1_compose_concepts": with_tables(NODES, CONCEPT_ROWS) + "SELECT * FROM concepts",
    "g1_compose_partial_files": with_tables(NODES) + "SELECT DISTINCT project, file FROM nodes WHERE partial",
    "g1_compose_unsupported": """
      SELECT r_name AS project, CASE c_mktsegment WHEN 'MACHINERY' THEN '.c' ELSE '.kt' END AS ext,
        CASE c_mktsegment WHEN 'MACHINERY' THEN 'C' ELSE 'Kotlin' END AS language, count(*) AS count
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE') GROUP BY ALL""",
    "g2_dedup_edges": _NE + "SELECT * FROM edges",
    "g2_dedup_concepts": with_tables(NODES, CONCEPT_ROWS) + "SELECT * FROM concepts",
    "g3_centrality": with_tables(NODES, EDGES, CENTRAL) + "SELECT * FROM central",
    "g4_test_scope": with_tables(NODES, FILES) + """
      SELECT project, file,
        regexp_matches(file, '(^|/)(tests|test|testing|__tests__|spec|__specs__)/')
          OR regexp_matches(regexp_replace(split_part(file, '/', -1), '\\.[^.]+$', ''), '^test_|_test$|^conftest$')
          AS graph_test,
        regexp_matches(file, '(^|/)(tests|test|__tests__|spec|specs)/') AS learner_test FROM files""",
    "g5_home_select": with_tables(NODES, CANDIDATES) + "SELECT project, home FROM home",
    "g6_region_rollup": with_tables(NODES, EDGES, CENTRAL, CANDIDATES, REGIONS) + "SELECT * FROM regions",
    "g7_region_edges": with_tables(NODES, EDGES, REGION_EDGES) + "SELECT * FROM region_edges",
    "g8_call_pairs": _NE + """
      SELECT e.project, src, dst, bool_or(certain) AS certain FROM edges e
      JOIN nodes a ON a.project = e.project AND a.id = src JOIN nodes b ON b.project = e.project AND b.id = dst
      WHERE e.kind = 'call' AND NOT external AND src <> dst GROUP BY ALL""",
    "g9_degree": with_tables(NODES, EDGES, REGION_EDGES) + """
      SELECT project, id, CAST(sum(i) AS BIGINT) AS used_by, CAST(sum(o) AS BIGINT) AS uses FROM (
        SELECT project, src AS id, 0 AS i, 1 AS o FROM region_edges
        UNION ALL SELECT project, dst, 1, 0 FROM region_edges) GROUP BY ALL""",
    "g9_node_degree": _NE + """
      SELECT project, id, CAST(sum(i) AS BIGINT) AS used_by, CAST(sum(o) AS BIGINT) AS uses FROM (
        SELECT project, src AS id, 0 AS i, 1 AS o FROM edges WHERE NOT external
        UNION ALL SELECT project, dst, 1, 0 FROM edges WHERE NOT external) GROUP BY ALL""",
    "g10_directory_groups": _N + """
      SELECT project, CASE WHEN file LIKE '%/%' THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END AS directory, region
      FROM nodes WHERE kind = 'module'""",
    "g11_path_tail": with_tables(NODES, FILES) + """
      SELECT project, file, regexp_extract(file, '([^/]+/)?[^/]+$') AS label FROM files""",
    "g12_hash_fraction": _N + """
      SELECT project, id, CAST(CAST('0x' || substr(sha256('sample:' || id), 1, 16) AS UBIGINT) AS DOUBLE)
        / 18446744073709551615.0::DOUBLE AS fraction FROM nodes""",
}
