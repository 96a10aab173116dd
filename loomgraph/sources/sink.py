"""Writing tables in canonical order and canonical JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The total order of each table.
CANONICAL_ORDER = {
    "nodes": ["project", "id"],
    "edges": ["project", "src", "dst", "kind", "lineno", "certain", "external"],
    "concepts": ["project", "language", "node_id", "lineno", "concept", "end_lineno"],
    "regions": ["project", "region"],
    "region_edges": ["project", "src", "dst"],
    "files": ["project", "file"],
}


def canonical_json(table: DataFrame) -> DataFrame:
    """One JSON document per row: keys sorted, NULLs kept, same text every run."""
    keys = sorted(table.columns)
    return table.select("*", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("json"))


def write_json(table: DataFrame, name: str, path: str) -> None:
    """Sorted JSON lines; a range sort keeps the order across the part files."""
    ordered = canonical_json(table.orderBy(*CANONICAL_ORDER[name])).select("json")
    ordered.write.mode("errorifexists").text(path)


def write_parquet(table: DataFrame, name: str, path: str) -> None:
    """Parquet by project, clustered by the canonical order.

    Range partitioning on the whole key splits a large project over many files
    instead of sending each project to one writer.
    """
    order = CANONICAL_ORDER[name]
    table.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("project").parquet(path)
