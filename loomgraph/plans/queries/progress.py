"""Queries p1 to p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators import progress as ops
from loomgraph.plans.oracle_base import CANDIDATES, NODES, PROGRESS, SIGNATURES, with_tables
from loomgraph.plans.warehouse import Warehouse


def p1_signature(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.signatures(w.nodes, w.files)


def p2_understood(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.understood(w.events, w.signatures)


def p3_visited(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.visited(w.events, w.outline)


def p4_reset(spark: SparkSession, folder: str) -> DataFrame:
    return ops.after_reset(Warehouse(spark, folder).events).select(
        "event_id", "project", "learner_id", "type", "region", "signature")


def p5_preferences(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.preferences(w.events, w.homes, w.nodes)


def p6_hydrate(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.hydrate(w.nodes.select("project", "id", "region"), w.understood)


def p6_hydrate_regions(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.hydrate(w.outline.select("project", "region", "node_count"), w.understood)


def p7_recents(spark: SparkSession, folder: str) -> DataFrame:
    return ops.recents(Warehouse(spark, folder).events)


QUERIES = {
    "p1_signature": p1_signature,
    "p2_understood": p2_understood,
    "p3_visited": p3_visited,
    "p4_reset": p4_reset,
    "p5_preferences": p5_preferences,
    "p6_hydrate": p6_hydrate,
    "p6_hydrate_regions": p6_hydrate_regions,
    "p7_recents": p7_recents,
}

_LOG = with_tables(NODES, SIGNATURES, PROGRESS)

SQL = {
    "p1_signature": with_tables(NODES, SIGNATURES) + "SELECT * FROM signatures",
    "p2_understood": _LOG + "SELECT * FROM understood",
    "p3_visited": _LOG + "SELECT * FROM visited",
    "p4_reset": _LOG + "SELECT event_id, project, learner_id, type, region, signature FROM kept",
    "p5_preferences": with_tables(NODES, SIGNATURES, PROGRESS, CANDIDATES) + """
      SELECT p.learner_id, p.project, coalesce(a.v, b.v, 'easy') AS mode,
        coalesce(h.home, CASE WHEN c.id IS NOT NULL THEN s.v END) AS home
      FROM (SELECT DISTINCT learner_id, project FROM log) p
      LEFT JOIN (SELECT learner_id, project, arg_max(value, (ts, event_id)) AS v FROM log
        WHERE type = 'mode' AND value IN ('easy', 'expert') GROUP BY ALL) a
        ON a.learner_id = p.learner_id AND a.project = p.project
      LEFT JOIN (SELECT learner_id, arg_max(value, (ts, event_id)) AS v FROM log
        WHERE type = 'mode' AND value IN ('easy', 'expert') GROUP BY ALL) b ON b.learner_id = p.learner_id
      LEFT JOIN (SELECT learner_id, project, arg_max(value, (ts, event_id)) AS v FROM log WHERE type = 'home' GROUP BY ALL) s
        ON s.learner_id = p.learner_id AND s.project = p.project
      LEFT JOIN candidates c ON c.project = p.project AND c.id = s.v
      LEFT JOIN home h ON h.project = p.project""",
    "p6_hydrate": _LOG + """
      SELECT n.project, n.id, n.region, EXISTS (SELECT 1 FROM understood u
        WHERE u.project = n.project AND u.region = n.region) AS understood FROM nodes n""",
    "p6_hydrate_regions": _LOG + """
      SELECT n.project, n.region, count(*) AS node_count, EXISTS (SELECT 1 FROM understood u
        WHERE u.project = n.project AND u.region = n.region) AS understood FROM nodes n GROUP BY n.project, n.region""",
    "p7_recents": _LOG + """
      SELECT l.learner_id, l.project, last_ts, CAST(place AS INTEGER) AS place, coalesce(n, 0) AS understood_count FROM (
        SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY last_ts DESC, project) AS place FROM (
          SELECT learner_id, project, max(ts) AS last_ts FROM log GROUP BY ALL)) l
      LEFT JOIN (SELECT learner_id, project, count(*) AS n FROM proofs GROUP BY ALL) p
        ON p.learner_id = l.learner_id AND p.project = l.project
      WHERE place <= 8""",
}
