"""Learner progress as folds over an append-only event log.

Events: ``event_id, project, learner_id, ts, type, region, signature, value``
with type one of visit, pass_check, reset, mode, home.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.canonical import candidates
from loomgraph.plans.ranking import top_rows

# Fixed values.
MODES = ["easy", "expert"]
DEFAULT_MODE = "easy"
RECENT_PROJECTS = 8
MISSING = "missing"


def signatures(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Hash of every region's sorted (file, content hash) pairs.

    Files are hashed in buckets by their name's hash, and then the buckets, so
    no task holds more than one bucket of a region, whatever its size.
    """
    listed = nodes.select("project", "region", "file").distinct().join(
        files.select("project", "file", "sha256"), ["project", "file"], "left"
    ).select("project", "region", "file", F.coalesce("sha256", F.lit(MISSING)).alias("sha256"))

    def digest(keys: list[str], rows: DataFrame, first: str, second: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(first, second)))
        text = F.to_json(F.transform(pairs, lambda p: F.array(p[first], p[second])))
        return rows.groupBy("project", "region", *keys).agg(F.sha2(text, 256).alias("signature"))

    bucketed = listed.withColumn("bucket", F.substring(F.sha2("file", 256), 1, 4))
    buckets = digest(["bucket"], bucketed, "file", "sha256").withColumnRenamed("signature", "part")
    return digest([], buckets, "bucket", "part")


def _moment() -> F.Column:
    return F.struct("ts", "event_id")


def after_reset(events: DataFrame) -> DataFrame:
    """Visits and passes later than the learner's last reset of the project."""
    resets = events.where(F.col("type") == "reset").groupBy("learner_id", "project").agg(
        F.max(_moment()).alias("cleared"))
    return (
        events.where(F.col("type").isin("visit", "pass_check"))
        .join(resets, ["learner_id", "project"], "left")
        .where(F.col("cleared").isNull() | (_moment() > F.col("cleared"))).drop("cleared")
    )


def proofs(events: DataFrame) -> DataFrame:
    """The signature last stored for each region the learner proved."""
    return after_reset(events).where(F.col("type") == "pass_check").groupBy("learner_id", "project", "region").agg(
        F.max_by("signature", _moment()).alias("signature"))


def understood(events: DataFrame, signature_rows: DataFrame) -> DataFrame:
    """Proofs that still hold: the region's files have not changed since."""
    return proofs(events).join(signature_rows, ["project", "region", "signature"], "left_semi").select(
        "learner_id", "project", "region")


def visited(events: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions the learner has been to that still exist."""
    seen = after_reset(events).where(F.col("type") == "visit").select("learner_id", "project", "region").distinct()
    return seen.join(regions.select("project", "region"), ["project", "region"], "left_semi").select(
        "learner_id", "project", "region")


def preferences(events: DataFrame, homes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mode and home per learner and project."""
    pairs = events.select("learner_id", "project").distinct()
    modes = events.where((F.col("type") == "mode") & F.col("value").isin(*MODES))
    here = modes.groupBy("learner_id", "project").agg(F.max_by("value", _moment()).alias("here"))
    anywhere = modes.groupBy("learner_id").agg(F.max_by("value", _moment()).alias("anywhere"))
    saved = events.where(F.col("type") == "home").groupBy("learner_id", "project").agg(
        F.max_by("value", _moment()).alias("saved"))
    known = candidates(nodes).select("project", F.col("id").alias("saved"))
    kept = saved.join(known, ["project", "saved"], "left_semi")
    return (
        pairs.join(here, ["learner_id", "project"], "left").join(anywhere, "learner_id", "left")
        .join(kept, ["learner_id", "project"], "left").join(homes, "project", "left")
        .select("learner_id", "project", F.coalesce("here", "anywhere", F.lit(DEFAULT_MODE)).alias("mode"),
                F.coalesce("home", "saved").alias("home"))
    )


def hydrate(rows: DataFrame, understood_regions: DataFrame) -> DataFrame:
    """Add ``understood`` to node or region rows by their region."""
    lit_regions = understood_regions.select("project", "region").distinct().withColumn("_lit", F.lit(True))
    return rows.join(lit_regions, ["project", "region"], "left").withColumn(
        "understood", F.col("_lit").isNotNull()).drop("_lit")


def recents(events: DataFrame) -> DataFrame:
    """Each learner's latest projects, with the proofs stored for them."""
    last = events.groupBy("learner_id", "project").agg(F.max("ts").alias("last_ts"))
    stored = proofs(events).groupBy("learner_id", "project").agg(F.count("*").alias("understood_count"))
    ranked = top_rows(last, ["learner_id"], [F.desc("last_ts"), F.col("project")], RECENT_PROJECTS)
    return ranked.join(stored, ["learner_id", "project"], "left").select(
        "learner_id", "project", "last_ts", "place",
        F.coalesce("understood_count", F.lit(0)).alias("understood_count"))
