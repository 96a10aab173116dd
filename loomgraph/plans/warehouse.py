"""The code graph as written tables, built on first use.

The graph is a set of persisted tables that every analysis reads, so a query
pays for the tables it needs once per session and input. Tables live in the
cluster's shared folder; the key carries each input's size and change time, so
changed inputs get new tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators import analytics, canonical, checks, extract, progress, study
from loomgraph.plans import views
from loomgraph.session import cut
from loomgraph.sources import corpus

_INPUTS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]
_BUILT: dict[tuple, dict[str, DataFrame]] = {}


def _fingerprint(spark: SparkSession, folder: str) -> tuple:
    jvm = spark._jvm
    stamps = []
    for name in _INPUTS:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        stamps.append((system.getContentSummary(path).getLength(),
                       system.getFileStatus(path).getModificationTime()))
    return tuple(stamps)


class Warehouse:
    """Lazily written tables over one folder of inputs."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        key = (spark.sparkContext.applicationId, folder, _fingerprint(spark, folder))
        self._tables = _BUILT.setdefault(key, {})

    def __getattr__(self, name: str) -> DataFrame:
        if name in UNIONS:
            return reduce(DataFrame.unionByName, [getattr(self, part) for part in UNIONS[name]])
        if name not in BUILDERS:
            raise AttributeError(name)
        return self.stored(name, lambda: BUILDERS[name](self))

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The written table ``name``, built now if this is its first use."""
        if name not in self._tables:
            self._tables[name] = cut(build(), name)
        return self._tables[name]

    def observed(self, kind: str) -> DataFrame:
        """Raw edges of a kind: their table if it is written, and else what it would be written from."""
        stored = self._tables.get(f"raw_{kind}s")
        return views.raw_edges(self.spark, self.folder, kind) if stored is None else stored


# Tables of both kinds of edges; a query that needs one kind asks for that one alone.
UNIONS = {"raw_edges": ["raw_imports", "raw_calls"], "edges": ["imports", "calls"]}

BUILDERS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "nodes": lambda w: views.nodes(w.spark, w.folder),
    "raw_imports": lambda w: views.raw_edges(w.spark, w.folder, "import"),
    "raw_calls": lambda w: views.raw_edges(w.spark, w.folder, "call"),
    "imports": lambda w: canonical.dedup_edges(w.observed("import")),
    "calls": lambda w: canonical.dedup_edges(w.observed("call")),
    "files": lambda w: views.files(w.nodes),
    "concepts": lambda w: views.concepts(w.spark, w.folder),
    "central": lambda w: canonical.centrality(w.nodes, w.raw_calls),
    "homes": lambda w: canonical.home_select(w.nodes),
    "regions": lambda w: canonical.region_rollup(w.nodes, w.central, w.homes),
    "outline": lambda w: canonical.region_outline(w.nodes, w.homes),
    "region_edges": lambda w: canonical.region_edges(w.nodes, w.imports),
    "communities": lambda w: analytics.communities(w.outline, w.region_edges),
    "hops": lambda w: analytics.hops(w.outline, w.region_edges),
    "layers": lambda w: analytics.call_layers(w.nodes, w.raw_calls),
    "components": lambda w: analytics.components(w.region_edges),
    "signatures": lambda w: progress.signatures(w.nodes, w.files),
    "events": lambda w: views.progress_events(w.spark, w.folder, w.signatures),
    "understood": lambda w: progress.understood(w.events, w.signatures),
    "visited": lambda w: progress.visited(w.events, w.outline),
    "claims": lambda w: checks.all_claims(w.nodes, w.edges, w.homes),
    "options": lambda w: checks.options(w.claims, w.nodes),
    "suites": lambda w: checks.suites(w.claims, w.options),
    "sources": lambda w: views.source_files(w.spark, w.folder),
    "facts": lambda w: extract.facts(w.sources),
    "documents": lambda w: corpus.scan_table(views.document_files(w.spark, w.folder)),
    "lines": lambda w: corpus.decode_lines(w.documents),
    "neighbors": lambda w: study.neighbors(w.nodes, w.raw_edges),
    "lens": lambda w: study.lens_join(w.concepts, w.nodes),
    "workflow": lambda w: analytics.workflow(w.nodes, w.raw_calls, w.homes),
}
