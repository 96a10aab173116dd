"""Table layouts shared by every operator; each carries the project key."""

from __future__ import annotations

NODES = (
    "project string, id string, kind string, name string, language string, file string, "
    "lineno int, end_lineno int, loc int, region string, entrypoint_rank int, partial boolean"
)
EDGES = (
    "project string, src string, dst string, kind string, certain boolean, lineno int, "
    "external boolean"
)
FILES = "project string, file string, language string, sha256 string"
CONCEPTS = (
    "project string, node_id string, language string, concept string, lineno int, "
    "end_lineno int, snippet string"
)
PROGRESS = (
    "event_id long, project string, learner_id long, ts timestamp, type string, region string, "
    "signature string, value string"
)

NODE_COLUMNS = [c.split()[0] for c in NODES.split(", ")]
EDGE_COLUMNS = [c.split()[0] for c in EDGES.split(", ")]
CONCEPT_COLUMNS = [c.split()[0] for c in CONCEPTS.split(", ")]
