from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomgraph.schema import EDGES, NODES  # noqa: E402
from loomgraph.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", 4)
    yield session
    session.stop()


@pytest.fixture
def graph(spark):
    """Build node and edge tables from short tuples.

    A node is (id, kind, region) with optional file, rank, partial, loc. An edge is
    (src, dst, kind, certain) with optional lineno and external.
    """

    def build(nodes, edges=(), project="p"):
        node_rows = []
        for node in nodes:
            id_, kind, region, *rest = node
            file, rank, partial, loc = (list(rest) + [None] * 4)[:4]
            node_rows.append((project, id_, kind, id_.split(".")[-1], "python", file or f"{region}.py", 1, loc or 3,
                              loc or 3, region, rank, bool(partial)))
        edge_rows = []
        for edge in edges:
            src, dst, kind, certain, *rest = edge
            lineno, external = (list(rest) + [None] * 2)[:2]
            edge_rows.append((project, src, dst, kind, certain, lineno or 1, bool(external)))
        return spark.createDataFrame(node_rows, NODES), spark.createDataFrame(edge_rows, EDGES)

    return build


def rows(df, *columns):
    """Collected tuples in order."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
