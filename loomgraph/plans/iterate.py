"""Breadth-first expansion as a loop of joins over written frontiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from loomgraph.session import cut, together

COMPACT_EVERY = 12


def expand(
    seed: DataFrame,
    step: Callable[[DataFrame, int], DataFrame],
    keys: list[str],
    limit: int | None = None,
) -> DataFrame:
    """Grow ``seed`` until a round adds nothing.

    ``step(frontier, round)`` proposes rows with the seed's columns and one row
    per key; rows whose key was placed before are dropped. Every frontier is
    written, so round n never recomputes rounds before it, and only the rows
    added last are expanded.
    """
    frontier = cut(seed, "frontier")
    rounds = [frontier]
    number = 1
    while limit is None or number <= limit:
        placed = together(rounds)
        fresh = step(frontier, number).join(placed.select(*keys), keys, "left_anti")
        frontier = cut(fresh.select(*seed.columns), "frontier")
        if frontier.isEmpty():
            break
        rounds.append(frontier)
        if len(rounds) > COMPACT_EVERY:
            rounds = [cut(together(rounds), "placed")]
        number += 1
    return together(rounds)
