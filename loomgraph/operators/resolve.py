"""Shared resolution joins: tiers, namesakes, owners, hierarchies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.iterate import expand
from loomgraph.session import cut, together

EDGE = ["project", "src", "dst", "kind", "certain", "lineno", "external"]


@dataclass(frozen=True)
class Late:
    """A tier that fans out: ``find`` gives candidates for those of ``rows`` that no stronger tier settles."""

    rows: DataFrame
    find: Callable[[DataFrame], DataFrame]


def tiered(keys: list[str], tiers: Sequence[DataFrame | Late]) -> DataFrame:
    """Candidates of the lowest tier that has any, per key; ties are all kept.

    Each tier holds ``keys`` plus ``dst, certain, external``. The lowest tier is
    found by a grouped minimum, which combines before the shuffle. Candidates
    are written first, since both that minimum and the result read them: each
    tier by itself, as the driver plans a job anew after each of its stages, so
    one job of all tiers costs it the square of their number in memory. Later
    plans have one scan of them all. Late
    tiers come after the others, for the keys that none of a lower number holds.
    """
    def pooled(some: list[tuple[int, DataFrame]], label: str) -> DataFrame:
        return together([cut(t.select(*keys, "dst", "certain", "external", F.lit(n).alias("tier")), label) for n, t in some])

    pool = pooled([(n, t) for n, t in enumerate(tiers) if not isinstance(t, Late)], "candidates")
    best = pool.groupBy(*keys).agg(F.min("tier").alias("tier"))
    late = [(n, t) for n, t in enumerate(tiers) if isinstance(t, Late)]
    if late:
        settled = cut(best, "settled")
        pool = pool.unionByName(pooled([
            (n, t.find(t.rows.join(settled.where(F.col("tier") < n).select(*keys), keys, "left_anti"))) for n, t in late], "late"))
        best = pool.groupBy(*keys).agg(F.min("tier").alias("tier"))
    return pool.join(best, [*keys, "tier"], "left_semi").select(*keys, "dst", "certain", "external").distinct()


# Names with more than one in so many of all rows or matches are spread; there are fewer than three times as many of them.
SPREAD_NAMES = 1024


def heavy_names(rows: DataFrame, named: DataFrame, on: list[str], most: int = SPREAD_NAMES) -> DataFrame:
    """``on, cells, split_rows`` of the names that hold more than one in ``most`` of either side's rows or of all matches.

    Fewer than ``most`` names can do each, so the table has a fixed bound.
    ``cells`` is how many parts the larger side of the name is cut into, none
    for a name that only one side has.
    """
    asked = rows.groupBy(*on).agg(F.count("*").alias("asked"))
    given = named.groupBy(*on).agg(F.count("*").alias("given"))
    sizes = asked.join(given, on, "full").select(
        *on, F.coalesce("asked", F.lit(0)).cast("double").alias("asked"), F.coalesce("given", F.lit(0)).cast("double").alias("given"))
    sizes = cut(sizes.withColumn("matches", F.col("asked") * F.col("given")), "names")
    totals = sizes.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("asked", "given", "matches")]).first()
    shares = {c: max(total / most, 1.0) for c, total in zip(("asked", "given", "matches"), totals, strict=True)}
    above = reduce(Column.__or__, [F.col(c) > share for c, share in shares.items()])
    parts = F.greatest(*[F.ceil(F.col(c) / F.lit(share)) for c, share in shares.items()])
    cells = F.when(F.col("matches") > 0, F.least(parts, F.ceil(F.greatest("asked", "given")))).otherwise(0).cast("int")
    return sizes.where(above).select(*on, cells.alias("cells"), (F.col("asked") >= F.col("given")).alias("split_rows"))


def split_join(rows: DataFrame, named: DataFrame, on: list[str], most: int = SPREAD_NAMES, written: bool = False) -> DataFrame:
    """``rows`` joined with ``named``, both having the name columns ``on``, and names common on either side spread.

    All matches are given. The larger side of a heavy name is cut into cells by
    hash, and the smaller one is copied to each, so that no task gets a name
    whole; a cell holds no more copies than it gives matches. Rows of heavy
    names that the other side lacks are left out first. ``written`` says that
    both sides are stored tables, which need not be written again to be read twice.
    """
    if not written:
        rows, named = cut(rows, "asked"), cut(named, "named")
    # Fewer than 3 * most rows.
    heavy = F.broadcast(cut(heavy_names(rows, named, on, most), "heavy"))

    def dealt(side: DataFrame, cut_up: Column) -> DataFrame:
        own = F.pmod(F.xxhash64(*side.columns), F.greatest("cells", F.lit(1))).cast("int")
        every = F.filter(F.sequence(F.lit(0), F.col("cells")), lambda cell: cell < F.col("cells"))
        cell = F.when(F.col("cells").isNull(), F.array(F.lit(0))).when(cut_up & (F.col("cells") > 0), F.array(own)).otherwise(every)
        return side.join(heavy, on, "left").select(*side.columns, F.explode(cell).alias("_cell"))

    left, right = dealt(rows, F.col("split_rows")), dealt(named, ~F.col("split_rows"))
    return left.join(right.hint("merge"), [*on, "_cell"]).drop("_cell")


def unresolved(calls: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    return calls.join(resolved.select(*keys).distinct(), keys, "left_anti")


def counted(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``n``, the number of distinct targets per key, without a window."""
    sizes = matches.groupBy(*keys).agg(F.count_distinct("dst").alias("n"))
    return matches.join(sizes, keys)


def hit(dst: Column | str, certain: Column | bool, external: Column | bool = False) -> list[Column]:
    target = F.col(dst) if isinstance(dst, str) else dst
    sure = F.lit(certain) if isinstance(certain, bool) else certain
    out = F.lit(external) if isinstance(external, bool) else external
    return [target.alias("dst"), sure.alias("certain"), out.alias("external")]


def prefixes(text: Column, separator: str = ".") -> Column:
    """Every prefix of a separated name, shortest first."""
    parts = F.split(text, "\\" + separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def owner_module(ids: DataFrame, modules: DataFrame) -> DataFrame:
    """``(project, id)`` to the longest dotted prefix that is a module."""
    every = ids.select("project", "id", F.explode(prefixes(F.col("id"))).alias("module"))
    found = every.join(modules.select("project", "module"), ["project", "module"], "left_semi")
    return found.groupBy("project", "id").agg(F.max_by("module", F.length("module")).alias("module"))


def ancestry(bases: DataFrame, classes: DataFrame) -> DataFrame:
    """``(project, class_id, ancestor, depth)`` up the in-project base chain.

    Each class starts at itself; only newly found ancestors are followed, so a
    cyclic hierarchy ends by itself.
    """
    seed = classes.select("project", "class_id", F.col("class_id").alias("ancestor"), F.lit(0).alias("depth"))

    def step(frontier: DataFrame, number: int) -> DataFrame:
        up = bases.select("project", F.col("class_id").alias("ancestor"), F.col("base_id").alias("next"))
        return frontier.join(up, ["project", "ancestor"]).select(
            "project", "class_id", F.col("next").alias("ancestor"), F.lit(number).alias("depth")).distinct()

    return expand(seed, step, ["project", "class_id", "ancestor"])


def members_named(wanted: DataFrame, keys: list[str], chain: DataFrame, members: DataFrame) -> DataFrame:
    """Members called ``leaf`` at the nearest level of ``class_id`` that has any.

    ``wanted`` holds ``keys, project, class_id, leaf``; ``members`` holds
    ``project, parent, name, node_id``.
    """
    reach = wanted.join(chain, ["project", "class_id"]).join(
        members.select("project", F.col("parent").alias("ancestor"), F.col("name").alias("leaf"), F.col("node_id").alias("dst")),
        ["project", "ancestor", "leaf"])
    nearest = reach.groupBy(*keys).agg(F.min("depth").alias("depth"))
    return reach.join(nearest, [*keys, "depth"], "left_semi").select(*keys, "dst").distinct()
