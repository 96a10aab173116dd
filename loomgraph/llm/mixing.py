"""Mixing sources to target weights (2): fixed-length blocks, drawn per output shard.

The documents of a source, in a pseudorandom order, are one stream of tokens
that is cut into blocks of a fixed length; the last block may be shorter. A
source's target says how many slots its blocks fill in the output. Each slot
picks its output shard at random, so a shard's source counts are multinomial
draws, given the totals that the targets fix. Slots map to blocks by a
pseudorandom permutation of each source's block numbers, a new one for each
pass over the source: no block comes a third time before all came twice. The
last slot is cut short so that a source's words meet its target exactly.

The stream order needs running totals per source. They are taken in many hash
buckets of each source and then over the buckets, so a source with most of the
rows is still spread.

Defined cases: null source is a source of its own, last in order; a null or
empty text has size 0 and is never taken; rows repeating a document id are
documents of their own; identical rows are interchangeable; an empty table
gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.text import whole, words
from loomgraph.session import cut

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 256
BUCKETS = 4096
SHARD_BLOCKS = 4096
ROUNDS = 24


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from rows of (source, source_size), one per source.

    Weights repeat over the sources in code-point order, null last. ``share`` of
    all words is split by weight; what would exceed ``most`` times a source's
    size is reshared among the others until none exceeds it. That is a common
    level per unit of weight, found by going through the sources by the level at
    which each is full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place).cast("double"))
    weighted = weighted.withColumn("full", F.lit(most) * F.col("source_size") / F.col("weight"))
    fill = Window.orderBy("full", F.col("source").asc_nulls_last())
    before, onwards = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (
        F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0.0))
    ) / F.sum("weight").over(onwards)
    levels = weighted.withColumn("level", level)
    # The first source that is not full at the level left for it and those behind it sets the level of all.
    throughout = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    common = F.first(F.when(F.col("level") <= F.col("full"), F.col("level")), ignorenulls=True).over(throughout)
    target = F.least(F.lit(most) * F.col("source_size"), F.coalesce(common, F.col("full")) * F.col("weight"))
    return levels.select("source", "source_size", target.cast("double").alias("target"))


def streamed(docs: DataFrame, seed: int, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """The documents with ``_size`` and ``_from``, their place in the source's stream, and the sources' sizes.

    Needs columns ``_source, _key, _size``; ``_key`` tells documents apart.
    """
    mixed = docs.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_key"), F.lit(buckets)).cast("int"))
    totals = mixed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"))
    over = Window.partitionBy("_source").orderBy("_bucket")
    starts = totals.select(
        F.col("_source").alias("_s"),
        F.col("_bucket").alias("_b"),
        (F.sum("_words").over(over) - F.col("_words")).alias("_start"),
    )
    within = Window.partitionBy("_source", "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = mixed.withColumn("_upto", F.sum("_size").over(within)).join(
        starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))
    )
    stream = placed.withColumn("_from", F.col("_start") + F.col("_upto") - F.col("_size"))
    sizes = totals.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size"))
    return stream.drop("_bucket", "_s", "_b", "_start", "_upto"), sizes


def permuted(index: Column, domain: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0 .. domain - 1, a swap-or-not shuffle.

    Every round pairs x with (k - x) mod domain and swaps them or not by a hash
    of the larger one; each round is its own inverse, so the whole is one to one.
    """

    def swap(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, i), domain) - x, domain)
        return F.when(F.pmod(F.xxhash64(key, i, F.greatest(x, other)), F.lit(2)) == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, swap)


def slots(sources: DataFrame, block_words: int, seed: int, shard_blocks: int) -> DataFrame:
    """``shard, spot, source, block, words``: what fills the output.

    ``sources`` has ``source, source_size, target``. The slots of a source are
    made from its block numbers, two a number at most, in chunks, so that a
    source with most of the blocks is spread.
    """
    size, block = F.col("source_size"), F.lit(block_words)
    chunk, tasks = 8192, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = sources.withColumn("wanted", F.round("target").cast("long")).where("source_size > 0")
    blocks = blocks.withColumn("blocks", F.ceil(size / block).cast("long"))
    total = F.sum(F.ceil(F.col("wanted") / block)).over(Window.partitionBy())
    blocks = blocks.withColumn("shards", F.greatest(F.lit(1), F.ceil(total / shard_blocks)).cast("long"))
    chunks = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(blocks - 1) div {chunk}"))))
    spread = chunks.repartition(tasks, "source", "chunk")
    numbers = F.sequence(F.col("chunk") * chunk, F.least((F.col("chunk") + 1) * chunk, F.col("blocks")) - 1)
    numbered = spread.withColumn("index", F.explode(numbers)).withColumn("round", F.explode(F.array(F.lit(0), F.lit(1))))
    # The short last block comes first in every pass, so that the words before a slot are known.
    tail = size - (F.col("blocks") - 1) * block
    before = F.col("round") * size + F.when(F.col("index") == 0, 0).otherwise(tail + (F.col("index") - 1) * block)
    key = F.xxhash64(F.lit(seed), "source", "round")
    at = F.when(F.col("index") == 0, F.col("blocks") - 1).otherwise(
        permuted(F.col("index") - 1, F.greatest(F.col("blocks") - 1, F.lit(1)), key)
    )
    length = F.when(F.col("index") == 0, tail).otherwise(block)
    drawn = F.xxhash64(F.lit(seed), F.lit("shard"), "source", "round", "index")
    return numbered.where(before < F.col("wanted")).select(
        F.pmod(drawn, F.col("shards")).alias("shard"),
        F.xxhash64(F.lit(seed), F.lit("spot"), "source", "round", "index").alias("spot"),
        "source",
        at.cast("long").alias("block"),
        F.least(length, F.col("wanted") - before).alias("words"),
    )


def mix(
    docs: DataFrame,
    key: list[Column],
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    seed: int = 7,
    shard_blocks: int = SHARD_BLOCKS,
) -> tuple[DataFrame, DataFrame]:
    """The packed documents and the mixture's spans.

    Documents: all columns of ``docs`` (which has ``_size``) with ``_source, _key, _from``. Spans:
    ``shard, spot, source, _from, start, words``: in slot ``spot`` of ``shard`` stand
    ``words`` tokens of the document at ``_from`` of its source, from token ``start`` on.
    """
    keyed = docs.withColumn("_source", F.col(source)).withColumn("_key", F.struct(*key))
    stream, sizes = streamed(keyed, seed)
    stream = cut(stream, "stream")
    sizes = cut(targets(sizes, weights), "sources")
    piece = F.explode(F.expr(f"sequence(_from div {block_words}, (_from + _size - 1) div {block_words})"))
    packed = stream.where("_size > 0").select(F.col("_source").alias("source"), "_from", "_size", piece.alias("block"))
    head = F.greatest(F.col("_from"), F.col("block") * block_words)
    packed = packed.select(
        "source", "block", "_from", (head - F.col("_from")).alias("start"), (head - F.col("block") * block_words).alias("offset"),
        (F.least(F.col("_from") + F.col("_size"), (F.col("block") + 1) * block_words) - head).alias("length"),
    )
    filled = slots(sizes, block_words, seed, shard_blocks).alias("f")
    same = F.col("f.source").eqNullSafe(F.col("p.source")) & (F.col("f.block") == F.col("p.block"))
    # Both sides grow with the input, though the exploded one is estimated small: never a broadcast.
    spans = filled.hint("merge").join(packed.alias("p").hint("merge"), same).select(
        "f.shard", "f.spot", "f.source", "p._from", "p.start",
        F.least(F.col("p.length"), F.col("f.words") - F.col("p.offset")).alias("words"),
    )
    return stream.join(sizes.withColumnRenamed("source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s"), spans.where("words > 0")


def taken(docs: DataFrame, key: list[Column], **options) -> DataFrame:
    """The documents of ``mix`` with ``taken``, the words that the mixture takes of each, repeats counted."""
    stream, spans = mix(docs, key, **options)
    words = spans.groupBy(F.col("source").alias("_s"), F.col("_from").alias("_f")).agg(F.sum("words").alias("_taken"))
    # An empty document shares its place with the next one.
    at = F.when(F.col("_size") > 0, F.col("_from"))
    joined = stream.join(words.hint("merge"), F.col("_source").eqNullSafe(F.col("_s")) & (at == F.col("_f")), "left")
    return joined.withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long")).drop("_s", "_f", "_taken")
