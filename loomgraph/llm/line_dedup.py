"""Line dedup (3): repeated lines stay only in the largest document id that holds them.

Line hashes, not texts, are shuffled. Keys found in enough documents are range-
partitioned by hash with a secondary sort by document (largest first) and
position, and a window streams over each key's run to find its first
occurrence. A key with very many occurrences is cut into parts by document
range, whose first part holds the first occurrence, so no task gets one key
whole. The result is a compressed keep bitmap per document.

Defined cases: a null or empty text is one empty line; a null document id counts
as one document that sorts below all others; rows repeating a document id share
that document; identical rows share one bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.text import BLANKS, lower_ascii, whole
from loomgraph.session import cut

# Occurrences of one key that one sorted run may hold before it is cut by document range.
RUN_ROWS = 20_000
_NO_ID = -(2**63)


def _keyed(docs: DataFrame) -> DataFrame:
    """``_doc, _hash, text, _own``: the id with null as lowest, the text's hash, and all own columns in one."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_doc"),
        F.xxhash64(whole(F.col("text"))).alias("_hash"),
        "text",
        F.struct("*").alias("_own"),
    )


def line_keys(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row per line whose key is long enough: ``_doc, _hash, pos, h1, h2``.

    The key is the line without blanks at its ends and with A-Z lower-cased; two
    64-bit hashes stand for it.
    """
    lines = _keyed(docs).select(
        "_doc", "_hash", F.posexplode(F.split(whole(F.col("text")), "\n", -1)).alias("pos", "line")
    )
    keys = lines.select("_doc", "_hash", "pos", lower_ascii(F.btrim("line", F.lit(BLANKS))).alias("key"))
    return keys.where(F.length("key") >= min_chars).select(
        "_doc", "_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, run_rows: int = RUN_ROWS) -> DataFrame:
    """``_doc, _hash, n_dropped, keep``: one row per document that loses a line.

    ``keep`` is an array of (word, bits), 64 lines a word, bit 1 for a line that
    stays; words of only ones are left out.
    """
    lines = cut(line_keys(docs, min_chars), "lines")
    repeated = (
        lines.groupBy("h1", "h2")
        .agg(
            F.count_distinct("_doc").alias("docs"),
            F.count("*").alias("rows"),
            F.max("_doc").alias("top"),
            F.min("_doc").alias("low"),
        )
        .where(F.col("docs") >= min_docs)
    )
    # Part 0 always holds the largest id of the key; doubles keep wide id ranges from overflowing.
    span = F.col("top").cast("double") - F.col("low").cast("double") + 1
    parts = F.ceil(F.col("rows") / run_rows)
    below = F.col("top").cast("double") - F.col("_doc").cast("double")
    run = Window.partitionBy("h1", "h2", "part").orderBy(F.desc("_doc"), "pos")
    ranged = (
        lines.join(repeated, ["h1", "h2"])
        .select("h1", "h2", F.floor(below / span * parts).cast("int").alias("part"), "_doc", "_hash", "pos")
        .repartitionByRange("h1", "h2", "part")
        .sortWithinPartitions("h1", "h2", "part", F.desc("_doc"), "pos")
    )
    first = F.first("_doc").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dropped = ranged.withColumn("first", first).where((F.col("part") > 0) | (F.col("_doc") != F.col("first")))
    bits = (
        dropped.select("_doc", "_hash", F.expr("pos div 64").cast("int").alias("word"), (F.col("pos") % 64).alias("bit"))
        .repartition("_doc", "_hash")
        .groupBy("_doc", "_hash", "word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("gone"))
    )
    return bits.groupBy("_doc", "_hash").agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"),
    )


def kept_positions(keep: Column, lines: Column) -> Column:
    """Positions of the lines that a keep bitmap leaves, in order."""
    gone = F.flatten(
        F.transform(
            keep,
            lambda w: F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(w["bits"], b) == 0),
                lambda b: w["word"] * 64 + b,
            ),
        )
    )
    return F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)


def dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, run_rows: int = RUN_ROWS) -> DataFrame:
    """The documents' own columns with ``kept_text, n_lines, n_dropped`` added."""
    marked = _keyed(docs).join(keep_bitmaps(docs, min_chars, min_docs, run_rows), ["_doc", "_hash"], "left")
    lines = marked.withColumn("_lines", F.split(whole(F.col("text")), "\n", -1))
    at = lines.withColumn("_at", F.when(F.col("keep").isNotNull(), kept_positions(F.col("keep"), F.col("_lines"))))
    kept = F.when(F.col("keep").isNull(), whole(F.col("text"))).otherwise(
        F.array_join(F.transform("_at", lambda i: F.get("_lines", i)), "\n")
    )
    return at.select(
        "_own.*",
        kept.alias("kept_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )
