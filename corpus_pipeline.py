"""A training corpus from raw documents: five operators in a row.

Every stage takes the documents that the one before it kept, and works on all
of them. Between stages the documents are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import bpe, line_dedup, mixing, ngram_join, quality
from loomgraph.llm.queries import vocabulary
from loomgraph.llm.text import table
from loomgraph.session import cut


def _with_text(docs: DataFrame, like: DataFrame, text: str) -> DataFrame:
    """The columns of ``like``, with ``text`` for the text and its length where lengths are given."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return docs.select(*[new[c].alias(c) if c in new else F.col(f"_own.`{c}`").alias(c) for c in like.columns])


def good_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts fail the base test, repeated rows are judged alike."""
    return quality.keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines found in three documents or more stay in the one with the largest id; nulls become empty texts, and every row stays."""
    packed = docs.select("doc_id", "text", F.struct("*").alias("_own"))
    return _with_text(line_dedup.dedup(packed), docs, "kept_text")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near copies stays, by text: repeated ids with different texts are documents of their own, wordless rows all stay."""
    return ngram_join.one_of_each(docs)


_KEYS = ["_id", "_no_id", "_hash", "_of", "_no_source"]


def _mixed_keys(id_: Column, hash_: Column, source: Column, kind: T.DataType) -> list[Column]:
    """``_KEYS``: a row's id, text and source, none of them null, so that they can be grouped and joined alike."""
    columns = F.coalesce(id_, F.lit(0).cast(kind)), id_.isNull(), hash_, F.coalesce(source, F.lit("")), source.isNull()
    return [column.alias(name) for column, name in zip(columns, _KEYS, strict=True)]


def mixed_to_weights(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The sources in their target shares: a row for every part of a document in a block, in the order of the output shards.

    Null sources are a source of their own, one id or text in two sources counts for both, and texts without words give no rows.
    """
    id_, hash_, kind = F.col("doc_id"), F.xxhash64("text"), docs.schema["doc_id"].dataType
    # Texts are shuffled twice, to their parts and to their shards, and never stand in a row a second time.
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")])
    keyed = docs.select(own.alias("_own"), "text", *_mixed_keys(id_, hash_, F.col("source"), kind))
    sized = docs.select(id_.alias("_id"), hash_.alias("_hash"), "source", mixing.n_words(F.col("text")).alias("_size"))
    stream, spans = mixing.mix(sized, [F.col("_id"), F.col("_hash")])
    placed = stream.where("_size > 0").select(F.col("_source").alias("_s"), F.col("_from").alias("_f"), "_id", "_hash")
    spent = spans.join(placed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_from") == F.col("_f")))
    spent = spent.select(*_mixed_keys(F.col("_id"), F.col("_hash"), F.col("_s"), kind), "shard", "spot", "start", "words")
    taken = spent.groupBy(*_KEYS).agg(F.collect_list(F.struct("shard", "spot", "start", "words")).alias("parts"))
    # Rows of one source, id and text share their parts, so one of them stands for all; the join finds them where that left them.
    joined = keyed.dropDuplicates(_KEYS).hint("merge").join(taken.hint("merge"), _KEYS)
    tokens = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+$)?"), F.lit(0))
    cuts = joined.select("_own", tokens.alias("_words"), "parts")
    texts = F.transform(
        "parts",
        lambda p: F.struct(
            p["shard"].alias("shard"), p["spot"].alias("spot"), p["start"].alias("start"),
            F.array_join(F.slice("_words", (p["start"] + 1).cast("int"), p["words"].cast("int")), "").alias("_text"),
        ),
    )
    rows = cuts.select("_own", F.explode(texts).alias("_part")).select("_own", "_part.*")
    ordered = rows.repartitionByRange("shard", "spot").sortWithinPartitions("shard", "spot", "start")
    return _with_text(ordered, docs, "_text")


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id, ids, n_tokens, text``: packed token ids of every row, repeats and null ids included, and the text decoded from them."""
    coded = bpe.encode(docs.select("doc_id", "text"), vocabulary())
    return coded.select("doc_id", "ids", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.decode("bytes", "UTF-8").alias("text"))


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing", mixed_to_weights),
    ("byte-level BPE", encoded),
]
# The quality rules' estimation and the mixture's draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
