"""Document fingerprints (9): bottom-k sketches of five-word shingle hashes.

A sketch is the k smallest of a text's distinct shingle hashes. Sketches of
parts merge into the sketch of the whole, and estimate resemblance, containment
and the number of distinct shingles. A fingerprint is the sketch in base 64.

``neighbour_fingerprints`` compares every document with the next one by
descending id. Documents are dealt into chunks of ids between quantiles, sorted
within, and streamed past each other; the first document of each chunk also
goes to the chunk that comes before it in that order, so texts are shuffled once.

Defined cases: null, empty and blank texts have an empty sketch, which is like
another empty one (1) and unlike any other (0); a null id is below all others;
rows that repeat an id follow each other by text; a single document is its own
next one; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.shingles import shingle_sets
from loomgraph.session import ship

K = 256
_SLICE_CHARS = 2_000_000
_OUT = 500


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of what two sketches stand for."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of all shingles that both have; exact if both sketches hold whole sets of k together."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first one's shingles that the second has."""
    if not len(a):
        return 1.0
    within = a if len(b) < k else a[a <= b[-1]]
    return float(np.isin(within, b, assume_unique=True).mean()) if len(within) else 0.0


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles, exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode("ascii")


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u8")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """``doc_id, fingerprint, n_shingles`` of every text; the count is estimated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            sketches = [shingles[:k] for shingles in shingle_sets(texts)]
            columns = [batch.column(0), pa.array(map(encode, sketches)), pa.array([distinct_shingles(s, k) for s in sketches])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fingerprint", "n_shingles"])

    ship(docs.sparkSession)
    schema = "doc_id bigint, fingerprint string, n_shingles double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _in_order(docs: DataFrame) -> DataFrame:
    """``chunk, guest, doc_id, text``: each chunk's documents in order, then as a guest the one that follows them."""
    spark = docs.sparkSession
    chunks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = keyed.withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63))))
    shares = [i / chunks for i in range(1, chunks)]
    bounds = keyed.agg(F.percentile_approx("_key", shares, 10_000).alias("b")).first().b or []
    # Binary search for the number of bounds below the key: steps of falling powers of two.
    limits = F.array(*map(F.lit, sorted(set(bounds))))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))] or [F.lit(0)])
    chunk = F.aggregate(
        steps, F.lit(0), lambda low, step: F.when(F.get(limits, low + step - 1) < F.col("_key"), low + step).otherwise(low)
    )
    dealt = keyed.withColumn("chunk", chunk)
    firsts = dealt.groupBy("chunk").agg(F.max("_key").alias("_first"))
    ends = Window.orderBy("chunk")
    top = F.last("_first").over(ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # One row per chunk, four times the number of shuffle partitions at most.
    guests = firsts.select(F.coalesce(F.lag("_first").over(ends), top).alias("_key"), F.col("chunk").alias("_to"))
    invited = dealt.join(F.broadcast(guests), "_key").select(F.col("_to").alias("chunk"), F.lit(1).alias("guest"), "_key", "doc_id", "text")
    own = dealt.select("chunk", F.lit(0).alias("guest"), "_key", "doc_id", "text")
    return own.union(invited).repartition("chunk").sortWithinPartitions("chunk", "guest", F.desc("_key"), "text").drop("_key")


def neighbour_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Every document against an edited text and against the next document, by their fingerprints.

    The edited text has the last half of its code points, rounded down, replaced
    by as many first ones of the next document.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])

    def compared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows in order; each one but the last is compared with the one behind it if it is of the same chunk."""
        sketches = [s[:k] for s in shingle_sets(text.encode() for _, _, _, text in rows)]
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        edited = []
        for i in pairs:
            text, half = rows[i][3], len(rows[i][3]) // 2
            edited.append((text[: len(text) - half] + rows[i + 1][3][:half]).encode())
        out: list[tuple] = []
        for i, text, shingles in zip(pairs, edited, shingle_sets(edited), strict=True):
            own, other = sketches[i], shingles[:k]
            out.append((
                rows[i][2], len(rows[i][3]), hashlib.sha256(text).hexdigest(), encode(own), encode(other),
                resemblance(own, other, k), resemblance(own, sketches[i + 1], k),
            ))
            if len(out) == _OUT:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for chunk, guest, id_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((chunk, guest, id_, text or ""))
                size += len(held[-1][3])
                if size >= _SLICE_CHARS:
                    yield from compared(held)
                    held, size = held[-1:], 0
        yield from compared(held)

    ship(docs.sparkSession)
    columns = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(docs).mapInArrow(run, columns)
