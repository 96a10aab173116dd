"""Ranked lexical search (11): the best documents for each query text, by bit-sliced Bloom signatures.

The index holds documents in shards of similar size. A document's signature has a
few bits for every term, and more for the term at higher counts (``LEVELS``); a
shard stores the signatures by bit, each a bitmap over its documents. ANDing the
bitmaps of a term at a level gives all documents that have it so often, and a few
that don't. What each level can add to the score at most, times the term's weight,
is summed over these bitmaps to an upper bound per query and document.

The ``PROBES`` documents with the highest bounds are scored exactly; the score of
the last one that would be returned is the bar. All documents whose bound is not
below the bar are then scored exactly from their whole texts, so the result is that
of scoring all documents. Query texts are taken in blocks of bounded size, so what
is sent to every task is bounded: terms, weights and at most ``PROBES`` documents per
query. The documents to be scored are joined by key, without a broadcast of unproven size.

Defined cases: null and empty texts have no terms, are never found and count
nowhere; a query without terms that any document holds has no rows; repeated rows
are documents of their own; documents without an id come last among equal scores;
repeated query ids are queries of their own; empty tables give an empty result.
Terms are counted by 64-bit hash for their document numbers, and compared as bytes in scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.shingles import mixed, word_hashes
from loomgraph.plans.ranking import top_rows
from loomgraph.session import cut, ship

TOP = 10
PROBES = 40
HASHES = 5
# Bits and documents of a shard at most, and rows of a signature for each of a document's entries.
SHARD_BITS, SHARD_DOCUMENTS, ROWS_PER_ENTRY = 1 << 21, 512, 16
# A block of queries ends at so many queries or terms.
BLOCK_ITEMS, BLOCK_TERMS = 512, 1 << 13
# Counts of a term that have their own bits.
LEVELS = np.array(sorted({k << i for i in range(40) for k in (2, 3)} | {1}), dtype=np.int64)
_SLICE = 1 << 20

# Bytes of ASCII letters and digits and beyond ASCII are kept, A-Z as a-z; others separate.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def hashed(found: list[bytes]) -> np.ndarray:
    return word_hashes(b" ".join(found))[0]


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def _term_hashes(texts: Iterable[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts at a time: how many, the hashes of all their terms, and the place of each term's text."""

    def found(held: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
        hashes, starts, _ = word_hashes(b" ".join(held).translate(_FOLD))
        return len(held), hashes, np.searchsorted(np.cumsum([len(t) + 1 for t in held]), starts, "right")

    held, size = [], 0
    for text in texts:
        held.append(text or b"")
        size += len(held[-1]) + 1
        if size >= _SLICE:
            yield found(held)
            held, size = [], 0
    if held:
        yield found(held)


def _entry(hashes: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    return mixed(hashes + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level).astype(np.uint64))


def _bits(entries: np.ndarray, rows: int) -> np.ndarray:
    """The rows of an entry's bits, ``HASHES`` per entry; ``rows`` is a power of two."""
    step = mixed(entries) | np.uint64(1)
    return ((entries[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(rows - 1)).astype(np.int64)


_SHARD = "rows int, keys array<bigint>, lengths array<bigint>, slices binary"
_SHARD_ARROW = pa.schema([("rows", pa.int32()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("slices", pa.binary())])


def _shard(rows: int, held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    width = -(-len(held) // 8) * 8
    bits = np.zeros((rows, width), dtype=np.uint8)
    column = np.repeat(np.arange(len(held)), [len(e) for _, _, e in held])
    places = _bits(np.concatenate([e for _, _, e in held]), rows)
    for i in range(HASHES):
        bits[places[:, i], column] = 1
    values = [[rows], [[k for k, _, _ in held]], [[n for _, n, _ in held]], [np.packbits(bits, axis=1).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, _SHARD_ARROW.types, strict=True)], schema=_SHARD_ARROW)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of documents whose entries need the same power of two of rows."""
    held: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for batch in batches:
        keys, at = batch.column(batch.schema.get_field_index("key")).to_pylist(), 0
        for texts, hashes, owner in _term_hashes(_texts(batch)):
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])) if len(hashes) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(hashes)))
            levels = np.searchsorted(LEVELS, times, "right")
            level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
            entries, of = _entry(np.repeat(hashes[first], levels), level), np.repeat(owner[first], levels)
            bounds, lengths = np.searchsorted(of, np.arange(texts + 1)), np.bincount(owner, minlength=texts)
            for i in np.flatnonzero(lengths).tolist():
                own = entries[bounds[i] : bounds[i + 1]]
                rows = ROWS_PER_ENTRY << max(3, int(len(own) - 1).bit_length())
                group = held.setdefault(rows, [])
                group.append((keys[at + i], int(lengths[i]), own))
                if len(group) == min(SHARD_DOCUMENTS, max(8, SHARD_BITS // rows)):
                    yield _shard(rows, held.pop(rows))
            at += texts
    for rows, group in held.items():
        yield _shard(rows, group)


def _keyed(docs: DataFrame) -> DataFrame:
    """A key may stand for several rows; those are then scored together and each exactly."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def index(docs: DataFrame) -> DataFrame:
    """The shards of an index over all documents with a term, written to the shared folder."""
    ship(docs.sparkSession)
    return cut(_keyed(docs).select("key", "text").mapInArrow(_shards, _SHARD), "signatures")


@dataclass
class Corpus:
    """Documents with a term, and all their terms."""

    documents: int
    terms: int

    def lengths(self, sizes: Iterable[int]) -> np.ndarray:
        """The length part of a document's score, in plain integers, for numbers of terms."""
        return np.array([25 + 75 * n * self.documents // self.terms for n in sizes], dtype=np.int64)

    def weight(self, holders: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * holders + 1)))


def corpus(shards: DataFrame) -> Corpus:
    found = shards.select(F.size("lengths").cast("long").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("l"))
    row = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    return Corpus(int(row[0]), int(row[1]))


def part(tf: np.ndarray | int, length: np.ndarray | int):
    """What ``tf`` occurrences add to a score for a weight of one."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * length)


def holders(docs: DataFrame, wanted: list[bytes]) -> list[int]:
    """How many documents hold each of the wanted terms."""
    hashes = hashed(wanted)
    order = np.argsort(hashes)
    ranked = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(ranked), dtype=np.int64)
        for batch in batches:
            for _, found, owner in _term_hashes(_texts(batch)):
                place = np.minimum(np.searchsorted(ranked, found), len(ranked) - 1)
                hit = ranked[place] == found
                once = np.unique(owner[hit] * len(ranked) + place[hit])
                counts += np.bincount(once % len(ranked), minlength=len(ranked))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(order[some].astype(np.int32)), pa.array(counts[some])], names=["term", "n"])

    summed = docs.select("text").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = [0] * len(wanted)
    for row in summed.toLocalIterator():
        out[row.term] = row.n
    return out


@dataclass
class Block:
    """Some queries: their terms, each with its weight, and for every query its terms' places and how often it has each."""

    corpus: Corpus
    words: list[bytes]
    weights: list[int]
    queries: list[dict[int, int]]

    def bounds(self, rows: int, lengths: np.ndarray, slices: bytes) -> np.ndarray:
        """Upper bounds of the scores, a row per query and a column per document of a shard."""
        stored = np.frombuffer(slices, dtype=np.uint8).reshape(rows, -1)
        length, hashes = self.corpus.lengths(lengths.tolist()), hashed(self.words)
        sums = np.zeros((len(hashes), len(lengths)), dtype=np.int64)
        alive, before = np.arange(len(hashes)), np.zeros(len(lengths), dtype=np.int64)
        for level in range(int(np.searchsorted(LEVELS, lengths.max(), "right"))):
            present = np.bitwise_and.reduce(stored[_bits(_entry(hashes[alive], level), rows)], axis=1)
            some = present.any(axis=1)
            if not some.any():
                break
            alive, present = alive[some], present[some]
            most = part(np.minimum(LEVELS[level + 1] - 1, lengths), length)
            sums[alive] += np.unpackbits(present, axis=1, count=len(lengths)) * (most - before)
            before = most
        out = np.zeros((len(self.queries), len(lengths)), dtype=np.int64)
        for i, query in enumerate(self.queries):
            if query:
                times = np.array([self.weights[t] * n for t, n in query.items()], dtype=np.int64)
                out[i] = times @ sums[list(query)]
        return out

    def scores(self, text: bytes | None, queries: list[int]) -> list[tuple[int, int]]:
        """(query, score) of the queries that score above nothing."""
        found = terms(text)
        counts, length = Counter(found), 25 + 75 * len(found) * self.corpus.documents // self.corpus.terms
        out = []
        for query in queries:
            total = sum(self.weights[t] * times * part(tf, length) for t, times in self.queries[query].items() if (tf := counts.get(self.words[t])))
            if total > 0:
                out.append((query, total))
        return out


_PAIR = pa.schema([("query", pa.int32()), ("key", pa.int64())])


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows, keys, lengths, slices = (batch.column(k)[i] for k in range(4))
            yield rows.as_py(), keys.values.to_numpy(), lengths.values.to_numpy(), slices.as_buffer()


def _highest(block: Block, probes: int):
    """The documents of the task with the highest bounds for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(block.queries), 0), dtype=np.int64)
        names = best
        for rows, keys, lengths, slices in _shard_rows(batches):
            best = np.concatenate([best, block.bounds(rows, lengths, slices)], axis=1)
            names = np.concatenate([names, np.broadcast_to(keys, (len(best), len(keys)))], axis=1)
            if best.shape[1] > probes:
                top = np.argpartition(-best, probes - 1, axis=1)[:, :probes]
                best, names = np.take_along_axis(best, top, 1), np.take_along_axis(names, top, 1)
        query, place = np.nonzero(best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), pa.array(names[query, place]), pa.array(best[query, place])], names=["query", "key", "bound"]
        )

    return run


def _not_below(block: Block, bars: np.ndarray):
    """The documents whose bound reaches the query's bar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, keys, lengths, slices in _shard_rows(batches):
            query, place = np.nonzero(block.bounds(rows, lengths, slices) >= bars[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(keys[place])], schema=_PAIR)

    return run


def _scored(block: Block):
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text, queries in zip(batch.column(0).to_pylist(), _texts(batch), batch.column(2).to_pylist(), strict=True):
                out += [(query, id_, score) for query, score in block.scores(text, queries)]
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _by_key(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.collect_set("query").alias("queries"))


def _rescored(docs: DataFrame, wanted: DataFrame, block: Block) -> DataFrame:
    """Exact scores of documents, by key, for the queries that want them, from whole texts."""
    found = _keyed(docs).join(wanted, "key").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "queries")
    return found.mapInArrow(_scored(block), "query int, doc_id bigint, score bigint")


def _best(scored: DataFrame, limit: int) -> DataFrame:
    return top_rows(scored, ["query"], [F.desc("score"), F.asc_nulls_last("doc_id")], limit, "rank")


def _block(found: list[list[bytes]], docs: DataFrame, size: Corpus) -> Block:
    words = sorted({w for query in found for w in query})
    counts = holders(docs, words) if words else []
    held = [(w, n) for w, n in zip(words, counts, strict=True) if n]
    place = {w: i for i, (w, _) in enumerate(held)}
    queries = [{place[w]: n for w, n in Counter(query).items() if w in place} for query in found]
    return Block(size, list(place), [size.weight(n) for _, n in held], queries)


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, found, size = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row[0])
        found.append(terms(row[1].encode() if row[1] is not None else None))
        size += len(set(found[-1]))
        if len(ids) >= BLOCK_ITEMS or size >= BLOCK_TERMS:
            yield ids, found
            ids, found, size = [], [], 0
    if ids:
        yield ids, found


def search(docs: DataFrame, items: DataFrame, shards: DataFrame | None = None, limit: int = TOP, probes: int = PROBES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``limit`` best documents for the text of each item."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    shards = index(docs) if shards is None else shards
    size, probes = corpus(shards), max(probes, limit)
    kind = items.schema["item_id"].dataType
    out = T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    results = []
    for ids, found in _blocks(items.select("item_id", "text")) if size.documents else ():
        block = _block(found, docs, size)
        if not block.words:
            continue
        highest = shards.mapInArrow(_highest(block, probes), "query int, key bigint, bound bigint")
        # At most PROBES documents for each of a block's queries.
        probed = cut(top_rows(highest, ["query"], [F.desc("bound"), F.asc("key")], probes).select("query", "key"), "probes")
        bars = np.ones(len(ids), dtype=np.int64)
        for row in _best(_rescored(docs, F.broadcast(_by_key(probed)), block), limit).where(F.col("rank") == limit).toLocalIterator():
            bars[row["query"]] = row["score"]
        pairs = cut(shards.mapInArrow(_not_below(block, bars), "query int, key bigint"), "pairs")
        best = _best(_rescored(docs, _by_key(pairs), block), limit)
        named = spark.createDataFrame([Row(query=i, item_id=id_) for i, id_ in enumerate(ids)], T.StructType([T.StructField("query", T.IntegerType()), out["item_id"]]))
        results.append(cut(best.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score"), "found"))
    return reduce(DataFrame.union, results) if results else spark.createDataFrame([], out)
