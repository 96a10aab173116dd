"""Byte-level BPE (1): ranked merges folded over byte arrays of distinct words.

Texts are cut into pieces by the vocabulary's pattern. The pieces that occur
most often, at most ``FREQUENT`` of them and each short, are encoded once by
Spark's higher-order functions: a fold starts from single bytes and joins the
leftmost pair with the lowest rank until no pair has one, with the ranks as one
literal, an array of small maps found by checksum. That table of pieces, ids
and decoded bytes has a fixed bound and is broadcast; all other pieces run the
same fold in place. So texts are never shuffled, only the counts of pieces are.

The pieces of a text leave the join in order, and one Arrow pass joins their
ids, and their decoded bytes, per text. Pieces of more than ``LONG`` bytes, for
which the fold's copies would add up, are merged there with a heap.

Defined cases: null and empty texts have no ids; the id column is passed on as
it is, nulls and repeats included; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.text import whole
from loomgraph.session import cut, ship

FREQUENT = 1 << 18
SHORT, LONG = 64, 2048
_BUCKETS = 1 << 16
# A rank that no piece has, and more places than a piece that is folded has bytes.
_NO_RANK, _SPAN = 1 << 31, 2 * LONG


class Vocabulary:
    """The ranks of a vocabulary file, and the pattern that cuts texts into pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        self.pattern = f"(?U){pattern}"

    def rank_literal(self) -> Column:
        """An array of maps from a piece in hexadecimal to its rank times ``_SPAN``; a piece's place is its crc32 modulo the size."""
        maps: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
        for piece, rank in self.ranks.items():
            maps[zlib.crc32(piece) % _BUCKETS][piece.hex().upper()] = rank * _SPAN
        return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,bigint>>")

    def piece_literal(self) -> Column:
        """An array of the pieces by rank."""
        pieces = [""] * (max(self.ranks.values(), default=-1) + 1)
        for piece, rank in self.ranks.items():
            pieces[rank] = base64.b64encode(piece).decode()
        return F.from_json(F.lit(json.dumps(pieces)), "array<binary>")

    def digit_literal(self) -> Column:
        """An array of the ranks as little-endian 32-bit integers in hexadecimal."""
        digits = [rank.to_bytes(4, "little").hex() for rank in range(max(self.ranks.values(), default=-1) + 1)]
        return F.from_json(F.lit(json.dumps(digits)), "array<string>")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that stands in the plan, and is worked out, once.

    A fold over nothing binds its start for the last step. Functions in
    ``body`` then see a plain variable, whose type Spark needn't derive from
    the whole expression for every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda done, _: done, body)


def encoded(word: Column, vocabulary: Vocabulary) -> Column:
    """Ids (array<int>) of a piece given as bytes, at most ``LONG`` of them, by merges in the order of rank.

    The state is one array with a number for every part: the rank of the part
    with the next one, and below it the place where the part begins. Its
    smallest number is the leftmost pair of the lowest rank. A number in front
    and one behind stand for the ends.
    """

    none = F.lit(_NO_RANK * _SPAN)

    def rank(ranks: Column, piece: Column) -> Column:
        return F.element_at(F.get(ranks, (F.crc32(piece) % _BUCKETS).cast("int")), F.hex(piece))

    def number(rank: Column, begin: Column) -> Column:
        return F.coalesce(rank, none) + begin

    def id_of(rank: Column) -> Column:
        return F.shiftright(rank, _SPAN.bit_length() - 1).cast("int")

    def begin(number: Column) -> Column:
        return number.bitwiseAND(_SPAN - 1).cast("int")

    def fold(ranks: Column, word: Column) -> Column:
        size = F.octet_length(word)

        def merge(state: Column, low: Column, place: Column) -> Column:
            """Joins the parts at ``place`` and behind it; both pairs that touch the new part change."""
            last, here = begin(F.get(state, place - 1)), begin(low)
            end, beyond = begin(F.get(state, place + 2)), begin(F.get(state, place + 3))
            before = F.when(place > 1, rank(ranks, F.substring(word, last, end - last)))
            behind = rank(ranks, F.substring(word, here, beyond - here))
            changed = F.array(number(before, last), number(behind, here))
            return _bound(F.array(F.slice(state, 1, place - 1), changed, F.slice(state, place + 3, F.size(state))), F.flatten)

        def turn(state: Column, _: Column) -> Column:
            def at(low: Column) -> Column:
                # array_position would find the place, but it leaves its loop by an exception, which costs more than the merge.
                place = _bound(F.transform(state, lambda n, i: F.when(n == low, i)), F.array_min)
                return F.when(low >= none, state).otherwise(_bound(place, lambda p: merge(state, low, p)))

            return _bound(F.array_min(state), at)

        def ids(state: Column) -> Column:
            parts = F.slice(state, 2, F.size(state) - 2)
            return F.transform(parts, lambda n, i: id_of(rank(ranks, F.substring(word, begin(n), begin(F.get(state, i + 2)) - begin(n)))))

        places = F.sequence(F.lit(1), size)
        pairs = F.transform(F.slice(places, 1, size - 1), lambda i: number(rank(ranks, F.substring(word, i, F.lit(2))), i))
        start = F.flatten(F.array(F.array(none), pairs, F.array(none + size, none + size + 1)))
        merged = _bound(F.aggregate(F.slice(places, 2, size), start, turn), ids)
        return F.when(size == 0, F.array().cast("array<int>")).otherwise(
            _bound(rank(ranks, word), lambda single: F.when(single.isNotNull(), F.array(id_of(single))).otherwise(merged))
        )

    return _bound(vocabulary.rank_literal(), lambda ranks: _bound(word, lambda w: fold(ranks, w)))


def decoded(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes that a piece's ids stand for: their pieces, one behind the other."""
    return _bound(
        vocabulary.piece_literal(),
        lambda pieces: F.aggregate(ids, F.lit(b""), lambda done, i: F.concat(done, F.get(pieces, i))),
    )


def _packed(ids: Column, vocabulary: Vocabulary) -> Column:
    """Ids as unsigned 32-bit integers, little-endian, looked up in hexadecimal."""
    return _bound(vocabulary.digit_literal(), lambda digits: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(digits, i)), "")))


def _with_codes(pieces: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds ``ids`` (packed) and ``bytes`` to rows with ``piece``."""
    coded = pieces.withColumn("_ids", encoded(F.col("piece").cast("binary"), vocabulary))
    return coded.withColumn("ids", _packed(F.col("_ids"), vocabulary)).withColumn("bytes", decoded(F.col("_ids"), vocabulary)).drop("_ids")


def frequent_pieces(pieces: DataFrame, limit: int = FREQUENT) -> DataFrame:
    """At most ``limit`` distinct short pieces, those that occur most often.

    Counts are put in levels, eight per power of two, so that the level down to
    which the limit holds is found from a few hundred sums.
    """
    short = pieces.where(F.octet_length("piece") <= SHORT)
    counts = cut(short.groupBy("piece").agg(F.floor(8 * F.log2(F.count("*"))).cast("int").alias("level")), "pieces")
    total, lowest = 0, 1 << 30
    for row in counts.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).toLocalIterator():
        total += row.n
        if total > limit:
            break
        lowest = row.level
    return counts.where(F.col("level") >= lowest).select("piece")


def heap_merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a very long piece: a heap of pairs over a linked list of parts."""
    size = len(piece)
    ends, after, before = list(range(1, size + 1)), list(range(1, size + 1)), list(range(-1, size - 1))
    alive = [True] * size

    def entry(left: int):
        right = after[left]
        rank = ranks.get(piece[left : ends[right]]) if right < size else None
        return None if rank is None else (rank, left, ends[left], ends[right])

    heap = [e for e in map(entry, range(size)) if e]
    heapq.heapify(heap)
    while heap:
        _, left, middle, end = heapq.heappop(heap)
        right = after[left]
        if not alive[left] or ends[left] != middle or right >= size or ends[right] != end:
            continue
        alive[right], ends[left], after[left] = False, end, after[right]
        if after[right] < size:
            before[after[right]] = left
        for start in (left, before[left]):
            if start >= 0 and (e := entry(start)):
                heapq.heappush(heap, e)
    return [ranks[piece[i : ends[i]]] for i in range(size) if alive[i]]


def _joined(vocabulary: Vocabulary):
    """Joins the ids and bytes of consecutive pieces; a piece at 0, or none, begins a text."""
    schema = pa.schema([("row", pa.binary()), ("ids", pa.binary()), ("bytes", pa.binary())])
    ranks = vocabulary.ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        pieces = {rank: piece for piece, rank in ranks.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            row, pos, ids, data, long = batch.columns
            if long.null_count < len(long):
                ids, data = _filled(ids, data, long, ranks, pieces)
            starts = np.flatnonzero(pos.fill_null(0).to_numpy(zero_copy_only=False) == 0)
            ids, data = (c.fill_null(b"") for c in (ids, data))
            tops = [np.frombuffer(c.buffers()[1], dtype=np.int32)[c.offset : c.offset + len(c) + 1] for c in (ids, data)]
            buffers = [memoryview(c.buffers()[2] or b"") for c in (ids, data)]
            bounds = [*starts.tolist(), batch.num_rows]
            if bounds[0] > 0:
                for k in (0, 1):
                    held[1 + k].append(bytes(buffers[k][tops[k][0] : tops[k][bounds[0]]]))
            out = []
            keys = row.take(pa.array(starts)).to_pylist()
            for key, a, b in zip(keys, bounds[:-1], bounds[1:], strict=True):
                if held is not None:
                    out.append((held[0], b"".join(held[1]), b"".join(held[2])))
                held = (key, *([bytes(buffers[k][tops[k][a] : tops[k][b]])] for k in (0, 1)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (held[0], b"".join(held[1]), b"".join(held[2]))], schema=schema)

    return run


def _filled(ids: pa.Array, data: pa.Array, long: pa.Array, ranks: dict, pieces: dict) -> tuple[pa.Array, pa.Array]:
    """Codes of long pieces put in their places."""
    ids, data = ids.to_pylist(), data.to_pylist()
    for i, piece in enumerate(long.to_pylist()):
        if piece is not None:
            found = heap_merged(piece, ranks)
            ids[i], data[i] = np.array(found, dtype="<u4").tobytes(), b"".join(pieces[r] for r in found)
    return pa.array(ids, pa.binary()), pa.array(data, pa.binary())


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """``key, ids, bytes`` of every text: packed ids, and the bytes they decode to."""
    ship(docs.sparkSession)
    pieces = F.regexp_extract_all(whole(F.col("text")), F.lit(vocabulary.pattern), F.lit(0))
    known = _with_codes(frequent_pieces(docs.select(F.explode(pieces).alias("piece"))), vocabulary)
    known = cut(known.select(F.col("piece").alias("_piece"), F.col("ids").alias("_ids"), F.col("bytes").alias("_bytes")), "codes")
    kind = docs.schema[key].dataType
    exploded = docs.select(F.col(key).cast("string").cast("binary").alias("row"), F.posexplode_outer(pieces).alias("pos", "piece"))
    # At most FREQUENT rows of at most SHORT bytes each. The join keeps the order of the texts' pieces.
    looked = exploded.join(F.broadcast(known), F.col("piece") == F.col("_piece"), "left")
    size = F.octet_length("piece")
    rare = F.when(F.col("_ids").isNull() & (size <= LONG), encoded(F.col("piece").cast("binary"), vocabulary))
    looked = looked.withColumn("_rare", rare)
    rows = looked.select(
        "row",
        "pos",
        F.coalesce("_ids", _packed(F.col("_rare"), vocabulary)).alias("ids"),
        F.coalesce("_bytes", decoded(F.col("_rare"), vocabulary)).alias("bytes"),
        F.when(size > LONG, F.col("piece").cast("binary")).alias("long"),
    )
    joined = rows.mapInArrow(_joined(vocabulary), "row binary, ids binary, bytes binary")
    return joined.select(F.col("row").cast("string").cast(kind).alias(key), "ids", "bytes")
