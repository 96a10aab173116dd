"""N-gram Jaccard join (10): texts whose five-word shingle sets overlap by 75 % or more.

Rare-first prefix filtering: if sets are sorted by one global order, similar
sets share shingles in short prefixes, two at least if they differ. The order puts rare shingles first; how
often a shingle occurs is read from a fixed-size table of counts by hash, made
over all texts, which needs to be only a good guess, as any total order gives
the same links. Prefix shingles are joined with length, positional and suffix
filters, and each pair of sets is verified exactly and at most once.

Equal sets are one node throughout. In a first round every set is verified
against one partner at most: among the sets in which a shingle of its prefix
stands earliest, which have the fewest rare shingles of their own, the one that
leads most of its groups. Such rounds go on over the groups whose sets are not
all in one component, each set with a partner of another component, while they
find links. Then all further candidate pairs are verified
whose two sets are not yet in one component; a pair inside a component could
not change the result. So a large group of near copies costs about one pair per
copy, and no pair that could join two components is left out. Shingles in very
many sets are salted for the first round. What grows with the input is merged,
not broadcast, however small it is.

Defined cases: null, empty or blank texts have no shingles and link with
nothing; equal texts are linked; a null document id takes part and is ignored
by the minimum unless alone; repeated ids are separate texts; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.components import components
from loomgraph.llm.shingles import mixed, set_id, shingle_sets
from loomgraph.llm.text import WORD
from loomgraph.session import cut, ship

PERCENT = 75
BITS = 22
MARK_BITS = 26
# Linked sets that differ share so many shingles in their prefixes, which are longer by as many.
COMMON = 2
# Rounds of one partner for every set go on while more than one in so many pairs is a link.
FEW = 50
# They are run only where the groups' squares come to more than so many times their rows.
CROWDED = 16
_CHUNK = 1 << 16
SALTS = 16


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


_SCANNED = "doc_id bigint, t1 bigint, t2 bigint, n bigint, sid bigint, chunk int, counts binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text, then the counts of the task's shingles by hash in compressed chunks."""
    numbers = ("doc_id", "t1", "t2", "n", "sid")
    schema = pa.schema([*((name, pa.int64()) for name in numbers), ("chunk", pa.int32()), ("counts", pa.binary())])
    counts = np.zeros(1 << BITS, dtype=np.uint32)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            keys = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in numbers[:3]), strict=True)
            for key, shingles in zip(keys, shingle_sets(_texts(batch)), strict=True):
                np.add.at(counts, (shingles >> np.uint64(64 - BITS)).astype(np.int64), 1)
                yield *key, len(shingles), set_id(shingles) if len(shingles) else None, None, None
        for chunk in range(0, len(counts), _CHUNK) if counts.any() else ():
            yield None, None, None, None, None, chunk // _CHUNK, zlib.compress(counts[chunk : chunk + _CHUNK].tobytes(), 1)

    yield from _batches(rows(), schema)


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the chunks that this task has, as levels: 8 per power of two, one byte each."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(packed), dtype=np.uint32).astype(np.int64)
            sums[chunk] = sums[chunk] + counts if chunk in sums else counts
    levels = [(chunk, _level(total).tobytes()) for chunk, total in sums.items()]
    yield from _batches(iter(levels), pa.schema([("chunk", pa.int32()), ("levels", pa.binary())]))


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.floor(8 * np.log2(1.0 + counts))).astype(np.uint8)


def shared_levels(scanned: DataFrame) -> np.ndarray:
    """How common each shingle hash is, 2^``BITS`` bytes whatever the input."""
    chunks = scanned.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk")
    levels = np.zeros(1 << BITS, dtype=np.uint8)
    for row in chunks.mapInArrow(_add_chunks, "chunk int, levels binary").toLocalIterator():
        levels[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(row.levels, dtype=np.uint8)
    return levels


def _prefixes(levels: np.ndarray, percent: int):
    """Rows (token, sid, size) for the prefix of every set; a task gives equal sets once.

    ``size`` packs the set's size (from bit 32), the position (from bit 1), and whether the shingle is so common
    that its group is salted (bit 0).
    """
    mean = float(np.mean(2 ** (levels / 8) - 1))
    hot = int(_level(np.array([max(1000.0, 4 * mean)]))[0])
    schema = pa.schema([("token", pa.int64()), ("sid", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            held: list[list[np.ndarray]] = []
            rows = 0
            for shingles in shingle_sets(_texts(batch)):
                n = len(shingles)
                if not n or (sid := set_id(shingles)) in done:
                    continue
                done.add(sid)
                size = min(n, n + (-percent * n) // 100 + COMMON)  # n - ceil(percent n / 100) + COMMON
                common = levels[(shingles >> np.uint64(64 - BITS)).astype(np.int64)]
                first = np.lexsort((shingles, common))[:size]
                at = np.arange(size, dtype=np.int64)
                sizes = (n << 32 | at << 1) + (common[first] >= hot)
                held.append([shingles[first].view(np.int64), np.full(size, sid), sizes])
                rows += size
                if rows > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)
                    held, rows = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)

    return run


def _mark(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.view(np.uint64)) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's ids as a bitmap of fixed size, compressed."""
    bits = np.zeros(1 << MARK_BITS, dtype=bool)
    for batch in batches:
        bits[_mark(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))] = True
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["bits"])


def _joined_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << (MARK_BITS - 3), dtype=np.uint8)
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            total |= np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["bits"])


def marks(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2^``MARK_BITS`` bits over one column of ids: what isn't marked isn't among them."""
    total = np.zeros(1 << (MARK_BITS - 3), dtype=np.uint8)
    parts = ids.mapInArrow(_marked, "bits binary").repartition(8).mapInArrow(_joined_marks, "bits binary")
    for row in parts.toLocalIterator():
        total |= np.frombuffer(zlib.decompress(row.bits), dtype=np.uint8)
    return total


def _whole_sets(wanted: np.ndarray):
    """Sets of the texts whose id may be wanted, with their sizes by quarter of the hash range, for the suffix filter."""
    schema = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("shingles", pa.list_(pa.int64())), ("quarters", pa.list_(pa.int32()))])
    pivots = np.array([1 << 62, 2 << 62, 3 << 62], dtype=np.uint64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bits = np.unpackbits(wanted).view(bool)
        for batch in batches:
            ids = batch.column(0)
            batch = batch.filter(pa.array(bits[_mark(ids.fill_null(0).to_numpy(zero_copy_only=False))]))
            for id_, shingles in zip(batch.column(0).to_pylist(), shingle_sets(_texts(batch)), strict=True):
                if len(shingles):
                    cuts = [0, *np.searchsorted(shingles, pivots).tolist(), len(shingles)]
                    yield id_, set_id(shingles), shingles.view(np.int64), [b - a for a, b in zip(cuts, cuts[1:], strict=False)]

    return lambda batches: _batches(rows(batches), schema, 200)


def _overlap_needed(a: Column, b: Column, percent: int) -> Column:
    """Least common shingles of two sets of these sizes: ceil(percent (a + b) / (100 + percent))."""
    return F.ceil(F.lit(percent) * (a + b) / (100 + percent))


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Length and positional filters on two prefix entries (pos, n) of one shingle.

    What two linked sets share lies from the first ``COMMON`` shared shingles on, but for those before; a pair may
    fail at later ones.
    """
    small, large = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    rest = F.least(a["n"] - a["pos"], b["n"] - b["pos"]) + COMMON - 1
    return (100 * small >= percent * large) & (rest >= _overlap_needed(a["n"], b["n"], percent))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets link. Only texts that are in a pair are read into sets."""
    ids = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    # A set is read from the text with the smallest id that has it; the bitmap of those ids spares most other texts.
    wanted = cut(nodes.join(ids.hint("merge"), "sid", "left_semi"), "wanted")
    sets = docs.mapInArrow(_whole_sets(marks(wanted.select("doc_id"))), "doc_id bigint, sid bigint, shingles array<bigint>, quarters array<int>")
    same = F.col("s.sid").eqNullSafe(F.col("w.sid")) & F.col("s.doc_id").eqNullSafe(F.col("w.doc_id"))
    sets = cut(sets.alias("s").join(wanted.alias("w").hint("merge"), same, "left_semi").drop("doc_id"), "sets")
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"), F.col("quarters").alias("xq"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"), F.col("quarters").alias("yq"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    needed = _overlap_needed(F.size("x"), F.size("y"), percent)
    suffix = F.expr("aggregate(zip_with(xq, yq, (p, q) -> least(p, q)), 0, (s, m) -> s + m)")
    linked = F.when(suffix >= needed, F.size(F.array_intersect("x", "y")) >= needed)
    return both.where(linked).select("a", "b").distinct()


def text_keys() -> dict[str, Column]:
    """Two hashes that stand for a text."""
    return {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")}


def linked_sets(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``doc_id, t1, t2, n, sid`` for every document, and ``sid, root`` for the sets in a link.

    ``t1`` and ``t2`` stand for the text, ``sid`` for the set of shingles (null if empty), ``root`` for the component.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = cut(docs.withColumns(text_keys()).mapInArrow(_scan, _SCANNED), "scan")
    rows = scanned.where("chunk IS NULL").select("doc_id", "t1", "t2", "n", "sid")
    nodes = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    entries = docs.select("text").mapInArrow(_prefixes(shared_levels(scanned), percent), "token bigint, sid bigint, size bigint")
    salt = F.when(F.col("size") % 2 == 1, 1 + F.pmod("sid", F.lit(SALTS))).otherwise(0).cast("int")
    group = Window.partitionBy("token", "part")
    entry = F.struct(F.expr("cast(size % 4294967296 div 2 as int)").alias("pos"), "sid", F.expr("cast(size div 4294967296 as int)").alias("n"))
    # Packed until they are shuffled.
    dealt = entries.repartition("token", salt.alias("part")).select("token", salt.alias("part"), entry.alias("e"))
    firsts = (F.min("e").over(group).alias("hub"), F.min("e.sid").over(group).alias("low"), F.max("e.sid").over(group).alias("high"))
    # A group of one set has no pair; salted groups stay for the other parts of their shingle.
    shared = cut(dealt.select("token", "part", "e", *firsts).where("low <> high OR part > 0").drop("low", "high"), "shared")
    members = shared.select("token", "e").distinct()

    best = Window.partitionBy("b").orderBy(F.desc("groups"), "a")
    starred = shared.where(F.col("hub.sid") != F.col("e.sid")).where(_may_link(F.col("e"), F.col("hub"), percent))
    stars = starred.groupBy(F.col("hub.sid").alias("a"), F.col("e.sid").alias("b")).agg(F.count("*").alias("groups"))
    stars = stars.withColumn("place", F.row_number().over(best)).where((F.col("place") == 1) & (F.col("groups") >= COMMON)).select("a", "b")
    # The parts of a salted shingle meet in their hubs.
    hubs = shared.where("part > 0").groupBy("token", "part").agg(F.first("hub").alias("hub"))
    lowest = hubs.groupBy("token").agg(F.min("hub").alias("low"))
    across = hubs.join(lowest, "token").where("hub.sid <> low.sid").where(_may_link(F.col("hub"), F.col("low"), percent))
    tried = cut(stars.union(across.select(F.col("low.sid").alias("a"), F.col("hub.sid").alias("b"))).distinct(), "stars")
    links = cut(_verified(tried, docs, nodes, percent), "links")
    roots = components(links)

    # What a set shares with any other lies from its first shared shingle on.
    first = F.min("e.pos").over(Window.partitionBy("sid"))
    placed = members.withColumn("sid", F.col("e.sid")).withColumn("e", F.col("e").withField("first", first))
    # An entry too late in its set for the smallest set of its group can pair with none.
    least = placed.groupBy("token").agg(F.min("e.n").alias("least"))
    most = F.least(F.col("e.n") - F.col("e.first"), F.col("e.n") - F.col("e.pos") + COMMON - 1)
    able = placed.join(least.hint("merge"), "token").where(percent * (F.col("e.n") + F.col("least")) <= (100 + percent) * most)
    left = cut(able.select("token", "e", "sid"), "able")
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = cut(_open(left, roots), "open")
    while _crowded(left):
        pairs = cut(_starred_again(left, percent).join(tried, ["a", "b"], "left_anti"), "stars")
        wanted = pairs.count()
        found = cut(_verified(pairs, docs, nodes, percent), "links") if wanted else pairs
        new = found.count()
        tried = tried.union(pairs)
        if new:
            links = links.union(found)
            roots = components(links)
            left = cut(_open(left.select("token", "e", "sid"), roots), "open")
        # Only a matter of time: what such rounds leave is crossed.
        if new * FEW <= wanted:
            break
    again = cut(_crossing(left, percent).join(tried, ["a", "b"], "left_anti"), "crossing")
    more = None if again.isEmpty() else cut(_verified(again, docs, nodes, percent), "links")
    if more is None or more.isEmpty():
        return rows, roots.withColumnRenamed("node", "sid")
    return rows, components(links.union(more)).withColumnRenamed("node", "sid")


def _open(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """``token, e, sid, root`` of the entries in groups whose sets lie in more than one component."""
    rooted = entries.join(roots.withColumnRenamed("node", "sid").hint("merge"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    ends = rooted.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token")
    return rooted.join(ends.hint("merge"), "token", "left_semi").select("token", "e", "sid", "root")


def _crowded(left: DataFrame) -> bool:
    rows, squares = left.groupBy("token").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    return (squares or 0) > CROWDED * (rows or 0)


def _from_first(a: Column, b: Column) -> Column:
    return F.least(a["n"] - a["first"], b["n"] - b["first"])


def _may_cross(a: Column, b: Column, percent: int) -> Column:
    return _may_link(a, b, percent) & (_from_first(a, b) >= _overlap_needed(a["n"], b["n"], percent))


def _starred_again(left: DataFrame, percent: int) -> DataFrame:
    """One pair (a, b) for every set at most, with a set of another component.

    A group's partners are its earliest entry, and the earliest of all other components for those in the
    first one's. Of its partners a set takes the one it meets in most groups.
    """
    lead = left.groupBy("token").agg(F.min(F.struct("e.pos", "e.sid", "e", "root")).alias("one"))
    both = left.join(lead.hint("merge"), "token")
    other = both.where(F.col("root") != F.col("one.root")).groupBy("token").agg(F.min(F.struct("e.pos", "e.sid", "e", "root")).alias("two"))
    met = both.join(other.hint("merge"), "token")
    met = met.withColumn("hub", F.when(F.col("root") != F.col("one.root"), F.col("one.e")).otherwise(F.col("two.e")))
    counts = met.where(_may_cross(F.col("e"), F.col("hub"), percent)).groupBy(F.col("hub.sid").alias("h"), "sid").agg(F.count("*").alias("n"))
    best = Window.partitionBy("sid").orderBy(F.desc("n"), "h")
    chosen = counts.where(F.col("n") >= COMMON).withColumn("place", F.row_number().over(best)).where("place = 1")
    return chosen.select(F.least("h", "sid").alias("a"), F.greatest("h", "sid").alias("b")).distinct()


def _crossing(left: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of sets of two components that may link."""
    crossing = left.alias("p").join(left.alias("q").hint("merge"), (F.col("p.token") == F.col("q.token")) & (F.col("p.root") < F.col("q.root")))
    crossing = crossing.where(_may_cross(F.col("p.e"), F.col("q.e"), percent)).select(
        F.least("p.e.sid", "q.e.sid").alias("a"), F.greatest("p.e.sid", "q.e.sid").alias("b")
    )
    return crossing.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).select("a", "b")


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per document."""
    rows, roots = linked_sets(docs, percent)
    nodes = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("low")).join(roots, "sid", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "sid"))
    ends = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.join(ends, "root").select("sid", "component_id")
    linked = rows.where("sid IS NOT NULL").join(named, "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("sid IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near copies, with its own columns: the one with the smallest id, rows without one last.

    Rows are chosen by their texts, so repeated ids with different texts are documents of their own, and rows
    without an id are compared like all others. Of rows that repeat both id and text one stays. Rows without
    words are near copies of nothing and all stay.
    """
    rows, roots = linked_sets(docs.select("doc_id", "text"), percent)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    sets = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min(first).alias("first")).join(roots, "sid", "left")
    chosen = sets.groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("first").alias("first")).select("first.doc_id", "first.t1", "first.t2")
    keys = {f"_{name}": column for name, column in text_keys().items()}
    shut = docs.select(F.col("doc_id").cast("long").alias("_id"), *[c.alias(n) for n, c in keys.items()], "text", F.struct("*").alias("_own"))
    wordy = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2"))
    kept = shut.where(wordy).drop("text").join(chosen, same, "left_semi").dropDuplicates(["_id", "_t1", "_t2"])
    return kept.select("_own").union(shut.where(~wordy).select("_own")).select("_own.*")
