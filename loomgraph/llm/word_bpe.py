"""Word-level BPE (12): a table of distinct words, each encoded once.

Texts are normalised and split into words in Arrow tasks, and the distinct words
counted. Every distinct word is encoded once, by merges in the order of rank from
a heap of pairs, and its ids are decoded through a join with the table of pieces.

The ids come back to the texts by position. The most frequent words, a table of
bounded rows and bytes, are sent to every task; each text leaves it as a packed
list of places in that table, and its other distinct words as rows of their own,
which are joined with the table of words and then, by text, with the packed lists.
So neither texts nor words that occur often are shuffled. Texts are known by 95
bits of hash of id and text, words in the frequent table by 96 bits of hash of their characters.

How the vocabulary's file normalises (composed characters, lower case) and which
characters are letters or digits is asked of the file's own normaliser and splitter,
one character or unusual text at a time, as their Unicode version decides the result.

Defined cases: null and empty texts have no ids; the special tokens' strings in a
text become those tokens; the id column is passed on as it is, nulls and repeats
included; repeated rows each have their own result; an empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.shingles import mixed
from loomgraph.llm.text import whole
from loomgraph.session import cut, ship

# Bounds of the table that every task gets: rows, bytes, and bytes of one word.
FREQUENT, FREQUENT_BYTES, LONGEST = 1 << 19, 1 << 26, 4096
# Words are counted in so many buckets; a task sends its counts on when it holds so many words.
BUCKETS, HELD_WORDS = 1024, 1 << 17
_SLICE, _GATHER, _ENCODED = 1 << 17, 1 << 16, 1 << 13
_SPACE, _LETTER, _NUMBER, _OTHER, _SPECIAL, _UNKNOWN = range(6)
# Special tokens stand in a text as surrogates, which no text can hold.
_MARK = 0xD800

# The steps a vocabulary file has to name.
_NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it can be seen, else the next one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in seen else next(hidden)) for b in range(256)]


class Vocabulary:
    """Pieces, merges and special tokens of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        model, added = read["model"], read["added_tokens"]
        split = read["pre_tokenizer"]["pretokenizers"][0]
        plain = all(not a["normalized"] and not a["lstrip"] and not a["rstrip"] and not a["single_word"] for a in added)
        if read["normalizer"]["normalizers"] != _NORMALISERS or split["pattern"]["Regex"] != _PATTERN or read["decoder"] is not None or not plain:
            raise ValueError(f"{path} normalises, splits or decodes in a way that is not known here")
        # Only what normalises and splits goes to the tasks that ask it.
        self.settings = json.dumps({**read, "added_tokens": [], "model": {**model, "vocab": {}, "merges": []}, "truncation": None, "padding": None})
        self.specials = {a["content"]: a["id"] for a in added}
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.pieces = {**{i: piece for piece, i in vocab.items()}, **{i: piece for piece, i in self.specials.items()}}
        self.inner = [vocab[c] for c in byte_characters()]
        self.last = [vocab[c + end] for c in byte_characters()]
        self.pairs = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])


def merged(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Join neighbours, the lowest rank and then the leftmost first, until no pair has a rank."""
    ids, size = list(ids), len(ids)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = []

    def put(i: int) -> None:
        j = after[i]
        if j < size and (found := pairs.get((ids[i], ids[j]))):
            heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

    for i in range(size - 1):
        put(i)
    while heap:
        _, i, left, right, joined = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j >= size or ids[j] != right:
            continue
        ids[i], ids[j], after[i] = joined, -1, after[j]
        if after[i] < size:
            before[after[i]] = i
        put(i)
        if before[i] >= 0:
            put(before[i])
    return [i for i in ids if i >= 0]


class Splitter:
    """Normalises texts and splits them into words, many at a time over arrays of code points."""

    _made: dict[str, Splitter] = {}

    def __init__(self, settings: str, specials: list[str]) -> None:
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(settings)
        self._normalise, self._split = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self._classes = np.full(0x110000, _UNKNOWN, dtype=np.uint8)
        self._classes[_MARK : _MARK + 256] = _SPECIAL
        self._odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        self._base, self._powers, self._inverse = 0xD6E8FEB86659FD93, np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
        self._specials = {s: chr(_MARK + k) for k, s in enumerate(specials)}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    @classmethod
    def of(cls, settings: str, specials: list[str]) -> Splitter:
        if settings not in cls._made:
            cls._made[settings] = cls(settings, specials)
        return cls._made[settings]

    # Characters that composing leaves alone and that have one lower-case form everywhere.
    _usual = re.compile(r"[^\x00-\u02ff\u2010-\u205e]")

    def normal(self, text: str) -> str:
        parts = self._cut.split(text) if self._cut else [text]
        return "".join(
            self._specials[p] if k % 2 else p.lower() if p.isascii() or not self._usual.search(p) else self._normalise(p) for k, p in enumerate(parts)
        )

    def _classify(self, points: np.ndarray) -> np.ndarray:
        classes = self._classes[points]
        unknown = points[classes == _UNKNOWN]
        if not len(unknown):
            return classes
        for point in np.unique(unknown).tolist():
            among_letters, among_others = (len(self._split(side + chr(point) + side)) for side in "a!")
            self._classes[point] = {(1, 3): _LETTER, (3, 1): _OTHER, (3, 3): _NUMBER, (2, 2): _SPACE}[among_letters, among_others]
        return self._classes[points]

    def _bounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end."""
        classes = self._classify(points)
        before = np.concatenate([[_SPACE], classes[:-1]])
        starts = (classes != _SPACE) & ((classes != before) | (classes == _NUMBER) | (classes == _SPECIAL))
        # An apostrophe that begins a word takes the end of a contraction with it, which ends the word.
        marks = np.flatnonzero(points == ord("'"))
        marks = marks[starts[marks]]
        padded = np.concatenate([points, np.zeros(2, dtype=points.dtype)]) if len(marks) else points
        for tail in _CONTRACTIONS if len(marks) else ():
            hit = marks[np.logical_and.reduce([padded[marks + 1 + k] == ord(c) for k, c in enumerate(tail)])]
            starts[np.concatenate([hit + 1 + k for k in range(len(tail))])] = False
            ends = hit + 1 + len(tail)
            ends = ends[ends < len(points)]
            starts[ends] = classes[ends] != _SPACE
        edges = np.flatnonzero(starts | (classes == _SPACE))
        words = starts[edges]
        return edges[words], np.append(edges[1:], len(points))[words]

    def _hashes(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Two hashes of every word: polynomials of its code points, from running sums."""
        if len(self._powers) <= len(points):
            size = max(len(points) + 1, _SLICE + 1)
            for name, step in (("_powers", self._base), ("_inverse", pow(self._base, -1, 2**64))):
                steps = np.full(size, step, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        found = []
        for odd in self._odd:
            sums = np.zeros(len(points) + 1, dtype=np.uint64)
            np.cumsum(mixed((points.astype(np.uint64) + np.uint64(1)) * odd) * self._powers[: len(points)], out=sums[1:])
            found.append(mixed((sums[ends] - sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64)))
        return found

    def hashes(self, words: list[str]) -> list[np.ndarray]:
        """Hashes of single words as they are."""
        found: list[list[np.ndarray]] = [[], []]
        for at in range(0, len(words), 1 << 13):
            some = words[at : at + (1 << 13)]
            points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            ends = np.cumsum([len(w) for w in some], dtype=np.int64)
            for held, new in zip(found, self._hashes(points, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends), strict=True):
                held.append(new)
        return [np.concatenate(held) if held else np.zeros(0, dtype=np.uint64) for held in found]

    def slices(self, texts: Iterable[str | None]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """About a million characters at a time: characters, their code points, words' starts and ends, their texts' places, and hashes."""
        held, owners, size = [], [], 0

        def found():
            joined = "\n".join(held)
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            starts, ends = self._bounds(points)
            owner = np.array(owners)[np.searchsorted(np.cumsum([len(h) + 1 for h in held]), starts, "right")]
            return joined, points, starts, ends, owner, self._hashes(points, starts, ends)

        for place, text in enumerate(texts):
            text, at = self.normal(text) if text else "", 0
            while at < len(text):
                stop = min(at + _SLICE - size, len(text))
                if stop < len(text):
                    # Words end at blanks.
                    stop = (text.find(" ", stop) + 1) or len(text)
                held.append(text[at:stop])
                owners.append(place)
                size += stop - at
                at = stop
                if size >= _SLICE:
                    yield found()
                    held, owners, size = [], [], 0
        if held:
            yield found()


def _texts(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, a few at a time."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()
    # Workers live on and share their executor's memory.
    pa.default_memory_pool().release_unused()


def _tidy(run):
    """``run``, giving back at its end what it has freed: workers live on and share their executor's memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return tidied


def _splitter(vocabulary: Vocabulary):
    settings, specials = vocabulary.settings, list(vocabulary.specials)
    return lambda: Splitter.of(settings, specials)


def _counted(splitter):
    """The task's distinct words by bucket of their hash: in order, one behind the other, with their counts, compressed."""
    schema = pa.schema([("bucket", pa.int32()), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("counts", pa.binary())])

    def packed(held: dict[str, int]) -> Iterator[pa.RecordBatch]:
        words = sorted(held)
        bucket = (splitter().hashes(words)[0] % np.uint64(BUCKETS)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds, rows = np.searchsorted(bucket[order], np.arange(BUCKETS + 1)), []
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            some = [words[i] for i in order[bounds[b] : bounds[b + 1]].tolist()]
            blobs = "\n".join(some).encode(), np.array([held[w] for w in some], dtype=np.int64).tobytes()
            rows.append((b, [len(x) for x in blobs], *(pa.compress(x, codec="zstd", asbytes=True) for x in blobs)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for joined, points, starts, ends, _, (hashes, _) in splitter().slices(_texts(batch.column(0))):
                _, first, times = np.unique(hashes, return_index=True, return_counts=True)
                plain = (points[starts[first]] < _MARK) | (points[starts[first]] >= _MARK + 256)
                first, times = first[plain], times[plain]
                for a, b, n in zip(starts[first].tolist(), ends[first].tolist(), times.tolist(), strict=True):
                    word = joined[a:b]
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield from packed(held)
                    held = {}
        if held:
            yield from packed(held)

    return _tidy(run)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, int]]:
    """Distinct words with their counts over all tasks, a bucket at a time."""
    bucket, held = None, {}
    for batch in batches:
        for b, sizes, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and held:
                yield held
                held = {}
            bucket = b
            words, counts = (pa.decompress(x, n, codec="zstd", asbytes=True) for x, n in zip((words, counts), sizes, strict=True))
            for word, n in zip(words.decode().split("\n"), np.frombuffer(counts, dtype=np.int64).tolist(), strict=True):
                held[word] = held.get(word, 0) + n
    if held:
        yield held


def _encoded(vocabulary: Vocabulary):
    """The words of each bucket with their counts and ids. One worker adds up and encodes, since each takes its share of the executor's memory."""
    inner, last, pairs = vocabulary.inner, vocabulary.last, vocabulary.pairs
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _summed(batches):
            rows = list(held.items())
            for at in range(0, len(rows), _ENCODED):
                words, counts = zip(*rows[at : at + _ENCODED], strict=True)
                data = [word.encode() for word in words]
                ids = [merged([*(inner[b] for b in word[:-1]), last[word[-1]]], pairs) for word in data]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((words, counts, ids), schema.types, strict=True)], schema=schema)

    return _tidy(run)


def word_table(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``word, n, ids, decoded`` of every distinct word of one column of texts: count, ids, and the ids' pieces joined by blanks."""
    parts = texts.mapInArrow(_counted(_splitter(vocabulary)), "bucket int, sizes array<bigint>, words binary, counts binary")
    coded = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encoded(vocabulary), "word string, n bigint, ids array<int>")
    # One row per id of the vocabulary.
    pieces = F.broadcast(texts.sparkSession.createDataFrame(list(vocabulary.pieces.items()), "id int, piece string"))
    placed = coded.select("word", "n", F.size("ids").alias("size"), F.posexplode("ids").alias("pos", "id")).join(pieces, "id")
    in_order = placed.select("word", "n", "size", "pos", "id", "piece").mapInArrow(_regrouped, "word string, n bigint, ids array<int>, decoded string")
    return cut(in_order, "words")


def _regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and pieces of a word, which left the join one behind the other, together again; any other order is an error."""
    held: pa.Table | None = None

    def grouped(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        pos, size = (table.column(c).to_numpy() for c in ("pos", "size"))
        starts = np.flatnonzero(pos == 0)
        ends = np.append(starts[1:], len(pos))
        if (len(starts) and starts[0]) or (ends - starts != size[starts]).any() or (pos != np.arange(len(pos)) - np.repeat(starts, ends - starts)).any():
            raise RuntimeError("the pieces of a word have lost their order")
        offsets = pa.array(np.append(starts, len(pos)), pa.int32())
        ids, pieces = (pa.ListArray.from_arrays(offsets, table.column(c).combine_chunks()) for c in ("id", "piece"))
        first = pa.array(starts)
        columns = [table.column("word").combine_chunks().take(first), table.column("n").combine_chunks().take(first), ids, pc.binary_join(pieces, " ")]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n", "ids", "decoded"])

    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        starts = np.flatnonzero(table.column("pos").to_numpy() == 0)
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield grouped(table.slice(0, last))
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield grouped(held)


_LEVEL = "cast(floor(8 * log2(n)) as int)"


def _lowest_level(words: DataFrame, rows: int, size: int) -> int:
    """The count level down to which words fit into the frequent table; there are eight per power of two."""
    weight = F.octet_length("word") + 4 * F.size("ids") + F.octet_length("decoded")
    levels = words.where(F.octet_length("word") <= LONGEST).groupBy(F.expr(_LEVEL).alias("level")).agg(F.count("*").alias("n"), F.sum(weight).alias("size"))
    lowest, total, used = 1 << 30, 0, 0
    for row in levels.orderBy(F.desc("level")).toLocalIterator():
        total, used = total + row.n, used + row["size"]
        if total > rows or used > size:
            break
        lowest = row.level
    return lowest


class Codes:
    """Ids and decoded bytes of numbered words, as flat arrays; a blank stands behind every decoded word."""

    def __init__(self, ids: np.ndarray, id_sizes: np.ndarray, data: np.ndarray, data_sizes: np.ndarray) -> None:
        self.ids, self.data = ids.astype("<u4"), data
        self.id_ends, self.data_ends = (np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) for sizes in (id_sizes, data_sizes))

    @classmethod
    def of(cls, ids: list[list[int]], decoded: list[bytes]) -> Codes:
        data = np.frombuffer(b"".join(d + b" " for d in decoded), dtype=np.uint8)
        flat = np.fromiter((i for word in ids for i in word), dtype=np.uint32)
        return cls(flat, np.array([len(i) for i in ids], dtype=np.int64), data, np.array([len(d) + 1 for d in decoded], dtype=np.int64))

    def __reduce__(self):
        """Sent compressed: sizes for ends, and the bytes of equal weight together."""
        arrays = [self.ids, np.diff(self.id_ends), self.data, np.diff(self.data_ends)]
        kinds = ["<u4", "<u4", "u1", "<u4"]
        planes = [a.astype(k).view(np.uint8).reshape(len(a), -1).T.tobytes() for a, k in zip(arrays, kinds, strict=True)]
        return _codes_sent, ([(len(a), len(p), k, pa.compress(p, codec="zstd", asbytes=True)) for a, p, k in zip(arrays, planes, kinds, strict=True)],)

    def with_more(self, other: Codes) -> Codes:
        out = object.__new__(Codes)
        out.ids, out.data = np.concatenate([self.ids, other.ids]), np.concatenate([self.data, other.data])
        out.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + other.id_ends[1:]])
        out.data_ends = np.concatenate([self.data_ends, self.data_ends[-1] + other.data_ends[1:]])
        return out

    def some(self, numbers: np.ndarray) -> Codes:
        """Only the words of these numbers."""
        ids, data = self._gathered(self.ids, self.id_ends, numbers), self._gathered(self.data, self.data_ends, numbers)
        return Codes(np.frombuffer(ids[0], dtype="<u4"), np.diff(ids[1]), np.frombuffer(data[0], dtype=np.uint8), np.diff(data[1]))

    @staticmethod
    def _gathered(flat: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The words' values one behind the other, as bytes, and where each begins; some words at a time."""
        sizes = ends[numbers + 1] - ends[numbers]
        tops, parts = np.concatenate([[0], np.cumsum(sizes)]), []
        for at in range(0, len(numbers), _GATHER):
            of, size = numbers[at : at + _GATHER], sizes[at : at + _GATHER]
            before = np.cumsum(size) - size
            parts.append(flat[np.repeat(ends[of] - before, size) + np.arange(size.sum())].tobytes())
        return b"".join(parts), tops

    def joined(self, numbers: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Packed ids and decoded bytes of the texts whose words' numbers lie between the bounds."""
        ids, tops = self._gathered(self.ids, self.id_ends, numbers)
        data, ends = self._gathered(self.data, self.data_ends, numbers)
        pairs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        return [ids[4 * tops[a] : 4 * tops[b]] for a, b in pairs], [data[ends[a] : max(ends[b] - 1, ends[a])] for a, b in pairs]


def _codes_sent(parts: list[tuple[int, int, str, bytes]]) -> Codes:
    arrays = []
    for n, size, kind, packed in parts:
        planes = np.frombuffer(pa.decompress(packed, size, codec="zstd", asbytes=True), dtype=np.uint8).reshape(-1, n)
        arrays.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
    ids, id_sizes, data, data_sizes = arrays
    return Codes(ids, id_sizes.astype(np.int64), data, data_sizes.astype(np.int64))


_PARTS = ["first", "second", "ids", "id_sizes", "data", "data_sizes"]
_KINDS = [np.uint64, np.uint64, np.int32, np.int32, np.uint8, np.int32]


def _words_packed(splitter):
    """Hashes, ids and decoded bytes of the words of a batch, as bytes of flat arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = splitter().hashes(batch.column(0).to_pylist())
            decoded = [d.encode() + b" " for d in batch.column(2).to_pylist()]
            arrays = [
                first, second, batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).value_lengths().to_numpy(zero_copy_only=False),
                np.frombuffer(b"".join(decoded), dtype=np.uint8), np.array([len(d) for d in decoded]),
            ]
            packed = [pa.array([a.astype(k).tobytes()], pa.binary()) for a, k in zip(arrays, _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays(packed, names=_PARTS)

    return run


class Frequent:
    """The numbers of the frequent words, specials first, and then by falling count, found by hash."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.number = np.argsort(first).astype(np.int32)
        self.first, self.second, self.size = first[self.number], second[self.number].astype(np.uint32), len(first)

    def __reduce__(self):
        """Sent in the order of numbers, and sorted where it arrives."""
        back = np.argsort(self.number)
        return Frequent, (self.first[back], self.second[back])

    def numbers(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Numbers of words, and -1 for others."""
        if not self.size:
            return np.full(len(hashes[0]), -1)
        place = np.minimum(np.searchsorted(self.first, hashes[0]), self.size - 1)
        return np.where((self.first[place] == hashes[0]) & (self.second[place] == hashes[1].astype(np.uint32)), self.number[place], -1)


def _frequent(vocabulary: Vocabulary, words: DataFrame) -> tuple[Frequent, Codes]:
    """Numbers and codes of the words, which come in order."""
    splitter, specials = _splitter(vocabulary), list(vocabulary.specials.items())
    start = Codes.of([[i] for _, i in specials], [s.encode() for s, _ in specials])
    hashes = splitter().hashes([chr(_MARK + k) for k in range(len(specials))])
    parts = [[h] for h in hashes] + [[start.ids], [np.diff(start.id_ends)], [start.data], [np.diff(start.data_ends)]]
    packed = words.select("word", "ids", "decoded").mapInArrow(_words_packed(splitter), ", ".join(f"{p} binary" for p in _PARTS))
    for row in packed.toLocalIterator():
        for part, name, kind in zip(parts, _PARTS, _KINDS, strict=True):
            part.append(np.frombuffer(row[name], dtype=kind))
    first, second, *codes = (np.concatenate(part) for part in parts)
    return Frequent(first, second), Codes(*codes)


def _numbered(splitter, frequent: Frequent, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """For every text with words: its place, the numbers of its words, and the words that have numbers of its own, from ``frequent.size`` on."""
    place, numbers, own = -1, [], {}

    def found():
        return place, np.concatenate(numbers), [w for w, _ in sorted(own.values(), key=lambda x: x[1])]

    for joined, _, starts, ends, owner, hashes in splitter().slices(texts):
        known = frequent.numbers(hashes)
        bounds = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)] if len(owner) else [0]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if owner[a] != place:
                if numbers:
                    yield found()
                place, numbers, own = int(owner[a]), [], {}
            mine = known[a:b].copy()
            for k in np.flatnonzero(mine < 0).tolist():
                word = joined[starts[a + k] : ends[a + k]]
                mine[k] = own.setdefault(word, (word, frequent.size + len(own)))[1]
            numbers.append(mine)
    if numbers:
        yield found()


def _id_kind(vocabulary: Vocabulary) -> str:
    """The shortest whole numbers that hold every id, for what is shuffled."""
    return "<u2" if max(vocabulary.pieces) < 1 << 16 else "<u4"


def _with_code(kind: str):
    """Words with their codes in one value: how many ids, the ids, and the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [
                len(ids).to_bytes(4, "little") + np.array(ids, dtype=kind).tobytes() + decoded.encode()
                for ids, decoded in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], names=["word", "code"])

    return run


def _read_codes(codes: list[bytes], kind: str) -> Codes:
    sizes, width = [int.from_bytes(c[:4], "little") for c in codes], np.dtype(kind).itemsize
    return Codes.of(
        [np.frombuffer(c, dtype=kind, count=n, offset=4).tolist() for c, n in zip(codes, sizes, strict=True)],
        [c[4 + width * n :] for c, n in zip(codes, sizes, strict=True)])


def _rare(splitter, shared: Broadcast):
    """The words of each text that the frequent table lacks, with their numbers in it."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("number", pa.int32()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [batch.column(i).to_pylist() for i in (0, 1)], []
            for place, _, own in _numbered(splitter, shared.value, _texts(batch.column(2))):
                out += [(keys[0][place], keys[1][place], i, word) for i, word in enumerate(own)]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return _tidy(run)


def _packed(splitter, shared: Broadcast):
    """Each text's words as numbers, the bytes of equal weight together, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, counts = [None] * batch.num_rows, [0] * batch.num_rows
            for place, numbers, _ in _numbered(splitter, shared.value, _texts(batch.column(3))):
                planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                blobs[place], counts[place] = pa.compress(planes, codec="zstd", asbytes=True), len(numbers)
            columns = [*batch.columns[:3], pa.array(blobs, pa.binary()), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "k1", "k2", "blob", "words"])

    return _tidy(run)


def _unpacked(shared: Broadcast, key: str, kind: str):
    """Ids and decoded bytes of texts from their packed numbers and the codes of their own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Codes = shared.value
        size_known = len(known.id_ends) - 1
        for batch in batches:
            counts, at = batch.column(2).to_pylist(), 0
            while at < len(counts):
                stop, size = at, 0
                while stop < len(counts) and (stop == at or size + counts[stop] <= _GATHER):
                    size += counts[stop]
                    stop += 1
                keys, blobs, rare = (batch.column(i).slice(at, stop - at) for i in (0, 1, 3))
                numbers, own, bounds = [], [], [0]
                for blob, n, more in zip(blobs.to_pylist(), counts[at:stop], rare.to_pylist(), strict=True):
                    mine = np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd"), dtype=np.uint8).reshape(4, n).T if n else np.zeros((0, 4), np.uint8)
                    mine = np.ascontiguousarray(mine).view("<u4").reshape(-1).astype(np.int64)
                    more = sorted(more or [], key=lambda r: r["number"])
                    if np.unique(mine[mine >= size_known]).tolist() != [size_known + r["number"] for r in more]:
                        raise RuntimeError("a text's words and their codes don't fit")
                    numbers.append(np.where(mine >= size_known, mine + len(own), mine))
                    own += more
                    bounds.append(bounds[-1] + n)
                used, place = np.unique(np.concatenate(numbers), return_inverse=True)
                codes = known.some(used[: len(used) - len(own)])
                if own:
                    codes = codes.with_more(_read_codes([r["code"] for r in own], kind))
                ids, data = codes.joined(place, np.array(bounds))
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(data, pa.binary())], names=[key, "ids", "decoded"])
                at = stop

    return _tidy(run)


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", rows: int = FREQUENT, size: int = FREQUENT_BYTES) -> DataFrame:
    """``key, ids, decoded`` of every text: ids as little-endian 32-bit integers, and the UTF-8 bytes of the text they decode to."""
    ship(docs.sparkSession)
    splitter, kind = _splitter(vocabulary), _id_kind(vocabulary)
    text = whole(F.col("text"))
    # The two hashes see the id and the text in turn. They are shuffled with every rare word, so 95 bits are kept.
    second = F.xxhash64(text, key).bitwiseAND(0x7FFFFFFF).cast("int")
    keyed = docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("k1"), second.alias("k2"), text.alias("text"))
    words = word_table(keyed.select("text"), vocabulary)
    near = (F.expr(_LEVEL) >= _lowest_level(words, rows, size)) & (F.octet_length("word") <= LONGEST)
    # At most ``rows`` words and ``size`` bytes.
    context = docs.sparkSession.sparkContext
    frequent, known = map(context.broadcast, _frequent(vocabulary, words.where(near).orderBy(F.desc("n"), "word")))

    rare = keyed.select("k1", "k2", "text").mapInArrow(_rare(splitter, frequent), "k1 bigint, k2 int, number int, word string")
    coded = words.where(~near).select("word", "ids", "decoded").mapInArrow(_with_code(kind), "word string, code binary")
    # Repeated rows send the same words, which count once.
    lists = rare.join(coded.hint("merge"), "word").groupBy("k1", "k2").agg(F.collect_set(F.struct("number", "code")).alias("rare"))
    packed_type = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("k1", T.LongType()), T.StructField("k2", T.IntegerType()),
        T.StructField("blob", T.BinaryType()), T.StructField("words", T.IntegerType()),
    ])
    packed = keyed.mapInArrow(_packed(splitter, frequent), packed_type)
    out = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    both = packed.join(lists.hint("merge"), ["k1", "k2"], "left").select("key", "blob", "words", "rare")
    return both.mapInArrow(_unpacked(known, key, kind), out)
