"""Toxicity (6): character n-grams scaled by naive Bayes log-count ratios, then a linear classifier.

A text's features are the hashed character n-grams of its distinct words. How
much commoner each is in toxic than in other labelled texts, as a log ratio, is
counted over all training rows; the ratios scale the features of a logistic
regression, which is fitted in one task on a bounded sample of those rows
(``SAMPLE`` of each label, those with the smallest hash of their id). The
intercept is moved back to the share of toxic rows among all training rows.

As a score adds up over distinct words, it is worked out once per word of a
task and looked up in its texts.

Defined cases: null, empty and blank texts have the intercept's score; rows with
a null label are not used; without any training row, or with one label only, all
scores are the smoothed share of toxic rows; repeated rows count as often as
they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut, ship

ORDERS = (2, 3, 4, 5)
BITS = 18
SAMPLE = 4000
EPOCHS = 12
_CACHE = 200_000
_WORDS = 20_000


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether a row is kept from training: by the crc32 of its id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def distinct_words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words, each between two blanks, and the number of the word of each."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    word = np.cumsum(codes == 32) - 1
    # An n-gram belongs to the word that it starts in; it may touch the blank behind, but not go beyond it.
    found, owners = [], []
    for order in ORDERS:
        runs = len(codes) - order + 1
        if runs <= 0:
            continue
        value = np.full(runs, order, dtype=np.uint64)
        for i in range(order):
            value = value * np.uint64(0x100000001B3) + codes[i : i + runs]
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        inside = word[order - 2 : order - 2 + runs] == word[:runs] if order > 2 else np.ones(runs, dtype=bool)
        found.append((value >> np.uint64(64 - BITS)).astype(np.int32)[inside])
        owners.append(word[:runs][inside])
    index, owner = np.concatenate(found), np.concatenate(owners)
    keep = owner < len(words)
    return index[keep], owner[keep]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's feature counts by label, in compressed chunks, with the numbers of rows."""
    schema = pa.schema([("toxic", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), ("counts", pa.binary())])
    sums, rows = np.zeros((2, 1 << BITS)), [0, 0]
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows[toxic] += 1
            if words := distinct_words(text):
                np.add.at(sums[toxic], ngrams(list(words))[0], 1)
    packed = [zlib.compress(s.astype(np.uint32).tobytes(), 1) for s in sums]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[0, 1], [0, 0], rows, packed], schema.types, strict=True)], schema=schema)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of what this task has been dealt, one label at a time."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for toxic, n, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts = np.frombuffer(zlib.decompress(packed), dtype=np.uint32).astype(np.float64)
            before = sums.get(toxic, (0, 0.0))
            sums[toxic] = (before[0] + n, before[1] + counts)
    for toxic, (n, counts) in sums.items():
        yield pa.RecordBatch.from_pydict({"toxic": pa.array([toxic], pa.int32()), "n": pa.array([n], pa.int64()), "counts": pa.array([counts.tobytes()], pa.binary())})


@dataclass
class Model:
    weights: np.ndarray  # one per feature, ratios included
    intercept: float

    def words(self, words: list[str]) -> np.ndarray:
        index, owner = ngrams(words)
        return np.bincount(owner, self.weights[index], minlength=len(words))


def _fit(ratios: np.ndarray, shift: float):
    """Logistic regression by stochastic gradient steps with a falling rate, on all rows of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = distinct_words(text)
                index = ngrams(sorted(words))[0] if words else np.zeros(0, dtype=np.int32)
                features, times = np.unique(index, return_counts=True)
                keep = np.abs(ratios[features]) > 0.05
                values = (times * ratios[features]).astype(np.float32)[keep]
                norm = float(np.sqrt((values**2).sum())) or 1.0
                rows.append((features[keep], values, norm, toxic))
        weights, bias, grads = np.zeros(len(ratios), dtype=np.float32), 0.0, np.full(len(ratios), 1e-3, dtype=np.float32)
        random = np.random.Generator(np.random.PCG64(5))
        bias_grads = 1e-3
        for _ in range(EPOCHS):
            for i in random.permutation(len(rows)):
                index, values, norm, toxic = rows[i]
                z = float(weights[index] @ values) + bias
                error = 1 / (1 + np.exp(-min(max(z, -30.0), 30.0))) - toxic
                step = error * values / max(1.0, norm / 10)
                grads[index] += step**2
                weights[index] -= 0.1 * step / np.sqrt(grads[index])
                bias_grads += error**2
                bias -= 0.1 * error / np.sqrt(bias_grads)
        weights *= ratios.astype(np.float32)
        toxic = sum(row[3] for row in rows)
        drawn = np.log((toxic + 1) / (len(rows) - toxic + 1))
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.tobytes()], pa.binary()), "intercept": pa.array([bias + shift - drawn], pa.float64())})

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic) with toxic 0 or 1.

    The sample is chosen from the labels alone, so that texts are shuffled once, for the counts. Labels grow with the
    texts, so they are merged and not broadcast, however few.
    """
    ship(docs.sparkSession)
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text").join(marks.hint("merge"), "doc_id").select("text", "toxic")
    counted = cut(rows.mapInArrow(_counts, "toxic int, chunk int, n bigint, counts binary"), "counts")
    # Summed in eight tasks, then their sums: two labels of 2^BITS numbers each.
    parts = counted.select("toxic", "n", "counts").repartition(8).mapInArrow(_summed, "toxic int, n bigint, counts binary")
    n, sums = [0, 0], [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    for row in parts.toLocalIterator():
        n[row.toxic] += row.n
        sums[row.toxic] = sums[row.toxic] + np.frombuffer(row.counts)
    share = (n[1] + 1) / (n[0] + n[1] + 2)
    shift = float(np.log(share / (1 - share)))
    if not n[0] or not n[1]:
        return Model(np.zeros(1 << BITS, dtype=np.float32), shift)
    p, q = sums[1] + 1, sums[0] + 1
    ratios = np.log(p / p.sum()) - np.log(q / q.sum())
    chosen = [marks.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id")).limit(sample) for t in (0, 1)]
    # At most twice ``sample`` ids, whatever the input.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    fitted = texts.select("text", "toxic").repartition(1).mapInArrow(_fit(ratios, shift), "weights binary, intercept double").first()
    return Model(np.frombuffer(fitted.weights, dtype=np.float32), fitted.intercept)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            held = [distinct_words(t) for t in texts]
            if len(known) > _CACHE:
                known = {}
            new = list(set().union(*held).difference(known))
            for start in range(0, len(new), _WORDS):
                part = new[start : start + _WORDS]
                known.update(zip(part, model.words(part).tolist(), strict=True))
            z = np.array([model.intercept + sum(sorted(map(known.__getitem__, words))) for words in held])
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
