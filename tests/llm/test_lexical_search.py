"""Ranked search against scores worked out in plain Python for every document."""

import math
import re
from collections import Counter

import numpy as np

from loomgraph.llm import lexical_search
from loomgraph.session import cut
from tests.llm.conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(rows, items, limit=10):
    docs = [(i, terms(t)) for i, t, *_ in rows]
    docs = [(i, t, Counter(t)) for i, t in docs if t]
    N, L = len(docs), sum(len(t) for _, t, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, t, c in docs:
            m = 100 - 75 + (75 * len(t) * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:limit])]
    return sorted(out, key=repr)


def frame_of(spark, items):
    return spark.createDataFrame([(i, t, 0, 1.0) for i, t in items], "item_id bigint, text string, rank int, score double")


def found(spark, docs, items, **options):
    out = lexical_search.search(docs, frame_of(spark, items), **options)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.toLocalIterator()), key=repr)


def test_ranks_as_if_every_document_were_scored(spark, frame, odd_rows):
    rows = odd_rows + [(i, prose(i % 40, 20 + 7 * (i % 30))) for i in range(100, 400)] + [(500 + i, "common words " * 40) for i in range(60)]
    items = [(i, " ".join(prose(i, 80).split()[10:50])) for i in range(8)] + [
        (20, None), (21, ""), (22, "?! -"), (23, "unheard-of"), (24, "Common COMMON words"), (25, "One two"), (26, "é É ÉÉ"), (26, prose(4, 30)), (None, prose(5, 30)), (30, "x\u0000y A1_b2")]
    for probes in (40, 10):
        assert found(spark, frame(rows).repartition(3), items, probes=probes) == brute(rows, items)
    assert found(spark, frame(rows), items[:5], limit=3) == brute(rows, items[:5], 3)


def test_blocks_of_queries_and_small_shards_change_nothing(spark, frame):
    rows = [(i, prose(i % 25, 10 + i)) for i in range(120)]
    items = [(i, prose(i, 25)) for i in range(9)]
    kept = lexical_search.BLOCK_ITEMS
    lexical_search.BLOCK_ITEMS = 4
    try:
        assert found(spark, frame(rows), items) == brute(rows, items)
    finally:
        lexical_search.BLOCK_ITEMS = kept


def test_empty_tables(spark, frame):
    assert found(spark, frame([]), [(1, "a")]) == []
    assert found(spark, frame([(1, "a")]), []) == []
    assert found(spark, frame([(1, None), (2, "  ")]), [(1, "a")]) == []
    assert found(spark, frame([(1, "a")]), [(1, "a a"), (2, "b")]) == brute([(1, "a")], [(1, "a a"), (2, "b")])


def test_bounds_are_never_below_scores_and_mostly_exclude(spark, frame):
    rows = [(i, prose(i % 150, 60 + i % 9)) for i in range(600)] + [(1000, "the " * 5000 + prose(3, 200))]
    docs = frame(rows).select("doc_id", "text")
    shards = cut(lexical_search.index(docs))
    size = lexical_search.corpus(shards)
    block = lexical_search._block([terms_of(prose(i, 60)) for i in range(6)], docs, size)
    texts = {r.key: r.text for r in lexical_search._keyed(docs).toLocalIterator()}
    seen, kept, all_pairs = 0, 0, 0
    for row in shards.toLocalIterator():
        bounds = block.bounds(row.rows, np.array(row.lengths), bytes(row.slices))
        seen += len(row.keys)
        for j, key in enumerate(row.keys):
            exact = dict(block.scores(texts[key].encode(), list(range(6))))
            for query in range(6):
                assert bounds[query, j] >= exact.get(query, 0)
                all_pairs += 1
                kept += bounds[query, j] >= 2 * exact.get(query, 0) + 10**9
    assert seen == len(rows) and kept < all_pairs / 20


def terms_of(text):
    return lexical_search.terms(text.encode())
