"""Mixing, BPE, similarity, fingerprints and the two models against plain Python."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from loomgraph.llm import bpe, fingerprints, language_model, mixing, ngram_join, shingles, toxicity
from loomgraph.llm.components import components
from loomgraph.llm.queries import tokenizer, vocabulary
from tests.llm.conftest import prose

def key():
    return [F.col("doc_id"), F.col("_size")]



def filled(sizes, weights, share=1.5):
    """Targets by resharing the excess until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in sizes if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / open_ for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing_meets_targets_and_never_takes_a_document_thrice(spark, frame, odd_rows):
    rows = odd_rows + [(100 + i, prose(i, 30 + i % 90), f"s{i % 5}") for i in range(200)]
    docs = frame(rows).select("doc_id", "source", mixing.n_words(F.col("text")).alias("_size"))
    got = [r.asDict() for r in mixing.taken(docs, key(), block_words=32).toLocalIterator()]
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["_size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["_size"]
    want = filled(dict(sizes), mixing.WEIGHTS)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
    assert all(abs(taken[s] - want[s]) <= 0.51 for s in sizes)
    again = sorted(((r.doc_id, r._size, r.taken) for r in mixing.taken(docs.repartition(3), key(), block_words=32).toLocalIterator()), key=repr)
    assert again == sorted(((r["doc_id"], r["_size"], r["taken"]) for r in got), key=repr)
    assert mixing.taken(docs.limit(0), key()).count() == 0


def test_permutation_is_one_to_one_and_spreads(spark):
    for domain in (1, 2, 37, 1000):
        rows = spark.range(domain).select(mixing.permuted(F.col("id"), F.lit(domain), F.lit(5)).alias("p")).toLocalIterator()
        found = [r.p for r in rows]
        assert sorted(found) == list(range(domain))
    assert sum(a == b for a, b in zip(found, range(1000), strict=True)) < 20


def test_slots_draw_shards_evenly(spark):
    sources = spark.createDataFrame([("a", 9_000, 18_000.0), ("b", 50_000, 25_000.0)], "source string, source_size bigint, target double")
    drawn = mixing.slots(sources, 10, 3, 500)
    counts = {(r.source, r.shard): r["count"] for r in drawn.groupBy("source", "shard").count().toLocalIterator()}
    assert {s for _, s in counts} == set(range(9))
    assert all(abs(n - (200 if s == "a" else 278)) < 90 for (s, _), n in counts.items())


def own_encoding():
    v = vocabulary()
    return v, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_bpe_encodes_as_the_library_and_decodes_back(spark, frame, odd_rows):
    v, library = own_encoding()
    rows = odd_rows + [(20, "a" * 5000 + " b"), (21, "don't  \n\n  stop  12345 \U0001f600 <|endoftext|>  x"), (22, "日本語" * 900)]
    want = []
    for id_, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((id_, struct.pack(f"<{len(ids)}I", *ids), (text or "").encode()))
    got = [(r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in bpe.encode(frame(rows), v).toLocalIterator()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.encode(frame([]), v).count() == 0


def test_both_ways_of_merging_agree_with_the_library(spark):
    v, library = own_encoding()
    draw = random.Random(4)
    pieces = [bytes(draw.choice(b"aehtoin rs\xc3\xa9\xff") for _ in range(draw.randint(1, 40))) for _ in range(400)]
    got = spark.createDataFrame([(p,) for p in pieces], "w binary").select("w", bpe.encoded(F.col("w"), v).alias("i")).toLocalIterator()
    for row in got:
        assert row.i == library._encode_single_piece(bytes(row.w)) == bpe.heap_merged(bytes(row.w), v.ranks)


def shingled(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def grouped(rows):
    sets = [shingled(text) for _, text, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, row in enumerate(rows):
        low[find(i)].append(row[0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted(((row[0], len(sets[i]), smallest[find(i)]) for i, row in enumerate(rows)), key=repr)


def edited(text, seed, changes):
    draw, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
    return " ".join(words)


def test_near_groups_match_all_pairs(spark, frame, odd_rows):
    text, other = prose(50, 150), prose(51, 60)
    rows = odd_rows + [(100 + i, edited(text, i, i % 7)) for i in range(60)] + [(200 + i, edited(other, i, i % 4)) for i in range(20)]
    rows += [(300 + i, prose(400 + i, 40)) for i in range(20)]
    got = sorted(map(tuple, ngram_join.near_groups(frame(rows).repartition(3)).toLocalIterator()), key=repr)
    assert got == grouped(rows)
    assert ngram_join.near_groups(frame([])).count() == 0


def test_salted_groups_lose_no_link(spark, frame):
    text = prose(60, 100)
    rows = [(i, edited(text, i, 2)) for i in range(1500)]
    got = sorted(map(tuple, ngram_join.near_groups(frame(rows)).toLocalIterator()), key=repr)
    # Two edits leave every copy within reach of the plain text, so of each other through some.
    assert len({r[2] for r in got}) == len({r[2] for r in grouped(rows[:400])}) == 1


def test_groups_that_do_not_all_link_get_more_rounds_of_one_partner(spark, frame, monkeypatch):
    text, written, plain = prose(70, 130), [], ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df, label="step": written.append((label, plain(df, label))) or written[-1][1])
    monkeypatch.setattr(ngram_join, "CROWDED", 0, raising=False)
    rows = [(i, edited(text, i, 1 + i % 4)) for i in range(120)]
    got = sorted(map(tuple, ngram_join.near_groups(frame(rows)).toLocalIterator()), key=repr)
    assert got == grouped(rows) and len({r[2] for r in got}) > 1
    rounds = [df.count() for label, df in written if label == "stars"]
    assert len(rounds) > 1 and max(rounds) <= len(rows)


def test_one_of_each_keeps_clean_documents_and_columns(spark, frame, odd_rows):
    kept = ngram_join.one_of_each(frame(odd_rows))
    assert kept.columns == frame([]).columns
    assert sorted((r.doc_id for r in kept.toLocalIterator()), key=repr) == sorted([1, 2, 3, 4, 5, 7, 9, None, None], key=repr)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "a bigint, b bigint")).toLocalIterator()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_shingles_do_not_depend_on_slices():
    texts = [prose(i, 300).encode() for i in range(20)]
    alone = [next(iter(shingles.shingle_sets([t]))) for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(alone, shingles.shingle_sets(texts), strict=True))
    assert [len(a) for a in alone] == [len(shingled(t.decode())) for t in texts]
    long = prose(1, 400_000).encode()
    assert len(next(iter(shingles.shingle_sets([long])))) == len(shingled(long.decode()))


def test_fingerprints_estimate_what_sets_say(spark):
    a, b = (next(iter(shingles.shingle_sets([t.encode()]))) for t in (prose(1, 3000), prose(1, 3000)[:9000]))
    k = fingerprints.K
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(fingerprints.resemblance(a[:k], b[:k]) - true) < 0.12
    assert abs(fingerprints.containment(b[:k], a[:k]) - 1) < 0.05
    assert abs(fingerprints.distinct_shingles(a[:k]) / len(a) - 1) < 0.2
    assert np.array_equal(fingerprints.merge(a[::2][:k], a[1::2][:k]), a[:k])
    assert np.array_equal(fingerprints.decode(fingerprints.encode(a[:k])), a[:k])


def test_neighbours_follow_descending_ids(spark, frame, odd_rows):
    rows = odd_rows + [(1000 + 7 * i, prose(i, 40)) for i in range(60)]
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    want = []
    for i, (id_, text, *_) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        want.append((id_, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    got = list(fingerprints.neighbour_fingerprints(frame(rows)).toLocalIterator())
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    alone = fingerprints.neighbour_fingerprints(frame([(5, "a b c d e f g h")])).first()
    assert alone.near_next == 1.0
    assert fingerprints.neighbour_fingerprints(frame([])).count() == 0
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(frame(rows)).toLocalIterator()}
    assert all(plain[r.doc_id] == r.fingerprint for r in got if r.doc_id and r.doc_id > 1)


def test_toxicity_learns_on_held_out_texts(spark, frame, odd_rows):
    rows, marks = [], []
    for i in range(900):
        toxic = i % 5 == 0
        rows.append((1000 + i, prose(i, 40) + (" awful gibberish " if toxic else " ") + prose(2000 + i, 20)))
        marks.append((1000 + i, int(toxic)))
    labels = spark.createDataFrame([*marks, (2, 1), (None, 1), (1003, None)], "doc_id bigint, toxic int")
    docs, out = frame(rows + odd_rows), toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs.where(~out), labels.where(~out))
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).toLocalIterator()}
    held = [(i, t) for i, t in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum((got[i] >= 0.5) == t for i, t in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    nothing = toxicity.fit(docs.limit(0), labels)
    assert toxicity.scores(docs.limit(3), nothing).count() == 3 and toxicity.scores(docs.limit(0), nothing).count() == 0


def test_language_model_gradients(spark):
    p = language_model.start_values(np.arange(language_model.END + 1))
    p = {k: v.astype(np.float64) for k, v in p.items()}
    draw = np.random.Generator(np.random.PCG64(1))
    ids, targets = draw.integers(0, 1025, (2, 3, language_model.WINDOW))
    scored = draw.random(ids.shape) < 0.7
    loss = lambda: -language_model._forward(p, ids, targets, scored)[0].mean()
    grads = language_model._forward(p, ids, targets, scored, True)[2]
    for name, value in p.items():
        place = np.unravel_index(np.abs(grads[name]).argmax(), value.shape)
        before, step = value[place], 1e-4
        value[place] = before + step
        up = loss()
        value[place] = before - step
        down = loss()
        value[place] = before
        assert math.isclose((up - down) / (2 * step), grads[name][place], rel_tol=2e-2, abs_tol=1e-6), name


def test_windows_score_every_token_once():
    lengths = np.array([1, 5, 24, 25, 200])
    ids = np.arange(lengths.sum()) % 1000
    inputs, targets, scored, text = language_model.windows(ids, lengths)
    assert sorted(targets[scored].tolist()) == sorted(ids.tolist())
    assert np.array_equal(np.bincount(np.repeat(text, scored.sum(1)), minlength=5), lengths)
    assert inputs[0, 0] == language_model.END


def test_later_windows_give_eight_tokens_of_context():
    inputs, targets, scored, _ = language_model.windows(np.arange(200), np.array([200]))
    assert inputs.shape[1] == 32 and scored[0].all() and (~scored[1:, :8]).all() and scored[1, 8:].all()
    assert np.array_equal(inputs[1, :9], np.arange(23, 32))


def test_language_model_scores(spark, frame, odd_rows):
    rows = odd_rows + [(100 + i, prose(i, 60)) for i in range(120)]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t, *_ in rows]
    c = Counter(w for i, ws in tokens if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, out(i), len(ws), sum(c[w] > 0 for w in ws), n) for i, ws in tokens), key=repr)
    frequent, language_model.FREQUENT = language_model.FREQUENT, 50
    try:
        got = list(language_model.scored(frame(rows), language_model.held_out(F.col("doc_id")), tokenizer("byte_bpe_50k.tiktoken")).toLocalIterator())
    finally:
        language_model.FREQUENT = frequent
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got), key=repr) == want
    scores = sorted(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) for _, ws in tokens)
    assert np.allclose(sorted(r.base_score for r in got), scores)
    assert all(r.score < 0 for r in got)
    same = {r.score for r in got if r.doc_id in (1, 10)}
    assert max(same) - min(same) < 1e-2


def test_training_lowers_the_loss(spark):
    path = tokenizer("byte_bpe_50k.tiktoken")
    texts = [prose(i, 200).encode().lower() for i in range(30)]
    tokens = language_model.Tokens(texts, language_model.Subwords(path))
    p = language_model.start_values(np.bincount(tokens.ids, minlength=language_model.END + 1))
    docs = spark.createDataFrame([(t.decode(),) for t in texts], "text string").repartition(2)
    trained = language_model.train(docs, path)
    assert language_model.text_scores(trained, tokens).sum() > 0.96 * language_model.text_scores(p, tokens).sum()
    assert base64.b64encode(language_model._pack(trained)) != base64.b64encode(language_model._pack(p))


def test_language_model_learns_from_every_training_row_once(spark, frame, odd_rows, monkeypatch):
    rows = odd_rows + [(100 + i, prose(i, 20)) for i in range(40)]
    seen, train = [], language_model.train
    monkeypatch.setattr(language_model, "train", lambda docs, path: seen.append(docs) or train(docs, path))
    language_model.scored(frame(rows), language_model.held_out(F.col("doc_id")), tokenizer("byte_bpe_50k.tiktoken"))
    learns = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    want = Counter(text for id_, text, *_ in rows if learns(id_))
    dealt = [Counter(r.text for r in language_model.round_texts(seen[0], turn, 3).toLocalIterator()) for turn in range(3)]
    assert sum(dealt, Counter()) == Counter(r.text for r in seen[0].toLocalIterator()) == want and all(dealt)


def test_held_out_texts_score_no_worse_than_by_counting_words(spark, frame):
    random_ = random.Random(8)
    phrases = [prose(300 + j, 6) for j in range(30)]
    rows = [(i, " ".join(random_.choices(phrases, k=10))) for i in range(150)] + [(200, "x" * 30_000), (201, "\u2003 \U0001f600" * 40), (202, None), (203, prose(5, 60).upper())]
    got = list(language_model.scored(frame(rows), language_model.held_out(F.col("doc_id")), tokenizer("byte_bpe_50k.tiktoken")).toLocalIterator())
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 200]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_followers_and_spelling_share_out_one(spark):
    draw = np.random.Generator(np.random.PCG64(5))
    known, end = np.bincount(draw.integers(0, 6, 300), minlength=6), 20
    pairs = np.arange(49)[draw.random(49) < 0.5]
    n = np.minimum(np.append(known, end)[pairs // 7] // 7, 9)
    followers = language_model.Followers(pairs[n > 1], n[n > 1], known, end)
    counts = (np.append(known, end) + 1) / (known.sum() + end + 8)
    for before in range(-1, 7):
        share, left = followers.of(np.arange(7), np.full(7, before))
        # What is missing is for the unseen words, which are one.
        assert math.isclose((share + left * counts).sum() + left[0] * counts.min() / (np.append(known, end) + 1).min(), 1) and (left > 0).all()


def test_every_pair_of_training_words_counts(spark, frame, odd_rows, monkeypatch):
    """Each text's score against a loop over all pairs in plain Python, few words and pairs being at hand in the tasks."""
    rows = odd_rows + [(100 + i, prose(i % 25, 40 + i % 3)) for i in range(90)]
    path, kept, learned, train = tokenizer("byte_bpe_50k.tiktoken"), (12, 20), [], language_model.train
    monkeypatch.setattr(language_model, "train", lambda docs, path: learned.append(train(docs, path)) or learned[-1])
    monkeypatch.setattr(language_model, "FREQUENT", kept[0])
    monkeypatch.setattr(language_model, "PAIRS", kept[1])
    got = list(language_model.scored(frame(rows), language_model.held_out(F.col("doc_id")), path).toLocalIterator())
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    texts = [(t or "").encode().lower().split() + [None] for _, t, *_ in rows]
    training = [ws for (i, *_), ws in zip(rows, texts, strict=True) if not out(i)]
    c, pairs = Counter(w for ws in training for w in ws), Counter(p for ws in training for p in zip([None, *ws], ws))
    kinds, total = Counter(before for before, _ in pairs), sum(c.values())
    unseen = (sum(n == 1 and w is not None for w, n in c.items()) + 1) / (2 * total + 2)
    subwords, want = language_model.Subwords(path), []
    for (_, text, *_), ws in zip(rows, texts, strict=True):
        tokens = language_model.Tokens([(text or "").encode().lower()], subwords)
        logs, at, score = language_model.token_logs(learned[0], tokens), 0, 0.0
        for before, w, k in zip([None, *ws], ws, [*tokens.sizes.tolist(), 1], strict=False):
            spelt = unseen * math.exp(logs[at : at + k].sum()) / (k * (k + 1))
            left = 0.75 * kinds[before] / c[before] if c[before] else 1.0
            share = (pairs[before, w] - 0.75) / c[before] if pairs[before, w] else 0.0
            score += math.log10((1 - unseen) * (share + left * (c[w] + 1) / (total + len(c) + 1)) + spelt)
            at += k
        want.append(score)
    assert np.allclose(sorted(r.score for r in got), sorted(want), rtol=1e-5)
