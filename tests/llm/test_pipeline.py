"""The pipeline's stages on a small corpus, and every query's columns."""

import re
from collections import Counter

import corpus_pipeline
from loomgraph.llm import mixing
from loomgraph.llm.queries import QUERIES, SQL
from loomgraph.session import cut
from tests.llm.conftest import prose


def test_stages_take_effect_one_after_the_other(spark, frame):
    clean = [(i, prose(i, 120), f"s{i % 3}") for i in range(40)]
    copies = [(100 + i, prose(3, 120) + f" extra{i}", "s1") for i in range(4)]
    junk = [(200 + i, re.sub(r"(\S)( |$)", r"\1###\2", prose(70 + i, 120)), "s0") for i in range(4)]
    boiler = [(300 + i, prose(500 + i, 90) + "\nThis very line is in many documents", "s2") for i in range(5)]
    docs, seen = frame(clean + copies + junk + boiler), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, ""))
        assert docs.columns == frame([]).columns, name
        seen.append([r.asDict() for r in docs.toLocalIterator()])
    good, lines, near, mix = seen
    assert {r["doc_id"] for r in good} == {i for i, *_ in clean + copies + boiler}
    assert [r["doc_id"] for r in lines if "very line" in r["text"]] == [304] and len(lines) == len(good)
    assert {r["doc_id"] for r in near} == {i for i, *_ in clean + boiler}
    words = Counter()
    for r in mix:
        words[r["source"]] += len(r["text"].split())
        whole = next(x["text"] for x in near if x["doc_id"] == r["doc_id"])
        assert r["text"] in whole and r["n_chars"] == len(r["text"])
    sizes = Counter()
    for r in near:
        sizes[r["source"]] += len(r["text"].split())
    wanted = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).toLocalIterator()}
    assert all(abs(words[s] - wanted[s]) <= 1 for s in wanted)
    last = [r for r in corpus_pipeline.encoded(spark, docs, "").toLocalIterator()]
    assert Counter(r.text for r in last) == Counter(r["text"] for r in mix)


def test_near_copies_are_chosen_by_text_and_not_by_id(spark, frame):
    one, two, three = prose(1, 120), prose(2, 120), prose(3, 120)
    rows = [(3, one), (5, one + " more"), (5, two), (None, three), (None, three + " more"), (None, two + " extra"), (7, None), (7, ""), (None, " "), (3, one)]
    got = corpus_pipeline.one_of_near_copies(spark, frame(rows).repartition(3), "")
    kept = sorted(((r.doc_id, r.text) for r in got.toLocalIterator()), key=repr)
    # Of two rows without an id, the one whose text's hash is smaller.
    assert kept in [sorted([(3, one), (5, two), (None, x), (7, None), (7, ""), (None, " ")], key=repr) for x in (three, three + " more")]


def test_one_text_in_two_sources_is_mixed_for_both(spark, frame):
    text = prose(9, 400)
    docs = frame([(1, text, "s0"), (1, text, "s1"), (1, text, None), (2, prose(4, 300), "s0"), (3, None, "s1"), (4, "", "s2")])
    taken = Counter()
    for r in corpus_pipeline.mixed_to_weights(spark, docs, "").toLocalIterator():
        taken[r.source] += len(r.text.split())
    sizes = Counter()
    for r in docs.toLocalIterator():
        sizes[r.source] += len((r.text or "").split())
    wanted = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).toLocalIterator()}
    assert all(abs(taken[s] - (wanted[s] or 0)) <= 1 for s in sizes) and taken["s1"] and taken[None]


def test_all_stages_take_odd_rows(spark, frame, odd_rows):
    docs = frame(odd_rows + [(20 + i, prose(20 + i, 120)) for i in range(12)])
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, ""))
        assert docs.count() > 0, name
    assert all(len(r.ids) == 4 * r.n_tokens for r in docs.toLocalIterator())


def test_stages_take_an_empty_table(spark, frame):
    docs = frame([])
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, ""))
    assert docs.count() == 0


def test_each_operator_has_one_query(spark):
    assert [n.split("_")[0] for n in QUERIES] and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(SQL) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5


def test_mixing_shuffles_a_text_to_its_parts_and_to_its_shards_only(spark, frame):
    texts = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        if node.nodeName() == "Exchange":
            # A group's buffer is called after its function.
            texts.extend(re.findall(r"(?:text|first|valueSet): string", node.schema().treeString()))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    mixed = corpus_pipeline.mixed_to_weights(spark, frame([(i, prose(i, 60), f"s{i % 2}") for i in range(6)]), "")
    walk(mixed._jdf.queryExecution().executedPlan())
    assert len(texts) == 2
