import random

from conftest import rows

from loomgraph.operators import canonical
from loomgraph.operators import checks as ops


def test_wrong_options_against_brute_force(graph, spark):
    picks = random.Random(3)
    names = [f"m.f{i:02d}" for i in range(12)]
    nodes, _ = graph([("m", "module", "m")] + [(n, "function", "m") for n in names] + [("m.k", "class", "m")])
    pool = sorted(names)
    answers = {}
    for check in range(25):
        size = picks.choice([1, 1, 2, 3, 6, 12])
        chosen = pool[:size] if check % 2 else picks.sample(names, size)
        answers[f"c{check}"] = set(chosen) | ({"m.k"} if check % 5 == 0 else set())
    table = spark.createDataFrame([("p", c, "first-call", a) for c, held in answers.items() for a in held],
                                  "project string, check_id string, kind string, option_id string")
    got = {}
    for check, slot, option in rows(ops.wrong_options(table, ops.option_pools(nodes)), "check_id", "slot", "option_id"):
        got.setdefault(check, []).append((slot, option))
    for check, held in answers.items():
        want = [n for n in pool if n not in held][: max(4 - len(held), 2)]
        assert [o for _, o in sorted(got.get(check, []))] == want


def test_suite_grade_and_completion(graph, spark):
    nodes, edges = graph(
        [("a", "module", "a", "a.py", 0), ("a.f", "function", "a"), ("b", "module", "b"), ("b.g", "function", "b"), ("c", "module", "c")],
        [("a.f", "b.g", "call", True, 4), ("a", "b", "import", True, 1), ("c", "b", "import", True, 2), ("c", "b", "import", True, 7)])
    claims = ops.all_claims(nodes, edges, canonical.home_select(nodes))
    assert rows(ops.direct_importer(nodes, edges), "region", "answer", "citation") == [
        ("a", "b", "a.py:1"), ("b", "a", "a.py:1"), ("b", "c", "c.py:2"), ("b", "c", "c.py:7"), ("c", "b", "c.py:2")]
    options = ops.options(claims, nodes)
    suite = ops.suites(claims, options)
    listed = {(r.region, r.kind): r for r in suite.collect()}
    assert set(listed) == {("a", "first-call"), ("a", "direct-importer"), ("a", "entrypoint"), ("b", "direct-importer"),
                           ("b", "removal-impact"), ("c", "direct-importer")}
    check = listed[("b", "direct-importer")].check_id
    assert listed[("b", "direct-importer")].n_answers == 2
    sent = spark.createDataFrame([(s, "p", check) for s in ("right", "half", "more", "empty", "odd")], "submission_id string, project string, check_id string")
    wrong = options.where((options.check_id == check) & ~options.is_answer).first().option_id
    ticks = [("right", "a"), ("right", "c"), ("right", "c"), ("half", "a"), ("more", "a"), ("more", "c"), ("more", wrong), ("odd", "a"), ("odd", "zzz")]
    graded = ops.grade(sent, spark.createDataFrame(ticks, "submission_id string, option_id string"), options)
    assert rows(graded, "submission_id", "outcome") == [
        ("empty", "invalid"), ("half", "incorrect"), ("more", "incorrect"), ("odd", "invalid"), ("right", "correct")]
    shown = ops.reveal(graded, spark.createDataFrame(ticks, "submission_id string, option_id string"))
    assert rows(shown, "submission_id", "answer") == [("right", "a"), ("right", "c")]
    passes = spark.createDataFrame([(1, "p", check)], "learner_id long, project string, check_id string")
    assert rows(ops.completion(passes, suite), "region", "passed", "needed", "complete") == [("b", 1, 2, False)]


def test_answers_far_from_the_first_places_are_only_counted(graph, spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(ops, "cut", lambda df, label: kept.setdefault(label, df))
    names = [f"m.f{i:02d}" for i in range(40)]
    nodes, _ = graph([("m", "module", "m")] + [(n, "function", "m") for n in names])
    picked = [(f"c{i}", n) for i, n in enumerate(names)] + [("many", n) for n in names[20:]]
    table = spark.createDataFrame([("p", c, "first-call", a) for c, a in picked], "project string, check_id string, kind string, option_id string")
    got = rows(ops.wrong_options(table, ops.option_pools(nodes)), "check_id", "slot", "option_id")
    assert [g for g in got if g[0] in ("c1", "c39", "many")] == [
        ("c1", 1, "m.f00"), ("c1", 2, "m.f02"), ("c1", 3, "m.f03"), ("c39", 1, "m.f00"), ("c39", 2, "m.f01"), ("c39", 3, "m.f02"),
        ("many", 1, "m.f00"), ("many", 2, "m.f01")]
    # One answer: places 0 to 3; twenty: places 0 to 22.
    assert kept["held_places"].count() == 4 + 3
