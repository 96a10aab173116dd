from datetime import datetime

from conftest import rows

from loomgraph.operators import progress as ops
from loomgraph.schema import PROGRESS
from loomgraph.streaming import progress as stream


def log(spark, *events):
    made = [(n, "p", 1, datetime(2024, 1, 1, 0, minute), kind, region, signature, value)
            for n, (minute, kind, region, signature, value) in enumerate(events)]
    return spark.createDataFrame(made, PROGRESS)


EVENTS = [
    (1, "visit", "a", None, None), (2, "pass_check", "a", "old", None), (3, "reset", None, None, None), (4, "visit", "b", None, None),
    (5, "pass_check", "b", "sb", None), (6, "pass_check", "a", "old", None), (7, "visit", "gone", None, None),
    (8, "mode", None, None, "expert"), (9, "mode", None, None, "loud"), (9, "home", None, None, "nope")]


def tables(spark):
    signatures = spark.createDataFrame([("p", "a", "sa"), ("p", "b", "sb")], "project string, region string, signature string")
    return signatures, signatures.select("project", "region")


def test_folds(spark, graph):
    events, (signatures, regions) = log(spark, *EVENTS), tables(spark)
    assert rows(ops.understood(events, signatures), "region") == [("b",)]
    assert rows(ops.visited(events, regions), "region") == [("b",)]
    nodes, _ = graph([("a", "module", "a", "a.py", 1), ("b", "module", "b", "b.py", 1)])
    homes = spark.createDataFrame([("p", None)], "project string, home string")
    assert rows(ops.preferences(events, homes, nodes), "mode", "home") == [("expert", None)]
    chosen = log(spark, *EVENTS, (10, "home", None, None, "b"))
    assert rows(ops.preferences(chosen, homes, nodes), "home") == [("b",)]
    assert rows(ops.recents(events), "project", "place", "understood_count") == [("p", 1, 2)]


def test_an_edit_retires_only_its_region(graph, spark):
    nodes, _ = graph([("a", "module", "a"), ("b", "module", "b"), ("b.f", "function", "b", "b2.py")])
    before = spark.createDataFrame([("p", f, "python", f) for f in ("a.py", "b.py", "b2.py")], "project string, file string, language string, sha256 string")
    after = before.replace({"b2.py": "changed"}, subset=["sha256"])
    one, two = (dict(rows(ops.signatures(nodes, f), "region", "signature")) for f in (before, after))
    assert one["a"] == two["a"] and one["b"] != two["b"]
    assert one["a"] == bucketed({"a.py": "a.py"})


def bucketed(files):
    import hashlib
    import json

    def digest(pairs):
        return hashlib.sha256(json.dumps(sorted(pairs), separators=(",", ":")).encode()).hexdigest()

    parts = {}
    for file, content in files.items():
        parts.setdefault(hashlib.sha256(file.encode()).hexdigest()[:4], []).append([file, content])
    return digest([bucket, digest(pairs)] for bucket, pairs in parts.items())


def test_the_signature_has_one_form_at_every_size(graph, spark):
    for size in (1, 1024, 1025):
        names = {f"f{i}.py": f"h{i}" for i in range(size)}
        nodes, _ = graph([(f"a.n{i}", "function", "a", name) for i, name in enumerate(names)])
        files = spark.createDataFrame([("p", f, "python", h) for f, h in names.items()], "project string, file string, language string, sha256 string")
        assert rows(ops.signatures(nodes, files), "signature") == [(bucketed(names),)]


def stream_of(spark, folder, like):
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def finish(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_stream_survives_a_stop_a_repeated_batch_disorder_and_repeats(spark, tmp_path):
    events, (signatures, regions) = log(spark, *EVENTS), tables(spark)
    source, checkpoint = tmp_path / "in", str(tmp_path / "state")
    for k, part in enumerate(("event_id >= 4 AND event_id < 8", "event_id < 3")):
        events.where(part).coalesce(1).write.parquet(str(source / f"part={k}"))
    first = finish(stream.run(stream_of(spark, source / "part=*", events), checkpoint))
    assert first.lastProgress["batchId"] == 1
    held = stream.read_state(spark, checkpoint)
    assert rows(held, "region") == [("",), ("a",), ("b",), ("gone",)]
    # As if the driver had been lost before the last batch was committed: it runs again.
    for name in ("1", ".1.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    for k, part in enumerate(("event_id >= 2", "event_id >= 4"), start=2):
        events.where(part).coalesce(1).write.parquet(str(source / f"part={k}"))
    finish(stream.run(stream_of(spark, source / "part=*", events), checkpoint, {"availableNow": True}))
    folded = stream.read_state(spark, checkpoint)
    assert rows(stream.view(folded, signatures, regions), "region", "visited", "understood") == [("b", True, True)]
    # A row per key, not per batch.
    assert rows(folded, "region") == [("",), ("a",), ("b",), ("gone",)]
    assert rows(ops.understood(events, signatures), "region") == [("b",)] == rows(ops.visited(events, regions), "region")


def test_changes_are_given_once_and_triggers_are_chosen(spark, tmp_path):
    events = log(spark, *EVENTS)
    source = tmp_path / "in"
    for k in range(2):
        events.coalesce(1).write.parquet(str(source / f"part={k}"))
    query = stream.run(stream_of(spark, source / "part=*", events), str(tmp_path / "state"), {"processingTime": "1 second"}, "noop")
    try:
        query.processAllAvailable()
        assert query.isActive
        updated = [sum(o["numRowsUpdated"] for o in p["stateOperators"]) for p in query.recentProgress if p["numInputRows"]]
        assert sum(updated) == 4
    finally:
        query.stop()
