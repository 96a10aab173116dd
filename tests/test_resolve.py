"""Joins on names that very many rows share."""

from conftest import rows
from pyspark.sql import functions as F

from loomgraph.operators import imports, resolve
from loomgraph.plans import warehouse
from loomgraph.plans.queries import all_queries

CALLS, DEFS = "project string, owner_id string, call_no int, leaf string", "project string, leaf string, dst string"


def sides(spark, calls, defs):
    called = [("p", f"o{i}", i, name) for name, n in calls.items() for i in range(n)]
    defined = [("p", name, f"{name}.{i}") for name, n in defs.items() for i in range(n)]
    return spark.createDataFrame(called, CALLS), spark.createDataFrame(defined, DEFS)


def test_every_match_is_given_for_light_heavy_and_one_sided_names(spark):
    calls = {"run": 300, "get": 40, "print": 500, **{f"n{i}": i % 4 for i in range(50)}}
    defs = {"run": 70, "get": 400, "unused": 600, **{f"n{i}": i % 3 for i in range(50)}}
    left, right = sides(spark, calls, defs)
    for most in (1024, 16, 2):
        found = resolve.split_join(left, right, ["project", "leaf"], most)
        assert found.count() == found.distinct().count() == sum(n * defs.get(name, 0) for name, n in calls.items())
        heavy = {r.leaf: r.cells for r in resolve.heavy_names(left, right, ["project", "leaf"], most).collect()}
        assert len(heavy) < 3 * most and heavy["run"] > 1
        assert {n: c for n, c in heavy.items() if n in ("print", "unused")} == {n: 0 for n in heavy if n in ("print", "unused")}
    empty = left.limit(0)
    assert resolve.split_join(empty, right, ["project", "leaf"]).count() == resolve.split_join(left, right.limit(0), ["project", "leaf"]).count() == 0


def test_a_name_defined_and_called_thousands_of_times_is_spread(spark):
    calls = {"run": 3000, **{f"n{i}": 3 for i in range(200)}}
    left, right = sides(spark, calls, {"run": 2000, **{f"n{i}": 2 for i in range(200)}})
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = resolve.split_join(left, right, ["project", "leaf"])
        sizes = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert sum(sizes) == 3000 * 2000 + 200 * 6 and len(sizes) == 16
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_each_tier_is_a_job_of_its_own(spark, monkeypatch):
    written = []
    monkeypatch.setattr(resolve, "cut", lambda df, label="step": written.append(label) or df)
    tiers = [spark.createDataFrame([(k, f"{k}{n}", True, False)], "k string, dst string, certain boolean, external boolean")
             for n, k in enumerate("aab")]
    found = resolve.tiered(["k"], tiers)
    assert sorted(r.dst for r in found.toLocalIterator()) == ["a0", "b2"] and written == ["candidates"] * 3


def test_import_queries_write_only_the_facts_they_read(spark, monkeypatch):
    monkeypatch.setattr(warehouse, "_BUILT", {})
    all_queries()["r5_rust_use"](spark, "/root/testdata/sf0.001")
    assert set(warehouse.Warehouse(spark, "/root/testdata/sf0.001")._tables) == {"rust_uses", "rust_files", "rust_inline_mods"}


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_later_plans_do_not_grow_with_the_number_of_tiers(spark):
    calls = spark.createDataFrame([("p", n) for n in range(20)], "project string, call_no int")

    def tier(n):
        return calls.where(F.col("call_no") % 10 == n).select("project", "call_no", *resolve.hit(F.lit(f"t{n}"), n % 2 == 0))

    few, many = (resolve.tiered(["project", "call_no"], [tier(n) for n in range(size)]) for size in (2, 10))
    assert scans(many) == scans(few)
    assert rows(many, "call_no", "dst") == sorted(((n, f"t{n % 10}") for n in range(20)), key=repr)


def test_rust_paths_are_followed_once(spark):
    files = spark.createDataFrame([("p", "m", ["a"]), ("p", "n", ["b"])], "project string, module string, module_path array<string>")
    uses = spark.createDataFrame([("p", "m", ["crate", "b", "x"], "x", 1), ("p", "m", ["std", "fmt"], "fmt", 2)],
                                 "project string, module string, segments array<string>, local_name string, lineno int")
    edges = imports.rust_uses(uses, files, spark.createDataFrame([], "project string, module string, name string"))
    assert "Generate" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert rows(edges, "dst", "certain") == [("external:std", True), ("n", True)]
