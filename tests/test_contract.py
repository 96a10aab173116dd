import pathlib
import re

from loomgraph.plans.queries import all_queries, all_sql

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_every_operator_is_registered_and_checked():
    families = {"a": 11, "c": 9, "f": 7, "g": 12, "k": 8, "l": 14, "p": 8, "r": 7, "s": 8, "t": 7}
    wanted = {f"{letter}{n}" for letter, size in families.items() for n in range(1, size + 1)}
    assert {name.split("_")[0] for name in all_queries()} == wanted
    assert set(all_sql()) == set(all_queries())


def test_no_task_or_driver_holds_a_whole_table():
    for path in (ROOT / "loomgraph").rglob("*.py"):
        text = path.read_text()
        assert not re.search(r"localCheckpoint|crossJoin|toPandas|\.collect\(\)|\.sample\(", text), path


def test_one_query_end_to_end(spark):
    found = all_queries()["g5_home_select"](spark, "/root/testdata/sf0.001")
    assert found.count() == 5
