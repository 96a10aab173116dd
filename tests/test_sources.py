import fnmatch
import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomgraph.sources import corpus as ops
from loomgraph.sources import tree as files
from loomgraph.sources.sink import write_json


def tree(tmp_path, files):
    for name, text in files.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path)


def test_walk_rules(spark, tmp_path):
    root = tree(tmp_path, {
        ".gitignore": "# comment\n*.log.py\n!keep.log.py\nout/\ngen/*.ts\n/only.py\n[ab].js\n",
        "a.py": "", "x.log.py": "", "keep.log.py": "", "out/b.py": "", "deep/out/c.py": "", "gen/d.ts": "", "gen/sub/e.ts": "",
        "only.py": "", "deep/only.py": "", "deep/__init__.py": "", "a.js": "", "c.js": "", "node_modules/m.js": "", ".hidden/h.py": "", "vendor/v.go": "",
        "vendor/v.py": "", "k.kt": "", "deep/k.kt": "", "s.h": "", "t.txt": ""})
    kept = ops.keep_readable(ops.scan_directory(spark, root, "p"))
    assert [r[0] for r in rows(kept, "path")] == sorted([
        ".gitignore", "a.py", "keep.log.py", "deep/__init__.py", "c.js", "vendor/v.go", "vendor/v.py", "k.kt", "deep/k.kt", "s.h", "t.txt"])
    owned = ops.ownership(kept)
    assert rows(owned, "path", "language") == [
        ("a.py", "python"), ("c.js", "javascript"), ("deep/__init__.py", "python"), ("keep.log.py", "python"), ("vendor/v.py", "python")]
    assert rows(ops.unsupported_tally(kept), "ext", "language", "count") == [(".h", None, 1), (".kt", "Kotlin", 2)]
    assert rows(ops.scope_counts(owned), "scope", "files", "place") == [(".", 3, 1), ("deep", 1, 2), ("vendor", 1, 3)]


def test_lines_and_hash(spark):
    texts = {
        "plain.py": b"a\r\nb\rc\x0cd\xc2\x85e\n", "empty.py": b"", "bad.ts": b"x\xffy\n", "latin.py": b"# -*- coding: latin-1 -*-\ns = '\xe9'\n",
        "bom.py": b"\xef\xbb\xbfx = 1\n"}
    files = ops.scan_table(spark.createDataFrame([("p", k, bytearray(v)) for k, v in texts.items()], "project string, path string, content binary"))
    found = {}
    for path, number, text in rows(ops.decode_lines(files), "path", "lineno", "text"):
        found.setdefault(path, []).append(text)
    assert found["plain.py"] == ["a", "b", "c", "d", "e"] and "empty.py" not in found
    assert found["bad.ts"] == ["x\ufffdy"] and found["latin.py"][1] == "s = '\xe9'" and found["bom.py"] == ["x = 1"]
    locs = dict(rows(ops.module_loc(ops.decode_lines(files), files), "path", "loc"))
    assert locs["empty.py"] == 1 and locs["plain.py"] == 5
    hashes = dict(rows(ops.file_hash(files), "path", "sha256"))
    assert hashes["bom.py"] == hashlib.sha256(texts["bom.py"]).hexdigest()


def test_json_is_the_same_for_any_partitioning(graph, tmp_path):
    nodes, _ = graph([(f"n{i:02d}", "module", f"n{i:02d}") for i in range(30)])
    texts = []
    for n, parts in enumerate((1, 5)):
        write_json(nodes.repartition(parts), "nodes", str(tmp_path / str(n)))
        files = sorted((tmp_path / str(n)).glob("part-*"))
        texts.append("".join(f.read_text() for f in files))
    assert texts[0] == texts[1] and '"entrypoint_rank":null' in texts[0]


def test_ignore_rules_match_whole_segments(spark, tmp_path):
    root = tree(tmp_path, {
        ".gitignore": "gen/\nbuild\n/docs/*\n\t*.log\t\n[[x].js\n[!a]z.py\n",
        "oxygen/a.py": "", "rebuild/c.py": "", "old/docs/d.py": "", "gen/e.py": "", "build/f.py": "", "docs/g.py": "",
        "x.log": "", "x.log.py": "", "[.js": "", "x.js": "", "y.js": "", "az.py": "", "bz.py": ""})
    kept = ops.keep_readable(ops.scan_directory(spark, root, "p"))
    assert [r[0] for r in rows(kept, "path")] == sorted([".gitignore", "oxygen/a.py", "rebuild/c.py", "old/docs/d.py", "x.log.py", "y.js", "az.py"])


def test_a_file_can_be_the_root(spark, tmp_path):
    root = tree(tmp_path, {"one.PY": "x = 1\n", "two.py": "", ".gitignore": "one.PY\n"})
    kept = ops.scan_directory(spark, root + "/one.PY", "p")
    assert rows(kept, "project", "path", "ext", "content") == [("p", "one.PY", ".py", bytearray(b"x = 1\n"))]
    assert rows(ops.scan_directory(spark, "file://" + root + "/two.py", "p"), "path") == [("two.py",)]
    with pytest.raises(Exception, match="nothing"):
        ops.scan_directory(spark, root + "/nothing", "p").count()


def test_contents_that_are_not_kept_are_never_opened(spark, tmp_path, monkeypatch):
    root = tree(tmp_path, {".gitignore": "*.secret\nlocked/\n", "a.py": "a", "b.secret": "b", "locked/c.py": "c", "d/e.py": "e" * 500})
    for path in ("b.secret", "locked/c.py"):
        target = tmp_path / path
        target.unlink()
        target.symlink_to(tmp_path / "missing")
    assert rows(ops.scan_directory(spark, root, "p"), "path") == [(".gitignore",), ("a.py",), ("d/e.py",)]


def test_lists_are_dealt_by_size_and_read_in_partitions_of_their_own(spark, tmp_path):
    root = tree(tmp_path, {f"d{i % 4}/f{i:03d}.txt": "x" * (i * 100) for i in range(60)})
    listed = files.listing(spark.createDataFrame([("p", root)], "project string, root string"), [])
    read = files.read_listed(listed, list_bytes=100_000)
    total = sum(i * 100 + 4096 for i in range(60))
    parts = read.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.octet_length("content") + 4096).alias("n")).collect()
    assert len(parts) == -(-total // 100_000) or len(parts) == total // 100_000
    assert max(r.n for r in parts) <= 100_000 + 6_000 + 4096
    assert {(r.path, len(r.content)) for r in read.collect()} == {(f"d{i % 4}/f{i:03d}.txt", i * 100) for i in range(60)}
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()


def test_entries_fetch_only_rules_whose_key_they_hold(spark):
    text = "\n".join([f"lib{i}/" for i in range(200)] + [f"*.x{i}" for i in range(200)] + ["/a/b*/deep/*.log", "?z*"])
    corpus = spark.createDataFrame([("p", ".gitignore", bytearray(text.encode()))], "project string, path string, content binary")
    rules = ops.ignore_rules(corpus)
    paths = ["lib7", "lib7/k.x9", "a/bb/deep/q.log", "a/bb/deep/sub/q.log", "b/bb/deep/q.log", "yz1", "plain.py"]
    entries = spark.createDataFrame([("p", p, p == "lib7") for p in paths], "project string, entry string, is_directory boolean")
    found = ops.rule_candidates(entries, rules)
    assert found.count() == len(paths) + 2 + 1 + 3  # the keyless rule for all, and few others
    assert rows(ops._rule_hits(entries, rules), "entry") == [("a/bb/deep/q.log",), ("a/bb/deep/sub/q.log",), ("lib7",), ("lib7/k.x9",), ("yz1",)]


def test_patterns_match_as_the_shell_module_says(spark):
    patterns = ["*.py", "a?c", "[!a]b*", "x[0-9]", "\\\\E*", "(a+b)", "a.b", "*", "??", "[]a]q", "[a", "q$^", "\\\\Qx"]
    names = ["a.py", "abc", "a.c", "bb1", "ab", "x5", "(a+b)", "aab", "a.b", "axb", "]q", "[a", "q$^", "\\\\E1", "\\\\Qx", "é"]
    corpus = spark.createDataFrame([("p", ".gitignore", bytearray("\n".join(patterns).encode()))], "project string, path string, content binary")
    regexes = dict(rows(ops.ignore_rules(corpus), "pattern", "regex"))
    tried = spark.createDataFrame([(p, n, regexes[p]) for p in patterns for n in names], "p string, n string, r string")
    for p, n, hit in rows(tried.select("p", "n", F.regexp("n", F.col("r")))):
        assert hit == fnmatch.fnmatchcase(n, p), (p, n)
