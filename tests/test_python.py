import ast

from conftest import rows
from pyspark.sql import functions as F

from loomgraph.operators import extract, python_resolve
from loomgraph.sources.corpus import scan_table

FILES = {
    "pkg/__init__.py": "from .base import Base\n",
    "pkg/base.py": "class Base:\n    def run(self):\n        pass\n    def stop(self):\n        self.run()\n",
    "pkg/child.py": (
        "from . import base\nfrom .base import Base as B\nimport os.path\n\n"
        "class Child(B):\n    def go(self, other: B, odd: 'B'):\n        self.run()\n        other.stop()\n        odd.stop()\n"
        "        Child().run()\n        base.Base()\n        os.path.join()\n        base.gone()\n        len([])\n        self.zap()\n\n"
        "class Loop(Twin):\n    def spin(self):\n        self.spin2()\n\nclass Twin(Loop):\n    pass\n"),
    "app.py": (
        "import typer\ncli = typer.Typer()\n\ndef outer():\n    def inner():\n        return leaf()\n    def leaf():\n        return inner()\n"
        "    return inner()\n\nclass Twice:\n    def a(self):\n        first()\n\nclass Twice:\n    def a(self):\n        import late\n    def b(self):\n        last()\n"
        "@cli.command()\ndef main():\n    outer()\n\nif '__main__' == __name__:\n    main()\n"),
    "runner/__main__.py": "x = 1\n",
    "broken.py": "def oops(:\n",
}


def build(spark, files=FILES, project="p"):
    corpus = scan_table(spark.createDataFrame([(project, k, bytearray(v.encode())) for k, v in files.items()],
                                              "project string, path string, content binary"))
    return extract.facts(corpus)


def edges_of(spark, facts, src):
    _, edges = python_resolve.python_graph(facts)
    return [(r.dst, r.certain, r.external) for r in edges.where((F.col("src") == src) & (F.col("kind") == "call")).orderBy("lineno", "dst").collect()]


def test_calls_and_imports(spark):
    facts = build(spark)
    nodes, edges = python_resolve.python_graph(facts)
    found = [(r.dst, r.certain, r.external) for r in edges.where("src = 'pkg.child.Child.go'").orderBy("lineno", "dst").collect()]
    assert found == [
        ("pkg.base.Base.run", True, False), ("pkg.base.Base.stop", False, False), ("pkg.base.Base.stop", False, False),
        ("pkg.base.Base.run", True, False), ("pkg.child.Child", True, False), ("pkg.base.Base", True, False),
        ("external:os.path.join", False, True), ("unresolved:pkg.base.gone", False, False), ("external:builtins.len", False, True),
        ("external:self.zap", False, True)]
    imports = rows(edges.where("kind = 'import'"), "src", "dst", "lineno")
    assert imports == [("app", "external:late", 17), ("app", "external:typer", 1), ("pkg", "pkg.base", 1), ("pkg.child", "external:os.path", 3),
                       ("pkg.child", "pkg.base", 1), ("pkg.child", "pkg.base", 2)]
    # A class cycle ends, and an inner name is not in scope for its own owner.
    assert [r.dst for r in edges.where("src = 'pkg.child.Loop.spin'").collect()] == ["external:self.spin2"]
    inner = rows(edges.where("src IN ('app.outer', 'app.outer.inner', 'app.outer.leaf') AND kind = 'call'"), "src", "dst", "certain")
    assert inner == [("app.outer", "app.outer.inner", False), ("app.outer.inner", "app.outer.leaf", True), ("app.outer.leaf", "app.outer.inner", True)]
    # The first definition of a repeated name wins; what the second adds is kept.
    assert rows(edges.where("src LIKE 'app.Twice%'"), "src", "dst") == [("app.Twice.a", "external:first"), ("app.Twice.b", "external:last")]
    assert nodes.where("id = 'app.Twice.a'").count() == 1
    ranks = {r.id: r.entrypoint_rank for r in nodes.where("entrypoint_rank IS NOT NULL").collect()}
    assert ranks == {"app": 0, "app.main": 1, "runner.__main__": 3}
    assert rows(nodes.where("partial"), "id", "loc") == [("broken", 1)]


def test_package_root_lends_its_name(spark):
    facts = build(spark, {"__init__.py": "", "util.py": "def f():\n    pass\n"}, "lib")
    assert rows(extract.defs(facts), "node_id") == [("lib",), ("lib.util",), ("lib.util.f",)]


def test_every_concept(spark):
    text = (
        "from dataclasses import dataclass\nfrom typing import Protocol\n\n@dataclass(frozen=True)\nclass A:\n    n: int\n\n"
        "class P(Protocol):\n    def __len__(self) -> int: ...\n\nasync def work(path):\n    async with open(path) as f:\n        await f\n"
        "    async for x in f:\n        yield x\n\ndef rest(v):\n    match v:\n        case 1:\n            raise ValueError\n    if (y := v) and [z for z in v]:\n"
        "        return f'{y}', (q for q in v)\n    try:\n        pass\n    except* OSError:\n        pass\n")
    found = extract.concepts(build(spark, {"c.py": text}))
    assert {r.concept for r in found.collect()} == {
        "dataclass", "protocol", "pattern-matching", "f-string", "walrus", "decorator", "comprehension", "generator",
        "context-manager", "async-await", "dunder-method", "exception-handling", "type-hint"}
    owners = {r.concept: r.node_id for r in found.where("concept IN ('dunder-method', 'dataclass', 'walrus')").collect()}
    assert owners == {"dunder-method": "c.P.__len__", "dataclass": "c.A", "walrus": "c.rest"}


ODD = b'''
import a.b as c
class K(Base, metaclass=M):
    x: int = f(1)
    def m(self, p: T, *rest: U):
        if p:
            y: First = g(p)[h()]
            def deep(q: int):
                y: Other = lambda z: z(i())
        try:
            with k() as w, w.l():
                y: Second = {**n(), "s": [o(v) for v in r() if v]}
        except E as e:
            y: Third = None
        match p:
            case [1, *_] if s():
                z: Fourth = -t()
        return f"{u(p)!r:>{w2()}}"
async def outer():
    async for item in a():
        x.y().z(*b(), **c())
'''


def test_facts_are_found_without_walking_definitions_again(monkeypatch):
    """Numbers and types against walks by the library of Python, which the extraction itself doesn't need."""
    tree = ast.parse(ODD)
    where = {}
    pending = [tree]
    number = 0
    while pending:
        scope = pending.pop()
        waiting, nested = list(reversed(scope.body)), []
        while waiting:
            item = waiting.pop()
            number += 1
            if isinstance(item, extract._DEFINITION):
                nested.append(item)
                number += len(item.bases) if isinstance(item, ast.ClassDef) else 0
                continue
            number += len(item.names) if isinstance(item, ast.Import) else 0
            if isinstance(item, ast.Call) and scope is not tree:
                where[item.lineno, number] = ast.unparse(item.func)
            waiting.extend(reversed(list(ast.iter_child_nodes(item))))
        pending.extend(reversed(nested))
    method = tree.body[1].body[1]
    types = {"p": "T"} | {n.target.id: n.annotation.id for n in ast.walk(method) if isinstance(n, ast.AnnAssign)}
    walked = []
    monkeypatch.setattr(ast, "walk", lambda node: walked.append(node) or iter(()))
    monkeypatch.setattr(ast, "iter_child_nodes", lambda node: walked.append(node) or iter(()))
    found = list(extract._facts("m.py", ODD, "m"))
    assert {(f["lineno"], f["seq"]) for f in found if f["fact"] == "call"} == set(where) and len(where) > 12
    assert {f["name"]: f["target"] for f in found if f["fact"] == "type" and f["owner"] == "m.K.m"} == types and len(types) == 3
    assert not walked
