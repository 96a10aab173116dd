"""Facts of Python source files, read in one pass over the corpus."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.corpus import python_text
from loomgraph.session import cut, ship, spread

# Syntax to concept.
CONCEPT_OF = {
    ast.ListComp: ["comprehension"], ast.SetComp: ["comprehension"], ast.DictComp: ["comprehension"],
    ast.GeneratorExp: ["generator"], ast.Yield: ["generator"], ast.YieldFrom: ["generator"],
    ast.With: ["context-manager"], ast.AsyncWith: ["context-manager", "async-await"],
    ast.Await: ["async-await"], ast.AsyncFor: ["async-await"],
    ast.Try: ["exception-handling"], ast.TryStar: ["exception-handling"], ast.Raise: ["exception-handling"],
    ast.Match: ["pattern-matching"], ast.JoinedStr: ["f-string"], ast.NamedExpr: ["walrus"],
}
# What marks a module as a place to start.
APP_FACTORIES = {"FastAPI", "Flask", "Typer"}
ENTRY_DECORATORS = {"command", "group", "route"}
SNIPPET_CHARS = 240

FACTS = (
    "project string, file string, module string, fact string, owner string, name string, kind string, "
    "parent string, class_id string, ancestors array<string>, target string, member string, level int, "
    "lineno int, end_lineno int, seq int, rank int, snippet string, receiver string, constructed string, "
    "is_init boolean, partial boolean"
)
_ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(name, _ARROW_TYPES[kind]) for name, kind in (c.split() for c in FACTS.split(", "))])
PIECE = 4096
_DEFINITION = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)
_DEFINITIONS, _IMPORTS = frozenset(_DEFINITION), frozenset([ast.Import, ast.ImportFrom])
# Fields of a node type that hold nodes, last first, for a walk over a stack.
_CHILDREN = {
    kind: tuple(name for name, held in reversed(kind._field_types.items()) if held not in (str, int, object, str | None, int | None))
    for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST) and hasattr(kind, "_field_types")
}
# Nodes that hold statements, and in which fields.
_BLOCKS = {
    kind: fields for kind in _CHILDREN
    if (fields := tuple(name for name in kind._fields if name in ("body", "handlers", "orelse", "finalbody", "cases")))
    and not issubclass(kind, ast.expr)
}


def module_name(path: str, package: str | None) -> str:
    """Dotted module of a path; a package root lends its own name as prefix."""
    parts = path[:-3].split("/")
    if parts[-1] == "__init__":
        parts.pop()
    if package:
        parts.insert(0, package)
    return ".".join(parts)


def written(expression: ast.AST | None) -> str | None:
    """A name or attribute chain as text; what precedes a non-name is left out."""
    tail: list[str] = []
    while isinstance(expression, ast.Attribute):
        tail.append(expression.attr)
        expression = expression.value
    if isinstance(expression, ast.Name):
        tail.append(expression.id)
    return ".".join(reversed(tail)) or None


def _leaf(decorator: ast.AST) -> str:
    text = written(decorator.func if isinstance(decorator, ast.Call) else decorator) or ""
    return text.rpartition(".")[2]


def _facts(path: str, raw: bytes, module: str) -> Iterator[dict]:
    """Rows of one file. Each scope is visited once, nested scopes on their own."""
    is_init = path.rpartition("/")[2] == "__init__.py"
    text, readable = python_text(raw)
    tree = None
    if readable:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            pass
    if tree is None:
        text = raw.decode("utf-8", errors="replace")
    lines = text.splitlines()
    size = max(1, len(lines))
    yield dict(fact="def", owner=module, name=module.rpartition(".")[2], kind="module", lineno=1,
               end_lineno=size, partial=tree is None, is_init=is_init, seq=0)
    if tree is None:
        return
    number = 0
    known: set[str] = set()
    concepts: set[tuple] = set()
    # A repeated definition is no node and owns nothing; its imports still count
    # for the module, and names it newly nests are nodes.
    pending = [(tree, module, None, [], False)]
    while pending:
        scope, owner, class_id, functions, repeated = pending.pop()

        def concept(name: str, at: ast.AST, owner: str = owner) -> None:
            first, last = getattr(at, "lineno", None), getattr(at, "end_lineno", None)
            if first is not None:
                shown = lines[first - 1].strip() if first <= len(lines) else ""
                concepts.add((owner, name, first, last or first, shown[:SNIPPET_CHARS]))

        if isinstance(scope, _DEFINITION) and not repeated:
            for name, at in _own_concepts(scope):
                concept(name, at)
            for name, type_name in _annotations(scope).items():
                yield dict(fact="type", owner=owner, name=name, target=type_name)
        inner = functions if isinstance(scope, (ast.Module, ast.ClassDef)) else [*functions, owner]
        inner_class = owner if isinstance(scope, ast.ClassDef) else class_id
        waiting = list(reversed(scope.body))
        nested = []
        while waiting:
            item = waiting.pop()
            number += 1
            kind = type(item)
            if kind in _DEFINITIONS:
                node_id = f"{owner}.{item.name}"
                nested.append((item, node_id, inner_class, inner, node_id in known))
                if node_id in known:
                    continue
                known.add(node_id)
                is_class = isinstance(item, ast.ClassDef)
                yield dict(fact="def", owner=node_id, name=item.name, kind="class" if is_class else "function",
                           parent=owner, class_id=inner_class, ancestors=inner, lineno=item.lineno,
                           end_lineno=item.end_lineno or item.lineno, partial=False, seq=number)
                for base in (item.bases if is_class else []):
                    number += 1
                    if (base_name := written(base)) is not None:
                        yield dict(fact="base", owner=node_id, target=base_name, seq=number)
                continue
            if kind in _IMPORTS:
                from_form = isinstance(item, ast.ImportFrom)
                for alias in item.names:
                    number += 1
                    yield dict(fact="import", owner=None if repeated else owner, kind="from" if from_form else "import",
                               target=(item.module or "") if from_form else alias.name,
                               member=alias.name if from_form else None, name=alias.asname,
                               level=item.level if from_form else 0, lineno=item.lineno, seq=number, is_init=is_init)
            for name in () if repeated else CONCEPT_OF.get(kind, ()):
                concept(name, item)
            if kind is ast.AnnAssign and not repeated:
                concept("type-hint", item.annotation)
            if kind is ast.Call and owner != module and not repeated:
                yield dict(fact="call", owner=owner, class_id=class_id, ancestors=functions, lineno=item.lineno,
                           seq=number, **_call(item.func))
            for field in _CHILDREN[kind]:
                held = getattr(item, field, None)
                if type(held) is list:
                    waiting.extend([node for node in reversed(held) if isinstance(node, ast.AST)])
                elif held is not None:
                    waiting.append(held)
        pending.extend(reversed(nested))
    for owner, name, lineno, last, snippet in sorted(concepts):
        yield dict(fact="concept", owner=owner, name=name, lineno=lineno, end_lineno=last, snippet=snippet)
    for owner, rank in _entry_evidence(tree, module, path):
        yield dict(fact="entry", owner=owner, rank=rank)


def _call(callee: ast.AST) -> dict:
    if isinstance(callee, ast.Name):
        return dict(kind="name", name=callee.id, target=callee.id)
    if not isinstance(callee, ast.Attribute):
        return dict(kind="dynamic")
    held = callee.value
    return dict(
        kind="member", name=callee.attr, target=written(callee),
        receiver=held.id if isinstance(held, ast.Name) else None,
        constructed=written(held.func) if isinstance(held, ast.Call) else None)


def _parameters(scope: ast.AST, variadic: bool) -> list[ast.arg]:
    if isinstance(scope, ast.ClassDef):
        return []
    given = scope.args
    listed = [*given.posonlyargs, *given.args, *given.kwonlyargs]
    if variadic:
        listed += [a for a in (given.vararg, given.kwarg) if a is not None]
    return [a for a in listed if a.annotation is not None]


def _own_concepts(scope: ast.AST) -> Iterator[tuple[str, ast.AST]]:
    """Concepts a definition carries by its own header."""
    for decorator in scope.decorator_list:
        yield "decorator", decorator
        if _leaf(decorator) == "dataclass":
            yield "dataclass", decorator
    if isinstance(scope, ast.ClassDef):
        yield from (("protocol", b) for b in scope.bases if (written(b) or "").rpartition(".")[2] == "Protocol")
        return
    if isinstance(scope, ast.AsyncFunctionDef):
        yield "async-await", scope
    if scope.name.startswith("__") and scope.name.endswith("__"):
        yield "dunder-method", scope
    yield from (("type-hint", a.annotation) for a in _parameters(scope, True))
    if scope.returns is not None:
        yield "type-hint", scope.returns


def _annotations(scope: ast.AST) -> dict[str, str]:
    """Local names with the type written for them; the last one counts."""
    named = {a.arg: written(a.annotation) for a in _parameters(scope, False)}
    found = {name: text for name, text in named.items() if text}
    # Level by level, as the last one in that order counts; annotations are statements, so expressions are left out.
    level: list[ast.AST] = [scope]
    while level:
        below = []
        for item in level:
            for field in _BLOCKS.get(type(item), ()):
                below.extend(getattr(item, field))
        for item in below:
            if type(item) is ast.AnnAssign and isinstance(item.target, ast.Name):
                if text := written(item.annotation):
                    found[item.target.id] = text
        level = below
    return found


def _entry_evidence(tree: ast.Module, module: str, path: str) -> Iterator[tuple[str, int]]:
    """Every reason to start here, with its rank; the best one counts later."""
    for statement in tree.body:
        if isinstance(statement, ast.If) and _is_main_guard(statement.test):
            yield module, 0
        if isinstance(statement, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if statement.name == "main":
                yield f"{module}.main", 1
            if any(_leaf(d) in ENTRY_DECORATORS for d in statement.decorator_list):
                yield module, 2
        targets = getattr(statement, "targets", None) or [getattr(statement, "target", None)]
        value = getattr(statement, "value", None)
        if isinstance(statement, (ast.Assign, ast.AnnAssign)) and len(targets) == 1:
            if isinstance(targets[0], ast.Name) and isinstance(value, ast.Call) and _leaf(value) in APP_FACTORIES:
                yield module, 2
    if path.rpartition("/")[2] == "__main__.py":
        yield module, 3


def _is_main_guard(test: ast.AST) -> bool:
    if not (isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.ops[0], ast.Eq)):
        return False
    sides = [test.left, *test.comparators]
    return any(isinstance(s, ast.Name) and s.id == "__name__" for s in sides) and any(
        isinstance(s, ast.Constant) and s.value == "__main__" for s in sides)


def _columns(fact: str, rows: list[dict], places: list[tuple]) -> pa.RecordBatch:
    """Facts of one kind; only the columns that the kind has are read from the rows."""
    given = set().union(*rows) if fact in _VARYING else set(rows[0])
    arrays = [pa.nulls(len(rows), field.type) if field.name not in given else pa.array([row.get(field.name) for row in rows], field.type)
              for field in _ARROW]
    for n in range(3):
        arrays[n] = pa.array([place[n] for place in places], pa.string())
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


# Kinds whose rows don't all have the same columns.
_VARYING = {"def", "call"}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts in pieces of some thousand rows, kind by kind, whatever the number of files in a batch."""
    held: dict[str, tuple[list, list]] = {}
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 16):
            for file in batch.slice(at, 16).to_pylist():
                project, path = file["project"], file["path"]
                module = module_name(path, file["package"]) or project
                place = (project, path, module)
                for fact in _facts(path, file["content"], module):
                    rows, places = held.setdefault(fact["fact"], ([], []))
                    rows.append(fact)
                    places.append(place)
                    size += 1
                    if size == PIECE:
                        yield from (_columns(kind, *kept) for kind, kept in held.items())
                        held, size = {}, 0
    yield from (_columns(kind, *kept) for kind, kept in held.items())


def facts(corpus: DataFrame) -> DataFrame:
    """All facts of the Python files, written once as a tagged union.

    A project whose root is itself a package prefixes its modules with its name.
    Those projects are written first, so the join that would otherwise move
    every file's content is a broadcast as long as their true size allows it.
    ``corpus`` is a stored table or a directory scan.
    """
    ship(corpus.sparkSession)
    packages = cut(corpus.where(F.col("path") == "__init__.py").select("project", F.col("project").alias("package")), "packages")
    files = spread(corpus.where(F.lower("path").endswith(".py")).select("project", "path", "content"))
    read = files.join(packages, "project", "left").select("project", "path", "package", "content").mapInArrow(_read, FACTS)
    return cut(read, "facts")


def of_kind(all_facts: DataFrame, fact: str) -> DataFrame:
    return all_facts.where(F.col("fact") == fact)


def defs(all_facts: DataFrame) -> DataFrame:
    return of_kind(all_facts, "def").select(
        "project", "file", "module", F.col("owner").alias("node_id"), "kind", "name", "parent", "class_id", "ancestors",
        "lineno", "end_lineno", "partial")


def nodes(all_facts: DataFrame) -> DataFrame:
    """The node table of the Python files, with their best entry rank."""
    ranks = entry_ranks(all_facts)
    return defs(all_facts).withColumnRenamed("node_id", "id").join(ranks, ["project", "id"], "left").select(
        "project", "id", "kind", "name", F.lit("python").alias("language"), "file", "lineno", "end_lineno",
        (F.col("end_lineno") - F.col("lineno") + 1).alias("loc"), F.col("module").alias("region"),
        "entrypoint_rank", "partial")


def entry_ranks(all_facts: DataFrame) -> DataFrame:
    return of_kind(all_facts, "entry").groupBy("project", F.col("owner").alias("id")).agg(
        F.min("rank").alias("entrypoint_rank"))


def concepts(all_facts: DataFrame) -> DataFrame:
    return of_kind(all_facts, "concept").select(
        "project", F.col("owner").alias("node_id"), F.lit("python").alias("language"), F.col("name").alias("concept"),
        "lineno", "end_lineno", "snippet").dropDuplicates()


def imports(all_facts: DataFrame) -> DataFrame:
    return of_kind(all_facts, "import").select(
        "project", "file", "module", "is_init", F.col("owner").alias("scope_id"), F.col("kind").alias("form"), "target",
        "member", F.col("name").alias("alias"), "level", "lineno", "seq")


def calls(all_facts: DataFrame) -> DataFrame:
    return of_kind(all_facts, "call").select(
        "project", "module", F.col("owner").alias("owner_id"), "class_id", "ancestors", F.col("kind").alias("form"),
        F.col("name").alias("leaf"), F.col("target").alias("dotted"), "receiver", "constructed", "lineno",
        F.col("seq").alias("call_no"))


def types(all_facts: DataFrame) -> DataFrame:
    return of_kind(all_facts, "type").select("project", "module", F.col("owner").alias("owner_id"), "name",
                                             F.col("target").alias("written_type"))


def bases(all_facts: DataFrame) -> DataFrame:
    return of_kind(all_facts, "base").select("project", "module", F.col("owner").alias("class_id"),
                                             F.col("target").alias("written_base"), "seq")
