"""The given tables seen as five code bases.

One project per region of the world. Every nation, customer, order, supplier
and ordered part is a module; order lines are functions inside their order.
Foreign keys become imports and calls, so every table is read whole and the
graph grows with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.schema import CONCEPT_COLUMNS, EDGE_COLUMNS, NODE_COLUMNS
from loomgraph.session import spread

# The concept ids a Python file can carry.
PYTHON_CONCEPTS = [
    "dataclass", "protocol", "pattern-matching", "f-string", "walrus", "decorator",
    "comprehension", "generator", "context-manager", "async-await", "dunder-method",
    "exception-handling", "type-hint",
]

# Which concept a line carries for its part's type; ``promo`` has no note.
TYPE_CONCEPTS = {
    "ECONOMY": "async-await", "LARGE": "arrow-function", "MEDIUM": "destructuring",
    "PROMO": "promo", "SMALL": "interface", "STANDARD": "generic",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _ident(prefix: str, key: str, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(suffix))


def _places(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("project"), "n_nationkey", "r_regionkey"
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    places = _places(spark, folder)
    return customer.join(places, customer.c_nationkey == places.n_nationkey).select(
        "project", "c_custkey", "c_nationkey", "c_mktsegment",
        (F.col("c_acctbal") >= 0).alias("linked"),
    )


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier")
    places = _places(spark, folder)
    return supplier.join(places, supplier.s_nationkey == places.n_nationkey).select(
        "project", "s_suppkey", "s_nationkey", "s_acctbal"
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    order = spread(table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"
    ))
    buyer = customers(spark, folder).select("project", "c_custkey", "linked")
    return order.join(buyer, order.o_custkey == buyer.c_custkey).drop("c_custkey")


def _node(kind: str, id_: Column, language: str, file: Column, lineno: Column, loc: Column,
          region: Column, rank: Column | None = None, partial: Column | None = None) -> list[Column]:
    return [
        F.col("project"),
        id_.alias("id"),
        F.lit(kind).alias("kind"),
        F.element_at(F.split(id_, r"\."), -1).alias("name"),
        F.lit(language).alias("language"),
        file.alias("file"),
        lineno.cast("int").alias("lineno"),
        (lineno + loc - 1).cast("int").alias("end_lineno"),
        loc.cast("int").alias("loc"),
        region.alias("region"),
        (F.lit(None) if rank is None else rank).cast("int").alias("entrypoint_rank"),
        (F.lit(False) if partial is None else partial).alias("partial"),
    ]


def _customer_file() -> Column:
    return F.concat(F.lit("src/customers/"), F.lower("c_mktsegment"), F.lit("/"),
                    _ident("customer_", "c_custkey", ".py"))


def _order_file() -> Column:
    return F.concat(F.lit("lib/orders/"), F.substring("o_orderpriority", 1, 1), F.lit("/"),
                    _ident("order_", "o_orderkey", ".ts"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    places = _places(spark, folder)
    one = F.lit(1)
    world = places.select("project").distinct().select(
        *_node("module", F.lit("world"), "python", F.lit("src/world.py"), one, F.lit(10), F.lit("world"))
    )
    nation_id = _ident("nation.", "n_nationkey")
    nation_file = F.when(F.col("n_nationkey") % 7 == 1, _ident("tests/geo/nation_", "n_nationkey", ".py")
                         ).otherwise(_ident("src/geo/nation_", "n_nationkey", ".py"))
    rank = F.when(F.col("r_regionkey") == 4, 1).otherwise(F.floor(F.col("n_nationkey") / 5))
    nation = places.select(*_node("module", nation_id, "python", nation_file, one, F.lit(20), nation_id, rank))
    nation_class = places.select(*_node(
        "class", _ident("nation.", "n_nationkey", ".Nation"), "python", nation_file, F.lit(3), F.lit(12), nation_id))

    buyer = customers(spark, folder)
    customer_id = _ident("customer.", "c_custkey")
    customer = buyer.select(*_node("module", customer_id, "python", _customer_file(), one, F.lit(8), customer_id))
    customer_class = buyer.select(*_node(
        "class", _ident("customer.", "c_custkey", ".Customer"), "python", _customer_file(), F.lit(3), F.lit(5), customer_id))

    order = orders(spark, folder)
    order_id = _ident("order.", "o_orderkey")
    order_module = order.select(*_node("module", order_id, "typescript", _order_file(), one, F.lit(90), order_id))
    order_class = order.select(*_node(
        "class", _ident("order.", "o_orderkey", ".Order"), "typescript", _order_file(), F.lit(2), F.lit(8), order_id))
    item = (
        spread(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
        .groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("quantity"))
    )
    line = item.join(order, item.l_orderkey == order.o_orderkey).select(*_node(
        "function", F.concat(order_id, F.lit(".line"), F.col("l_linenumber").cast("string")), "typescript",
        _order_file(), F.col("l_linenumber") * 10, F.col("quantity"), order_id))

    seller = suppliers(spark, folder)
    supplier_id = _ident("supplier.", "s_suppkey")
    supplier_file = _ident("src/suppliers/supplier_", "s_suppkey", ".go")
    supplier = seller.select(*_node("module", supplier_id, "go", supplier_file, one, F.lit(6), supplier_id,
                                    F.when(F.col("s_acctbal") < 0, 3)))
    ship = seller.select(*_node("function", _ident("supplier.", "s_suppkey", ".ship"), "go", supplier_file,
                                F.lit(2), F.lit(4), supplier_id))

    ordered = (
        spread(table(spark, folder, "lineitem").select("l_orderkey", "l_partkey"))
        .join(order.select("o_orderkey", "project"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("project", "l_partkey").distinct()
    )
    part = table(spark, folder, "part")
    used = ordered.join(part, ordered.l_partkey == part.p_partkey)
    part_id = _ident("part.", "p_partkey")
    brand = F.lower(F.regexp_replace("p_brand", "#", "_"))
    part_file = F.concat(
        F.when(F.col("p_brand").endswith("5"), "tests/").otherwise("lib/parts/"), brand, F.lit("/"),
        _ident("part_", "p_partkey", ".ts"))
    broken = F.col("p_type") == "PROMO"
    part_module = used.select(*_node("module", part_id, "typescript", part_file, one,
                                     F.col("p_size") + 2, part_id, None, broken))
    make = used.where(~broken).select(*_node("function", _ident("part.", "p_partkey", ".make"), "typescript",
                                             part_file, F.lit(2), F.col("p_size"), part_id))
    whole = world
    for piece in (nation, nation_class, customer, customer_class, order_module, order_class, line,
                  supplier, ship, part_module, make):
        whole = whole.unionByName(piece)
    return whole.select(*NODE_COLUMNS)


def _edge(src: Column, dst: Column, kind: str, certain: Column, lineno: Column,
          external: Column | None = None) -> tuple[str, Column]:
    return kind, F.struct(
        src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), certain.alias("certain"),
        lineno.cast("int").alias("lineno"),
        (F.lit(False) if external is None else external).alias("external"),
    )


def _spread(df: DataFrame, *edges: tuple[str, Column]) -> dict[str, DataFrame]:
    """Per kind, the rows' edges of that kind."""
    return {
        kind: df.select("project", F.explode(F.filter(F.array(*[e for k, e in edges if k == kind]), lambda e: e["src"].isNotNull())).alias("e"))
        .select("project", "e.*")
        for kind in dict.fromkeys(k for k, _ in edges)
    }


def raw_edges(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Edges of a kind (import or call) as observed, repeats included; what only the other kind needs is not read."""
    places = _places(spark, folder)
    yes = F.lit(True)
    first = places.groupBy("project").agg(F.min("n_nationkey").alias("n_nationkey"))
    world = _spread(first, _edge(F.lit("world"), _ident("nation.", "n_nationkey"), "import", yes, F.lit(1)))
    first_supplier = suppliers(spark, folder).groupBy("project", "s_nationkey").agg(
        F.min("s_suppkey").alias("s_suppkey"))
    nation_id = _ident("nation.", "n_nationkey")
    nation = _spread(places, _edge(nation_id, F.lit("world"), "import", yes, F.lit(1)))
    nation_supplier = _spread(
        first_supplier,
        _edge(_ident("nation.", "s_nationkey"), _ident("supplier.", "s_suppkey"), "import", yes, F.lit(2)))
    supplier = _spread(
        suppliers(spark, folder),
        _edge(_ident("supplier.", "s_suppkey"), _ident("nation.", "s_nationkey"), "import", yes, F.lit(1)))
    linked = F.col("linked")
    customer_id = _ident("customer.", "c_custkey")
    customer = _spread(
        customers(spark, folder),
        _edge(F.when(linked, customer_id), _ident("nation.", "c_nationkey"), "import", yes, F.lit(1)),
        _edge(_ident("nation.", "c_nationkey", ".Nation"), _ident("customer.", "c_custkey", ".Customer"),
              "call", linked, F.lit(5)))
    order = orders(spark, folder)
    order_id = _ident("order.", "o_orderkey")
    from_order = _spread(
        order,
        _edge(order_id, _ident("customer.", "o_custkey"), "import", yes, F.lit(1)),
        _edge(_ident("customer.", "o_custkey", ".Customer"), _ident("order.", "o_orderkey", ".Order"), "call",
              F.col("o_orderstatus") != "P", F.lit(4)))
    latest = order.groupBy("project", "o_custkey").agg(
        F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("o_orderkey"))
    to_latest = _spread(
        latest, _edge(_ident("customer.", "o_custkey"), order_id, "import", F.lit(False), F.lit(2)))

    line = (
        spread(table(spark, folder, "lineitem")
               .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus",
                       "l_tax", "l_discount"))
        .join(order.select("project", "o_orderkey", "linked"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers(spark, folder).select(F.col("project").alias("s_project"), "s_suppkey"),
              F.col("l_suppkey") == F.col("s_suppkey"))
    )
    number = F.col("l_linenumber")
    line_id = F.concat(order_id, F.lit(".line"), number.cast("string"))
    kept = F.col("l_returnflag") != "R"
    near = F.col("s_project") == F.col("project")
    seller = _ident("supplier.", "l_suppkey")
    before = F.when(number > 1, F.concat(order_id, F.lit(".line"), (number - 1).cast("string"))).otherwise(
        F.concat(F.lit("unresolved:"), order_id, F.lit(":line0")))
    from_line = _spread(
        line,
        _edge(line_id, _ident("part.", "l_partkey", ".make"), "call", kept, number * 10 + 1),
        _edge(line_id, F.when(near, F.concat(seller, F.lit(".ship"))).otherwise(
            F.concat(F.lit("external:"), seller, F.lit(".ship"))), "call", near, number * 10 + 2, ~near),
        _edge(line_id, before, "call", F.col("l_linestatus") == "F", number * 10 + 3),
        _edge(F.when(F.col("l_discount") == 0, line_id), line_id, "call", yes, number * 10 + 4),
        _edge(F.when((number == 1) & (F.col("l_tax") < 0.02), line_id), F.concat(order_id, F.lit(".line2")),
              "call", yes, number * 10 + 5),
        _edge(_ident("order.", "o_orderkey", ".Order"), line_id, "call", F.col("l_returnflag") == "A", number + 2),
        _edge(F.when(F.col("linked"), order_id), _ident("part.", "l_partkey"), "import", kept, number + 1),
        _edge(F.when(F.col("linked"), order_id), F.when(near, seller).otherwise(
            F.concat(F.lit("external:"), seller)), "import", yes, number + 20, ~near),
    )
    pieces = (world, nation, nation_supplier, supplier, customer, from_order, to_latest, from_line)
    return reduce(DataFrame.unionByName, [piece[kind] for piece in pieces if kind in piece]).select(*EDGE_COLUMNS)


def files(node_table: DataFrame) -> DataFrame:
    """One row per file; the stand-in content hash is taken over its path."""
    return (
        node_table.select("project", "file", "language").distinct()
        .withColumn("sha256", F.sha2(F.concat_ws("/", "project", "file"), 256))
    )


def _type_concept() -> Column:
    pairs = [F.lit(v) for pair in TYPE_CONCEPTS.items() for v in pair]
    return F.create_map(*pairs)[F.col("p_type")]


def concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Customers carry Python concepts in turn, lines one by their part's type."""
    cycle = F.array(*[F.lit(c) for c in PYTHON_CONCEPTS])
    buyer = customers(spark, folder).select(
        "project", _ident("customer.", "c_custkey", ".Customer").alias("node_id"),
        F.lit("python").alias("language"),
        F.element_at(cycle, (F.col("c_custkey") % len(PYTHON_CONCEPTS) + 1).cast("int")).alias("concept"),
        F.lit(3).alias("lineno"), F.lit(4).alias("end_lineno"), F.col("c_mktsegment").alias("snippet"))
    line = (
        spread(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"))
        .join(orders(spark, folder).select("project", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "part").select("p_partkey", "p_type", "p_name"),
              F.col("l_partkey") == F.col("p_partkey"))
    )
    bought = line.select(
        "project",
        F.concat(_ident("order.", "o_orderkey"), F.lit(".line"), F.col("l_linenumber").cast("string")).alias("node_id"),
        F.lit("typescript").alias("language"), _type_concept().alias("concept"),
        (F.col("l_linenumber") * 10 + 1).cast("int").alias("lineno"),
        (F.col("l_linenumber") * 10 + 1).cast("int").alias("end_lineno"), F.col("p_name").alias("snippet"))
    return buyer.unionByName(bought).distinct().select(*CONCEPT_COLUMNS)


def progress_events(spark: SparkSession, folder: str, signatures: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """The events table, or a batch of it, as a learner's log.

    The project is that of the customer an event's ``k`` names. Clicks name the
    learner's own customer module, which often lies in another project, so some
    visits point at regions that do not exist.
    """
    raw = table(spark, folder, "events") if events is None else events
    event = raw.withColumn(
        "k", F.get_json_object("props", "$.k").cast("long"))
    place = customers(spark, folder).select("project", F.col("c_custkey").alias("k"))
    kind = F.col("event_type")
    mapped = event.join(place, "k").select(
        "event_id", "project", F.col("user_id").alias("learner_id"), "ts",
        F.when(kind.isin("view", "click"), "visit").when(kind == "purchase", "pass_check")
        .when(kind == "signup", "mode").when(F.col("value") < 5, "reset").otherwise("home").alias("type"),
        F.concat(F.lit("customer."), F.when(kind == "click", F.col("user_id")).otherwise(F.col("k")).cast("string")).alias("region"),
        F.when(kind == "signup", F.when(F.col("value") < 50, "easy").when(F.col("value") < 200, "expert").otherwise("loud"))
        .when(kind == "error", F.concat(F.lit("nation."), (F.col("k") % 25).cast("string"))).alias("value"),
        (F.col("value") < 40).alias("fresh"))
    known = signatures.withColumnRenamed("signature", "current")
    return mapped.join(known, ["project", "region"], "left").select(
        "event_id", "project", "learner_id", "ts", "type", "region",
        F.when(F.col("type") == "pass_check", F.when(F.col("fresh"), F.coalesce("current", F.lit("stale"))).otherwise("stale")).alias("signature"),
        "value")


def other_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files in languages without an owner: one per customer of two market segments."""
    language = F.when(F.col("c_mktsegment") == "MACHINERY", ".c").when(F.col("c_mktsegment") == "FURNITURE", ".kt")
    return customers(spark, folder).where(language.isNotNull()).select(
        "project", F.concat(F.lit("native/customer_"), F.col("c_custkey").cast("string"), language).alias("path"), language.alias("ext"))


# ---- the same tables as Python source files ------------------------------

def _file(rows: DataFrame, path: Column, *lines: Column | str) -> DataFrame:
    text = F.concat_ws("\n", *[F.lit(line) if isinstance(line, str) else line for line in lines])
    return rows.select("project", path.alias("path"), F.encode(text, "UTF-8").alias("content"))


def _say(pattern: str, *keys: str) -> Column:
    return F.format_string(pattern, *[F.col(k) for k in keys])


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """One Python file per nation, supplier, customer and order.

    A file's text depends on its own row only, so writing it needs no grouping.
    Orders in status P do not parse.
    """
    nation = _file(
        _places(spark, folder), _ident("app/geo/nation_", "n_nationkey", ".py"),
        "from dataclasses import dataclass",
        "",
        "@dataclass",
        "class Nation:",
        "    code: int = 0",
        "    def locate(self):",
        "        return f'{self.code}'",
        "    async def fetch(self):",
        "        async with self.session() as s:",
        "            await s.go()",
        "",
        "def visit(place):",
        "    if (n := len(place)) > 1:",
        "        raise ValueError(n)",
    )
    supplier = _file(
        suppliers(spark, folder), _ident("app/suppliers/supplier_", "s_suppkey", ".py"),
        "from fastapi import FastAPI",
        "import typing",
        _say("import app.geo.nation_%d as home", "s_nationkey"),
        "app = FastAPI()",
        "class Supplier(typing.Protocol):",
        _say("    def deliver_%d(self):", "s_suppkey"),
        "        ...",
        "class Backup(Supplier):",
        _say("    def deliver_%d(self):", "s_suppkey"),
        "        yield 1",
        "def main(thing):",
        _say("    thing.deliver_%d()", "s_suppkey"),
        "    home.visit('x')",
        "    home.lost()",
        "    typing.cast(int, 1)",
        "main(None)",
    )
    customer = _file(
        customers(spark, folder), _ident("app/customers/customer_", "c_custkey", ".py"),
        _say("from ..geo.nation_%d import Nation, visit as go", "c_nationkey"),
        "class Customer(Nation):",
        "    label: str = ''",
        "    def __init__(self, name: str):",
        "        self.reset()",
        "        self.locate()",
        "    def reset(self):",
        "        print(self.label)",
        "        self.code.bump()",
        "def build():",
        _say("    def inner_%d(x):", "c_custkey"),
        "        return [go(i) for i in x]",
        "    Customer('x').locate()",
        _say("    inner_%d([])", "c_custkey"),
        "    return (lambda: 0)()",
        "def build():",
        "    return None",
    )
    order = orders(spark, folder)
    whole = order.where(F.col("o_orderstatus") != "P")
    order_file = _file(
        whole, _ident("app/orders/order_", "o_orderkey", ".py"),
        _say("from app.customers.customer_%d import Customer, build", "o_custkey"),
        "from app.missing import ghost",
        "import json",
        "class Order:",
        "    def run(self, buyer: Customer):",
        "        buyer.reset()",
        "        buyer.locate()",
        "        build()",
        "        ghost()",
        "        helper()",
        "        with open('f') as f:",
        "            return json.dumps(f)",
        "def helper():",
        "    try:",
        "        nothing()",
        "    except ValueError:",
        "        pass",
        F.when(F.col("o_orderstatus") == "F", "if __name__ == '__main__':\n    helper()").otherwise("helper()"),
    )
    broken = _file(
        order.where(F.col("o_orderstatus") == "P"), _ident("app/orders/order_", "o_orderkey", ".py"),
        "def broken(:", "    pass")
    return nation.unionByName(supplier).unionByName(customer).unionByName(order_file).unionByName(broken)


# Fixed cycle of extensions given to documents, known and unknown alike.
DOCUMENT_EXTENSIONS = [".py", ".ts", ".go", ".java", ".rs", ".cs", ".jsx", ".c", ".h", ".txt", ".kt", ".PY"]


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of twenty projects, each with a root ignore file."""
    doc = table(spark, folder, "documents")
    names = F.array(*[F.lit(e) for e in DOCUMENT_EXTENSIONS])
    key = F.col("doc_id")
    where = F.element_at(F.array(*[F.lit(d) for d in (
        "", "src/", "src/gen/", "node_modules/x/", ".cache/", "vendor/", "docs/old/", "build/", "src/keep/deep/")]),
        (key % 9 + 1).cast("int"))
    path = F.concat(where, F.col("lang"), F.lit("_"), key.cast("string"),
                    F.element_at(names, (F.floor(key / 9) % len(DOCUMENT_EXTENSIONS) + 1).cast("int")))
    files = doc.select(F.col("source").alias("project"), path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    rules = "# kept short\n*_1?.go\ngen/\n!src/gen/en_2.py\ndocs/*\n/src/keep/deep\n*.txt\n!fr_*.txt\n"
    ignore = doc.select(F.col("source").alias("project")).distinct().select(
        "project", F.lit(".gitignore").alias("path"), F.encode(F.lit(rules), "UTF-8").alias("content"))
    return files.unionByName(ignore)
