"""Comprehension questions whose answers are graph facts, and their grading.

Answers, options and evidence are child tables keyed by check, never arrays: a
check on a hub has as many answers as the hub has callers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.hashing import short_id
from loomgraph.operators.canonical import candidates, internal_edges
from loomgraph.plans.ranking import ordered_index, top_rows
from loomgraph.session import cut, small_side

# Fixed values of the question format.
CHECK_VERSION = "6"
LEAST_OPTIONS = 4
LEAST_WRONG = 2
KIND_ORDER = {"first-call": 1, "direct-importer": 2, "removal-impact": 3, "entrypoint": 4}

CLAIM_COLUMNS = ["project", "region", "kind", "subject", "form", "answer", "citation"]


def _claims(rows: DataFrame, kind: str, form: str) -> DataFrame:
    return rows.withColumn("kind", F.lit(kind)).withColumn("form", F.lit(form)).select(*CLAIM_COLUMNS)


def _cite(column: str = "file") -> F.Column:
    return F.concat(column, F.lit(":"), F.col("lineno").cast("string"))


def _certain_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return internal_edges(edges.where("certain"), nodes, "call").select("project", "src", "dst", "lineno")


def first_call(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per region: what its smallest calling structure calls first."""
    src = nodes.select("project", F.col("id").alias("src"), "region", "file")
    calls = _certain_calls(nodes, edges).join(src, ["project", "src"])
    first = calls.groupBy("project", "region").agg(F.min(F.struct("src", "lineno", "dst", "file")).alias("f"))
    rows = first.select(
        "project", "region", F.col("f.src").alias("subject"), F.col("f.dst").alias("answer"),
        F.concat("f.file", F.lit(":"), F.col("f.lineno").cast("string")).alias("citation"))
    return _claims(rows, "first-call", "calls")


def direct_importer(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Importers of each region's module, or else the first import it makes."""
    imports = edges.where((F.col("kind") == "import") & F.col("certain") & ~F.col("external"))
    regions = nodes.select("project", "region").distinct()
    ids = nodes.select("project", "id", "file")
    incoming = (
        imports.join(ids.withColumnRenamed("id", "src"), ["project", "src"])
        .join(regions.withColumnRenamed("region", "dst"), ["project", "dst"], "left_semi")
        .select("project", F.col("dst").alias("region"), F.col("dst").alias("subject"),
                F.col("src").alias("answer"), _cite().alias("citation"))
    )
    outgoing = (
        imports.join(ids.select("project", F.col("id").alias("dst")), ["project", "dst"], "left_semi")
        .groupBy("project", "src").agg(F.min(F.struct("lineno", "dst")).alias("first"))
        .join(regions.withColumnRenamed("region", "src"), ["project", "src"], "left_semi")
        .join(_imported(imports, nodes), ["project", "src"], "left_anti")
        .join(ids.withColumnRenamed("id", "src"), ["project", "src"])
        .select("project", F.col("src").alias("region"), F.col("src").alias("subject"),
                F.col("first.dst").alias("answer"),
                F.concat("file", F.lit(":"), F.col("first.lineno").cast("string")).alias("citation"))
    )
    return _claims(incoming, "direct-importer", "imported by").unionByName(
        _claims(outgoing, "direct-importer", "imports"))


def _imported(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """Modules that some node imports, in the column ``src``."""
    return imports.join(
        nodes.select("project", F.col("id").alias("src")), ["project", "src"], "left_semi"
    ).select("project", F.col("dst").alias("src")).distinct()


def removal_impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per region: the callers of its most widely called structure."""
    calls = _certain_calls(nodes, edges)
    spread = calls.select("project", "src", "dst").distinct().groupBy("project", "dst").agg(
        F.count("*").alias("callers"))
    where = nodes.select("project", F.col("id").alias("dst"), "region")
    target = spread.join(where, ["project", "dst"]).groupBy("project", "region").agg(
        F.min(F.struct(-F.col("callers"), F.col("dst")))["dst"].alias("dst"))
    src = nodes.select("project", F.col("id").alias("src"), "file")
    rows = calls.join(target, ["project", "dst"]).join(src, ["project", "src"]).select(
        "project", "region", F.col("dst").alias("subject"), F.col("src").alias("answer"), _cite().alias("citation"))
    return _claims(rows, "removal-impact", "called by")


def entrypoint(nodes: DataFrame, homes: DataFrame) -> DataFrame:
    """The region holding the selected home asks where the program starts."""
    chosen = homes.where(F.col("home").isNotNull()).select("project", F.col("home").alias("id"))
    ranked = candidates(nodes).select("project", "id", "region")
    rows = chosen.join(ranked, ["project", "id"]).join(
        nodes.select("project", "id", "file", "lineno"), ["project", "id"]
    ).select("project", "region", F.col("id").alias("subject"), F.col("id").alias("answer"), _cite().alias("citation"))
    return _claims(rows, "entrypoint", "starts")


def all_claims(nodes: DataFrame, edges: DataFrame, homes: DataFrame) -> DataFrame:
    """Every question's evidence: one row per citation, keyed by check id."""
    whole = reduce(DataFrame.unionByName, [
        first_call(nodes, edges), direct_importer(nodes, edges), removal_impact(nodes, edges), entrypoint(nodes, homes)])
    return whole.withColumn("check_id", short_id(F.lit(CHECK_VERSION), F.col("region"), F.col("kind"), F.col("subject")))


def answers(claims: DataFrame) -> DataFrame:
    return claims.select("project", "check_id", "kind", F.col("answer").alias("option_id")).distinct()


def option_pools(nodes: DataFrame) -> DataFrame:
    """Ids of each pool (functions, modules, all) numbered in order."""
    pooled = nodes.select("project", "id", F.explode(
        F.when(F.col("kind") == "class", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.col("kind")))
    ).alias("pool"))
    return ordered_index(pooled, ["project", "pool"], [F.col("id")], "place")


def wrong_options(answer_rows: DataFrame, pools: DataFrame) -> DataFrame:
    """The first pool ids that are not answers, enough to fill each question.

    At most three wrong options are ever needed (four slots less the answers,
    at least two), so they lie among the first n + 3 places of the pool for n
    answers, and are among places 0-2 and the three places after some answer
    there. Answers further on, which are nearly all, are only counted.
    """
    most_wrong = LEAST_OPTIONS - 1
    pools = cut(pools, "pools")
    sizes = pools.groupBy("project", "pool").agg(F.count("*").alias("pool_size"))
    pool_of = F.when(F.col("kind") == "entrypoint", "all").when(
        F.col("kind") == "direct-importer", "module").otherwise("function")
    whole = F.col("pool") == "all"
    places = pools.groupBy("project", F.col("id").alias("option_id")).agg(
        F.max(F.when(whole, F.col("place"))).alias("in_all"),
        F.max(F.when(~whole, F.struct("pool", "place"))).alias("own"))
    wanted = answer_rows.select("project", "check_id", "option_id", pool_of.alias("pool"))
    placed = cut(
        wanted.join(places, ["project", "option_id"], "left").select(
            "project", "check_id", "pool", "in_all",
            F.when(whole, F.col("in_all")).when(F.col("own.pool") == F.col("pool"), F.col("own.place")).alias("place")),
        "answer_places")
    counts = placed.groupBy("project", "check_id", "pool").agg(
        F.count("*").alias("n_answers"), F.count("place").alias("n_inside"))
    counts = counts.join(sizes, ["project", "pool"], "left").withColumn(
        "reach", F.coalesce("pool_size", F.lit(0)) + F.col("n_answers") - F.col("n_inside"))
    chosen_pool = counts.select(
        "project", "check_id", "n_answers",
        F.when(F.col("reach") < 2, "all").otherwise(F.col("pool")).alias("pool"))
    checks = cut(chosen_pool.join(sizes, ["project", "pool"]).select(
        "project", "check_id", "pool", "n_answers", F.least("pool_size", F.col("n_answers") + most_wrong).alias("bound")), "check_pools")
    furthest = checks.agg(F.max("bound")).first()[0] or 0
    # First by the bound of all checks, so that few rows meet their own.
    early = placed.where(F.least("in_all", "place") < furthest).withColumnRenamed("pool", "own_pool")
    held = cut(
        early.join(checks, ["project", "check_id"])
        .withColumn("place", F.when(F.col("pool") == F.col("own_pool"), F.col("place")).otherwise(F.col("in_all")))
        .where(F.col("place") < F.col("bound")).select(*checks.columns, "place"), "held_places")
    near = held.withColumn("place", F.explode(F.array(*[F.col("place") + i for i in range(1, most_wrong + 1)])))
    start = checks.withColumn("place", F.explode(F.array(*[F.lit(i).cast("long") for i in range(most_wrong)])))
    tried = near.unionByName(start).where(F.col("place") < F.col("bound")).distinct()
    free = tried.join(held.select("project", "check_id", "place"), ["project", "check_id", "place"], "left_anti")
    slots = top_rows(free, ["project", "check_id"], [F.col("place")], most_wrong, "slot").where(
        F.col("slot") <= F.greatest(F.lit(LEAST_OPTIONS) - F.col("n_answers"), F.lit(LEAST_WRONG)))
    # Nearly all questions share the first places.
    first = small_side(cut(pools.where(F.col("place") < furthest), "first_places"))
    return slots.join(first, ["project", "pool", "place"]).select(
        "project", "check_id", F.col("id").alias("option_id"), F.lit(False).alias("is_answer"),
        F.col("slot").cast("int").alias("slot"))


def options(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """All options of every check that has a wrong one; answers have no slot."""
    answer_rows = cut(answers(claims), "answers")
    wrong = cut(wrong_options(answer_rows, option_pools(nodes)), "wrong")
    right = answer_rows.join(wrong.select("project", "check_id"), ["project", "check_id"], "left_semi").select(
        "project", "check_id", "option_id", F.lit(True).alias("is_answer"), F.lit(None).cast("int").alias("slot"))
    return right.unionByName(wrong)


def suites(claims: DataFrame, option_rows: DataFrame) -> DataFrame:
    """One row per usable check, with both voices of its prompt."""
    heads = claims.groupBy("project", "region", "kind", "subject", "check_id").agg(
        F.min("form").alias("form"), F.count("*").alias("n_citations"))
    sizes = option_rows.groupBy("project", "check_id").agg(
        F.count_if("is_answer").alias("n_answers"), F.count("*").alias("n_options"))
    position = F.create_map(*[F.lit(v) for pair in KIND_ORDER.items() for v in pair])[F.col("kind")]
    subject = F.col("subject")
    easy = (
        F.when(F.col("form") == "calls", F.concat(F.lit("What is the first thing that "), subject, F.lit(" calls?")))
        .when(F.col("form") == "imported by", F.concat(F.lit("Which files bring in "), subject, F.lit("?")))
        .when(F.col("form") == "imports", F.concat(F.lit("What does "), subject, F.lit(" bring in first?")))
        .when(F.col("form") == "called by", F.concat(F.lit("What would stop working without "), subject, F.lit("?")))
        .otherwise(F.lit("Where does this program begin?")))
    expert = (
        F.when(F.col("form") == "calls", F.concat(F.lit("First certain callee of "), subject, F.lit("?")))
        .when(F.col("form") == "imported by", F.concat(F.lit("Direct importers of "), subject, F.lit("?")))
        .when(F.col("form") == "imports", F.concat(F.lit("First project import of "), subject, F.lit("?")))
        .when(F.col("form") == "called by", F.concat(F.lit("Direct callers of "), subject, F.lit("?")))
        .otherwise(F.lit("Selected home of this project?")))
    return heads.join(sizes, ["project", "check_id"]).select(
        "project", "region", "kind", position.alias("position"), "subject", "check_id", "n_answers", "n_options",
        "n_citations", F.create_map(F.lit("easy"), easy, F.lit("expert"), expert).alias("prompt"))


def grade(submissions: DataFrame, selections: DataFrame, option_rows: DataFrame) -> DataFrame:
    """Score ``submissions(submission_id, project, check_id)``.

    ``selections(submission_id, option_id)`` holds what was ticked. A submission
    is invalid when nothing or something not offered was ticked, and correct when
    the ticked set equals the answers. One for a check that is not offered is told so.
    """
    ticked = selections.select("submission_id", "option_id").distinct().join(submissions, "submission_id")
    judged = ticked.join(
        option_rows.select("project", "check_id", "option_id", "is_answer"),
        ["project", "check_id", "option_id"], "left"
    ).groupBy("submission_id").agg(
        F.count("*").alias("ticked"), F.count("is_answer").alias("offered"),
        F.count_if("is_answer").alias("right"))
    sizes = option_rows.groupBy("project", "check_id").agg(F.count_if("is_answer").alias("n_answers"))
    scored = submissions.join(sizes, ["project", "check_id"], "left").join(judged, "submission_id", "left")
    invalid = F.col("ticked").isNull() | (F.col("offered") < F.col("ticked"))
    correct = (F.col("right") == F.col("n_answers")) & (F.col("ticked") == F.col("n_answers"))
    return scored.select(
        "submission_id", "project", "check_id",
        F.when(F.col("n_answers").isNull(), "unknown check").when(invalid, "invalid").when(correct, "correct").otherwise("incorrect").alias("outcome"))


def reveal(graded: DataFrame, selections: DataFrame) -> DataFrame:
    """Answers shown to the learner: only after a correct submission.

    A correct selection is the answer set, so it is read back from there.
    """
    return selections.select("submission_id", "option_id").distinct().join(
        graded.where(F.col("outcome") == "correct"), "submission_id"
    ).select("submission_id", "project", "check_id", F.col("option_id").alias("answer"))


def evidence(graded: DataFrame, claims: DataFrame) -> DataFrame:
    """Citations shown with the answers: only after a correct submission."""
    cited = claims.select("project", "check_id", "citation").distinct()
    return graded.where(F.col("outcome") == "correct").join(cited, ["project", "check_id"]).select(
        "submission_id", "project", "check_id", "citation")


def completion(passes: DataFrame, suite_rows: DataFrame) -> DataFrame:
    """``passes(learner_id, project, check_id)`` to regions passed in full."""
    need = suite_rows.groupBy("project", "region").agg(F.count("*").alias("needed"))
    got = passes.distinct().join(suite_rows.select("project", "check_id", "region"), ["project", "check_id"]).groupBy(
        "learner_id", "project", "region").agg(F.count("*").alias("passed"))
    return got.join(need, ["project", "region"]).select(
        "learner_id", "project", "region", "passed", "needed", (F.col("passed") == F.col("needed")).alias("complete"))
