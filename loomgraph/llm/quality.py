"""Quality rules (4): rules vote or abstain; expectation-maximisation weighs the votes.

Every rule looks at one measure of a text and says good, bad or nothing. How
often a rule says each of these on good and on bad texts is not given but
estimated: distinct texts that pass the base test are counted by their vector of
votes (at most 3 to the number of rules), and expectation-maximisation runs over
that bounded table inside one expression. The posterior probability of good
decides. Copies and texts that the base test rejects anyway would make a class of
their own.

Defined cases: a null or empty text has no words and fails the base test; rows
with equal texts get equal verdicts; without a text that passes the base test all
are as likely good as bad; columns of the input are not touched; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.text import count_of, whole, words
from loomgraph.session import cut

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
ABSTAIN, GOOD, BAD = 0, 1, 2
ROUNDS = 25
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_distinct", "n_symbol_runs"]


def measured(docs: DataFrame) -> DataFrame:
    """The documents with the measures of ``MEASURES`` (long) in one struct ``_m``.

    Repeated 3-word windows are found by sorting the windows' 64-bit hashes
    within the text; the sort is skipped where no hash repeats.
    """
    w, h, runs, at = (F.col(c) for c in ("_w", "_h", "_runs", "_at"))
    text = whole(F.col("text"))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    steps = docs.withColumn("_w", words(F.col("text"))).withColumn("_lines", lines)
    steps = steps.withColumn(
        "_h",
        F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])),
        ),
    )
    steps = steps.withColumn(
        "_runs",
        F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ),
    )
    same = lambda e, k: F.coalesce(F.get(runs, k)["x"] == e["x"], F.lit(False))
    steps = steps.withColumn(
        "_at",
        F.sort_array(F.transform(F.filter(runs, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"])),
    )
    covered = F.aggregate(
        F.transform(at, lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get(at, k - 1)))),
        F.lit(0),
        lambda total, step: total + step,
    )
    measures = {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")),
        "n_symbols": count_of(text, SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("_lines"),
        "n_capitals": count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_marks": count_of(text, "!?"),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_symbol_runs": F.regexp_count(text, F.lit(r"[#*$%&|<>]+")),
    }
    packed = F.struct(*[value.cast("long").alias(name) for name, value in measures.items()])
    # The generator keeps the optimiser from copying each measure into every place that reads it.
    return steps.select(*docs.columns, F.explode(F.array(packed)).alias("_m"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _votes(m: Column) -> list[Column]:
    """One vote per rule. Between its two thresholds, or on too little text, a rule abstains.

    Two rules at least look for each kind of junk, as one bad vote among good ones should not decide.
    """

    def share(part: str, of: str) -> Column:
        return m[part] / F.greatest(m[of], F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    chars, symbols, again = share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_repeat_words", "n_words")
    capitals, marks, twice = share("n_capitals", "word_chars"), share("n_marks", "n_words"), share("n_dup_lines", "n_lines")
    variety = m["n_distinct"] / F.sqrt(F.greatest(m["n_words"], F.lit(1)))
    return [
        vote(symbols > 0.1, symbols < 0.02),
        vote(again > 0.5, again < 0.25),
        vote((twice > 0.3) & (m["n_lines"] >= 4), (twice < 0.1) & (m["n_lines"] >= 4)),
        vote(capitals > 0.5, capitals < 0.15),
        vote(marks > 0.3, marks < 0.1),
        vote((chars < 2) | (chars > 14), (chars > 3) & (chars < 10)),
        vote((variety < 2) & (m["n_words"] >= 50), variety > 4),
        vote(share("n_symbol_runs", "n_words") > 0.1, share("n_symbol_runs", "n_words") < 0.02),
    ]


RULES = 8


def vote_code(m: Column) -> Column:
    """The vector of votes as one number in base three."""
    code = F.lit(0)
    for rule, vote in enumerate(_votes(m)):
        code = code + vote * 3**rule
    return code.cast("int")


def counted(measures: DataFrame) -> DataFrame:
    """``code, n``: every vector of votes of rows with ``_m`` and ``_text`` (hash), and its number of distinct texts that pass the base test."""
    texts = measures.select(vote_code(F.col("_m")).alias("code"), base_failed(F.col("_m")).alias("failed"), "_text").distinct()
    return texts.groupBy("code").agg(F.count_if(~F.col("failed")).alias("n"))


def posteriors(codes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``code, p_good`` for every vector of votes that occurs in column ``code``, each row counting once."""
    return estimated(codes.groupBy("code").agg(F.count("*").alias("n")), rounds)


def estimated(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``code, p_good`` for every row ``code, n``; one with n = 0 is judged by what the others teach.

    ``theta`` holds, for good and then for bad texts, each rule's chances of the
    three votes. A step with an odd number works out the posteriors from it, an
    even one estimates it and the prior from the posteriors. A text with a bad
    vote starts as likely bad, any other as likely good.
    """
    seen = counts.agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("seen")).where("size(seen) > 0")
    votes = f"transform(seen, s -> transform(sequence(0, {RULES - 1}), j -> cast(s.code div cast(pow(3, j) as int) % 3 as int)))"
    table = seen.selectExpr("seen", f"{votes} as v").selectExpr(
        "seen", "v", f"transform(v, x -> if(array_contains(x, {BAD}), 0.1D, 0.9D)) as start"
    )
    odds = (
        f"aggregate(sequence(0, {RULES - 1}), ln(s.prior / (1 - s.prior)), (sum, j) -> sum "
        f"+ ln(s.theta[j * 3 + x[j]]) - ln(s.theta[{3 * RULES} + j * 3 + x[j]]))"
    )
    weight = f"seen[k].n * if(c < {3 * RULES}, s.q[k], 1 - s.q[k])"
    ks = "sequence(0, size(seen) - 1)"
    hits = f"aggregate({ks}, 1D, (sum, k) -> sum + if(v[k][(c % {3 * RULES}) div 3] = c % 3, {weight}, 0D))"
    total = f"aggregate({ks}, 3D, (sum, k) -> sum + {weight})"
    prior = (
        f"aggregate({ks}, 1D, (sum, k) -> sum + seen[k].n * s.q[k]) / "
        f"aggregate({ks}, 2D, (sum, k) -> sum + seen[k].n)"
    )
    estimate = f"transform(sequence(0, {6 * RULES - 1}), c -> {hits} / {total})"
    model = table.selectExpr(
        "seen",
        f"aggregate(sequence(0, {2 * rounds}), "
        "named_struct('q', start, 'theta', cast(array() as array<double>), 'prior', 0.5D), (s, i) -> if(i % 2 = 1, "
        f"named_struct('q', transform(v, x -> 1 / (1 + exp(-({odds})))), 'theta', s.theta, 'prior', s.prior), "
        f"named_struct('q', s.q, 'theta', {estimate}, 'prior', {prior}))).q as q",
    )
    return model.selectExpr("inline(arrays_zip(seen, q))").selectExpr("seen.code as code", "q as p_good")


def judged(measures: DataFrame, p_good: DataFrame) -> DataFrame:
    """Rows with ``_m`` get ``p_good, base_failed, kept``.

    ``p_good`` has a row per vector of votes, at most 3 to the power of the number of rules, and is broadcast.
    """
    coded = measures.withColumn("code", vote_code(F.col("_m"))).join(F.broadcast(p_good), "code").drop("code")
    failed = base_failed(F.col("_m"))
    return coded.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= 0.5))


def score(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measures, ``p_good``, ``base_failed`` and ``kept`` of every document."""
    measures = cut(measured(docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))).select("doc_id", "_text", "_m"), "measures")
    p_good = estimated(counted(measures))
    return judged(measures, p_good).select("doc_id", "_m.*", "p_good", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, whole and with their own columns.

    Texts are measured once: those that pass the base test are written with their votes, and never shuffled.
    """
    m = F.col("_m")
    shut = measured(docs.select(F.struct("*").alias("_own"), "text", F.xxhash64("text").alias("_text")))
    passed = cut(shut.where(~base_failed(m)).select("_own", "_text", vote_code(m).alias("code")), "passed")
    p_good = estimated(passed.select("code", "_text").distinct().groupBy("code").agg(F.count("*").alias("n")))
    # As in ``judged``: a row per vector of votes.
    return passed.join(F.broadcast(p_good), "code").where("p_good >= 0.5").select("_own.*")
