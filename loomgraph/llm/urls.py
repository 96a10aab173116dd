"""URL filters (5): rules are found by their rarest literal token.

A rule has a regular expression, a verdict and the literal tokens without which
it cannot match. It is indexed under the one of its tokens that fewest urls
hold; the tokens of a url then fetch candidate rules, and only those run their
expressions. A rule without a token is a candidate for every url. Of the rules
that match, the longest wins.

Distinct urls are judged once. The rules are a parameter; up to ``SMALL_RULES``
of them their index is broadcast, beyond that the join on tokens is salted, as
a single token may be in a third of all urls.

Defined cases: a null url, or one without ``://``, has empty host and path and
matches only rules without tokens; repeated rows get the same verdict; of rules
with equal length and place the blocking one wins, then the smaller name; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.text import lower_ascii, whole
from loomgraph.session import cut

SMALL_RULES = 10_000
SALTS = 64
TOKEN = r"[0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host + path + rest; ``tokens`` are whole tokens that every match holds.

    ``rank`` goes before length: rules of a higher rank win over all of a lower one.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with its subdomains and all paths that start with ``path``."""
    pattern = r"^(?:[^/?#]*\.)?" + re.escape(host) + re.escape(path)
    # The path's last token may go on in the url, so it counts only if the rule itself ends it.
    tokens = re.findall(TOKEN, host) + re.findall(TOKEN + r"(?=[^0-9A-Za-z])", path)
    return Rule(host + path, verdict, pattern, tuple(tokens), 1)


def pattern_rule(text: str, verdict: str = "block") -> Rule:
    """A rule in the manner of filter lists: ``*`` is anything, ``^`` a separator or the end, ``|`` the start of a host's label."""
    special = {"*": ".*", "^": r"(?:[^0-9A-Za-z.%_-]|$)", "|": r"^(?:[^/?#]*\.)?"}
    pattern = "".join(special.get(c, re.escape(c)) for c in text)
    safe = re.findall(r"(?<=[^0-9A-Za-z*])" + TOKEN + r"(?=[^0-9A-Za-z*])", text)
    return Rule(text, verdict, pattern, tuple(safe))


def parts(url: Column) -> dict[str, Column]:
    """``host`` (A-Z lower-cased), ``path``, and ``rest`` of a url from its query or fragment on."""
    get = lambda group: F.regexp_extract(whole(url), r"^(?s:.*?)://([^/?#]*)([^?#]*)(?s:(.*))$", group)
    return {"host": lower_ascii(get(1)), "path": get(2), "rest": get(3)}


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.name, r.verdict, r.pattern, list(r.tokens), r.rank) for r in rules]
    return spark.createDataFrame(rows, "rule string, verdict string, pattern string, tokens array<string>, rank int")


def judge(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``url, host, path, rule, verdict, rank``: the winning rule of each distinct url, null where none matches."""
    spark = urls.sparkSession
    subject = F.concat("host", "path", "rest")
    tokens = F.array_distinct(F.regexp_extract_all(subject, F.lit(TOKEN), F.lit(0)))
    distinct = cut(urls.select("url").distinct().select("url", *[c.alias(n) for n, c in parts(F.col("url")).items()]), "urls")
    seen = distinct.select("url", subject.alias("subject"), F.explode(F.array_append(tokens, "")).alias("token"))
    table = rule_table(spark, rules)
    wanted = table.select("rule", F.explode("tokens").alias("token"))
    frequency = seen.join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi") if len(rules) <= SMALL_RULES else seen
    counted = frequency.groupBy("token").agg(F.count("*").alias("urls"))
    rarest = (
        wanted.join(counted, "token", "left")
        .groupBy("rule")
        .agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    )
    index = table.drop("tokens").join(rarest, "rule", "left").withColumn("token", F.coalesce("token", F.lit("")))
    if len(rules) <= SMALL_RULES:
        candidates = seen.join(F.broadcast(index), "token")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        candidates = seen.withColumn("salt", F.pmod(F.hash("url"), F.lit(SALTS))).join(salted, ["token", "salt"])
    fits = candidates.where(F.expr("regexp(subject, pattern)"))
    best = F.max_by(F.struct("rule", "verdict", "rank"), F.struct("rank", F.length("rule"), F.col("verdict") == "block", "rule"))
    won = fits.groupBy("url").agg(best.alias("won"))
    match = F.col("d.url").eqNullSafe(F.col("w.url"))
    return distinct.alias("d").join(won.alias("w"), match, "left").select("d.url", "host", "path", "won.*")


def filtered(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """The pages' own columns packed in ``_own``, with ``host, path, rule, verdict, rank``."""
    judged = judge(pages, rules)
    shut = pages.select(F.struct("*").alias("_own"), "url")
    joined = shut.alias("p").join(judged.alias("j"), F.col("p.url").eqNullSafe(F.col("j.url")), "left")
    return joined.select("_own", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), "rank")
