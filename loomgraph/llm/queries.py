"""The registered queries of these operators, over whole tables and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, fingerprints, language_model, lexical_search, licences, line_dedup, mixing, ngram_join, quality, toxicity, urls, whitening, word_bpe
from loomgraph.llm.text import table


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), vocabulary())
    return coded.select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("_size"))
    taken = mixing.taken(docs, [F.col("doc_id"), F.col("_size")])
    return taken.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT doc_id, pos, line,
           trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT doc_id, pos, line, coalesce(last <> doc_id, false) AS gone FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


# Host and path rules come first; pattern rules judge the urls that none of them fits.
HOST_RULES = [
    urls.prefix_rule("org", "/", "allow"),
    urls.prefix_rule("example.org", "/es/", "block"),
    urls.prefix_rule("example.org", "/en/1", "block"),
    urls.prefix_rule("com", "/fr/", "allow"),
    urls.prefix_rule("com", "/de/", "block"),
]
PATTERN_RULES = [
    urls.pattern_rule(text)
    for text in [
        "|spam-farm.", "|casino-*.", "|adult-x.", "|adult-*/", "|free-pills.", "|poker-*.", "|xxx.", "|click-bait.",
        "/banner/*", "/popup/*", "/affiliate/*", "/sponsored/*", "?adurl=", "&clickid=", "/tracker^", "/doorway^",
    ]
]


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = urls.filtered(pages, HOST_RULES + PATTERN_RULES)
    return judged.select(
        "_own.page_id", "host", "path", F.when(F.col("rank") == 1, F.col("rule")).alias("rule"), "verdict",
        F.when(F.col("rank") == 0, F.col("rule")).alias("pattern"),
    )


URL_FILTERS_SQL = r"""
WITH parts AS (
    SELECT page_id,
           CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail
    FROM pages
), split AS (
    SELECT page_id,
           translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path,
           regexp_extract(tail, '^[^?#]*(.*)$', 1, 's') AS rest
    FROM parts
), rules(rule_host, rule_path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
    SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM split JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)
    GROUP BY page_id
), patterns(pattern, expression) AS (
    VALUES -- PATTERNS
), hits AS (
    SELECT page_id, arg_max(pattern, (length(pattern), pattern)) AS pattern
    FROM split JOIN patterns ON regexp_matches(host || path || rest, expression) GROUP BY page_id
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN fits.verdict WHEN hits.pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN hits.pattern END AS pattern
FROM split LEFT JOIN fits USING (page_id) LEFT JOIN hits USING (page_id)
""".replace("-- PATTERNS", ", ".join(f"('{r.name}', '{r.pattern}')" for r in PATTERN_RULES))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, out = table(spark, folder, "documents").select("doc_id", "text"), toxicity.held_out(F.col("doc_id"))
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(~out)
    scored = toxicity.scores(docs, toxicity.fit(docs.where(~out), labels))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_licence_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("_own.doc_id", "licence", F.array_join("notices", ",").alias("notices"))


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return language_model.scored(docs, language_model.held_out(F.col("doc_id")), tokenizer("byte_bpe_50k.tiktoken"))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(table(spark, folder, "documents").select("doc_id", "text"))


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, folder, "documents").select("doc_id", "text"))


NGRAM_JOIN_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), links AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM shingles x JOIN shingles y ON x.s = y.s JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a
)
SELECT doc_id, n AS n_shingles, component_id
FROM sizes JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return lexical_search.search(docs.select("doc_id", "text"), items.select("item_id", "text"))


LEXICAL_SEARCH_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), asked AS (
    SELECT item_id, term, count(*) AS times
    FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY item_id, term
), sizes AS (
    SELECT doc_id, count(*)::BIGINT AS n FROM words GROUP BY doc_id
), total AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes
), lengths AS (
    SELECT doc_id, 100 - 75 + ((75 * n * docs) // terms) AS m FROM sizes, total
), held AS (
    SELECT doc_id, term, count(*)::BIGINT AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
    SELECT term, floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE)))::BIGINT AS w FROM held, total GROUP BY term, docs
), scores AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op12_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = word_bpe.encode(docs, word_bpe.Vocabulary(tokenizer("word_bpe_49k.json")))
    return coded.select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filters": op5_url_filters,
    "op6_toxicity": op6_toxicity,
    "op7_licence_scans": op7_licence_scans,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_fingerprints": op9_fingerprints,
    "op10_ngram_join": op10_ngram_join,
    "op11_lexical_search": op11_lexical_search,
    "op12_word_bpe": op12_word_bpe,
    "op13_whitening": op13_whitening,
}
SQL = {"op3_line_dedup": LINE_DEDUP_SQL, "op5_url_filters": URL_FILTERS_SQL, "op10_ngram_join": NGRAM_JOIN_SQL, "op11_lexical_search": LEXICAL_SEARCH_SQL}
