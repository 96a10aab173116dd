"""Queries s1 to s8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans import views
from loomgraph.plans.oracle_base import NODES, with_tables
from loomgraph.plans.warehouse import Warehouse
from loomgraph.session import scratch_path
from loomgraph.sources import corpus as ops
from loomgraph.sources import tree
from loomgraph.sources.sink import canonical_json


def s1_corpus_scan(spark: SparkSession, folder: str) -> DataFrame:
    return ops.scan_table(views.document_files(spark, folder)).select(
        "project", "path", "ext", F.octet_length("content").alias("bytes"))


def s1_scan_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The documents written out as trees of files, and read back with what the ignore rules leave."""
    written = tree.write_tree(Warehouse(spark, folder).documents, scratch_path(spark, "trees"))
    return ops.scan_roots(written).select(
        "project", "path", "ext", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    return ops.keep_readable(Warehouse(spark, folder).documents)


def s2_ignore_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder).select("project", "path")


def s3_ownership(spark: SparkSession, folder: str) -> DataFrame:
    return ops.ownership(_kept(spark, folder)).select("project", "path", "language")


def s4_unsupported_tally(spark: SparkSession, folder: str) -> DataFrame:
    return ops.unsupported_tally(_kept(spark, folder))


def s5_scope_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ops.scope_counts(ops.ownership(_kept(spark, folder)))


def s6_file_hash(spark: SparkSession, folder: str) -> DataFrame:
    return ops.file_hash(Warehouse(spark, folder).documents)


def s7_decode_lines(spark: SparkSession, folder: str) -> DataFrame:
    return ops.decode_lines(Warehouse(spark, folder).documents)


def s7_module_loc(spark: SparkSession, folder: str) -> DataFrame:
    files = Warehouse(spark, folder).documents
    return ops.module_loc(ops.decode_lines(files), files)


def s8_canonical_json(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_json(Warehouse(spark, folder).nodes).select("project", "id", "json")


QUERIES = {
    "s1_corpus_scan": s1_corpus_scan,
    "s1_scan_tree": s1_scan_tree,
    "s2_ignore_filter": s2_ignore_filter,
    "s3_ownership": s3_ownership,
    "s4_unsupported_tally": s4_unsupported_tally,
    "s5_scope_counts": s5_scope_counts,
    "s6_file_hash": s6_file_hash,
    "s7_decode_lines": s7_decode_lines,
    "s7_module_loc": s7_module_loc,
    "s8_canonical_json": s8_canonical_json,
}

_RULES = r"# kept short\n*_1?.go\ngen/\n!src/gen/en_2.py\ndocs/*\n/src/keep/deep\n*.txt\n!fr_*.txt\n"

DOCUMENTS = f"""
docs AS MATERIALIZED (
  SELECT source AS project, dir, dir || lang || '_' || doc_id || e AS path, lower(e) AS ext, lang, doc_id, text FROM (
    SELECT *, ['', 'src/', 'src/gen/', 'node_modules/x/', '.cache/', 'vendor/', 'docs/old/', 'build/', 'src/keep/deep/'][doc_id % 9 + 1] AS dir,
      ['.py', '.ts', '.go', '.java', '.rs', '.cs', '.jsx', '.c', '.h', '.txt', '.kt', '.PY'][(doc_id // 9) % 12 + 1] AS e
    FROM documents)
  UNION ALL
  SELECT DISTINCT source, '', '.gitignore', '', '', -1, replace('{_RULES}', '\\n', chr(10)) FROM documents),
kept AS MATERIALIZED (SELECT * FROM docs WHERE dir IN ('', 'src/', 'vendor/', 'build/')
  AND NOT (ext = '.go' AND regexp_matches(path, '_1.\\.go$')) AND NOT (ext = '.txt' AND lang <> 'fr')),
owned AS MATERIALIZED (SELECT project, dir, path, CASE ext WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.jsx' THEN 'javascript'
    WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' WHEN '.rs' THEN 'rust' WHEN '.cs' THEN 'csharp' END AS language
  FROM kept WHERE ext IN ('.py', '.ts', '.go', '.java', '.rs', '.cs', '.jsx')
  AND NOT (dir = 'vendor/' AND ext = '.go') AND NOT (dir = 'build/' AND ext IN ('.ts', '.jsx', '.java')))"""

LINES = """
pieces AS (SELECT project, path, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM (
  SELECT project, path, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS p FROM docs)),
lines AS MATERIALIZED (SELECT project, path, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS lineno, unnest(p) AS text FROM pieces)"""

_D = with_tables(DOCUMENTS)

SQL = {
    "s1_corpus_scan": _D + "SELECT project, path, ext, CAST(octet_length(encode(text)) AS INTEGER) AS bytes FROM docs",
    "s1_scan_tree": _D + """SELECT k.project, k.path, k.ext, CAST(octet_length(encode(d.text)) AS INTEGER) AS bytes, sha256(d.text) AS sha256
      FROM kept k JOIN docs d ON d.project = k.project AND d.path = k.path""",
    "s2_ignore_filter": _D + "SELECT project, path FROM kept",
    "s3_ownership": _D + "SELECT project, path, language FROM owned",
    "s4_unsupported_tally": _D + """
      SELECT project, ext, CASE ext WHEN '.c' THEN 'C' WHEN '.kt' THEN 'Kotlin' END AS language, count(*) AS count
      FROM kept WHERE ext IN ('.c', '.h', '.kt') GROUP BY ALL""",
    "s5_scope_counts": _D + """
      SELECT project, scope, files, CAST(place AS INTEGER) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY project ORDER BY files DESC, scope) AS place FROM (
          SELECT project, CASE WHEN dir = '' THEN '.' ELSE split_part(dir, '/', 1) END AS scope, count(*) AS files
          FROM owned GROUP BY ALL)) WHERE place <= 6""",
    "s6_file_hash": _D + "SELECT project, path, sha256(text) AS sha256 FROM docs",
    "s7_decode_lines": with_tables(DOCUMENTS, LINES) + "SELECT * FROM lines",
    "s7_module_loc": with_tables(DOCUMENTS, LINES) + """
      SELECT d.project, d.path, greatest(count(l.lineno), 1) AS loc FROM docs d
      LEFT JOIN lines l ON l.project = d.project AND l.path = d.path GROUP BY ALL""",
    "s8_canonical_json": with_tables(NODES) + """
      SELECT project, id, CAST(to_json({'end_lineno': end_lineno, 'entrypoint_rank': entrypoint_rank, 'file': file, 'id': id,
        'kind': kind, 'language': language, 'lineno': lineno, 'loc': loc, 'name': name, 'partial': partial, 'project': project,
        'region': region}) AS VARCHAR) AS json FROM nodes""",
}
