"""Queries t1 to t7 and the streamed p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import study as ops
from loomgraph.operators.notes import _TEXT
from loomgraph.plans import views
from loomgraph.plans.oracle_base import CONCEPT_ROWS, EDGES, FILES, NODES, PROGRESS, SIGNATURES, with_tables
from loomgraph.plans.queries.sources import DOCUMENTS, LINES
from loomgraph.plans.warehouse import Warehouse
from loomgraph.session import scratch_path
from loomgraph.streaming import progress as stream_ops

PROVIDER, MODEL = "local", "small"


def t1_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.neighbors(w.nodes, w.raw_edges)


def _spans(w: Warehouse) -> DataFrame:
    """Three spans per document: its head, all of it, and a late part."""
    lengths = w.lines.groupBy("project", F.col("path").alias("file")).agg(F.max("lineno").alias("n"))
    spans = [("#head", 1, F.lit(12)), ("#body", 1, F.coalesce("n", F.lit(1))), ("#tail", 300, F.lit(320))]
    files = w.documents.select("project", F.col("path").alias("file")).join(lengths, ["project", "file"], "left")
    return files.select("project", "file", F.explode(F.array(*[
        F.struct(F.lit(t).alias("tail"), F.lit(a).alias("lineno"), b.cast("int").alias("end_lineno")) for t, a, b in spans])).alias("s")
    ).select("project", F.concat("file", "s.tail").alias("id"), "file", "s.lineno", "s.end_lineno")


def _span_rows(w: Warehouse) -> DataFrame:
    return ops.source_span(_spans(w), w.lines)


def t2_source_span(spark: SparkSession, folder: str) -> DataFrame:
    return _span_rows(Warehouse(spark, folder))


def t3_lens_join(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.lens_join(w.concepts, w.nodes)


def t4_structural_summary(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return ops.structural_summary(w.nodes, w.neighbors, w.lens)


def t5_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    return ops.excerpts(_span_rows(Warehouse(spark, folder)))


def t5_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """Source lines of the document spans, evidence lines of the graph nodes."""
    w = Warehouse(spark, folder)
    return ops.prompt_lines(_span_rows(w), w.neighbors, w.lens)


def t6_pending_work(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes with a concept already have a ready easy explanation."""
    w = Warehouse(spark, folder)
    noted = w.concepts.select("project", F.col("node_id").alias("id")).distinct()
    done = w.nodes.join(noted, ["project", "id"], "left_semi").join(w.files.select("project", "file", "sha256"), ["project", "file"])
    ready = done.select(ops.cache_key(PROVIDER, MODEL, F.lit("easy")).alias("cache_key"))
    return ops.pending_work(w.nodes, w.files, ready, PROVIDER, MODEL, ["easy", "expert"])


def responses(w: Warehouse) -> tuple[DataFrame, DataFrame]:
    """One generated text per node, of eleven kinds by the hash of its id."""
    linked = w.neighbors.groupBy("project", F.col("node").alias("id")).agg(F.min("neighbor").alias("nb"))
    rows = w.nodes.join(linked, ["project", "id"], "left")
    kind = F.conv(F.substring(F.sha2("id", 256), 1, 2), 16, 10).cast("int") % 11


    def say(*parts: F.Column | str) -> F.Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    at, end = F.col("lineno"), F.col("end_lineno") + 1
    ten: list = []
    for n in range(10):
        ten += [", " if n else "", '{"line": ', at, f', "explanation": "i{n}"}}']
    texts = [
        say("oops {"), say('```json\n{"summary": "ok ', F.col("id"), '"}\n```'), say('{"summary": "   "}'),
        say('{"summary": "s", "walkthrough": [{"line": ', end, ', "explanation": "x"}]}'),
        say('{"summary": "s", "relationships": [{"node_id": "ghost", "explanation": "x"}]}'),
        say('{"summary": "s", "walkthrough": [{"line": ', at, ', "explanation": ""}, {"line": ', at, ', "explanation": " fine "}]}'),
        say('{"summary": "s", "walkthrough": "none"}'), say('{"summary": "s", "walkthrough": [{"line": "1", "explanation": "x"}]}'),
        F.coalesce(say('{"summary": "s", "relationships": [{"node_id": "', F.col("nb"), '", "explanation": "link"}]}'), say('{"summary": "s"}')),
        say('{"summary": "s", "walkthrough": [', *ten, "]}"), say('{"summary": "  padded ", "walkthrough": null, "relationships": 5}')]
    raw = F.element_at(F.array(*texts), kind + 1)
    made = rows.select(F.concat_ws("/", "project", "id").alias("response_id"), "project", F.col("id").alias("node"), raw.alias("raw"))
    excerpt = w.nodes.select("project", "id", "file", F.col("lineno").alias("first"),
                             F.least(F.col("end_lineno"), F.col("lineno") + ops.EXCERPT_LINES - 1).alias("last"),
                             (F.col("end_lineno") - F.col("lineno") + 1).alias("total"),
                             (F.col("end_lineno") - F.col("lineno") + 1 > ops.EXCERPT_LINES).alias("truncated"))
    return made, excerpt


def _ground(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    w = Warehouse(spark, folder)
    made, excerpt = responses(w)
    return ops.ground(w.stored("responses", lambda: made), excerpt, w.neighbors, w.nodes)


def t7_ground_responses(spark: SparkSession, folder: str) -> DataFrame:
    return _ground(spark, folder)[0]


def t7_walkthrough(spark: SparkSession, folder: str) -> DataFrame:
    return _ground(spark, folder)[1]


def t7_relationships(spark: SparkSession, folder: str) -> DataFrame:
    return _ground(spark, folder)[2]


def p8_progress_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The whole events table read as a stream, then the live view of it."""
    w = Warehouse(spark, folder)
    raw = spark.readStream.schema(views.table(spark, folder, "events").schema).option(
        "pathGlobFilter", "events.parquet").parquet(folder)
    checkpoint = scratch_path(spark, "progress")
    stream_ops.run(views.progress_events(spark, folder, w.signatures, raw), checkpoint).awaitTermination()
    return stream_ops.view(stream_ops.read_state(spark, checkpoint), w.signatures, w.outline)


QUERIES = {
    "t1_neighbors": t1_neighbors,
    "t2_source_span": t2_source_span,
    "t3_lens_join": t3_lens_join,
    "t4_structural_summary": t4_structural_summary,
    "t5_excerpt": t5_excerpt,
    "t5_prompt": t5_prompt,
    "t6_pending_work": t6_pending_work,
    "t7_ground_responses": t7_ground_responses,
    "t7_walkthrough": t7_walkthrough,
    "t7_relationships": t7_relationships,
    "p8_progress_stream": p8_progress_stream,
}


def _note_values() -> str:
    """The notes table as SQL rows."""
    rows, languages = [], []
    for line in _TEXT.strip().splitlines():
        parts = [p.strip().replace("'", "''") for p in line.split("|")]
        if len(parts) == 1:
            languages = line.split()
        else:
            rows += ["('" + "', '".join([language, *parts]) + "')" for language in languages]
    return "notes(language, concept, title, easy, expert) AS (VALUES " + ", ".join(rows) + ")"


_NEIGHBORS = """
near AS MATERIALIZED (SELECT o.project, o.node, o.neighbor, o.direction, o.w.kind AS relationship, o.w.certain AS certain,
    o.w.lineno AS observed_line, m.file || ':' || m.lineno AS citation
  FROM (SELECT project, node, neighbor, direction, min({'lineno': lineno, 'kind': kind, 'certain': certain}) AS w FROM (
      SELECT project, src AS node, dst AS neighbor, 'outbound' AS direction, lineno, kind, certain FROM edges WHERE NOT external
      UNION ALL SELECT project, dst, src, 'inbound', lineno, kind, certain FROM edges WHERE src <> dst) GROUP BY ALL) o
  JOIN nodes n ON n.project = o.project AND n.id = o.node JOIN nodes m ON m.project = o.project AND m.id = o.neighbor)"""

_LENS = "\n" + _note_values() + """,
lens AS MATERIALIZED (SELECT c.project, c.node_id, c.language, c.concept, title, easy, expert, c.lineno, c.end_lineno, c.snippet,
    n.file || ':' || c.lineno AS citation
  FROM concepts c JOIN notes t ON t.language = c.language AND t.concept = c.concept
  JOIN nodes n ON n.project = c.project AND n.id = c.node_id AND n.language = c.language)"""

_SPANS = """
spans AS MATERIALIZED (SELECT d.project, d.path || t AS id, d.path AS file, a AS first, CAST(least(coalesce(b, s.size), s.size) AS INTEGER) AS last
  FROM docs d CROSS JOIN (VALUES ('#head', 1, 12), ('#body', 1, NULL), ('#tail', 300, 320)) v(t, a, b)
  JOIN (SELECT project, path, max(lineno) AS size FROM lines GROUP BY ALL) s ON s.project = d.project AND s.path = d.path
  WHERE a <= s.size),
span_rows AS MATERIALIZED (SELECT s.project, s.id, s.file, s.first, s.last, l.lineno AS number, l.text FROM spans s
  JOIN lines l ON l.project = s.project AND l.path = s.file AND l.lineno BETWEEN s.first AND s.last)"""

_KEYS = """
keys AS MATERIALIZED (SELECT n.project, n.id, m AS mode,
    sha256('study-v4' || chr(0) || 'local' || chr(0) || 'small' || chr(0) || n.id || chr(0) || sha256(n.project || '/' || n.file) || chr(0) || m) AS cache_key,
    n.partial FROM nodes n CROSS JOIN (VALUES ('easy'), ('expert')) v(m))"""

_VERDICTS = """
made AS MATERIALIZED (SELECT n.project || '/' || n.id AS response_id, n.project, n.id AS node, n.file, n.lineno, n.end_lineno,
    CAST('0x' || substr(sha256(n.id), 1, 2) AS INTEGER) % 11 AS k, b.nb
  FROM nodes n LEFT JOIN (SELECT project, node, min(neighbor) AS nb FROM near GROUP BY ALL) b ON b.project = n.project AND b.node = n.id)"""

_WORDS = "['no','one','two','three','four','five','six','seven','eight','nine','ten']"


def _word(number: str) -> str:
    return f"CASE WHEN {number} < 11 THEN {_WORDS}[{number} + 1] ELSE CAST({number} AS VARCHAR) END"


_GRAPH = with_tables(NODES, EDGES, _NEIGHBORS)

SQL = {
    "t1_neighbors": _GRAPH + "SELECT * FROM near",
    "t2_source_span": with_tables(DOCUMENTS, LINES, _SPANS) + "SELECT * FROM span_rows",
    "t3_lens_join": with_tables(NODES, CONCEPT_ROWS, _LENS) + "SELECT * FROM lens",
    "t4_structural_summary": with_tables(NODES, EDGES, _NEIGHBORS, CONCEPT_ROWS, _LENS) + f"""
      SELECT project, id, concat_ws(' ', name || ' is a ' || CASE kind WHEN 'module' THEN 'file' ELSE kind END || ' in ' || file
          || ' at line ' || lineno || '.',
        'Length: ' || loc || CASE WHEN loc = 1 THEN ' line.' ELSE ' lines.' END,
        CASE WHEN imp + cal = 0 THEN 'Nothing here depends on it yet.' ELSE 'Used: ' || concat_ws(' and ',
          CASE WHEN imp > 0 THEN {_word('imp')} || CASE WHEN imp = 1 THEN ' file imports' ELSE ' files import' END || ' it' END,
          CASE WHEN cal > 0 THEN {_word('cal')} || CASE WHEN cal = 1 THEN ' place calls' ELSE ' places call' END || ' it' END) || '.' END,
        'It relies on ' || {_word('uses')} || CASE WHEN uses = 1 THEN ' part' ELSE ' parts' END || ' of this code.',
        CASE WHEN pos > 0 THEN {_word('pos')} || CASE WHEN pos = 1 THEN ' link is' ELSE ' links are' END || ' only possible.' END,
        'Ideas: ' || titles || '.', CASE WHEN partial THEN 'The file did not parse fully.' END) AS easy,
      concat_ws(' ', kind || ' ' || name || ', ' || file || ':' || lineno || '-' || end_lineno || '.',
        (imp + cal) || ' in, ' || uses || ' out, ' || pos || ' unproven.', 'Concepts: ' || concepts || '.',
        CASE WHEN partial THEN 'Partial parse.' END) AS expert
      FROM (SELECT n.*, coalesce(c.imp, 0) AS imp, coalesce(c.cal, 0) AS cal, coalesce(c.uses, 0) AS uses, coalesce(c.pos, 0) AS pos,
          i.titles, i.concepts
        FROM nodes n LEFT JOIN (SELECT project, node, count(*) FILTER (direction = 'inbound' AND relationship = 'import') AS imp,
            count(*) FILTER (direction = 'inbound' AND relationship = 'call') AS cal, count(*) FILTER (direction = 'outbound') AS uses,
            count(*) FILTER (NOT certain) AS pos FROM near GROUP BY ALL) c ON c.project = n.project AND c.node = n.id
        LEFT JOIN (SELECT project, node_id, string_agg(DISTINCT title, ', ' ORDER BY title) AS titles,
            string_agg(DISTINCT concept, ', ' ORDER BY concept) AS concepts FROM lens GROUP BY ALL) i
          ON i.project = n.project AND i.node_id = n.id)""",
    "t5_excerpt": with_tables(DOCUMENTS, LINES, _SPANS) + """
      SELECT project, id, file, first, CAST(least(last, first + 199) AS INTEGER) AS last, CAST(last - first + 1 AS INTEGER) AS total,
        last - first + 1 > 200 AS truncated FROM spans""",
    "t5_prompt": with_tables(NODES, EDGES, _NEIGHBORS, CONCEPT_ROWS, _LENS, DOCUMENTS, LINES, _SPANS) + """
      SELECT project, id, 1 AS section, lpad(CAST(number AS VARCHAR), 10, '0') AS position,
        CASE WHEN number < 1000 THEN lpad(CAST(number AS VARCHAR), 4, '0') ELSE CAST(number AS VARCHAR) END || ': ' || text AS line
      FROM span_rows WHERE number < first + 200
      UNION ALL SELECT project, node, 2, neighbor || ' ' || direction,
        '- ' || neighbor || ' (' || relationship || ', ' || CASE WHEN certain THEN 'certain' ELSE 'possible' END || ') at ' || citation FROM near
      UNION ALL SELECT project, node_id, 3, lpad(CAST(lineno AS VARCHAR), 10, '0') || ' ' || concept || ' ' || lpad(CAST(end_lineno AS VARCHAR), 10, '0'),
        '- ' || concept || ' at ' || citation || ': ' || snippet FROM lens""",
    "t6_pending_work": with_tables(NODES, FILES, CONCEPT_ROWS, _KEYS) + """
      SELECT project, id, mode, cache_key FROM keys k WHERE NOT partial AND NOT (mode = 'easy' AND EXISTS (
        SELECT 1 FROM concepts c JOIN keys d ON d.project = c.project AND d.id = c.node_id AND d.mode = 'easy'
        WHERE d.cache_key = k.cache_key))""",
    "t7_ground_responses": with_tables(NODES, EDGES, _NEIGHBORS, _VERDICTS) + """
      SELECT response_id, project, node, reason,
        CASE WHEN reason IS NULL THEN CASE k WHEN 1 THEN 'ok ' || node WHEN 10 THEN 'padded' ELSE 's' END END AS summary,
        CASE WHEN reason IS NULL THEN CASE WHEN k IN (5, 6, 7, 10) THEN CAST(1 AS BIGINT) ELSE 0 END END AS withheld,
        CASE WHEN reason IS NULL THEN file || ':' || lineno END AS citation, CASE WHEN reason IS NULL THEN lineno END AS first,
        CASE WHEN reason IS NULL THEN CAST(least(end_lineno, lineno + 199) AS INTEGER) END AS last,
        CASE WHEN reason IS NULL THEN CAST(end_lineno - lineno + 1 AS INTEGER) END AS total,
        CASE WHEN reason IS NULL THEN end_lineno - lineno + 1 > 200 END AS truncated
      FROM (SELECT *, CASE k WHEN 0 THEN 'not a JSON object' WHEN 2 THEN 'no usable summary' WHEN 3 THEN 'line outside the excerpt'
        WHEN 4 THEN 'unknown neighbor' END AS reason FROM made)""",
    "t7_walkthrough": with_tables(NODES, EDGES, _NEIGHBORS, _VERDICTS) + """
      SELECT response_id, CAST(1 AS INTEGER) AS n, CAST(lineno AS BIGINT) AS line, file || ':' || lineno AS citation, 'fine' AS text
      FROM made WHERE k = 5
      UNION ALL SELECT response_id, CAST(i AS INTEGER), CAST(lineno AS BIGINT), file || ':' || lineno, 'i' || i
      FROM made, range(8) r(i) WHERE k = 9""",
    "t7_relationships": with_tables(NODES, EDGES, _NEIGHBORS, _VERDICTS) + """
      SELECT m.response_id, 0 AS n, m.nb AS neighbor, x.citation, x.certain, 'link' AS text FROM made m
      JOIN (SELECT project, node, neighbor, arg_max(citation, direction) AS citation, arg_max(certain, direction) AS certain
        FROM near GROUP BY ALL) x ON x.project = m.project AND x.node = m.node AND x.neighbor = m.nb
      WHERE m.k = 8""",
    "p8_progress_stream": with_tables(NODES, SIGNATURES, PROGRESS) + """
      SELECT coalesce(v.learner_id, u.learner_id) AS learner_id, coalesce(v.project, u.project) AS project,
        coalesce(v.region, u.region) AS region, v.region IS NOT NULL AS visited, u.region IS NOT NULL AS understood
      FROM visited v FULL JOIN understood u ON u.learner_id = v.learner_id AND u.project = v.project AND u.region = v.region""",
}
