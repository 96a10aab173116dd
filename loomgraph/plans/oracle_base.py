"""The table view restated in DuckDB SQL, for the side-by-side check.

Everything here is text: nothing in the library calls it.
"""

from __future__ import annotations

_CONCEPTS = (
    "['dataclass','protocol','pattern-matching','f-string','walrus','decorator','comprehension',"
    "'generator','context-manager','async-await','dunder-method','exception-handling','type-hint']"
)

DIMENSIONS = """
places AS MATERIALIZED (
  SELECT r_name AS project, n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS MATERIALIZED (
  SELECT project, c_custkey, c_nationkey, c_mktsegment, c_acctbal >= 0 AS linked
  FROM customer JOIN places ON c_nationkey = n_nationkey),
supp AS MATERIALIZED (
  SELECT project, s_suppkey, s_nationkey, s_acctbal FROM supplier JOIN places ON s_nationkey = n_nationkey),
ord AS MATERIALIZED (
  SELECT project, linked, o.o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate
  FROM orders o JOIN cust ON o_custkey = c_custkey)"""

NODES = DIMENSIONS + """,
node_parts AS (
  SELECT DISTINCT project, 'world' AS id, 'module' AS kind, 'python' AS language, 'src/world.py' AS file,
    1 AS lineno, 10 AS loc, 'world' AS region, NULL AS entrypoint_rank, false AS partial FROM places
  UNION ALL
  SELECT project, 'nation.' || n_nationkey, 'module', 'python',
    CASE WHEN n_nationkey % 7 = 1 THEN 'tests/geo/nation_' ELSE 'src/geo/nation_' END || n_nationkey || '.py',
    1, 20, 'nation.' || n_nationkey, CASE WHEN r_regionkey = 4 THEN 1 ELSE n_nationkey // 5 END, false FROM places
  UNION ALL
  SELECT project, 'nation.' || n_nationkey || '.Nation', 'class', 'python',
    CASE WHEN n_nationkey % 7 = 1 THEN 'tests/geo/nation_' ELSE 'src/geo/nation_' END || n_nationkey || '.py',
    3, 12, 'nation.' || n_nationkey, NULL, false FROM places
  UNION ALL
  SELECT project, 'customer.' || c_custkey, 'module', 'python',
    'src/customers/' || lower(c_mktsegment) || '/customer_' || c_custkey || '.py',
    1, 8, 'customer.' || c_custkey, NULL, false FROM cust
  UNION ALL
  SELECT project, 'customer.' || c_custkey || '.Customer', 'class', 'python',
    'src/customers/' || lower(c_mktsegment) || '/customer_' || c_custkey || '.py',
    3, 5, 'customer.' || c_custkey, NULL, false FROM cust
  UNION ALL
  SELECT project, 'order.' || o_orderkey, 'module', 'typescript',
    'lib/orders/' || substr(o_orderpriority, 1, 1) || '/order_' || o_orderkey || '.ts',
    1, 90, 'order.' || o_orderkey, NULL, false FROM ord
  UNION ALL
  SELECT project, 'order.' || o_orderkey || '.Order', 'class', 'typescript',
    'lib/orders/' || substr(o_orderpriority, 1, 1) || '/order_' || o_orderkey || '.ts',
    2, 8, 'order.' || o_orderkey, NULL, false FROM ord
  UNION ALL
  SELECT project, 'order.' || o_orderkey || '.line' || l_linenumber, 'function', 'typescript',
    'lib/orders/' || substr(o_orderpriority, 1, 1) || '/order_' || o_orderkey || '.ts',
    l_linenumber * 10, CAST(quantity AS INTEGER), 'order.' || o_orderkey, NULL, false
  FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS quantity FROM lineitem GROUP BY ALL) i
  JOIN ord ON l_orderkey = o_orderkey
  UNION ALL
  SELECT project, 'supplier.' || s_suppkey, 'module', 'go', 'src/suppliers/supplier_' || s_suppkey || '.go',
    1, 6, 'supplier.' || s_suppkey, CASE WHEN s_acctbal < 0 THEN 3 END, false FROM supp
  UNION ALL
  SELECT project, 'supplier.' || s_suppkey || '.ship', 'function', 'go',
    'src/suppliers/supplier_' || s_suppkey || '.go', 2, 4, 'supplier.' || s_suppkey, NULL, false FROM supp
  UNION ALL
  SELECT project, 'part.' || p_partkey || unnest(CASE WHEN p_type = 'PROMO' THEN [''] ELSE ['', '.make'] END) AS id,
    CASE WHEN id LIKE '%.make' THEN 'function' ELSE 'module' END, 'typescript',
    CASE WHEN p_brand LIKE '%5' THEN 'tests/' ELSE 'lib/parts/' END || lower(replace(p_brand, '#', '_'))
      || '/part_' || p_partkey || '.ts',
    CASE WHEN id LIKE '%.make' THEN 2 ELSE 1 END,
    CASE WHEN id LIKE '%.make' THEN p_size ELSE p_size + 2 END, 'part.' || p_partkey, NULL,
    p_type = 'PROMO' AND id NOT LIKE '%.make'
  FROM (SELECT DISTINCT project, l_partkey FROM lineitem JOIN ord ON l_orderkey = o_orderkey) u
  JOIN part ON l_partkey = p_partkey),
nodes AS MATERIALIZED (
  SELECT project, id, kind, split_part(id, '.', -1) AS name, language, file, CAST(lineno AS INTEGER) AS lineno,
    CAST(lineno + loc - 1 AS INTEGER) AS end_lineno, CAST(loc AS INTEGER) AS loc, region,
    CAST(entrypoint_rank AS INTEGER) AS entrypoint_rank, partial FROM node_parts)"""

EDGES = """
li AS MATERIALIZED (
  SELECT o.project, s.project = o.project AS near, linked, o_orderkey, l_partkey, l_suppkey, l_linenumber AS n,
    l_returnflag, l_linestatus, l_tax, l_discount, 'order.' || o_orderkey AS oid,
    'order.' || o_orderkey || '.line' || l_linenumber AS lid
  FROM lineitem JOIN ord o ON l_orderkey = o_orderkey JOIN supp s ON l_suppkey = s_suppkey),
raw_edges AS (
  SELECT project, 'world' AS src, 'nation.' || min(n_nationkey) AS dst, 'import' AS kind, true AS certain,
    1 AS lineno, false AS external FROM places GROUP BY project
  UNION ALL SELECT project, 'nation.' || n_nationkey, 'world', 'import', true, 1, false FROM places
  UNION ALL SELECT project, 'nation.' || s_nationkey, 'supplier.' || min(s_suppkey), 'import', true, 2, false
    FROM supp GROUP BY project, s_nationkey
  UNION ALL SELECT project, 'supplier.' || s_suppkey, 'nation.' || s_nationkey, 'import', true, 1, false FROM supp
  UNION ALL SELECT project, 'customer.' || c_custkey, 'nation.' || c_nationkey, 'import', true, 1, false
    FROM cust WHERE linked
  UNION ALL SELECT project, 'nation.' || c_nationkey || '.Nation', 'customer.' || c_custkey || '.Customer', 'call',
    linked, 5, false FROM cust
  UNION ALL SELECT project, 'order.' || o_orderkey, 'customer.' || o_custkey, 'import', true, 1, false FROM ord
  UNION ALL SELECT project, 'customer.' || o_custkey || '.Customer', 'order.' || o_orderkey || '.Order', 'call',
    o_orderstatus <> 'P', 4, false FROM ord
  UNION ALL SELECT project, 'customer.' || o_custkey, 'order.' || k, 'import', false, 2, false FROM (
    SELECT project, o_custkey, o_orderkey AS k,
      row_number() OVER (PARTITION BY project, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
    FROM ord) WHERE r = 1
  UNION ALL SELECT project, lid, 'part.' || l_partkey || '.make', 'call', l_returnflag <> 'R', n * 10 + 1, false FROM li
  UNION ALL SELECT project, lid, CASE WHEN near THEN '' ELSE 'external:' END || 'supplier.' || l_suppkey || '.ship',
    'call', near, n * 10 + 2, NOT near FROM li
  UNION ALL SELECT project, lid, CASE WHEN n > 1 THEN oid || '.line' || (n - 1) ELSE 'unresolved:' || oid || ':line0' END,
    'call', l_linestatus = 'F', n * 10 + 3, false FROM li
  UNION ALL SELECT project, lid, lid, 'call', true, n * 10 + 4, false FROM li WHERE l_discount = 0
  UNION ALL SELECT project, lid, oid || '.line2', 'call', true, n * 10 + 5, false FROM li WHERE n = 1 AND l_tax < 0.02
  UNION ALL SELECT project, oid || '.Order', lid, 'call', l_returnflag = 'A', n + 2, false FROM li
  UNION ALL SELECT project, oid, 'part.' || l_partkey, 'import', l_returnflag <> 'R', n + 1, false FROM li WHERE linked
  UNION ALL SELECT project, oid, CASE WHEN near THEN '' ELSE 'external:' END || 'supplier.' || l_suppkey, 'import',
    true, n + 20, NOT near FROM li WHERE linked),
edges AS MATERIALIZED (
  SELECT DISTINCT project, src, dst, kind, certain, CAST(lineno AS INTEGER) AS lineno, external FROM raw_edges)"""

FILES = """
files AS MATERIALIZED (
  SELECT DISTINCT project, file, language, sha256(project || '/' || file) AS sha256 FROM nodes)"""

CONCEPT_ROWS = f"""
concepts AS MATERIALIZED (
  SELECT project, 'customer.' || c_custkey || '.Customer' AS node_id, 'python' AS language,
    {_CONCEPTS}[c_custkey % 13 + 1] AS concept, 3 AS lineno, 4 AS end_lineno, c_mktsegment AS snippet FROM cust
  UNION
  SELECT project, 'order.' || o_orderkey || '.line' || l_linenumber, 'typescript',
    CASE p_type WHEN 'ECONOMY' THEN 'async-await' WHEN 'LARGE' THEN 'arrow-function' WHEN 'MEDIUM' THEN 'destructuring'
      WHEN 'PROMO' THEN 'promo' WHEN 'SMALL' THEN 'interface' WHEN 'STANDARD' THEN 'generic' END,
    CAST(l_linenumber * 10 + 1 AS INTEGER), CAST(l_linenumber * 10 + 1 AS INTEGER), p_name
  FROM lineitem JOIN ord ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

SIGNATURES = """
signatures AS MATERIALIZED (
  SELECT project, region, sha256('[' || string_agg('["' || bucket || '","' || part || '"]', ',' ORDER BY bucket) || ']') AS signature
  FROM (
    SELECT project, region, substr(sha256(file), 1, 4) AS bucket,
      sha256('[' || string_agg('["' || file || '","' || sha256(project || '/' || file) || '"]', ',' ORDER BY file) || ']') AS part
    FROM (SELECT DISTINCT project, region, file FROM nodes) GROUP BY ALL)
  GROUP BY project, region)"""

PROGRESS = """
log AS MATERIALIZED (
  SELECT m.* EXCLUDE (fresh), CASE WHEN type = 'pass_check' THEN
      CASE WHEN fresh THEN coalesce(s.signature, 'stale') ELSE 'stale' END END AS signature
  FROM (
    SELECT event_id, project, user_id AS learner_id, ts,
      CASE WHEN event_type IN ('view', 'click') THEN 'visit' WHEN event_type = 'purchase' THEN 'pass_check'
        WHEN event_type = 'signup' THEN 'mode' WHEN value < 5 THEN 'reset' ELSE 'home' END AS type,
      'customer.' || CASE WHEN event_type = 'click' THEN user_id ELSE c_custkey END AS region,
      CASE WHEN event_type = 'signup' THEN CASE WHEN value < 50 THEN 'easy' WHEN value < 200 THEN 'expert' ELSE 'loud' END
        WHEN event_type = 'error' THEN 'nation.' || (c_custkey % 25) END AS value,
      value < 40 AS fresh
    FROM events JOIN cust ON c_custkey = CAST(json_extract_string(props, '$.k') AS BIGINT)) m
  LEFT JOIN signatures s ON s.project = m.project AND s.region = m.region),
resets AS (SELECT learner_id, project, max((ts, event_id)) AS cleared FROM log WHERE type = 'reset' GROUP BY ALL),
kept AS MATERIALIZED (SELECT l.* FROM log l LEFT JOIN resets r ON r.learner_id = l.learner_id AND r.project = l.project
  WHERE type IN ('visit', 'pass_check') AND (r.cleared IS NULL OR (l.ts, l.event_id) > r.cleared)),
proofs AS MATERIALIZED (SELECT learner_id, project, region, arg_max(signature, (ts, event_id)) AS signature FROM kept
  WHERE type = 'pass_check' GROUP BY ALL),
understood AS MATERIALIZED (SELECT p.learner_id, p.project, p.region FROM proofs p
  JOIN signatures s ON s.project = p.project AND s.region = p.region AND s.signature = p.signature),
visited AS MATERIALIZED (SELECT DISTINCT learner_id, project, region FROM kept k WHERE type = 'visit'
  AND EXISTS (SELECT 1 FROM nodes n WHERE n.project = k.project AND n.region = k.region))"""

CENTRAL = """
central AS MATERIALIZED (
  SELECT n.project, n.id, count(DISTINCT e.src) AS centrality
  FROM nodes n LEFT JOIN edges e ON e.project = n.project AND e.dst = n.id AND e.kind = 'call' AND NOT e.external
  GROUP BY ALL)"""

CANDIDATES = """
candidates AS MATERIALIZED (
  SELECT project, id, file, region, entrypoint_rank,
    regexp_matches(file, '(^|/)(tests|test|testing|__tests__|spec|__specs__)/') AS is_test
  FROM nodes WHERE entrypoint_rank IS NOT NULL),
home AS MATERIALIZED (
  SELECT project, CASE WHEN count(*) = 1 THEN min(id) END AS home FROM (
    SELECT *, rank() OVER (PARTITION BY project ORDER BY is_test, entrypoint_rank) AS r FROM candidates) WHERE r = 1
  GROUP BY project)"""

REGION_EDGES = """
region_edges AS MATERIALIZED (
  SELECT e.project, a.region AS src, b.region AS dst, count(*) AS weight, bool_and(certain) AS certain
  FROM edges e JOIN nodes a ON a.project = e.project AND a.id = e.src
  JOIN nodes b ON b.project = e.project AND b.id = e.dst
  WHERE e.kind = 'import' AND NOT external AND a.region <> b.region GROUP BY ALL)"""

REGIONS = """
regions AS MATERIALIZED (
  SELECT n.project, n.region, coalesce(min(CASE WHEN n.kind = 'module' THEN n.language END), min(n.language)) AS language,
    CAST(coalesce(nullif(sum(CASE WHEN n.kind = 'module' THEN loc END), 0), sum(loc)) AS BIGINT) AS loc,
    CAST(sum(centrality) AS BIGINT) AS centrality, count(*) AS node_count,
    coalesce(bool_or(n.id = h.home), false) AS home
  FROM nodes n JOIN central c ON c.project = n.project AND c.id = n.id
  LEFT JOIN home h ON h.project = n.project GROUP BY n.project, n.region)"""

NEIGHBORS = """
neighbors AS MATERIALIZED (
  SELECT project, src AS a, dst AS b FROM region_edges UNION SELECT project, dst, src FROM region_edges)"""

HOPS = """
hops AS MATERIALIZED (
  WITH RECURSIVE walk AS (
    SELECT n.project, n.region AS region, 0 AS d FROM nodes n JOIN home h ON n.project = h.project AND n.id = h.home
    UNION
    SELECT w.project, k.b, w.d + 1 FROM walk w JOIN neighbors k ON k.project = w.project AND k.a = w.region
    WHERE w.d < 14)
  SELECT project, region, CAST(min(d) AS INTEGER) AS hops FROM walk GROUP BY ALL)"""


def with_tables(*ctes: str, recursive: bool = False) -> str:
    """A WITH clause over the named blocks, each included once and in order."""
    seen: list[str] = []
    for cte in ctes:
        if cte not in seen:
            seen.append(cte)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(seen) + "\n"
