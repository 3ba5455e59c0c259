"""Property graph of the star schema: nodes, edges, degrees, expansion."""

from __future__ import annotations

from folioforge.functions.dialect import Dialect
from folioforge.operators.text import lines

# Edge types with weight and confidence.
EDGES = (
    ("nation", "n_nationkey", "region", "n_regionkey", "IN_REGION", 1.0, 1.0),
    ("customer", "c_custkey", "nation", "c_nationkey", "IN_NATION", 0.9, 0.95),
    ("supplier", "s_suppkey", "nation", "s_nationkey", "IN_NATION", 0.9, 0.95),
    ("orders", "o_orderkey", "customer", "o_custkey", "PLACED_BY", 0.7, 0.9),
)


def edges(d: Dialect) -> str:
    parts = [f"SELECT concat('{a}:', cast({k} AS STRING)) AS src, concat('{b}:', cast({f} AS STRING)) AS dst, '{kind}' AS kind, cast({w} AS DOUBLE) AS weight, cast({c} AS DOUBLE) AS confidence FROM {d.t(a)}" for a, k, b, f, kind, w, c in EDGES]
    return "edges AS (" + " UNION ALL ".join(parts) + ")"


def graph_edges(d: Dialect) -> str:
    """Typed edges, equal ones merged with the largest weight and confidence."""
    return f"WITH {edges(d)} SELECT src, dst, kind, max(weight) AS weight, max(confidence) AS confidence FROM edges GROUP BY src, dst, kind"


def graph_summary(d: Dialect) -> str:
    """Edges and nodes by type."""
    ends = "SELECT src AS node FROM edges UNION SELECT dst FROM edges"
    return f"""WITH {edges(d)} SELECT 'edge' AS what, kind AS type, cast(count(*) AS BIGINT) AS n FROM edges GROUP BY kind
UNION ALL SELECT 'node', substr(node, 1, instr(node, ':') - 1), cast(count(*) AS BIGINT) FROM ({ends}) e GROUP BY substr(node, 1, instr(node, ':') - 1)"""


def degree_stats(d: Dialect) -> str:
    """In, out and weighted degree of every node."""
    return f"""
WITH {edges(d)}, e AS (SELECT src AS node, 1 AS o, 0 AS i, weight FROM edges UNION ALL SELECT dst, 0, 1, weight FROM edges)
SELECT node, cast(sum(i) AS BIGINT) AS in_degree, cast(sum(o) AS BIGINT) AS out_degree, cast(count(*) AS BIGINT) AS degree, round(sum(weight), 4) AS weighted FROM e GROUP BY node"""


def adjacency_topn(d: Dialect) -> str:
    """The 20 first neighbours of every node by weight, confidence, type and id."""
    return f"""
WITH {edges(d)}, u AS (SELECT src AS node, dst AS other, kind, weight, confidence FROM edges UNION ALL SELECT dst, src, kind, weight, confidence FROM edges),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, confidence DESC, kind, other) AS rk FROM u)
SELECT node, other, kind, cast(rk AS BIGINT) AS rk FROM r WHERE rk <= 20"""


def bfs_expand(d: Dialect) -> str:
    """Nodes within three undirected steps of the regions, with depth and decayed score."""
    return f"""
WITH {edges(d)}, u AS (SELECT src AS node, dst AS other FROM edges UNION SELECT dst, src FROM edges),
d0 AS (SELECT DISTINCT dst AS node, 0 AS depth FROM edges WHERE kind = 'IN_REGION'),
d1 AS (SELECT node, depth FROM d0 UNION ALL SELECT DISTINCT u.other, 1 FROM u JOIN d0 ON u.node = d0.node),
v1 AS (SELECT node, min(depth) AS depth FROM d1 GROUP BY node),
d2 AS (SELECT node, depth FROM v1 UNION ALL SELECT DISTINCT u.other, 2 FROM u JOIN v1 ON u.node = v1.node AND v1.depth = 1),
v2 AS (SELECT node, min(depth) AS depth FROM d2 GROUP BY node),
d3 AS (SELECT node, depth FROM v2 UNION ALL SELECT DISTINCT u.other, 3 FROM u JOIN v2 ON u.node = v2.node AND v2.depth = 2),
v3 AS (SELECT node, min(depth) AS depth FROM d3 GROUP BY node)
SELECT node, cast(depth AS BIGINT) AS depth, round(power(0.82, greatest(depth - 1, 0)), 6) AS score FROM v3"""


def kg_edges(d: Dialect) -> str:
    """Document graph: documents, sections (numbered or capital lines) and chunks (lines of 80 characters) with typed, weighted edges."""
    doc, sec, chunk = ("concat('document:', cast(doc_id AS STRING))", "concat('section:', cast(doc_id AS STRING), ':', cast({} AS STRING))", "concat('chunk:', cast(doc_id AS STRING), ':', cast(line_no AS STRING))")
    head = f"length(text) <= 120 AND NOT {d.matches('text', '[.;:,]$')}"
    return f"""
WITH {lines(d)}, k AS (SELECT *, {head} AS head, max(CASE WHEN {head} THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM lines),
s AS (SELECT doc_id, line_no, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_no FROM k WHERE head)
SELECT {doc} AS src, {sec.format('line_no')} AS dst, 'HAS_SECTION' AS kind, cast(1.0 AS DOUBLE) AS weight FROM s
UNION ALL SELECT {sec.format('line_no')}, {sec.format('next_no')}, 'NEXT_SECTION', 1.0 FROM s WHERE next_no IS NOT NULL
UNION ALL SELECT {doc}, {chunk}, 'HAS_CHUNK', 0.55 FROM k WHERE length(text) >= 80
UNION ALL SELECT {sec.format('section')}, {chunk}, 'HAS_CHUNK', 0.85 FROM k WHERE length(text) >= 80 AND section IS NOT NULL"""


QUERIES = [graph_edges, graph_summary, degree_stats, adjacency_topn, bfs_expand, kg_edges]
