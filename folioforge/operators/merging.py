"""Duplicates: the first of a key, the best of a key, and rows merged field by field."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.dialect import Dialect
from folioforge.operators.graph import edges
from folioforge.operators.text import lines


def first_of(df: DataFrame, keys: list[Column], *order: Column) -> DataFrame:
    """The first row of each key; null keys are one key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rk", F.row_number().over(w)).where("__rk = 1").drop("__rk")


def merge_unique(a: Column, b: Column) -> Column:
    """The values of two arrays in order of appearance, each once; null arrays hold none."""
    empty = lambda x: F.coalesce(x, F.array())
    return F.array_union(empty(a), empty(b))


def dedup_documents(d: Dialect) -> str:
    """The first document of equal language and equal first 800 characters of its match form, and how many it stands for."""
    return f"""
WITH n AS (SELECT doc_id, lang, substr({d.match_words('text')}, 1, 800) AS head FROM {d.t('documents')}),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, head ORDER BY doc_id) AS rk, count(*) OVER (PARTITION BY lang, head) AS n FROM n)
SELECT doc_id, cast(n AS BIGINT) AS copies FROM r WHERE rk = 1"""


def dedup_chunks(d: Dialect) -> str:
    """The first line of equal content in all documents, by the hash of its match form."""
    return f"""
WITH {lines(d)}, h AS (SELECT doc_id, line_no, {d.sha(d.match_words('text'))} AS content FROM lines WHERE length(text) >= 80),
r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, line_no) AS rk FROM h)
SELECT doc_id, line_no, content FROM r WHERE rk = 1"""


def dedup_evidence(d: Dialect) -> str:
    """The best evidence of equal text (first 700 characters of the match form) and source; its sources joined, and how often it came."""
    return f"""
WITH e AS (SELECT conv_id, turn, role, substr({d.match_words('text')}, 1, 700) AS head, length(text) AS score FROM {d.t('conversations')}),
r AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY score DESC, conv_id, turn) AS rk FROM e),
j AS (SELECT head, {d.joined(d.gather('role', 'role'))} AS roles, cast(count(*) AS BIGINT) AS n, cast(count(DISTINCT role) AS BIGINT) AS sources FROM e GROUP BY head)
SELECT conv_id, turn, cast(score AS BIGINT) AS score, roles, n, sources FROM r JOIN j ON r.head IS NOT DISTINCT FROM j.head WHERE rk = 1"""


def merge_fused(d: Dialect) -> str:
    """Parts sold at a name merged: best price, union of brands in order, longest type, largest size, first key."""
    return f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY length(p_type) DESC, p_partkey) AS rk FROM {d.t('part')}),
g AS (SELECT p_name, max(p_retailprice) AS score, min(p_partkey) AS first_key, cast(max(p_size) AS BIGINT) AS size, {d.joined(d.gather('p_brand', 'p_brand'))} AS brands, cast(count(*) AS BIGINT) AS n FROM {d.t('part')} GROUP BY p_name)
SELECT g.p_name, score, first_key, size, brands, n, r.p_type FROM g JOIN r ON g.p_name = r.p_name WHERE rk = 1"""


def merge_nodes(d: Dialect) -> str:
    """Nodes of one id merged: longest label, largest weight, union of pages; suppliers and customers give nations twice."""
    return f"""
WITH n AS (SELECT concat('nation:', cast(c_nationkey AS STRING)) AS id, c_name AS label, c_acctbal AS weight, c_custkey % 7 AS page FROM {d.t('customer')}
  UNION ALL SELECT concat('nation:', cast(s_nationkey AS STRING)), s_name, s_acctbal, s_suppkey % 7 FROM {d.t('supplier')}),
r AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY length(label) DESC, label) AS rk FROM n),
g AS (SELECT id, max(weight) AS weight, {d.joined(d.gather('cast(page AS STRING)', 'page'))} AS pages, cast(count(*) AS BIGINT) AS n FROM n GROUP BY id)
SELECT g.id, r.label, weight, pages, n FROM g JOIN r ON g.id = r.id WHERE rk = 1"""


def first_edges(d: Dialect) -> str:
    """The first edge of each pair of ends, whatever its kind, by (-weight, kind); the pair has no direction."""
    return f"""
WITH {edges(d)}, u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, kind, weight FROM edges),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY weight DESC, kind) AS rk FROM u) SELECT a, b, kind, weight FROM r WHERE rk = 1"""


def best_candidates(d: Dialect) -> str:
    """The surest heading candidate of each document and text: numbered 0.8, capitals 0.6, others 0.4; ties go to the first line."""
    sure = f"CASE WHEN {d.matches('text', '^[0-9]+([.][0-9]+)*[.)]? +.')} THEN 0.8e0 WHEN text = upper(text) THEN 0.6e0 ELSE 0.4e0 END"
    return f"""
WITH {lines(d)}, c AS (SELECT doc_id, line_no, {d.match_words('text')} AS form, {sure} AS confidence FROM lines WHERE length(text) <= 120),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, form ORDER BY confidence DESC, line_no) AS rk FROM c) SELECT doc_id, line_no, form, confidence FROM r WHERE rk = 1"""


def _horizontal(a: list[float], b: list[float]) -> float:
    width = min(a[2] - a[0], b[2] - b[0])
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) / width if width > 0 else 0.0


def _iou(a: list[float], b: list[float]) -> float:
    both = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
    area = lambda x: max(x[2] - x[0], 0.0) * max(x[3] - x[1], 0.0)
    return both / (area(a) + area(b) - both) if area(a) + area(b) - both > 0 else 0.0


def join_boxes(boxes: list[list[float]], iou: float = 0.20, gap: float = 25.0, overlap: float = 0.5) -> list[tuple[list[float], int]]:
    """Boxes of one page grown together until none fits another: enough overlap, or close below with a shared width.

    From the top: each box takes in those that fit it, again and again as it grows. Returns boxes and how many each took in.
    """
    left = sorted(boxes, key=lambda b: (b[1], b[0]))
    done = []
    while left:
        now, n = list(left.pop(0)), 1
        while True:
            fits = [b for b in left if _iou(now, b) >= iou or (max(b[1] - now[3], now[1] - b[3], 0.0) <= gap and _horizontal(now, b) >= overlap)]
            if not fits:
                break
            b = fits[0]
            left.remove(b)
            now, n = [min(now[0], b[0]), min(now[1], b[1]), max(now[2], b[2]), max(now[3], b[3])], n + 1
        done.append((now, n))
    return done


def merge_boxes(df: DataFrame, page: str = "page") -> DataFrame:
    """page, x0, y0, x1, y1, n of the boxes of every page, merged to a fixed point; a page is one group in memory."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        made = join_boxes(rows[["x0", "y0", "x1", "y1"]].astype(float).values.tolist())
        return pd.DataFrame([(rows[page].iloc[0], *b, n) for b, n in made], columns=[page, "x0", "y0", "x1", "y1", "n"])

    kind = df.schema[page].dataType.simpleString()
    return df.select(page, "x0", "y0", "x1", "y1").groupBy(page).applyInPandas(run, f"{page} {kind}, x0 double, y0 double, x1 double, y1 double, n long")


QUERIES = [dedup_documents, dedup_chunks, dedup_evidence, merge_fused, merge_nodes, first_edges, best_candidates]
