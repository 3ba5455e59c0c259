"""Filters and predicates: values in lists, overlaps, nested and normalised fields, shapes and kinds of lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.dialect import Dialect
from folioforge.operators.tables import boxes
from folioforge.operators.text import lines


def merge_filters(filters: dict | None = None, **lists: list | None) -> dict:
    """Explicit filters with lists such as ``page_numbers`` added where no filter of that name is."""
    out = dict(filters or {})
    for name, values in lists.items():
        if values:
            out.setdefault(name, list(values))
    return out


def passes(df: DataFrame, filters: dict | None, metadata: str | None = None) -> DataFrame:
    """Rows that fit every filter: a value equals, or is one of, the values asked for; an array column shares one with them.

    A filter of None asks nothing. A field that is no column is looked up in the map column ``metadata``; without one,
    nothing fits. A null value fits no filter. An empty list asks for one of no values, so nothing fits.
    """

    def test(name: str, wanted) -> Column:
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        if name in df.columns:
            if df.schema[name].dataType.typeName() == "array":
                return F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in values])) if values else F.lit(False)
            return F.col(name).isin(values)
        if metadata is None:
            return F.lit(False)
        return F.col(metadata)[name].isin([str(v) for v in values])

    tests = [test(k, v) for k, v in (filters or {}).items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def filter_fields(d: Dialect) -> str:
    """Documents of some languages and one source, that have a good label or none."""
    return f"""
SELECT t.doc_id, lang, source FROM {d.t('documents')} t LEFT JOIN {d.t('labels')} l ON t.doc_id = l.doc_id
WHERE lang IN ('en', 'de') AND source IN ('src3', 'src7') AND (l.quality IS NULL OR l.quality = 1)"""


def filter_metadata(d: Dialect) -> str:
    """Events of a type whose property k, no column of its own, is one of the values asked for."""
    return f"SELECT event_id, event_type, {d.json('props', 'k')} AS k FROM {d.t('events')} WHERE event_type = 'click' AND {d.json('props', 'k')} IN ('7', '21', '69')"


def filter_overlap(d: Dialect) -> str:
    """Tables (orders) that share a page (part) with the pages asked for; a table without pages fails."""
    return f"""
WITH p AS (SELECT l_orderkey AS table_id, {d.gather('l_partkey', 'l_partkey, l_linenumber')} AS pages FROM {d.t('lineitem')} GROUP BY l_orderkey)
SELECT table_id, cast({d.size('pages')} AS BIGINT) AS n_pages FROM p WHERE {d.overlap('pages', d.array('cast(3 AS BIGINT)', 'cast(77 AS BIGINT)', 'cast(150 AS BIGINT)'))}"""


def filter_normalized(d: Dialect) -> str:
    """Parts whose normalised name or brand holds one of the values asked for, in any case and with any marks."""
    wanted = "('red widget', 'blue bolt')"
    return f"SELECT p_partkey, p_name FROM {d.t('part')} WHERE {d.match('p_name')} IN {wanted} AND {d.match_words('p_brand')} IN ('brand 4', 'brand 17')"


def field_values(d: Dialect) -> str:
    """Every field of an event as (field, value) in index form: numbers as text, texts normalised, nested fields by their path; nulls and blanks give no value."""
    fields = [("event_type", d.match("event_type")), ("user_id", "cast(user_id AS STRING)"), ("is_error", "CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END"), ("metadata.k", d.json("props", "k")), ("metadata.missing", d.json("props", "missing"))]
    every = " UNION ALL ".join(f"SELECT event_id, '{name}' AS field, {value} AS value FROM {d.t('events')}" for name, value in fields)
    return f"WITH f AS ({every}) SELECT field, value, cast(count(*) AS BIGINT) AS n FROM f WHERE value IS NOT NULL AND value <> '' GROUP BY field, value"


def facet(d: Dialect) -> str:
    """The five most frequent values of each event field after a filter, by (-count, value)."""
    return f"""
WITH v AS (SELECT 'event_type' AS field, event_type AS value FROM {d.t('events')} WHERE value >= 5 UNION ALL SELECT 'k', {d.json('props', 'k')} FROM {d.t('events')} WHERE value >= 5),
c AS (SELECT field, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY field, value), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rk FROM c)
SELECT field, value, cast(n AS BIGINT) AS n, cast(rk AS BIGINT) AS rk FROM r WHERE rk <= 5"""


def existing_edges(d: Dialect) -> str:
    """Edges from customers to nations of which both ends are among the nodes kept (customers in credit, some nations)."""
    return f"""
WITH nodes AS (SELECT concat('customer:', cast(c_custkey AS STRING)) AS id FROM {d.t('customer')} WHERE c_acctbal > 0 UNION ALL SELECT concat('nation:', cast(n_nationkey AS STRING)) FROM {d.t('nation')} WHERE n_regionkey <> 2),
e AS (SELECT concat('customer:', cast(c_custkey AS STRING)) AS src, concat('nation:', cast(c_nationkey AS STRING)) AS dst FROM {d.t('customer')})
SELECT src, dst FROM e WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)"""


# Forms of page numbers and dates.
PAGE_NUMBER = r"^[0-9]+$|^[-–—] *[0-9]+ *[-–—]$|^(trang|page) +[0-9]+$|^[0-9]+ */ *[0-9]+$"
DATE_LIKE = r"(^|[^0-9])[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}([^0-9]|$)|tháng +[0-9]{1,2}|năm +[0-9]{4}"


def line_kinds(d: Dialect) -> str:
    """Lines that are page numbers, like dates, or blank once normalised."""
    return f"""
WITH {lines(d)}, k AS (SELECT doc_id, line_no, {d.matches('lower(text)', PAGE_NUMBER)} AS page_number, {d.matches('lower(text)', DATE_LIKE)} AS date_like, {d.match_words('text')} = '' AS blank FROM lines)
SELECT doc_id, line_no, page_number, date_like, blank FROM k WHERE page_number OR date_like OR blank"""


def text_validity(d: Dialect) -> str:
    """Whether a line holds as paragraph (2 to 6,000 characters), list item (1 to 3,000), contents entry (2 to 300), sentence (25 to 500 and four words) or entity (2 to 250)."""
    between = lambda a, z: f"length(text) BETWEEN {a} AND {z}"
    return f"""
WITH {lines(d)} SELECT doc_id, line_no, {between(2, 6000)} AS paragraph, {between(1, 3000)} AS item, {between(2, 300)} AND {d.matches('text', r'\p{L}')} AS entry,
  {between(25, 500)} AND {d.count('text', r'\S+')} >= 4 AS sentence, {between(2, 250)} AS entity FROM lines"""


def drawings(d: Dialect) -> str:
    """CTE drawings(page, id, x0, y0, x1, y1): one drawing for each line of an order, thin where the quantity is small."""
    return f"""drawings AS (SELECT l_orderkey AS page, cast(l_linenumber AS BIGINT) AS id, l_partkey % 400 AS x0, l_suppkey % 700 AS y0,
  l_partkey % 400 + CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE cast(l_quantity AS BIGINT) * 4 END AS x1, l_suppkey % 700 + CASE WHEN l_linenumber % 3 = 0 THEN cast(l_quantity AS BIGINT) * 3 ELSE 2 END AS y1 FROM {d.t('lineitem')})"""


def line_shapes(d: Dialect) -> str:
    """Drawings as horizontal, vertical and thin lines: longer than 10 and at most 2 thick; such lines may be a table's."""
    return f"""
WITH {drawings(d)}, s AS (SELECT page, id, x1 - x0 AS w, y1 - y0 AS h FROM drawings)
SELECT page, id, cast(w AS BIGINT) AS w, cast(h AS BIGINT) AS h, w > 10 AND h <= 2 AS horizontal, h > 10 AND w <= 2 AS vertical, least(w, h) <= 2 AS thin, (w > 10 AND h <= 2) OR (h > 10 AND w <= 2) AS table_line FROM s"""


def edge_zone(d: Dialect) -> str:
    """Lines whose middle lies in the upper or lower six hundredths of their page: headers and footers that paragraphs leave out."""
    return f"""
WITH {boxes(d)}, p AS (SELECT doc_id, line_no, (y0 + y1) / 2e0 AS cy, max(y1) OVER (PARTITION BY doc_id) AS height FROM boxes)
SELECT doc_id, line_no, CASE WHEN cy / height <= 0.06e0 THEN 'header' ELSE 'footer' END AS zone FROM p WHERE cy / height <= 0.06e0 OR cy / height >= 0.94e0"""


QUERIES = [filter_fields, filter_metadata, filter_overlap, filter_normalized, field_values, facet, existing_edges, line_kinds, text_validity, line_shapes, edge_zone]
