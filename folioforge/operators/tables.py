"""Table grids (one per order) and layout boxes."""

from __future__ import annotations

from folioforge.functions.dialect import Dialect
from folioforge.operators.text import lines

HEADERS = ("line", "part", "quantity", "price", "flag", "status")


def cells(d: Dialect) -> str:
    """CTE cells(table_id, r, c, text): a header row of names and one row for each lineitem."""
    values = ("cast(l_linenumber AS STRING)", "concat('P-', cast(l_partkey AS STRING))", "cast(cast(floor(l_quantity) AS BIGINT) AS STRING)", "concat(cast(cast(floor(l_extendedprice) AS BIGINT) AS STRING), ' VND')", "CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END", "l_linestatus")
    if d.spark:  # one scan: a table's first row also brings its header
        heads = d.array(*(f"'{h}'" for h in HEADERS))
        order = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"
        grid = f"SELECT l_orderkey AS table_id, {d.array(*values)} AS body, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS k FROM {d.t('lineitem')}"
        return f"""cells AS (SELECT table_id, r, c, text FROM (SELECT table_id, body, explode(CASE WHEN k = 1 THEN array(0, k) ELSE array(k) END) AS r FROM ({grid}) g) rows
  LATERAL VIEW posexplode(CASE WHEN r = 0 THEN {heads} ELSE body END) x AS c, text)"""
    body = " UNION ALL ".join(f"SELECT l_orderkey AS table_id, r, {c} AS c, {v} AS text FROM grid" for c, v in enumerate(values))
    head = " UNION ALL ".join(f"SELECT DISTINCT l_orderkey, 0, {c}, '{h}' FROM grid" for c, h in enumerate(HEADERS))
    order = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"
    return f"grid AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS r FROM {d.t('lineitem')}), cells AS ({body} UNION ALL {head})"


def _numeric(d: Dialect, x: str) -> str:
    clean = f"trim({d.replace(x, '[.,%+-]|VNĐ|VND|đ', '')})"
    return f"({d.matches(clean, '^[0-9]+$')} OR {d.matches(f'trim({x})', '^[0-9]+/[0-9]+(/[0-9]+)?$')} OR ({d.matches(x, '[0-9]')} AND NOT {d.matches(x, r'\\p{L}'.replace(chr(92) * 2, chr(92)))}))"


def _profile(d: Dialect, by: str) -> str:
    return f"""
WITH {cells(d)}, f AS (SELECT table_id, {by}, CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END AS filled, CASE WHEN {_numeric(d, 'text')} THEN 1 ELSE 0 END AS num, length(text) AS n FROM cells)
SELECT table_id, cast({by} AS BIGINT) AS {by}, cast(sum(filled) AS BIGINT) AS non_empty, cast(sum(1 - filled) AS BIGINT) AS empty_cells, cast(sum(num) AS BIGINT) AS numeric_cells,
  round(cast(sum(num) AS DOUBLE) / count(*), 4) AS numeric_ratio, round(cast(sum(n) AS DOUBLE) / count(*), 4) AS mean_length FROM f GROUP BY table_id, {by}"""


def row_profiles(d: Dialect) -> str:
    """Filled, empty and numeric cells of every row."""
    return _profile(d, "r")


def column_profiles(d: Dialect) -> str:
    """Filled, empty and numeric cells of every column."""
    return _profile(d, "c")


def number_parse(d: Dialect) -> str:
    """Locale number of each cell: both marks mean point for thousands, a comma alone is decimal; and the money unit."""
    bare = d.replace(d.replace("text", "%|VNĐ|VND|vnđ|vnd|đ| ", ""), "[^0-9.,-]", "")
    both = "replace(replace(b, '.', ''), ',', '.')"
    return f"""
WITH {cells(d)}, n AS (SELECT table_id, r, c, text, {bare} AS b FROM cells WHERE r > 0)
SELECT table_id, cast(r AS BIGINT) AS r, cast(c AS BIGINT) AS c, {d.number(f"CASE WHEN instr(b, ',') > 0 AND instr(b, '.') > 0 THEN {both} ELSE replace(b, ',', '.') END")} AS number,
  CASE WHEN {d.matches('lower(text)', 'vn[đd]|đ')} THEN 'VND' WHEN {d.matches('lower(text)', '[$]|usd')} THEN 'USD' ELSE '' END AS unit FROM n"""


def span_runs(d: Dialect) -> str:
    """Row spans: a filled cell and the run of empty cells below it in its column, at most 20 rows."""
    return f"""
WITH {cells(d)}, g AS (SELECT table_id, r, c, text, sum(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY table_id, c ORDER BY r ROWS UNBOUNDED PRECEDING) AS island FROM cells),
s AS (SELECT table_id, c, island, min(r) AS first_row, count(*) AS n FROM g WHERE island > 0 GROUP BY table_id, c, island)
SELECT table_id, cast(c AS BIGINT) AS c, cast(first_row AS BIGINT) AS first_row, cast(least(n, 20) AS BIGINT) AS row_span FROM s WHERE n > 1"""


def records(d: Dialect) -> str:
    """Body rows as key=value texts, by the header of each column."""
    return f"""
WITH {cells(d)}, h AS (SELECT table_id, c, text AS header FROM cells WHERE r = 0),
b AS (SELECT cells.table_id, r, cells.c, concat(header, '=', text) AS kv FROM cells JOIN h ON cells.table_id = h.table_id AND cells.c = h.c WHERE r > 0 AND trim(text) <> '')
SELECT table_id, cast(r AS BIGINT) AS r, {d.join('kv', '; ', 'c')} AS record FROM b GROUP BY table_id, r"""


def boxes(d: Dialect) -> str:
    """CTE boxes: a box for each line, from its number and length; odd documents have a second column."""
    shift = "CASE WHEN doc_id % 2 = 1 AND line_no % 2 = 1 THEN 300 ELSE 0 END"
    return f"""{lines(d)}, boxes AS (SELECT doc_id, line_no, text, 50 + 20 * (line_no % 3) + {shift} AS x0, 14 * line_no AS y0,
  50 + 20 * (line_no % 3) + {shift} + 6 * least(length(text), 80) AS x1, 14 * line_no + 10 AS y1 FROM lines)"""


def box_overlap(d: Dialect) -> str:
    """Intersection over the smaller area, and over the union, of boxes at most two lines apart."""
    return f"""
WITH {boxes(d)}, p AS (SELECT a.doc_id, a.line_no AS a, b.line_no AS b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) AS w, greatest(least(a.y1 + 8, b.y1 + 8) - greatest(a.y0, b.y0), 0) AS h,
  (a.x1 - a.x0) * (a.y1 + 8 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 + 8 - b.y0) AS sb FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND b.line_no - a.line_no BETWEEN 1 AND 2)
SELECT doc_id, a, b, round(cast(w * h AS DOUBLE) / least(sa, sb), 4) AS overlap, round(cast(w * h AS DOUBLE) / (sa + sb - w * h), 4) AS iou FROM p WHERE w * h > 0"""


def reading_order(d: Dialect) -> str:
    """Rank of every line by column, height and position."""
    return f"""
WITH {boxes(d)}, o AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN x0 >= 300 THEN 1 ELSE 0 END, y0, x0) AS rk FROM boxes)
SELECT doc_id, line_no, cast(rk AS BIGINT) AS rk FROM o"""


def line_islands(d: Dialect) -> str:
    """Blocks of lines: a new one begins where the gap exceeds 1.8 times the median height or the left edge moves by more than 12."""
    return f"""
WITH {boxes(d)}, h AS (SELECT doc_id, median(y1 - y0) AS height FROM boxes GROUP BY doc_id),
l AS (SELECT b.*, h.height, lag(y1) OVER w AS py, lag(x0) OVER w AS px FROM boxes b JOIN h ON b.doc_id = h.doc_id WINDOW w AS (PARTITION BY b.doc_id ORDER BY line_no)),
i AS (SELECT *, sum(CASE WHEN py IS NULL OR y0 - py > 1.8 * height OR abs(x0 - px) > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM l)
SELECT doc_id, cast(block AS BIGINT) AS block, cast(count(*) AS BIGINT) AS n_lines, cast(min(x0) AS BIGINT) AS x0, cast(min(y0) AS BIGINT) AS y0, cast(max(x1) AS BIGINT) AS x1, cast(max(y1) AS BIGINT) AS y1 FROM i GROUP BY doc_id, block"""


QUERIES = [row_profiles, column_profiles, number_parse, span_runs, records, box_overlap, reading_order, line_islands]
