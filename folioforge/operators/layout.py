"""Layout: islands of lines, clusters of positions, columns, cells from borders, texts in cells, captions and their targets."""

from __future__ import annotations

from folioforge.functions.dialect import Dialect
from folioforge.operators.context import _caption
from folioforge.operators.selection import drawings
from folioforge.operators.tables import boxes
from folioforge.operators.text import lines


def _islands(d: Dialect, source: str, key: str, order: str, begins: str, out: str) -> str:
    """Blocks of rows in order, a new one where ``begins`` holds of the row and the one before (py, px)."""
    return f"""
WITH {source}, l AS (SELECT *, lag(y1) OVER w AS py, lag(x0) OVER w AS px, lag(x1) OVER w AS pxe FROM boxes WINDOW w AS (PARTITION BY {key} ORDER BY {order})),
i AS (SELECT *, sum(CASE WHEN py IS NULL OR {begins} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS block FROM l)
SELECT {key}, cast(block AS BIGINT) AS block, cast(count(*) AS BIGINT) AS n_lines, cast(min(x0) AS BIGINT) AS x0, cast(min(y0) AS BIGINT) AS y0, cast(max(x1) AS BIGINT) AS x1, cast(max(y1) AS BIGINT) AS y1{out} FROM i GROUP BY {key}, block"""


def text_regions(d: Dialect) -> str:
    """Regions of lines: a gap of at most 12 and a shift of at most 20 join them."""
    return _islands(d, boxes(d), "doc_id", "line_no", "y0 - py > 12 OR abs(x0 - px) > 20", "")


def table_blocks(d: Dialect) -> str:
    """Blocks of table-like lines with gaps of at most 18."""
    source = boxes(d).replace("AS y1 FROM lines)", f"AS y1 FROM lines WHERE {d.matches('text', '[0-9]')})")
    return _islands(d, source, "doc_id", "line_no", "y0 - py > 18", ", cast(max(length(text)) AS BIGINT) AS widest")


def nearby_lines(d: Dialect) -> str:
    """Groups of lines with gaps of at most 25."""
    return _islands(d, boxes(d), "doc_id", "line_no", "y0 - py > 25", "")


def position_clusters(d: Dialect) -> str:
    """Left edges of the drawings of a page in clusters: each within 6 of the one before it; the mean of each cluster."""
    return f"""
WITH {drawings(d)}, l AS (SELECT page, x0, lag(x0) OVER (PARTITION BY page ORDER BY x0, id) AS px, id FROM drawings),
i AS (SELECT page, x0, sum(CASE WHEN px IS NULL OR x0 - px > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0, id ROWS UNBOUNDED PRECEDING) AS cluster FROM l)
SELECT page, cast(cluster AS BIGINT) AS cluster, round(avg(cast(x0 AS DOUBLE)), 4) AS position, cast(count(*) AS BIGINT) AS n FROM i GROUP BY page, cluster"""


def _mean_fold(d: Dialect, values: str, tolerance: str) -> str:
    """Spark: a fold over ascending values that begins a group where a value is further than ``tolerance`` from the mean of the group so far; arrays of (total, n)."""
    return f"""aggregate({values}, cast(array() AS ARRAY<STRUCT<total: DOUBLE, n: BIGINT>>), (g, x) -> CASE WHEN size(g) > 0 AND abs(x - element_at(g, -1).total / element_at(g, -1).n) <= {tolerance}
  THEN concat(slice(g, 1, size(g) - 1), array(named_struct('total', element_at(g, -1).total + x, 'n', element_at(g, -1).n + 1L))) ELSE concat(g, array(named_struct('total', x, 'n', 1L))) END)"""


def _mean_groups(d: Dialect, source: str, value: str, order: str, tolerance: int) -> str:
    """Groups of the drawings of a page against the running mean: group number, mean and size."""
    if d.spark:
        return f"""
WITH {drawings(d)}, v AS (SELECT page, {d.gather(f'cast({value} AS DOUBLE)', order)} AS xs FROM {source} GROUP BY page), g AS (SELECT page, {_mean_fold(d, 'xs', str(tolerance))} AS groups FROM v)
SELECT page, cast(k + 1 AS BIGINT) AS cluster, round(one.total / one.n, 4) AS position, one.n AS n FROM g LATERAL VIEW posexplode(groups) x AS k, one"""
    return f"""
WITH RECURSIVE {drawings(d)}, v AS (SELECT page, cast({value} AS DOUBLE) AS x, row_number() OVER (PARTITION BY page ORDER BY {order}) AS i FROM {source}),
walk AS (SELECT page, i, 1 AS cluster, x AS total, 1 AS n FROM v WHERE i = 1 UNION ALL
  SELECT v.page, v.i, CASE WHEN abs(v.x - w.total / w.n) <= {tolerance} THEN w.cluster ELSE w.cluster + 1 END, CASE WHEN abs(v.x - w.total / w.n) <= {tolerance} THEN w.total + v.x ELSE v.x END, CASE WHEN abs(v.x - w.total / w.n) <= {tolerance} THEN w.n + 1 ELSE 1 END
  FROM walk w JOIN v ON v.page = w.page AND v.i = w.i + 1)
SELECT page, cast(cluster AS BIGINT) AS cluster, round(max_by(total / n, n), 4) AS position, cast(max(n) AS BIGINT) AS n FROM walk GROUP BY page, cluster"""


def baseline_lines(d: Dialect) -> str:
    """Pieces of a page on one line: their tops within 3 of the mean of the line so far."""
    return _mean_groups(d, "drawings", "y0", "y0, id", 3)


def parallel_rules(d: Dialect) -> str:
    """Horizontal rules of a page on one axis: within 2 of the mean of the group so far."""
    return _mean_groups(d, "(SELECT * FROM drawings WHERE y1 - y0 <= 2 AND x1 - x0 > 10) h", "y0", "y0, id", 2)


def page_columns(d: Dialect) -> str:
    """Columns of a page: centres within 35 of the mean of the column so far."""
    return _mean_groups(d, "drawings", "(x0 + x1) / 2e0", "(x0 + x1) / 2e0, id", 35)


def rounded_order(d: Dialect) -> str:
    """Reading order within columns by tops rounded to fives (half to even), then left edges."""
    return f"""
WITH {drawings(d)}, o AS (SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN x0 >= 200 THEN 1 ELSE 0 END, {d.half_even('y0 / 5e0')} * 5, x0, id) AS rk FROM drawings) SELECT page, id, cast(rk AS BIGINT) AS rk FROM o"""


def column_counts(d: Dialect) -> str:
    """Columns of each line by tabs, bars or two and more blanks; the most and the median over a document."""
    n = f"{d.count('text', r'(\t|\||  +)')} + 1"
    return f"WITH {lines(d)}, c AS (SELECT doc_id, {n} AS n FROM lines) SELECT doc_id, cast(max(n) AS BIGINT) AS most, {d.half_even('median(n)')} AS usual FROM c GROUP BY doc_id"


def _grid(d: Dialect) -> str:
    """CTEs rows and cols (page, i, a, z): consecutive borders of at least 6 and 10 apart, from the edges of a page's drawings."""
    def axis(name: str, low: str, high: str, least: int) -> str:
        return f"""{name}0 AS (SELECT page, {low} AS v FROM drawings UNION SELECT page, {high} FROM drawings), {name}1 AS (SELECT page, v, lag(v) OVER (PARTITION BY page ORDER BY v) AS p FROM {name}0),
{name}2 AS (SELECT page, v, row_number() OVER (PARTITION BY page ORDER BY v) AS i FROM {name}1 WHERE p IS NULL OR v - p >= {least}), {name} AS (SELECT page, i, v AS a, lead(v) OVER (PARTITION BY page ORDER BY v) AS z FROM {name}2)"""

    return f"{drawings(d)}, {axis('rws', 'y0', 'y1', 6)}, {axis('cls', 'x0', 'x1', 10)}, cell AS (SELECT r.page, r.i AS r, c.i AS c, c.a AS x0, r.a AS y0, c.z AS x1, r.z AS y1 FROM rws r JOIN cls c ON r.page = c.page WHERE r.z IS NOT NULL AND c.z IS NOT NULL)"


def grid_cells(d: Dialect) -> str:
    """Cells of a page's grid: every row band with every column band of consecutive borders."""
    return f"WITH {_grid(d)} SELECT page, cast(count(*) AS BIGINT) AS n_cells, cast(max(r) AS BIGINT) AS n_rows, cast(max(c) AS BIGINT) AS n_cols, cast(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM cell GROUP BY page"


def cell_texts(d: Dialect) -> str:
    """What stands in each cell: the drawings whose centre lies within it, by top then left edge; cells with none are left out."""
    return f"""
WITH {_grid(d)}, inside AS (SELECT k.page, r, c, p.id, p.y0 AS top, p.x0 AS edge FROM cell k JOIN drawings p ON p.page = k.page AND (p.x0 + p.x1) / 2e0 >= k.x0 AND (p.x0 + p.x1) / 2e0 < k.x1 AND (p.y0 + p.y1) / 2e0 >= k.y0 AND (p.y0 + p.y1) / 2e0 < k.y1)
SELECT page, cast(r AS BIGINT) AS r, cast(c AS BIGINT) AS c, {d.text(d.gather('cast(id AS STRING)', 'top, edge, id'), ' ')} AS held FROM inside GROUP BY page, r, c"""


def caption_links(d: Dialect) -> str:
    """Each caption-like line with its best box of the document: a shared width of a fifth, at most 90 away, nearest first, boxes above rather than below."""
    kind = f"CASE WHEN {_caption(d)} IS NOT NULL THEN {_caption(d)} WHEN {d.matches('text', '^[0-9]')} THEN 'numbered' END"
    wide = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) / cast(greatest(least(a.x1 - a.x0, b.x1 - b.x0), 1) AS DOUBLE)"
    away = "CASE WHEN b.y0 >= a.y1 THEN b.y0 - a.y1 WHEN a.y0 >= b.y1 THEN a.y0 - b.y1 ELSE 0 END"
    return f"""
WITH {boxes(d)}, k AS (SELECT *, {kind} AS kind FROM boxes),
j AS (SELECT a.doc_id, a.line_no, a.kind, b.line_no AS target, {wide} AS wide, {away} AS away, CASE WHEN b.y0 < a.y0 THEN 1 ELSE 0 END AS above FROM k a JOIN boxes b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no - 7 AND a.line_no + 7 AND b.line_no <> a.line_no WHERE a.kind IS NOT NULL),
s AS (SELECT *, round(0.45e0 + 0.25e0 * wide + 0.2e0 * (1 - away / 90e0) + 0.05e0 * above, 4) AS score FROM j WHERE wide >= 0.2e0 AND away <= 90),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY score DESC, target) AS rk FROM s) SELECT doc_id, line_no, kind, target, score FROM r WHERE rk = 1"""


def list_groups(d: Dialect) -> str:
    """List items in groups: a new one where lines lie between, the kind of marker changes, or the gap exceeds 35."""
    kind = f"CASE WHEN {d.matches('text', '^[•●○▪▫■□◦–—-][ ]+.')} THEN 'bullet' WHEN {d.matches('text', '^([0-9]+[.)]|[(][0-9]+[)])[ ]*.')} THEN 'number' WHEN {d.matches('text', '^([a-zA-Z][.)]|[(][a-zA-Z][)])[ ]+.')} THEN 'letter' END"
    return f"""
WITH {boxes(d)}, k AS (SELECT *, {kind} AS kind FROM boxes), l AS (SELECT *, lag(line_no) OVER w AS pl, lag(kind) OVER w AS pk, lag(y1) OVER w AS py FROM k WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
i AS (SELECT *, sum(CASE WHEN pl IS NULL OR line_no - pl > 2 OR kind <> pk OR y0 - py > 35 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS list_no FROM l)
SELECT doc_id, cast(list_no AS BIGINT) AS list_no, min(kind) AS kind, min(line_no) AS first_line, cast(count(*) AS BIGINT) AS items FROM i GROUP BY doc_id, list_no"""


def geometry(d: Dialect) -> str:
    """Boxes put in order and within a page of 400 by 700: width, height, area, centre, place on the page and zone."""
    return f"""
WITH {drawings(d)}, b AS (SELECT page, id, greatest(least(x0, x1), 0) AS x0, greatest(least(y0, y1), 0) AS y0, least(greatest(x0, x1), 400) AS x1, least(greatest(y0, y1), 700) AS y1 FROM drawings)
SELECT page, id, cast(x1 - x0 AS BIGINT) AS width, cast(y1 - y0 AS BIGINT) AS height, cast((x1 - x0) * (y1 - y0) AS BIGINT) AS area, (x0 + x1) / 2e0 AS cx, (y0 + y1) / 2e0 AS cy, round(x0 / 400e0, 4) AS rx, round(y0 / 700e0, 4) AS ry,
  CASE WHEN (y0 + y1) / 2e0 / 700 <= 0.12e0 THEN 'header' WHEN (y0 + y1) / 2e0 / 700 >= 0.88e0 THEN 'footer' ELSE 'body' END AS zone FROM b"""


def font_stats(d: Dialect) -> str:
    """Fonts (brands) with their sizes: least, most, mean, median and most frequent (the smallest of equals), and the role against the size of most texts: title from 1.5, heading from 1.2 or bold, else body."""
    return f"""
WITH c AS (SELECT p_brand AS font, p_size AS size, count(*) AS n FROM {d.t('part')} GROUP BY p_brand, p_size), m AS (SELECT font, size, row_number() OVER (PARTITION BY font ORDER BY n DESC, size) AS rk FROM c),
b AS (SELECT size AS body FROM (SELECT p_size AS size, row_number() OVER (ORDER BY count(*) DESC, p_size) AS rk FROM {d.t('part')} GROUP BY p_size) t WHERE rk = 1),
s AS (SELECT p_brand AS font, cast(min(p_size) AS BIGINT) AS least, cast(max(p_size) AS BIGINT) AS most, round(avg(cast(p_size AS DOUBLE)), 4) AS mean, cast(median(p_size) AS DOUBLE) AS middle, cast(count(*) AS BIGINT) AS n FROM {d.t('part')} GROUP BY p_brand)
SELECT s.font, least, most, mean, middle, n, cast(m.size AS BIGINT) AS usual, CASE WHEN m.size >= 1.5e0 * body THEN 'title' WHEN m.size >= 1.2e0 * body OR {d.matches('lower(s.font)', 'bold|black|heavy')} THEN 'heading' ELSE 'body' END AS role, {d.matches('lower(s.font)', 'italic|oblique')} AS italic
FROM s JOIN m ON s.font = m.font AND m.rk = 1 JOIN b ON 1 = 1"""


def title_candidates(d: Dialect) -> str:
    """Scores of the first lines of a document as its title: place, length, capitals, less for organisations and dates; the three best."""
    one = lambda test, v: f"CASE WHEN {test} THEN {v}e0 ELSE 0e0 END"
    score = " + ".join(["0.30e0", "0.20e0", one("line_no < 3", 0.12), one("x0 >= 70", 0.12), one(f"text = upper(text) AND {d.matches('text', r'\p{L}')}", 0.10), one("length(text) BETWEEN 10 AND 120", 0.08)])
    less = " - ".join(["", one(d.matches("lower(text)", r"^(bộ|sở|ủy ban|công ty|ministry|department)"), 0.15), one(d.matches("text", "[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}"), 0.10)])
    return f"""
WITH {boxes(d)}, s AS (SELECT doc_id, line_no, round(least(greatest({score}{less}, 0e0), 0.95e0), 4) AS score FROM boxes WHERE line_no < 12 AND length(text) <= 250),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS rk FROM s) SELECT doc_id, line_no, score, cast(rk AS BIGINT) AS rk FROM r WHERE rk <= 3"""


QUERIES = [text_regions, table_blocks, nearby_lines, position_clusters, baseline_lines, parallel_rules, page_columns, rounded_order, column_counts, grid_cells, cell_texts, caption_links, list_groups, geometry, font_stats, title_candidates]
