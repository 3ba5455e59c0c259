"""Semantics of table grids: header rows, row and column types, table types, continuation over tables of one customer."""

from __future__ import annotations

from folioforge.functions.dialect import Dialect
from folioforge.operators.tables import HEADERS, _numeric, cells

# Words that a header holds.
HEADER_WORDS = [
    "stt", "tt", "số", "so", "tên", "ten", "nội dung", "noi dung", "đơn vị", "don vi", "kết quả", "ket qua", "ghi chú", "ghi chu", "ngày", "tháng", "năm",
    "giá trị", "gia tri", "tỷ lệ", "ty le", "chỉ tiêu", "chi tieu", "mã", "ma", "loại", "loai", "tổng", "tong", "name", "value", "date", "total", "amount", "description",
]
# Column types in order, with the parts of a header that decide.
COLUMN_WORDS = {
    "index_column": ["stt", "tt", "so thu tu", "no", "number", "index"],
    "code_column": ["ma", "ma so", "code", "id", "identifier", "ky hieu"],
    "name_column": ["ten", "ho ten", "name", "title"],
    "description_column": ["noi dung", "mo ta", "dien giai", "description", "content"],
    "date_column": ["ngay", "thang", "nam", "date", "time", "period"],
    "organization_column": ["don vi", "co quan", "to chuc", "department", "agency", "organization"],
    "quantity_column": ["so luong", "sl", "quantity", "count"],
    "money_column": ["gia tri", "so tien", "kinh phi", "chi phi", "vnd", "vnđ", "amount", "cost", "price"],
    "percentage_column": ["ty le", "ti le", "%", "percentage", "rate"],
    "status_column": ["trang thai", "tinh trang", "status"],
    "note_column": ["ghi chu", "note", "remark"],
    "result_column": ["ket qua", "result", "outcome"],
}
TOTAL, SUBTOTAL = ["tong", "tong cong", "cong", "total", "grand total"], ["cong muc", "subtotal", "tieu tong", "nhom"]


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"instr({x}, '{w}') > 0" for w in words) + ")"


def _rows(d: Dialect) -> str:
    """CTEs cells, cl (cells with flags), rp (profile of each row) and hr (its header score)."""
    word = _any("lower(trim(text))", HEADER_WORDS)
    one = lambda test, v: f"CASE WHEN {test} THEN {v} ELSE 0 END"
    score = " + ".join(["0.20", one("r = 0", 0.15), one("filled >= greatest(1, floor(n_cols / 2))", 0.15), one("num * 4 <= n_cols", 0.20), one("(n_cols - filled) * 2 <= n_cols", 0.10), one("chars BETWEEN n_cols AND 80 * n_cols", 0.08), "least(0.20, hits * 0.06)"])
    return f"""{cells(d)}, cl AS (SELECT table_id, r, c, text, CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END AS f, CASE WHEN {_numeric(d, 'text')} THEN 1 ELSE 0 END AS num, CASE WHEN {word} THEN 1 ELSE 0 END AS hit FROM cells),
rp AS (SELECT table_id, r, count(*) AS n_cols, sum(f) AS filled, sum(num) AS num, sum(length(text)) AS chars, sum(hit) AS hits, {d.join('text', ' ', 'c')} AS row_text FROM cl GROUP BY table_id, r),
hr AS (SELECT *, round(cast(least({score}, 0.95) AS DOUBLE), 4) AS score FROM rp),
hd AS (SELECT *, r < 3 AND score >= 0.45 AND (r = 0 OR num * 4 <= n_cols AND hits > 0) AS is_header FROM hr)"""


def header_rows(d: Dialect) -> str:
    """Score of the first three rows of each table as headers; 0.45 is enough, below the first row only with a header word."""
    return f"WITH {_rows(d)} SELECT table_id, cast(r AS BIGINT) AS r, score, is_header FROM hd WHERE r < 3"


def row_types(d: Dialect) -> str:
    """Header, empty, total, subtotal, group, numeric or data row, with confidence."""
    text = d.match_words("row_text")
    cases = [("is_header", "header_row", 0.90), ("filled = 0", "empty_row", 0.95), (_any("n", TOTAL), "total_row", 0.80), (_any("n", SUBTOTAL), "subtotal_row", 0.75), ("filled = 1 AND num = 0", "group_row", 0.60), ("num * 10 >= filled * 6", "numeric_data_row", 0.70)]
    return f"""WITH {_rows(d)}, x AS (SELECT *, {text} AS n FROM hd)
SELECT table_id, cast(r AS BIGINT) AS r, CASE {' '.join(f"WHEN {t} THEN '{k}'" for t, k, _ in cases)} ELSE 'data_row' END AS row_type, cast(CASE {' '.join(f"WHEN {t} THEN {c}" for t, _, c in cases)} ELSE 0.65 END AS DOUBLE) AS confidence FROM x"""


def _columns(d: Dialect) -> str:
    """CTE col: header, shares of the first 30 filled body values, semantic type and data type of each column."""
    date = d.matches("text", r"(^|[^0-9])[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}([^0-9]|$)|(^|[^0-9])[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}([^0-9]|$)")
    money = f"({d.matches('lower(text)', 'vnđ|vnd|đ|[$]|usd')} OR ({_numeric(d, 'text')} AND {d.count('text', '[0-9]')} >= 5))"
    code = f"({d.matches('trim(text)', '^[A-Za-z0-9_./-]+$')} AND {d.matches('text', '[0-9]')})"
    share = lambda test: f"avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END)"
    kinds = " ".join(f"WHEN {_any('h', words)} THEN '{k}'" for k, words in COLUMN_WORDS.items())
    return f"""{cells(d)}, hdr AS (SELECT table_id, c, text AS header, {d.match_words('text')} AS h FROM cells WHERE r = 0),
body AS (SELECT table_id, c, text, row_number() OVER (PARTITION BY table_id, c ORDER BY r) AS k FROM cells WHERE r > 0 AND trim(text) <> ''),
vals AS (SELECT table_id, c, count(*) AS n, {share(date)} AS dates, {share("instr(text, '%') > 0")} AS pcts, {share(money)} AS money, {share(code)} AS codes, {share(_numeric(d, 'text'))} AS nums FROM body WHERE k <= 30 GROUP BY table_id, c),
col AS (SELECT hdr.table_id, hdr.c, header, coalesce(n, 0) AS n, CASE {kinds} WHEN dates >= 0.5 THEN 'date_column' WHEN pcts >= 0.4 THEN 'percentage_column' WHEN money >= 0.4 THEN 'money_column' WHEN codes >= 0.5 THEN 'code_column' WHEN nums >= 0.7 THEN 'numeric_column' WHEN hdr.c = 0 THEN 'row_label_column' ELSE 'text_column' END AS semantic_type,
  CASE WHEN {_any('h', ['ngay', 'date'])} THEN 'date' WHEN instr(header, '%') > 0 OR {_any('h', ['ty le', 'ti le', 'percentage'])} THEN 'percentage' WHEN {_any('h', ['vnd', 'vnđ', 'tien', 'amount', 'cost'])} THEN 'money' WHEN dates >= 0.5 THEN 'date' WHEN pcts >= 0.4 THEN 'percentage' WHEN money >= 0.4 THEN 'money' WHEN nums >= 0.7 THEN 'number' ELSE 'text' END AS data_type
  FROM hdr LEFT JOIN vals ON hdr.table_id = vals.table_id AND hdr.c = vals.c)"""


def column_semantics(d: Dialect) -> str:
    """Semantic and data type of every column: parts of its header, then its values, then its place."""
    return f"WITH {_columns(d)} SELECT table_id, cast(c AS BIGINT) AS c, header, semantic_type, data_type FROM col"


def table_types(d: Dialect) -> str:
    """Class of every table from the types of its columns."""
    has = lambda k: f"max(CASE WHEN semantic_type = '{k}_column' THEN 1 ELSE 0 END) = 1"
    return f"""WITH {_columns(d)} SELECT table_id, cast(count(*) AS BIGINT) AS n_columns, CASE WHEN {has('money')} THEN 'financial_table' WHEN {has('date')} AND ({has('status')} OR {has('result')}) THEN 'tracking_table'
  WHEN {has('percentage')} THEN 'metric_table' WHEN {has('code')} AND {has('name')} THEN 'master_data_table' WHEN count(*) <= 2 THEN 'simple_table' ELSE 'general_data_table' END AS semantic_class FROM col GROUP BY table_id"""


def cell_roles(d: Dialect) -> str:
    """Role of every cell: header, stub, numeric body, empty or body."""
    return f"""WITH {_rows(d)}, st AS (SELECT table_id, c, sum(num) * 100 <= count(*) * 35 AND c = 0 OR sum(num) * 5 <= count(*) AND sum(f) >= 2 AND c = 1 AS stub FROM cl WHERE r > 0 GROUP BY table_id, c)
SELECT cl.table_id, cast(cl.r AS BIGINT) AS r, cast(cl.c AS BIGINT) AS c, CASE WHEN hd.is_header THEN 'header' WHEN st.stub THEN 'stub' WHEN cl.num = 1 THEN 'numeric_body' WHEN cl.f = 0 THEN 'empty' ELSE 'body' END AS role
FROM cl JOIN hd ON cl.table_id = hd.table_id AND cl.r = hd.r LEFT JOIN st ON cl.table_id = st.table_id AND cl.c = st.c"""


def table_continuation(d: Dialect) -> str:
    """Score that a table goes on in the next table of the same customer: columns, shared header words, width, type, neighbourhood; 0.45 and more.

    Tables are orders, pages are their places in the customer's sequence. The width of a table is its longest row.
    """
    heads = d.array(*(f"'{h}'" for h in HEADERS))
    return f"""
WITH g AS (SELECT l_orderkey AS table_id, count(*) AS n_rows, {len(HEADERS)} AS n_cols, {heads} AS headers, max(length(cast(l_partkey AS STRING))) + 20 AS width FROM {d.t('lineitem')} GROUP BY l_orderkey),
t AS (SELECT o_custkey, g.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM g JOIN {d.t('orders')} ON o_orderkey = table_id),
p AS (SELECT a.o_custkey, a.table_id, b.table_id AS next_id, cast(least(a.n_cols, b.n_cols) AS DOUBLE) / greatest(a.n_cols, b.n_cols) AS cols, cast({d.size(d.common('a.headers', 'b.headers'))} AS DOUBLE) / (a.n_cols + b.n_cols - {d.size(d.common('a.headers', 'b.headers'))}) AS heads,
  cast(least(a.width, b.width) AS DOUBLE) / greatest(a.width, b.width) AS widths FROM t a JOIN t b ON a.o_custkey = b.o_custkey AND b.page = a.page + 1),
s AS (SELECT *, round(least(CASE WHEN cols >= 0.70 THEN 0.25 * cols ELSE 0 END + CASE WHEN heads >= 0.40 THEN 0.25 * heads ELSE 0 END + CASE WHEN widths >= 0.60 THEN 0.15 * widths ELSE 0 END + CASE WHEN widths >= 0.50 THEN 0.15 ELSE 0 END + 0.05 + 0.05, 0.95), 4) AS score FROM p)
SELECT o_custkey, table_id, next_id, score FROM s WHERE score >= 0.45"""


def column_spans(d: Dialect) -> str:
    """Column spans: a filled cell and the run of empty cells to its right, at most 8 columns."""
    return f"""
WITH {cells(d)}, g AS (SELECT table_id, r, c, sum(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY table_id, r ORDER BY c ROWS UNBOUNDED PRECEDING) AS island FROM cells),
s AS (SELECT table_id, r, min(c) AS first_col, count(*) AS n FROM g WHERE island > 0 GROUP BY table_id, r, island)
SELECT table_id, cast(r AS BIGINT) AS r, cast(first_col AS BIGINT) AS first_col, cast(least(n, 8) AS BIGINT) AS col_span FROM s WHERE n > 1"""


QUERIES = [header_rows, row_types, column_semantics, table_types, cell_roles, table_continuation, column_spans]
