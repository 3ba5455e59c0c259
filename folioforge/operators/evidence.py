"""Knowledge for answers: page and section evidence, citations with their checks, chunk trees, table chunks, relations, prompts."""

from __future__ import annotations

import re

from folioforge.functions.dialect import Dialect
from folioforge.operators.pages import _packed, _with, virtual_pages
from folioforge.operators.retrieval import _search
from folioforge.operators.tables import cells
from folioforge.operators.text import lines

# Weight of each check of a citation.
CHECKS = {"quote_in_page": 3.0, "page_reference": 1.5, "evidence_reference": 1.5, "chunk_reference": 1.2, "table_reference": 1.2, "source_consistency": 1.7, "bbox": 0.5}
#: Checks that do not count where there is nothing to check.
OPTIONAL = ("evidence_reference", "chunk_reference", "table_reference", "bbox")
# Forms of citation markers, in the order in which they are looked for.
MARKERS = (r"\[tr[.] *[0-9][^\]]*\]", r"\[p[.] *[0-9][^\]]*\]", r"\[page +[0-9][^\]]*\]", r"\[[0-9]+\]", r"【[^】]+】")


def combine_checks(checks: dict[str, tuple[str, float]]) -> float:
    """Weighted mean of the checks' (status, score); optional ones whose status begins with ``no_`` are left out."""
    used = [(CHECKS.get(k, 1.0), score) for k, (status, score) in checks.items() if not (k in OPTIONAL and status.startswith("no_"))]
    return sum(w * s for w, s in used) / sum(w for w, _ in used) if used else 0.0


def record_key(header: str) -> str:
    """Header as a key: match form with underscores."""
    return re.sub(r"[^a-z0-9]+", "_", header.lower()).strip("_")


def page_evidence(d: Dialect) -> str:
    """The first three pieces of each text: lines packed to 1,200 characters without overlap, of 60 and more; confidence 0.60, weight 0.85."""
    text = "coalesce(text, '')"
    units = f"SELECT doc_id, {d.lines(text)} AS us FROM {d.t('documents')}"
    piece = f"trim({d.text('texts', chr(92) + 'n')})" if d.spark else "trim(array_to_string(texts, chr(10)))"
    return f"""{_with(d)} {_packed(d, units, 1200, 1, 0)}, v AS (SELECT doc_id, no, length({piece}) AS n, {d.sha(piece)} AS digest FROM packed), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS rk FROM v WHERE n >= 60)
SELECT doc_id, cast(rk AS BIGINT) AS piece, cast(n AS BIGINT) AS n_chars, digest, 0.6e0 AS confidence, 0.85e0 AS weight FROM k WHERE rk <= 3"""


def _sections(d: Dialect) -> str:
    """CTE sect(doc_id, section, line_no, text, k): lines under the short line that begins their section."""
    head = f"length(text) <= 60 AND NOT {d.matches('text', '[.;:,]$')}"
    return f"""{lines(d)}, hd AS (SELECT *, {head} AS head FROM lines), sc AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM hd),
sect AS (SELECT doc_id, section, line_no, text, head, row_number() OVER (PARTITION BY doc_id, section ORDER BY line_no) AS k FROM sc)"""


def section_evidence(d: Dialect) -> str:
    """One piece of evidence per section: its title and first two paragraphs."""
    nl = "'\\n'" if d.spark else "chr(10)"
    joined = f"{d.join('text', '|', 'line_no')}"
    return f"WITH {_sections(d)} SELECT doc_id, cast(section AS BIGINT) AS section, {joined} AS body, length(concat({nl}, {joined})) - 1 AS n_chars FROM sect WHERE k <= 3 GROUP BY doc_id, section"


def section_chunks(d: Dialect) -> str:
    """A chunk per section: title and lines; its size, whether it is long (over 2,600 characters, to be split) or too short (under 80 characters and 8 words)."""
    words = d.count("text", r"\S+")
    return f"""
WITH {_sections(d)}, g AS (SELECT doc_id, section, min(line_no) AS first_line, max(line_no) AS last_line, cast(sum(length(text) + 2) - 2 AS BIGINT) AS n_chars, cast(sum({words}) AS BIGINT) AS n_words, max(CASE WHEN head THEN text END) AS title FROM sect GROUP BY doc_id, section)
SELECT doc_id, cast(section AS BIGINT) AS section, title, first_line, last_line, n_chars, n_words, n_chars > 2600 AS long_chunk, n_chars >= 80 OR n_words >= 8 AS valid FROM g"""


def parent_chunks(d: Dialect) -> str:
    """Parent chunks by section: first 20 characters of each child joined, its children in order, the least of their orders."""
    return f"""
WITH {_sections(d)}, c AS (SELECT doc_id, section, line_no, substr(text, 1, 20) AS preview FROM sect WHERE length(text) >= 40)
SELECT doc_id, cast(section AS BIGINT) AS section, min(line_no) AS first_order, cast(count(*) AS BIGINT) AS n_children, {d.join('preview', '|', 'line_no')} AS preview, {d.join('cast(line_no AS STRING)', ',', 'line_no')} AS children FROM c GROUP BY doc_id, section"""


def relations(d: Dialect) -> str:
    """Links between consecutive pieces of one section, and between the first pieces of consecutive sections."""
    return f"""
WITH {_sections(d)}, p AS (SELECT doc_id, section, line_no AS a, lead(line_no) OVER (PARTITION BY doc_id, section ORDER BY line_no) AS b FROM sect),
s AS (SELECT doc_id, line_no AS a, lead(line_no) OVER (PARTITION BY doc_id ORDER BY section) AS b FROM sect WHERE k = 1)
SELECT doc_id, a, b, 'same_section' AS kind, 0.75e0 AS confidence FROM p WHERE b IS NOT NULL UNION ALL SELECT doc_id, a, b, 'next_section', 0.75e0 FROM s WHERE b IS NOT NULL"""


def page_edges(d: Dialect) -> str:
    """Edges from each virtual page to the next one, of weight 0.20, and from the document to its pages, of weight 1."""
    p = f"SELECT doc_id, page_number, lead(page_number) OVER (PARTITION BY doc_id ORDER BY page_number) AS next_page FROM ({virtual_pages(d)}) v"
    return f"SELECT doc_id, page_number AS src, next_page AS dst, 'NEXT_PAGE' AS kind, 0.2e0 AS weight FROM ({p}) q WHERE next_page IS NOT NULL UNION ALL SELECT doc_id, cast(0 AS BIGINT), page_number, 'HAS_PAGE', 1e0 FROM ({virtual_pages(d)}) w"


def section_pages(d: Dialect) -> str:
    """Pages (of 20 lines) of each section: from its first line to the last page before the next section begins, the same page if that begins there."""
    return f"""
WITH {_sections(d)}, l AS (SELECT doc_id, cast(floor(max(line_no) / 20e0) + 1 AS BIGINT) AS pages FROM lines GROUP BY doc_id),
f AS (SELECT doc_id, section, cast(floor(line_no / 20e0) + 1 AS BIGINT) AS page_start FROM sect WHERE k = 1), n AS (SELECT *, lead(page_start) OVER (PARTITION BY doc_id ORDER BY section) AS following FROM f)
SELECT n.doc_id, cast(section AS BIGINT) AS section, page_start, CASE WHEN following IS NULL THEN pages WHEN following = page_start THEN page_start ELSE following - 1 END AS page_end FROM n JOIN l ON n.doc_id = l.doc_id"""


def section_of_page(d: Dialect) -> str:
    """The section of every page: of those whose pages hold it, the last; paragraphs take the first, a page's chunk the last."""
    pages = "sequence(page_start, greatest(page_start, page_end))" if d.spark else "range(page_start, greatest(page_start, page_end) + 1)"
    each = d.explode(f"({section_pages(d)}) s", "doc_id, section", pages, "p", "page")
    return f"SELECT doc_id, page, max(section) AS chunk_section, min(section) AS paragraph_section FROM ({each}) e GROUP BY doc_id, page"


def table_chunks(d: Dialect) -> str:
    """Texts of each table: a summary (name, columns, first 20 records) and its number of records."""
    return f"""
WITH {cells(d)}, h AS (SELECT table_id, {d.join('text', ', ', 'c')} AS columns FROM cells WHERE r = 0 GROUP BY table_id),
b AS (SELECT table_id, r, {d.join('text', ' | ', 'c')} AS record FROM cells WHERE r BETWEEN 1 AND 20 AND trim(text) <> '' GROUP BY table_id, r), n AS (SELECT table_id, cast(max(r) AS BIGINT) AS n_records FROM cells GROUP BY table_id),
s AS (SELECT table_id, {d.join('record', '; ', 'r')} AS records FROM b GROUP BY table_id)
SELECT h.table_id, n_records, {d.sha("concat('Table ', cast(h.table_id AS STRING), '. Columns: ', columns, '. Records: ', records)")} AS digest, cast(length(records) AS BIGINT) AS n_chars FROM h JOIN s ON h.table_id = s.table_id JOIN n ON h.table_id = n.table_id"""


def record_keys(d: Dialect) -> str:
    """Keys of the table headers: match form with underscores, numbered from the second of equal ones on."""
    key = f"trim(BOTH '_' FROM {d.replace(d.match_words('text'), '[^a-z0-9]+', '_')})"
    return f"WITH {cells(d)}, k AS (SELECT table_id, c, {key} AS name FROM cells WHERE r = 0) SELECT table_id, cast(c AS BIGINT) AS c, name, cast(row_number() OVER (PARTITION BY table_id, name ORDER BY c) AS BIGINT) AS nth FROM k"


def cell_contexts(d: Dialect) -> str:
    """Every filled body cell with its row's first cell and its column's header."""
    return f"""
WITH {cells(d)}, h AS (SELECT table_id, c, text AS header FROM cells WHERE r = 0), s AS (SELECT table_id, r, text AS stub FROM cells WHERE c = 0 AND r > 0)
SELECT x.table_id, cast(x.r AS BIGINT) AS r, cast(x.c AS BIGINT) AS c, concat(stub, ' / ', header, ': ', text) AS context FROM cells x JOIN h ON h.table_id = x.table_id AND h.c = x.c JOIN s ON s.table_id = x.table_id AND s.r = x.r WHERE x.r > 0 AND x.c > 0 AND trim(text) <> ''"""


def _cited(d: Dialect) -> str:
    """CTE cited(item_id, doc_id, page, marker): pages (hundreds of ids) of the documents found, with their markers."""
    return f"""{_search(d)}, cited AS (SELECT item_id, doc_id, cast(floor(doc_id / 100e0) + 1 AS BIGINT) AS page, concat('[tr.', cast(cast(floor(doc_id / 100e0) + 1 AS BIGINT) AS STRING), ']') AS marker FROM r WHERE rk <= 10)"""


def citation_order(d: Dialect) -> str:
    """Citations by page and document, numbered; the second of equal markers gets .2 within the bracket, and so on."""
    return f"""
WITH {_cited(d)}, o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY page, doc_id) AS rk, row_number() OVER (PARTITION BY item_id, marker ORDER BY page, doc_id) AS nth FROM cited)
SELECT item_id, cast(rk AS BIGINT) AS rk, doc_id, page, CASE WHEN nth = 1 THEN marker ELSE concat(substr(marker, 1, length(marker) - 1), '.', cast(nth AS STRING), ']') END AS marker FROM o"""


def citation_markers(d: Dialect) -> str:
    """Which citation a marker names: the last one wins; labels of single pages and of ranges."""
    return f"""
WITH {_cited(d)}, o AS (SELECT *, row_number() OVER (PARTITION BY item_id, marker ORDER BY doc_id DESC) AS back FROM cited), g AS (SELECT item_id, min(page) AS low, max(page) AS high FROM cited GROUP BY item_id)
SELECT o.item_id, marker, doc_id, CASE WHEN low = high THEN concat('trang ', cast(low AS STRING)) ELSE concat('trang ', cast(low AS STRING), '-', cast(high AS STRING)) END AS label FROM o JOIN g ON o.item_id = g.item_id WHERE back = 1"""


def marker_mentions(d: Dialect) -> str:
    """Citation markers that texts mention, by kind in order."""
    every = d.explode(d.t("documents"), "doc_id", d.tagged([(str(k), f"({p})") for k, p in enumerate(MARKERS)], "lower(coalesce(text, ''))"), "p", "hit")
    return f"SELECT doc_id, hit, cast(count(*) AS BIGINT) AS n FROM ({every}) e GROUP BY doc_id, hit"


def citation_checks(d: Dialect) -> str:
    """Checks of each citation put together: quote (exact 0.95, shared words), page (known or not), box (inside its page within 10, size unknown, outside, invalid), weighted mean and status."""
    words = lambda x: d.find_all(x, "[^ ]+")
    w = {k: f"{v}e0" for k, v in CHECKS.items()}
    box = "CASE WHEN n_chars IS NULL OR n_chars < 0 THEN 0e0 WHEN n_chars = 0 THEN 0.35e0 WHEN n_chars <= 4000 + 10 THEN 0.6e0 ELSE 0.2e0 END"
    share = f"cast({d.size(d.common(d.distinct(words('q')), d.distinct(words('s'))))} AS DOUBLE) / greatest({d.size(d.distinct(words('q')))}, 1)"
    return f"""
WITH {_cited(d)}, k AS (SELECT c.item_id, c.doc_id, c.page, m.n_chars, {d.match_words('b.text')} AS q, {d.match_words('m.text')} AS s FROM cited c JOIN {d.t('documents')} m ON m.doc_id = c.doc_id JOIN {d.t('benchmark')} b ON b.item_id = c.item_id),
f AS (SELECT *, {share} AS share, q <> '' AND instr(s, q) > 0 AS exact FROM k),
x AS (SELECT item_id, doc_id, CASE WHEN exact THEN 0.95e0 WHEN share >= 0.55e0 THEN 0.6e0 + least(share, 0.35e0) ELSE 0e0 END AS quote, CASE WHEN page <= 5 THEN 0.55e0 WHEN page <= 8 THEN 0.4e0 ELSE 0e0 END AS known, {box} AS box, exact, share FROM f)
SELECT item_id, doc_id, round((quote * {w['quote_in_page']} + known * {w['page_reference']} + box * {w['bbox']}) / ({w['quote_in_page']} + {w['page_reference']} + {w['bbox']}), 6) AS score, CASE WHEN exact THEN 'verified' WHEN share >= 0.55e0 THEN 'partially_verified' WHEN known > 0e0 THEN 'page_only' ELSE 'unverified' END AS status FROM x"""


def embedding_texts(d: Dialect) -> str:
    """Every text cut for embedding to 4,000 characters at the last line end or blank after six tenths of them."""
    head = "substr(s, 1, 4000)"
    back = f"4000 - length({d.extract(head, '([^ ]*)$')})"
    return f"""
WITH n AS (SELECT doc_id, {d.tidy('text')} AS s FROM {d.t('documents')}), c AS (SELECT doc_id, s, CASE WHEN length(s) <= 4000 THEN length(s) WHEN {back} > 2400 THEN {back} ELSE 4000 END AS cut FROM n)
SELECT doc_id, cast(cut AS BIGINT) AS cut, {d.sha('trim(substr(s, 1, cast(cut AS INT)))')} AS digest FROM c"""


def first_keywords(d: Dialect) -> str:
    """The first eight distinct tokens of every text, in order of appearance."""
    toks = d.distinct(d.find_all(d.match("text"), "[a-z0-9_]{3,}"))
    if d.spark:
        return f"SELECT doc_id, array_join(slice({toks}, 1, 8), ' ') AS keywords FROM {d.t('documents')}"
    every = d.explode(f"(SELECT doc_id, {d.match('text')} AS n FROM documents) s", "doc_id", d.find_all("n", "[a-z0-9_]{3,}"), "p", "term")
    return f"""
WITH t AS (SELECT doc_id, term, min(p) AS p FROM ({every}) e GROUP BY doc_id, term), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS rk FROM t)
SELECT documents.doc_id, coalesce(string_agg(term, ' ' ORDER BY p), '') AS keywords FROM documents LEFT JOIN r ON r.doc_id = documents.doc_id AND rk <= 8 GROUP BY documents.doc_id"""


def numeric_overlap(d: Dialect) -> str:
    """Share of the distinct numbers (with % and units) of each item that a document holds; of pairs that share one."""
    forms = "[0-9]+(?:[.,][0-9]+)*%?"
    every = lambda table, key: d.explode(f"(SELECT {key}, {d.find_all('lower(coalesce(text, ' + chr(39) + chr(39) + '))', forms)} AS ns FROM {d.t(table)}) s", key, "ns", "p", "number")
    return f"""
WITH q AS (SELECT DISTINCT item_id, number FROM ({every('benchmark', 'item_id')}) a), t AS (SELECT DISTINCT doc_id, number FROM ({every('documents', 'doc_id')}) b), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id)
SELECT q.item_id, t.doc_id, round(cast(count(*) AS DOUBLE) / max(n.n), 4) AS overlap FROM q JOIN t ON q.number = t.number JOIN n ON n.item_id = q.item_id GROUP BY q.item_id, t.doc_id"""


def prompts(d: Dialect) -> str:
    """The prompt of each query: instruction by the language of the query, the question, and the numbered documents found; its size and digest."""
    viet = d.matches("lower(b.text)", "[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]")
    said = f"CASE WHEN {viet} THEN 'Trả lời bằng tiếng Việt, chỉ dựa vào ngữ cảnh.' ELSE 'Answer from the context only.' END"
    return f"""
WITH {_search(d)}, c AS (SELECT item_id, {d.join("concat('[', cast(rk AS STRING), '] ', cast(doc_id AS STRING))", ' ', 'rk')} AS context FROM r WHERE rk <= 10 GROUP BY item_id)
SELECT b.item_id, {d.sha(f"concat({said}, ' Q: ', {d.tidy('b.text')}, ' C: ', coalesce(context, ''))")} AS digest, cast(length(coalesce(context, '')) AS BIGINT) AS n_context FROM {d.t('benchmark')} b LEFT JOIN c ON b.item_id = c.item_id WHERE b.item_id % 100 = 0"""


QUERIES = [page_evidence, section_evidence, section_chunks, parent_chunks, relations, page_edges, section_pages, section_of_page, table_chunks, record_keys, cell_contexts, citation_order, citation_markers, marker_mentions, citation_checks, embedding_texts, first_keywords, numeric_overlap, prompts]
