"""Entities, references, continuation of paragraphs, contents lines, captions and page profiles."""

from __future__ import annotations

from folioforge.functions.dialect import Dialect
from folioforge.operators.tables import boxes
from folioforge.operators.text import lines

# Words that carry a sentence on over a page break.
CONNECTORS = "và|hoặc|của|với|theo|tại|trong|để|do|khi|nếu|gồm|bao gồm|là"
LEGAL = r"Nghị\s*quyết|Nghị\s*định|Quyết\s*định|Thông\s*tư|Luật|Chỉ\s*thị|Công\s*văn"
LEGAL_SUFFIX = "QĐ|NĐ|TT|CT|CV|NQ|CP|TTg|BCT|BTC|BTTTT|KTNN|UBND"
NAME = r"[A-ZĐĂÂÊÔƠƯa-zđăâêôơư0-9&,\-\s]{2,120}"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
URL = r"(?:https?://|www\.)[A-Za-z0-9\-._~:/?#\[\]@!$&\x27()*+,;=%]+"
CODE = r"[0-9A-ZĐa-zđ/\-.]+"
# Entity type, confidence, whether case counts, pattern.
ENTITIES = (
    ("legal_document", 0.80, False, rf"(?:{LEGAL})\s+(?:số\s*)?{CODE}"),
    ("legal_document", 0.75, False, rf"[0-9]{{1,5}}/(?:{LEGAL_SUFFIX})[\-/A-ZĐa-zđ0-9]*"),
    ("decision", 0.82, False, rf"(?:Quyết\s*định|QĐ)\s+(?:số\s*)?{CODE}"),
    ("decree", 0.82, False, rf"(?:Nghị\s*định|NĐ)\s+(?:số\s*)?{CODE}"),
    ("circular", 0.82, False, rf"(?:Thông\s*tư|TT)\s+(?:số\s*)?{CODE}"),
    ("law", 0.70, False, r"Luật\s+[A-ZĐĂÂÊÔƠƯa-zđăâêôơư0-9\s,\-]{3,120}"),
    ("date", 0.75, False, r"[0-9]{1,2}[/\-][0-9]{1,2}[/\-][0-9]{2,4}"),
    ("date", 0.85, False, r"ngày\s+[0-9]{1,2}\s+tháng\s+[0-9]{1,2}\s+năm\s+[0-9]{4}"),
    ("date", 0.65, False, r"20[0-9]{2}\s*[-–]\s*20[0-9]{2}"),
    ("money", 0.80, False, r"[0-9][0-9.,]*\s*(?:VNĐ|VND|đồng|đ)"),
    ("money", 0.75, False, r"[0-9][0-9.,]*\s*(?:tỷ|triệu|nghìn|ngàn)\s*(?:đồng|VNĐ|VND)?"),
    ("money", 0.75, False, r"(?:[$]|USD\s*)\s*[0-9][0-9.,]*|[0-9][0-9.,]*\s*USD"),
    ("percentage", 0.80, False, r"[0-9]+(?:[,.][0-9]+)?\s*%"),
    ("percentage", 0.75, False, r"[0-9]+(?:[,.][0-9]+)?\s*phần\s*trăm"),
    ("organization", 0.70, False, rf"(?:Bộ|Cục|Vụ|Sở|Ban|Ủy\s*ban|UBND|HĐND|Kiểm\s*toán\s*nhà\s*nước|KTNN)\s+{NAME}"),
    ("organization", 0.68, False, rf"(?:Công\s*ty|Tổng\s*công\s*ty|Tập\s*đoàn|Doanh\s*nghiệp|Trung\s*tâm|Bệnh\s*viện|Viện)\s+{NAME}"),
    ("organization", 0.45, True, r"[A-ZĐ]{2,10}(?:-[A-ZĐ0-9]{2,10})?"),
    ("email", 0.90, True, EMAIL),
    ("url", 0.88, True, URL),
    ("code", 0.55, True, r"[A-ZĐ0-9]{2,}[/\-][A-ZĐ0-9/\-]{2,}"),
    ("code", 0.55, True, r"[A-Z]{2,8}[-_][0-9]{2,8}(?:[-_][A-Z0-9]{2,8})?"),
    ("table_reference", 0.75, False, r"(?:Bảng|Bang|Table)\s+[0-9]+(?:\.[0-9]+)*"),
    ("section_reference", 0.70, False, r"(?:Mục|Phần|Chương|Điều|Khoản)\s+[IVXLC0-9]+(?:\.[0-9]+)*"),
)
# Reference type, confidence, pattern.
REFERENCES = (
    ("page_reference", 0.80, r"trang\s+[0-9]{1,5}"),
    ("page_reference", 0.75, r"(?:page|p\.)\s*[0-9]{1,5}"),
    ("section_reference", 0.78, r"Chương\s+[IVXLC0-9]+(?:\.[0-9]+)*"),
    ("section_reference", 0.76, r"Phần\s+[IVXLC0-9]+(?:\.[0-9]+)*"),
    ("section_reference", 0.75, r"Mục\s+[IVXLC0-9]+(?:\.[0-9]+)*"),
    ("section_reference", 0.70, r"section\s+[0-9]+(?:\.[0-9]+)*"),
    ("article_reference", 0.78, r"(?:Điều|Article)\s+[0-9]+[A-Za-z]?"),
    ("clause_reference", 0.74, r"(?:Khoản|Clause)\s+[0-9]+[A-Za-z]?"),
    ("clause_reference", 0.65, r"điểm\s+[a-z]"),
    ("table_reference", 0.82, r"(?:Bảng|Bang)\s+[0-9]+(?:\.[0-9]+)*"),
    ("table_reference", 0.78, r"Table\s+[0-9]+(?:\.[0-9]+)*"),
    ("figure_reference", 0.78, r"(?:Hình|Hinh|Sơ\s*đồ|So\s*do|Figure|Fig\.)\s+[0-9]+(?:\.[0-9]+)*"),
    ("legal_document_reference", 0.80, rf"(?:{LEGAL})\s+(?:số\s*)?{CODE}"),
    ("email_reference", 0.90, EMAIL),
    ("url_reference", 0.88, URL),
)
GUARD = r"(?:^|[^\p{L}\p{N}_])"
#: Kinds whose patterns may end within a word, as their last part takes in all that follows.
OPEN_ENDED = ("decision", "decree", "circular", "law", "url", "url_reference", "legal_document_reference")


def _whole(d: Dialect, kind: str, pattern: str) -> str:
    """The end of a pattern that must be the end of a word; DuckDB has no look-ahead and takes the next character in."""
    if kind in OPEN_ENDED or pattern.endswith(("%", NAME, CODE)):
        return ""
    return r"(?![\p{L}\p{N}_])" if d.spark else r"(?:[^\p{L}\p{N}_]|$)"


def entity_rules(d: Dialect) -> list[tuple[str, str]]:
    return [(f"{kind}|{c}", (GUARD if case else d.ci(GUARD)) + f"({p})" + _whole(d, kind, p)) for kind, c, case, p in ENTITIES]


def _entities(d: Dialect) -> str:
    """CTE found(doc_id, kind, confidence, entity, n): entities by the match form of their text."""
    every = d.explode(d.t("documents"), "doc_id", d.tagged(entity_rules(d), "coalesce(text, '')"), "p", "hit")
    return f"""hits AS (SELECT doc_id, split_part(hit, '|', 1) AS kind, cast(split_part(hit, '|', 2) AS DOUBLE) AS confidence, {d.match("substr(hit, length(split_part(hit, '|', 1)) + length(split_part(hit, '|', 2)) + 3)")} AS entity FROM ({every}) e),
found AS (SELECT doc_id, kind, max(confidence) AS confidence, entity, cast(count(*) AS BIGINT) AS n FROM hits WHERE entity <> '' GROUP BY doc_id, kind, entity)"""


def entities(d: Dialect) -> str:
    """Entities of each document with their occurrences. Case counts for abbreviations, so that words are not organisations."""
    return f"WITH {_entities(d)} SELECT doc_id, kind, entity, n, confidence FROM found"


def _links(d: Dialect) -> str:
    return f"""{_entities(d)}, links AS (SELECT kind, entity, cast(sum(n) AS BIGINT) AS occurrences, cast(count(*) AS BIGINT) AS documents, min(doc_id) AS first_doc, max(doc_id) AS last_doc, max(confidence) AS confidence
  FROM found GROUP BY kind, entity HAVING sum(n) >= 2 AND count(*) >= 2)"""


def entity_links(d: Dialect) -> str:
    """Entities that occur at least twice, in at least two documents."""
    return f"WITH {_links(d)} SELECT * FROM links"


def entity_network(d: Dialect) -> str:
    """Edges of weight 0.65 from each linked entity to its documents."""
    return f"WITH {_links(d)} SELECT concat(f.kind, ':', f.entity) AS src, concat('document:', cast(f.doc_id AS STRING)) AS dst, cast(0.65 AS DOUBLE) AS weight, f.confidence FROM found f JOIN links l ON f.kind = l.kind AND f.entity = l.entity"


def references(d: Dialect) -> str:
    """References of each document, their key (the last number or letter), and whether a numbered line of the document carries that key."""
    rules = [(f"{kind}|{c}", d.ci(GUARD + f"({p})" + _whole(d, kind, p))) for kind, c, p in REFERENCES]
    every = d.explode(d.t("documents"), "doc_id", d.tagged(rules, "coalesce(text, '')"), "p", "hit")
    return f"""
WITH {lines(d)}, h AS (SELECT doc_id, split_part(hit, '|', 1) AS kind, cast(split_part(hit, '|', 2) AS DOUBLE) AS confidence, {d.match("substr(hit, length(split_part(hit, '|', 1)) + length(split_part(hit, '|', 2)) + 3)")} AS reference FROM ({every}) e),
r AS (SELECT doc_id, kind, reference, {d.extract('reference', '([^ ]+)$')} AS target, max(confidence) AS confidence, cast(count(*) AS BIGINT) AS n FROM h WHERE reference <> '' GROUP BY doc_id, kind, reference),
k AS (SELECT DISTINCT doc_id, {d.extract('text', '^([0-9]+([.][0-9]+)*)')} AS number FROM lines WHERE {d.matches('text', '^[0-9]+([.][0-9]+)*[.)]? +.')})
SELECT r.doc_id, kind, reference, target, n, number IS NOT NULL AS resolved, round(least(confidence + CASE WHEN number IS NOT NULL THEN 0.10 ELSE 0 END, 0.95), 4) AS confidence
FROM r LEFT JOIN k ON r.doc_id = k.doc_id AND r.target = k.number AND r.kind IN ('section_reference', 'article_reference', 'clause_reference')"""


def paragraph_continuation(d: Dialect) -> str:
    """Score that a turn of a conversation goes on in the next one: marks, connectors, case, shared words, headings; 0.35 and more."""
    heading = r"^(CHƯƠNG|Chương|PHẦN|Phần)\s+[IVXLC0-9]+|^[IVXLC]+\.\s+|^[0-9]+(\.[0-9]+)*[.)]\s+[A-ZĐĂÂÊÔƠƯ]|^[A-ZĐĂÂÊÔƠƯ][A-ZĐĂÂÊÔƠƯ\s,\-:]{8,}$"
    tail_word, head_word = d.ci(rf"(^|[^\p{{L}}])({CONNECTORS})$"), d.ci(rf"^({CONNECTORS})([^\p{{L}}]|$)")
    table = r"\t|\||\s{3,}"
    m = d.matches
    mark = f"CASE WHEN {m('a', '[-–]$')} THEN 0.22 WHEN {m('a', r'[,;:(\[{]$')} THEN 0.22 WHEN {m('a', '([.!?]”?|\")$')} THEN -0.15 WHEN {m('a', tail_word)} THEN 0.25 ELSE 0.18 END"
    start = f"CASE WHEN {m('b', r'^\p{Ll}')} THEN 0.22 WHEN {m('b', r'^[,;:)\]]')} THEN 0.18 WHEN {m('b', head_word)} THEN 0.20 WHEN {m('b', r'^[0-9]+[.)]\s+')} THEN -0.10 WHEN {m('b', heading)} THEN -0.20 ELSE 0.05 END"
    shared = f"{d.size(d.common('ta', 'tb'))}"
    fresh = f"{m('b', r'^([0-9]+(\.[0-9]+)*[.)]|[a-zA-Z][.)]|[-•–])\s+')} OR {m('b', r'^\p{Lu}')}"
    return f"""
WITH n AS (SELECT conv_id, turn, {d.tidy('text')} AS a, lead({d.tidy('text')}) OVER w AS b, lead(turn) OVER w AS next_turn FROM {d.t('conversations')} WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
t AS (SELECT *, {d.distinct(d.find_all(d.match_words('a'), '[^ ]+'))} AS ta, {d.distinct(d.find_all(d.match_words('b'), '[^ ]+'))} AS tb FROM n WHERE b IS NOT NULL AND length(a) >= 8 AND length(b) >= 3),
o AS (SELECT *, cast({shared} AS DOUBLE) / greatest(least({d.size('ta')}, {d.size('tb')}), 1) AS share FROM t),
s AS (SELECT conv_id, turn, next_turn, CASE WHEN next_turn = turn + 1 THEN 0.08 ELSE 0.0 END + {mark} + {start} + CASE WHEN {m('a', '[-–]$')} THEN 0.20 ELSE 0.0 END
  + CASE WHEN {m('a', '[,;:–-]$')} OR {m('a', tail_word)} OR {m('b', r'^\p{Ll}')} THEN 0.12 ELSE 0.0 END - CASE WHEN {m('a', '[.!?][”\"]?$')} AND ({fresh}) THEN 0.20 ELSE 0.0 END
  - CASE WHEN {m('b', heading)} THEN 0.25 ELSE 0.0 END - CASE WHEN {m('a', table)} OR {m('b', table)} THEN 0.15 ELSE 0.0 END AS fixed, CASE WHEN share >= 0.15 THEN round(least(0.10, share * 0.20), 4) ELSE 0 END AS lexical FROM o)
SELECT conv_id, turn, next_turn, round(least(greatest(cast(fixed AS DOUBLE) + lexical, 0), 0.95), 4) AS score FROM s WHERE round(cast(fixed AS DOUBLE) + lexical, 4) >= 0.35"""


def toc_lines(d: Dialect) -> str:
    """Lines of a table of contents: section number, target page, level and confidence."""
    prefix = r"^([0-9]+(?:\.[0-9]+)*\.?|[IVXLCDM]+\.)\s+"
    return f"""
WITH {lines(d)}, e AS (SELECT doc_id, line_no, text, {d.extract('text', prefix)} AS prefix, {d.extract('text', r'([0-9]{1,4})$')} AS page, {d.matches('text', r'\.\.|…')} AS leader FROM lines
  WHERE length(text) <= 240 AND {d.matches('text', r'\S.*(\.\.+|…|\s)\s*[0-9]{1,4}$')}),
f AS (SELECT *, {d.replace(d.replace('text', prefix, ''), r'\s*[.…]*\s*[0-9]{1,4}$', '')} AS title FROM e WHERE prefix <> '' OR leader)
SELECT doc_id, line_no, prefix AS section_number, cast(page AS BIGINT) AS target_page, title, CASE WHEN prefix = '' THEN 1 ELSE {d.count(d.replace('prefix', r'\.$', ''), r'\.')} + 1 END AS level,
  round(cast(least(0.45 + CASE WHEN prefix <> '' THEN 0.15 ELSE 0 END + 0.15 + CASE WHEN leader THEN 0.15 ELSE 0 END + CASE WHEN length(title) BETWEEN 5 AND 120 THEN 0.08 ELSE 0 END, 0.95) AS DOUBLE), 4) AS confidence FROM f WHERE title <> ''"""


def _caption(d: Dialect) -> str:
    kinds = [("table_caption", r"^(bảng|bang|table|tbl\.)\s*[0-9]+"), ("figure_caption", r"^(hình|hinh|figure|fig\.)\s*[0-9]+"), ("chart_caption", r"^(biểu\s*đồ|bieu\s*do|chart|sơ\s*đồ|so\s*do|diagram)\s+[0-9]+"), ("image_caption", r"^(ảnh|anh|image)\s+[0-9]+")]
    return "CASE " + " ".join(f"WHEN {d.matches('lower(text)', p)} THEN '{k}'" for k, p in kinds) + " END"


def captions(d: Dialect) -> str:
    """Captions by their first word and number, with the nearest table-like line of the document, if any."""
    return f"""
WITH {lines(d)}, t AS (SELECT doc_id, line_no, {_caption(d)} AS kind, CASE WHEN instr(text, '|') > 0 OR {d.matches('text', r'\t|\s{3,}')} THEN line_no END AS spot FROM lines),
n AS (SELECT *, max(spot) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, min(spot) OVER (PARTITION BY doc_id ORDER BY line_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM t)
SELECT doc_id, line_no, kind, CASE WHEN above IS NULL THEN below WHEN below IS NULL OR line_no - above <= below - line_no THEN above ELSE below END AS nearest FROM n WHERE kind IS NOT NULL"""


def paragraph_class(d: Dialect) -> str:
    """Class of every line: heading, caption, list item, table row or paragraph, in this order."""
    head = rf"^({'|'.join(('CHƯƠNG', 'Chương', 'PHẦN', 'Phần'))})\s+[IVXLC0-9]+|^[IVXLC]+\.\s+.|^[0-9]+(\.[0-9]+)+[.)]?\s+."
    item = r"^([•●○▪▫■□◦–—-]|[0-9]+[.)]|[(][0-9a-zA-Z]+[)]|[a-zA-Z][.)])\s+."
    return f"""
WITH {lines(d)} SELECT doc_id, line_no, CASE WHEN length(text) <= 160 AND {d.matches('text', head)} THEN 'heading_like_paragraph' WHEN {_caption(d)} IS NOT NULL THEN 'caption_like_paragraph'
  WHEN {d.matches('text', item)} THEN 'list_item_like_paragraph' WHEN instr(text, '|') > 0 OR {d.matches('text', r'\t|\s{3,}')} THEN 'table_like_paragraph' ELSE 'paragraph' END AS kind FROM lines"""


def page_profile(d: Dialect) -> str:
    """Profile of every text as a page: flags, table candidates, type and complexity."""
    return f"""
WITH {lines(d)}, l AS (SELECT doc_id, cast(count(*) AS BIGINT) AS n_lines, sum(CASE WHEN {d.matches('text', r'\t|  ')} THEN 1 ELSE 0 END) AS aligned, sum(CASE WHEN cast({d.count('text', '[0-9]')} AS DOUBLE) / length(text) > 0.25 THEN 1 ELSE 0 END) AS digits FROM lines GROUP BY doc_id),
p AS (SELECT t.doc_id, length(coalesce(t.text, '')) >= 30 AND {d.count("coalesce(t.text, '')", r'\S+')} >= 5 AS has_text, coalesce(n_lines, 0) AS n_lines, cast(CASE WHEN aligned >= 3 THEN 1 ELSE 0 END + CASE WHEN digits >= 3 THEN 1 ELSE 0 END AS BIGINT) AS tables FROM {d.t('documents')} t LEFT JOIN l ON t.doc_id = l.doc_id)
SELECT doc_id, has_text, n_lines, tables, CASE WHEN tables > 0 AND has_text THEN 'text_with_table' WHEN has_text THEN 'text_page' ELSE 'blank_or_unknown' END AS page_type,
  CASE CASE WHEN n_lines > 80 THEN 2 WHEN n_lines > 40 THEN 1 ELSE 0 END + least(tables, 2) WHEN 0 THEN 'low' WHEN 1 THEN 'low' ELSE 'medium' END AS complexity FROM p"""


def quality_flags(d: Dialect) -> str:
    """Flags and category of every document, from its text, table-like lines and links. The DuckDB statement reads only 15,000 characters for the category, as the reference does."""
    source = d.match("coalesce(text, '')" if d.spark else "substr(coalesce(text, ''), 1, 15000)")
    # Words that name a category.
    kinds = [("decision", ["quyet dinh"]), ("investment_report", ["bao cao kinh te ky thuat", "bao cao nghien cuu kha thi"]), ("plan_or_scheme", ["de an", "ke hoach"]), ("contract", ["hop dong"]), ("minutes", ["bien ban"]), ("report", ["bao cao"]), ("submission", ["to trinh"])]
    kind = " ".join(f"WHEN {' OR '.join(f'instr(s, {chr(39)}{w}{chr(39)}) > 0' for w in words)} THEN '{k}'" for k, words in kinds)
    flag = lambda test, name: f"CASE WHEN {test} THEN '{name}' END"
    tables = d.size(d.keep(d.lines("coalesce(text, '')"), "x", f"instr(x, '|') > 0 OR {d.matches('x', chr(92) + 't')}"))
    flags = [flag(d.matches("coalesce(text, '')", "https?://|www[.]"), "has_links"), flag(f"{tables} > 0", "has_tables"), flag("length(coalesce(text, '')) < 100", "low_text_density"), flag("coalesce(text, '') = ''", "no_text"), flag(f"{tables} >= 30", "table_heavy_document")]
    text = f"concat_ws(',', {', '.join(flags)})"
    return f"WITH c AS (SELECT doc_id, {text} AS flags, {source} AS s FROM {d.t('documents')}) SELECT doc_id, flags, CASE {kind} ELSE 'document' END AS category FROM c"


def sample_pages(d: Dialect) -> str:
    """Ten line numbers (from 0) to profile: the first, middle and last three, and an even fill."""
    seq = lambda a, b, step="1": f"sequence(cast({a} AS BIGINT), cast({b} - 1 AS BIGINT), cast({step} AS BIGINT))" if d.spark else f"range(cast({a} AS BIGINT), cast({b} AS BIGINT), cast({step} AS BIGINT))"
    cat = lambda *x: f"concat({', '.join(x)})" if d.spark else f"flatten([{', '.join(x)}])"
    cut = lambda x, n: f"slice({x}, 1, {n})" if d.spark else f"{x}[1:{n}]"
    order = "array_sort" if d.spark else "list_sort"
    has = lambda a, x: f"array_contains({a}, {x})" if d.spark else f"list_contains({a}, {x})"
    half = "cast(floor(n / 2) AS BIGINT)"
    return f"""
WITH {lines(d)}, c AS (SELECT doc_id, cast(count(*) AS BIGINT) AS n FROM lines GROUP BY doc_id),
k AS (SELECT doc_id, n, {d.distinct(cat(seq('0', 'least(3, n)'), seq(f'greatest(0, {half} - 1)', f'least(n, {half} + 2)'), seq('greatest(0, n - 3)', 'n')))} AS base, {seq('0', 'n', 'greatest(cast(floor(n / 10) AS BIGINT), 1)')} AS fill FROM c),
f AS (SELECT doc_id, n, base, {d.keep('fill', 'x', f'NOT {has("base", "x")}')} AS more FROM k)
SELECT doc_id, n, {('array_join' if d.spark else 'array_to_string')}({cut(f"{order}({cat('base', cut('more', f'cast(greatest(10 - {d.size('base')}, 0) AS INT)'))})", '10')}, ',') AS sampled FROM f"""


def header_footer(d: Dialect) -> str:
    """Lines in the upper or lower 12 percent of their page, with a score."""
    return f"""
WITH {boxes(d)}, p AS (SELECT *, max(y1) OVER (PARTITION BY doc_id) AS height, max(x1) OVER (PARTITION BY doc_id) AS width FROM boxes),
z AS (SELECT *, CASE WHEN cast(y1 AS DOUBLE) / height <= 0.12 THEN 'header' WHEN cast(y0 AS DOUBLE) / height >= 0.88 THEN 'footer' END AS zone FROM p)
SELECT doc_id, line_no, zone, round(cast(least(0.65 + CASE WHEN length(text) <= 80 THEN 0.08 ELSE 0 END + CASE WHEN {d.matches('text', '^[-–]?[ ]*[0-9]+([ ]*/[ ]*[0-9]+)?[ ]*[-–]?$')} THEN 0.08 ELSE 0 END
  + CASE WHEN {d.matches('text', '[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}')} THEN 0.05 ELSE 0 END + CASE WHEN x1 - x0 >= 0.5 * width THEN 0.03 ELSE 0 END - CASE WHEN length(text) > 180 THEN 0.20 ELSE 0 END, 0.95) AS DOUBLE), 4) AS score FROM z WHERE zone IS NOT NULL"""


QUERIES = [entities, entity_links, entity_network, references, paragraph_continuation, toc_lines, captions, paragraph_class, page_profile, quality_flags, sample_pages, header_footer]
