"""Text, keyword and line operators over ``documents``."""

from __future__ import annotations

from folioforge.functions.dialect import Dialect

# Words that keyword extraction ignores.
KEYWORD_STOPWORDS = [
    "va", "hoac", "cua", "cho", "cac", "mot", "nhung", "duoc", "trong", "ngoai", "theo", "voi", "den", "tu", "tai", "ve", "la", "co", "khong", "nay", "do",
    "khi", "sau", "truoc", "tren", "duoi", "vao", "ra", "de", "nham", "phuc", "vu", "can", "phai", "bao", "dam", "quy", "dinh", "noi", "dung",
    "thuc", "hien", "quan", "ly", "nha", "nuoc",
]
# Words that the indexes ignore.
INDEX_STOPWORDS = [
    "va", "hoac", "cua", "cho", "cac", "mot", "nhung", "duoc", "trong", "ngoai", "theo", "voi", "den", "tu", "tai", "ve", "la", "co", "khong", "nay", "do",
    "khi", "sau", "truoc", "tren", "duoi", "vao", "ra", "de", "nham", "phuc", "vu", "can", "phai", "bao", "dam", "quy", "dinh", "noi", "dung",
    "thuc", "hien", "quan", "ly", "nha", "nuoc", "du", "lieu", "he", "thong", "chuc", "nang", "phan", "mem", "duan", "du an",
    "this", "that", "with", "from", "into", "about", "the", "and", "or", "for", "to", "of", "in", "on", "by", "is", "are", "be", "as", "at",
]
VIETNAMESE = "[àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ]"


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def lines(d: Dialect) -> str:
    """CTE lines(doc_id, line_no, text): non-blank lines of every document."""
    every = d.explode(d.t("documents"), "doc_id", d.lines("coalesce(text, '')"), "line_no", "line")
    return f"lines AS (SELECT doc_id, line_no, {d.replace('line', '^[ \\t\\r]+|[ \\t\\r]+$', '')} AS text FROM ({every}) q WHERE {d.matches('line', '[^ \\t\\r]')})"


def tokens(d: Dialect, table: str = "documents", key: str = "doc_id", name: str = "tokens") -> str:
    """CTE tokens(key, raw_pos, term): index terms in order, stopwords and single letters left out."""
    every = d.explode(f"(SELECT {key}, {d.match('text')} AS n FROM {d.t(table)}) s", key, d.find_all("n", d.WORD), "raw_pos", "term")
    return f"{name} AS (SELECT {key}, raw_pos, term FROM ({every}) e WHERE length(term) BETWEEN 2 AND 64 AND term NOT IN ({_list(INDEX_STOPWORDS)}))"


def normalize_match(d: Dialect) -> str:
    """Both match normalisers of every text, and a content id."""
    return f"""SELECT doc_id, {d.match('text')} AS page_form, {d.match_words('text')} AS chunk_form, concat('chunk_', substr({d.sha(d.tidy('text'))}, 1, 16)) AS content_id FROM {d.t('documents')}"""


def text_stats(d: Dialect) -> str:
    """Character, word, sentence, line and paragraph statistics."""
    sentences = f"{d.count('s', '[.?!]\\s+')} + CASE WHEN length(s) > 0 THEN 1 ELSE 0 END"
    return f"""
WITH n AS (SELECT doc_id, {d.tidy('text')} AS s FROM {d.t('documents')}),
c AS (SELECT doc_id, cast(length(s) AS BIGINT) AS char_count, {d.count('s', r'\S+')} AS word_count, {sentences} AS sentence_count,
  {d.count('s', r'[^\n]*[^\s][^\n]*')} AS line_count, CASE WHEN length(s) > 0 THEN {d.count('s', r'\n\s*\n')} + 1 ELSE 0 END AS paragraph_count, {d.count('s', '[0-9]')} AS digit_count, {d.count('s', '[A-ZÀ-Ỵ]')} AS uppercase_count,
  {d.count('lower(s)', VIETNAMESE)} AS vietnamese_char_count, cast(length({d.replace('s', r'\s', '')}) AS BIGINT) AS letters FROM n)
SELECT doc_id, char_count, word_count, sentence_count, line_count, paragraph_count, digit_count, uppercase_count, vietnamese_char_count, round(cast(letters AS DOUBLE) / greatest(word_count, 1), 2) AS avg_word_length,
  round(cast(word_count AS DOUBLE) / greatest(sentence_count, 1), 2) AS avg_sentence_words, round(cast(digit_count AS DOUBLE) / greatest(char_count, 1), 4) AS numeric_density,
  round(cast(uppercase_count AS DOUBLE) / greatest(char_count, 1), 4) AS uppercase_density, round(cast(vietnamese_char_count AS DOUBLE) / greatest(char_count, 1), 4) AS vietnamese_density FROM c"""


def language_hint(d: Dialect) -> str:
    """vi by accented letters or common words, else Latin or unknown."""
    common = r"(^|[^\p{L}])(của|và|các|được|trong|theo|quyết|định|thông|tư|nghị|báo|cáo|dữ|liệu)([^\p{L}]|$)"
    return f"""
WITH n AS (SELECT doc_id, lower({d.tidy('text')}) AS s FROM {d.t('documents')})
SELECT doc_id, CASE WHEN {d.count('s', VIETNAMESE)} >= 10 OR {d.count('s', common)} >= 5 THEN 'vi' WHEN {d.matches('s', '[a-z]')} THEN 'en_or_latin' ELSE 'unknown' END AS language FROM n"""


def keywords_topn(d: Dialect) -> str:
    """The ten most frequent keywords of each document, by (-count, keyword)."""
    every = d.explode(f"(SELECT doc_id, {d.match('text')} AS n FROM {d.t('documents')}) s", "doc_id", d.find_all("n", "[a-z0-9_]{3,}"), "p", "keyword")
    return f"""
WITH k AS (SELECT doc_id, keyword, count(*) AS n FROM ({every}) e WHERE keyword NOT IN ({_list(KEYWORD_STOPWORDS)}) AND NOT {d.matches('keyword', '^[0-9]+$')} GROUP BY doc_id, keyword),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, keyword) AS rk FROM k)
SELECT doc_id, keyword, cast(n AS BIGINT) AS n, cast(rk AS BIGINT) AS rk FROM r WHERE rk <= 10"""


def keyword_facets(d: Dialect) -> str:
    """In how many documents each keyword occurs, the 50 most frequent."""
    every = d.explode(f"(SELECT doc_id, {d.match('text')} AS n FROM {d.t('documents')}) s", "doc_id", d.find_all("n", "[a-z0-9_]{3,}"), "p", "keyword")
    return f"""
SELECT keyword, cast(count(DISTINCT doc_id) AS BIGINT) AS docs FROM ({every}) e WHERE keyword NOT IN ({_list(KEYWORD_STOPWORDS)}) AND NOT {d.matches('keyword', '^[0-9]+$')}
GROUP BY keyword ORDER BY docs DESC, keyword LIMIT 50"""


def metadata_facet(d: Dialect) -> str:
    """Value counts of language and source with the label filters: quality 1 and not toxic, or no label."""
    return f"""
WITH m AS (SELECT p.doc_id, p.lang, p.source FROM {d.t('documents')} p LEFT JOIN {d.t('labels')} l ON p.doc_id = l.doc_id WHERE coalesce(l.quality, 1) = 1 AND coalesce(l.toxic, 0) = 0)
SELECT 'lang' AS field, lang AS value, cast(count(*) AS BIGINT) AS n FROM m GROUP BY lang UNION ALL SELECT 'source', source, cast(count(*) AS BIGINT) FROM m GROUP BY source"""


def in_runs(d: Dialect, texts: str, key: str) -> str:
    """CTEs up to hits(key, term, n): how often each term of ``q`` occurs in a text, also within words.

    A term has no other marks than a word, so it lies within one; distinct words meet the terms, not texts.
    """
    every = d.explode(f"({texts}) t", key, d.find_all("s", "[a-z0-9_]+"), "p", "word")
    return f"""worded AS (SELECT {key}, word, count(*) AS n FROM ({every}) e GROUP BY {key}, word),
held AS (SELECT word, term, (length(word) - length(replace(word, term, ''))) / length(term) AS k FROM (SELECT DISTINCT word FROM worded) w JOIN (SELECT DISTINCT term FROM q) x ON instr(word, term) > 0),
hits AS (SELECT {key}, term, sum(n * k) AS n FROM worded JOIN held ON worded.word = held.word GROUP BY {key}, term)"""


def metadata_search(d: Dialect) -> str:
    """Substring score of the query terms (benchmark items divisible by 100) over document previews, the 20 best of each."""
    terms = d.explode(f"(SELECT item_id, {d.match('text')} AS n FROM {d.t('benchmark')} WHERE item_id % 100 = 0) s", "item_id", d.find_all("n", "[a-z0-9_]{3,}"), "p", "term")
    if d.spark:
        texts = f"""SELECT doc_id, {d.match("concat(coalesce(lang, ''), ' ', coalesce(source, ''), ' ', substr(coalesce(text, ''), 1, 500))")} AS s FROM {d.t('documents')}"""
        return f"""
WITH q AS (SELECT DISTINCT item_id, term FROM ({terms}) t), {in_runs(d, texts, 'doc_id')},
h AS (SELECT item_id, doc_id, sum(1.0 + 0.15 * n) AS score FROM hits JOIN q ON hits.term = q.term GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rk FROM h)
SELECT item_id, doc_id, round(cast(score AS DOUBLE), 6) AS score, cast(rk AS BIGINT) AS rk FROM r WHERE rk <= 20"""
    return f"""
WITH q AS (SELECT DISTINCT item_id, term FROM ({terms}) t),
m AS (SELECT doc_id, {d.match("concat(coalesce(lang, ''), ' ', coalesce(source, ''), ' ', substr(coalesce(text, ''), 1, 500))")} AS s FROM {d.t('documents')}),
h AS (SELECT item_id, doc_id, sum(1.0 + 0.15 * (length(s) - length(replace(s, term, ''))) / length(term)) AS score FROM m JOIN q ON instr(s, term) > 0 GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rk FROM h)
SELECT item_id, doc_id, round(cast(score AS DOUBLE), 6) AS score, cast(rk AS BIGINT) AS rk FROM r WHERE rk <= 20"""


def _heading(d: Dialect) -> str:
    upper = f"({d.matches('text', '[A-ZÀ-Ý]')} AND NOT {d.matches('text', '[a-zß-ÿ]')})"
    chapter = "^(chuong|phan) +([ivxlcdm]+|[0-9]+)"
    return (
        f"CASE WHEN {d.matches(d.fold('text'), chapter)} THEN 'chapter' WHEN {d.matches('text', r'^[0-9]+([.][0-9]+)*[.)]?\\s+.'.replace(chr(92) * 2, chr(92)))} THEN 'numbered' "
        f"WHEN {d.matches('text', '^[IVXLCDM]+[.)] +.')} THEN 'roman' WHEN {d.matches('text', '^[a-zA-Z][)] +.')} THEN 'letter' WHEN {upper} THEN 'uppercase' ELSE 'plain' END"
    )


def line_headings(d: Dialect) -> str:
    """Heading type and level of every line of up to 120 characters without a closing mark."""
    return f"""
WITH {lines(d)}, h AS (SELECT doc_id, line_no, text, {_heading(d)} AS kind FROM lines WHERE length(text) <= 120 AND NOT {d.matches('text', '[.;:,]$')})
SELECT doc_id, line_no, kind, CASE kind WHEN 'numbered' THEN {d.size(d.find_all(d.extract('text', '^([0-9]+([.][0-9]+)*)'), '[.]'))} + 1 WHEN 'letter' THEN 3 WHEN 'uppercase' THEN 2 WHEN 'plain' THEN 3 ELSE 1 END AS level FROM h"""


def list_items(d: Dialect) -> str:
    """Marker and type of the lines that are list items; the first pattern that fits decides."""
    kinds = [("bullet", "^([•●○▪▫■□◦])[ \\t]+."), ("dash", "^([-–—])[ \\t]+."), ("numbered", "^([0-9]+([.][0-9]+)*[.)]|[(][0-9]+[)])[ \\t]+."), ("letter", "^([a-zA-Z][.)]|[(][a-zA-Z][)])[ \\t]+."), ("roman", "^([IVXLCDM]+[.)]|[(][IVXLCDM]+[)])[ \\t]+.")]
    kind = " ".join(f"WHEN {d.matches('text', p)} THEN '{k}'" for k, p in kinds)
    marker = " ".join(f"WHEN {d.matches('text', p)} THEN {d.extract('text', p)}" for _, p in kinds)
    return f"""
WITH {lines(d)}, i AS (SELECT doc_id, line_no, CASE {kind} END AS kind, CASE {marker} END AS marker FROM lines)
SELECT doc_id, line_no, kind, marker FROM i WHERE kind IS NOT NULL"""


def table_lines(d: Dialect) -> str:
    """Lines that look like rows of a table: bars, wide gaps, or many numbers."""
    return f"""
WITH {lines(d)}, f AS (SELECT doc_id, line_no, text, {d.count('text', r'\S+')} AS toks, {d.count('text', r'\S*[0-9]\S*')} AS nums, {d.count('text', '[0-9]')} AS digits FROM lines)
SELECT doc_id, line_no, toks, nums FROM f WHERE instr(text, '|') > 0 OR {d.matches('text', r'\t|\s{3,}')} OR (toks >= 4 AND nums >= 2) OR (cast(digits AS DOUBLE) / greatest(length(text), 1) >= 0.25 AND toks >= 3)"""


def section_tree(d: Dialect) -> str:
    """Sections from headings, numbered ones as deep as their number: the parent is the nearest heading before of a smaller level; the end is the line before the next section."""
    last = ", ".join(f"max(CASE WHEN level = {k} THEN o END) OVER w AS last{k}" for k in range(1, 9))
    parent = "CASE level WHEN 1 THEN 0 " + " ".join(f"WHEN {k} THEN greatest({', '.join(f'coalesce(last{j}, 0)' for j in range(1, k))}, 0)" for k in range(2, 10)) + " END"
    level = f"CASE kind WHEN 'chapter' THEN 1 WHEN 'roman' THEN 1 WHEN 'uppercase' THEN 2 WHEN 'numbered' THEN least({d.size(d.find_all(d.extract('text', '^([0-9]+([.][0-9]+)*)'), '[.]'))} + 1, 9) ELSE 3 END"
    return f"""
WITH {lines(d)}, h AS (SELECT doc_id, line_no, text, {_heading(d)} AS kind FROM lines WHERE length(text) <= 120 AND NOT {d.matches('text', '[.;:,]$')}),
v AS (SELECT doc_id, line_no, {level} AS level, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS o FROM h WHERE kind <> 'plain'),
p AS (SELECT *, {last}, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT doc_id, max(line_no) AS last_line FROM lines GROUP BY doc_id)
SELECT p.doc_id, cast(o AS BIGINT) AS section, cast(level AS BIGINT) AS level, cast({parent} AS BIGINT) AS parent, p.line_no AS first_line, coalesce(next_line - 1, e.last_line) AS last_line FROM p JOIN e ON p.doc_id = e.doc_id"""


def paragraphs(d: Dialect) -> str:
    """Lines merged to paragraphs: a line goes on if the one before lacks a closing mark and is short, or this one starts in lower case."""
    start = f"CASE WHEN before IS NULL THEN 1 WHEN NOT {d.matches('before', '[.!?:;]$')} AND (length(before) <= 60 OR {d.matches('text', '^[a-zß-ÿ]')}) THEN 0 ELSE 1 END"
    return f"""
WITH {lines(d)}, b AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM lines),
i AS (SELECT doc_id, line_no, text, sum({start}) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS paragraph FROM b)
SELECT doc_id, cast(paragraph AS BIGINT) AS paragraph, min(line_no) AS first_line, cast(count(*) AS BIGINT) AS n_lines, cast(sum(length(text)) AS BIGINT) AS n_chars FROM i GROUP BY doc_id, paragraph"""


def chunks(d: Dialect) -> str:
    """Lines of 80 characters or 8 words as chunks, first of equal texts kept, in order, with the chunks before and after."""
    return f"""
WITH {lines(d)}, v AS (SELECT doc_id, line_no, text, {d.match_words('text')} AS n FROM lines WHERE length(text) >= 80 OR {d.count('text', r'\S+')} >= 8),
u AS (SELECT doc_id, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY line_no) AS rk FROM v) f WHERE rk = 1),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS o, concat('chunk_', substr({d.sha("concat(cast(doc_id AS STRING), '|', cast(line_no AS STRING), '|', text)")}, 1, 16)) AS chunk_id, length(text) AS n FROM u)
SELECT doc_id, cast(o AS BIGINT) AS chunk_order, chunk_id, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id, cast(n AS BIGINT) AS n_chars FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY o)"""


def _citations(d: Dialect) -> str:
    """The Spark form of citation_check: runs are of four words, or of all words of a shorter item."""
    words = lambda x: d.find_all(x, "[^ ]+")
    runs = "transform(sequence(0, size(w) - n), i -> array_join(slice(w, i + 1, n), ' '))"
    return f"""
WITH q AS (SELECT item_id, q, w, least(size(w), 4) AS n FROM (SELECT item_id, q, {words('q')} AS w FROM (SELECT item_id, {d.match_words('text')} AS q FROM {d.t('benchmark')}) a) b WHERE size(w) > 0),
k AS (SELECT item_id, run, min(p) AS p FROM (SELECT item_id, p, run FROM q LATERAL VIEW posexplode({runs}) x AS p, run) a GROUP BY item_id, run),
s AS (SELECT doc_id, {d.match_words('text')} AS s FROM {d.t('documents')}),
v AS (SELECT doc_id, w, n FROM (SELECT doc_id, {words('s')} AS w FROM s) a JOIN (SELECT DISTINCT n FROM q) b ON size(w) >= n),
r AS (SELECT doc_id, run FROM v LATERAL VIEW explode({runs}) x AS run),
g AS (SELECT k.item_id, r.doc_id, max(CASE WHEN k.p = 0 THEN 1 ELSE 0 END) AS led FROM r JOIN k ON r.run = k.run GROUP BY k.item_id, r.doc_id),
qd AS (SELECT g.item_id, g.doc_id, led, q, s FROM g JOIN q ON g.item_id = q.item_id JOIN s ON g.doc_id = s.doc_id),
e AS (SELECT item_id, doc_id, led, q, s, word FROM qd LATERAL VIEW OUTER explode({d.find_all("q", r"\S{3,}")}) x AS word),
f AS (SELECT item_id, doc_id, max(led) AS led, sum(CASE WHEN instr(concat(' ', s, ' '), concat(' ', word, ' ')) > 0 THEN 1.0 ELSE 0.0 END) / count(*) AS share, max(CASE WHEN instr(s, q) > 0 THEN 1 ELSE 0 END) AS exact FROM e GROUP BY item_id, doc_id)
SELECT item_id, doc_id, CASE WHEN exact = 1 THEN 'verified_exact' WHEN share >= 0.55 THEN 'verified_fuzzy' ELSE 'page_available_quote_not_found' END AS status,
  round(cast(CASE WHEN exact = 1 THEN 0.92 WHEN share >= 0.55 THEN 0.65 + least(share, 0.30) ELSE 0.45 END AS DOUBLE), 4) AS confidence FROM f WHERE led = 1 OR exact = 1 OR share >= 0.55"""


def citation_check(d: Dialect) -> str:
    """Benchmark items as quotes against documents that share their first four words: exact, fuzzy (at least .55 of the words), or not found.

    Documents meet items by the equality of four-word runs, and only the pairs found carry texts. In Spark any run of the item counts, not only the first, and items under four
    words are looked for whole; pairs without the first four words are kept if the quote is found. The DuckDB statement knows the first four words only.
    """
    if d.spark:
        return _citations(d)
    words = d.explode("qd", "item_id, doc_id, q, s", d.find_all("q", r"\S{3,}"), "p", "word")
    run = "list_transform(range(0, len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' '))"
    runs = d.explode(f"(SELECT doc_id, w FROM (SELECT doc_id, {d.find_all('s', '[^ ]+')} AS w FROM s) x WHERE {d.size('w')} >= 4) y", "doc_id", run, "p", "lead4")
    return f"""
WITH q AS (SELECT item_id, {d.match_words('text')} AS q FROM {d.t('benchmark')}),
k AS (SELECT item_id, q, {d.extract('q', r'^(\S+ \S+ \S+ \S+)')} AS lead4 FROM q),
s AS (SELECT doc_id, {d.match_words('text')} AS s FROM {d.t('documents')}),
g AS (SELECT DISTINCT k.item_id, r.doc_id FROM ({runs}) r JOIN k ON r.lead4 = k.lead4),
qd AS (SELECT g.item_id, g.doc_id, q, s FROM g JOIN k ON g.item_id = k.item_id JOIN s ON g.doc_id = s.doc_id),
f AS (SELECT item_id, doc_id, sum(CASE WHEN instr(concat(' ', s, ' '), concat(' ', word, ' ')) > 0 THEN 1.0 ELSE 0.0 END) / count(*) AS share, max(CASE WHEN instr(s, q) > 0 THEN 1 ELSE 0 END) AS exact FROM ({words}) w GROUP BY item_id, doc_id)
SELECT item_id, doc_id, CASE WHEN exact = 1 THEN 'verified_exact' WHEN share >= 0.55 THEN 'verified_fuzzy' ELSE 'page_available_quote_not_found' END AS status,
  round(cast(CASE WHEN exact = 1 THEN 0.92 WHEN share >= 0.55 THEN 0.65 + least(share, 0.30) ELSE 0.45 END AS DOUBLE), 4) AS confidence FROM f"""


QUERIES = [normalize_match, text_stats, language_hint, keywords_topn, keyword_facets, metadata_facet, metadata_search, line_headings, list_items, table_lines, section_tree, paragraphs, chunks, citation_check]
