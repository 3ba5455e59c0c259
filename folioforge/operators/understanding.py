"""Understanding of queries (user turns and benchmark items), evidence, answers and prompts."""

from __future__ import annotations

from folioforge.functions.dialect import Dialect
from folioforge.operators.context import entity_rules
from folioforge.operators.retrieval import _search
from folioforge.operators.text import INDEX_STOPWORDS

# Intents in order of priority, with the patterns that count for them.
INTENTS = {
    "table_query": [r"\bbang\b", r"\bcot\b", r"\bdong\b", r"\bo nao\b", r"\btable\b", r"\bcolumn\b", r"\brow\b", r"\bcell\b"],
    "citation": [r"\btrich dan\b", r"\bdan chung\b", r"\bcan cu\b", r"\bbang chung\b", r"\bcitation\b", r"\bevidence\b", r"\bsource\b", r"\bproof\b"],
    "comparison": [r"\bso sanh\b", r"\bkhac nhau\b", r"\bgiong nhau\b", r"\bdiem khac\b", r"\bdiem giong\b", r"\bcompare\b", r"\bdifference\b", r"\bsimilar\b"],
    "summary": [r"\btom tat\b", r"\btong hop\b", r"\bnoi dung chinh\b", r"\by chinh\b", r"\bkhai quat\b", r"\bsummarize\b", r"\bsummary\b", r"\boverview\b"],
    "extraction": [r"\btrich xuat\b", r"\blay ra\b", r"\btim giup\b", r"\bneu ro\b", r"\bextract\b", r"\bfind\b", r"\bidentify\b"],
    "list": [r"\bliet ke\b", r"\bdanh sach\b", r"\bcac noi dung\b", r"\bnhung noi dung\b", r"\bgom nhung\b", r"\bbao gom\b", r"\blist\b", r"\benumerate\b"],
    "counting": [r"\bbao nhieu\b", r"\bso luong\b", r"\bdem\b", r"\btong so\b", r"\bcount\b", r"\bhow many\b", r"\bnumber of\b", r"\btotal\b"],
    "definition": [r"\bla gi\b", r"\bla gi vay\b", r"\bkhai niem\b", r"\bdinh nghia\b", r"\bwhat is\b", r"\bdefine\b", r"\bdefinition\b"],
    "procedure": [r"\blam the nao\b", r"\bcach\b", r"\bquy trinh\b", r"\bcac buoc\b", r"\bhuong dan\b", r"\bhow to\b", r"\bprocedure\b", r"\bsteps\b", r"\bguide\b"],
    "reasoning": [r"\btai sao\b", r"\bvi sao\b", r"\bnguyen nhan\b", r"\bly do\b", r"\bphan tich\b", r"\bdanh gia\b", r"\bwhy\b", r"\breason\b", r"\banalyze\b", r"\bevaluate\b"],
    "yes_no": [r"\bco phai\b", r"\bco dung\b", r"\bco xung dot\b", r"\bco can\b", r"\bco nen\b", r"\bis it\b", r"\bdoes\b", r"\bdo\b", r"\bshould\b", r"\bcan\b"],
    "graph_query": [r"\blien quan\b", r"\bmoi quan he\b", r"\bket noi\b", r"\blien ket\b", r"\btham chieu\b", r"\brelationship\b", r"\bconnected\b", r"\blink\b", r"\breference\b"],
    "metadata_query": [r"\bmetadata\b", r"\bthong tin tai lieu\b", r"\bloai tai lieu\b", r"\bten file\b", r"\bfile name\b", r"\bdocument type\b"],
    "page_lookup": [r"\btrang\b", r"\bpage\b", r"\btr\.\s*\d+", r"\bp\.\s*\d+"],
}
# Type of a query by the first intent found.
TYPES = {"table_query": "table", "citation": "evidence", "graph_query": "graph", "metadata_query": "metadata", "comparison": "comparison", "summary": "summary", "counting": "count", "yes_no": "yes_no", "procedure": "procedure", "definition": "definition", "reasoning": "analysis"}
# Scope of a query by the first pattern found.
SCOPES = {"document": r"\btoan bo\b|\bca tai lieu\b|\ball document\b|\bwhole document\b", "page": r"\btrang\s*\d+|\bpage\s*\d+|\btr\.\s*\d+|\bp\.\s*\d+", "section": r"\bmuc\b|\bphan\b|\bchuong\b|\bsection\b|\bchapter\b", "table": r"\bbang\b|\btable\b", "chunk": r"\bdoan\b|\bparagraph\b|\bchunk\b"}
PAGE = r"\b(?:trang|page|tr\.|p\.)\s*"


def _asked(d: Dialect) -> str:
    """CTEs up to counted: every query with its match form and the hits of each intent."""
    hits = ", ".join(" + ".join(d.count("s", p) for p in ps) + f" AS {k}" for k, ps in INTENTS.items())
    return f"""asked AS (SELECT concat('b:', cast(item_id AS STRING)) AS query_id, coalesce(text, '') AS q FROM {d.t('benchmark')} UNION ALL SELECT concat('c:', cast(conv_id AS STRING), ':', cast(turn AS STRING)), coalesce(text, '') FROM {d.t('conversations')} WHERE role = 'user'),
formed AS (SELECT query_id, q, {d.match('q')} AS s FROM asked), counted AS (SELECT query_id, q, s, {hits} FROM formed)"""


def _classified(d: Dialect) -> str:
    best = f"greatest({', '.join(INTENTS)})"
    intent = "CASE WHEN best = 0 THEN 'factual' " + " ".join(f"WHEN {k} = best THEN '{k}'" for k in INTENTS) + " END"
    kind = "CASE " + " ".join(f"WHEN {k} > 0 THEN '{v}'" for k, v in TYPES.items()) + f" WHEN {d.matches('s', r'\b\d+\b|\btrang\b|\bpage\b|\btr\.')} THEN 'lookup' ELSE 'factual' END"
    scope = "CASE " + " ".join(f"WHEN {d.matches('s', p)} THEN '{k}'" for k, p in SCOPES.items()) + " ELSE 'open' END"
    form = f"CASE WHEN {d.matches('s', r'\bbang markdown\b|\bdang bang\b|\btable format\b|\bmarkdown table\b')} THEN 'table' WHEN intent IN ('list', 'procedure', 'comparison') THEN 'bullets' WHEN intent = 'summary' THEN 'structured' WHEN intent = 'yes_no' THEN 'direct_then_explain' WHEN {d.matches('s', r'\bngan gon\b|\btom gon\b|\bbrief\b|\bconcise\b')} THEN 'concise' ELSE 'structured' END"
    return f"""{_asked(d)}, ranked AS (SELECT *, {best} AS best FROM counted), typed AS (SELECT *, {intent} AS intent, {kind} AS query_type, {scope} AS query_scope FROM ranked),
classified AS (SELECT *, {form} AS answer_format, {d.count('s', '[a-z0-9_]{2,}')} AS n_tokens FROM typed)"""


def query_classify(d: Dialect) -> str:
    """Intent, type, scope and answer format of every query."""
    return f"WITH {_classified(d)} SELECT query_id, intent, query_type, query_scope, answer_format, best AS hits, instr(q, '?') > 0 AS question, n_tokens FROM classified"


def _filters(d: Dialect) -> str:
    quotes = d.size(d.find_all("q", '"[^"]+"|“[^”]+”'))
    return f"""filtered AS (SELECT *, {d.joined(d.find_all('s', PAGE + r'[0-9]+\s*-\s*[0-9]+'))} AS page_ranges, {d.joined(d.groups('s', PAGE + '([0-9]+)'))} AS pages, {d.joined(d.groups('s', r'\b(?:muc|phan|chuong|section|chapter)\s+([0-9ivxlc]+(?:[.][0-9]+)*)'))} AS sections,
  {d.joined(d.groups('s', r'\b(?:bang|table|bieu)\s+([0-9]+(?:[.][0-9]+)*)'))} AS tables, {quotes} AS n_quotes, {d.joined(d.groups('q', r'\b((?:19|20|21)[0-9]{2})\b'))} AS years, {d.joined(d.find_all('q', '[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}'))} AS dates,
  {d.matches('s', r'\btrong bang\b|\bin table\b')} AS prefer_table, {d.matches('s', r'\btrich dan\b|\bcitation\b|\bevidence\b|\bdan chung\b|\bcan cu\b')} AS require_evidence FROM classified)"""


def query_filters(d: Dialect) -> str:
    """Pages, sections, tables, quotes, years and dates that a query names. Page ranges stay ranges."""
    return f"WITH {_classified(d)}, {_filters(d)} SELECT query_id, page_ranges, pages, sections, tables, n_quotes, years, dates, prefer_table, require_evidence FROM filtered"


def route_plan(d: Dialect) -> str:
    """Complexity, retrievers, result sizes and route of every query; a complex query takes the hybrid route."""
    one = lambda test, v: f"CASE WHEN {test} THEN {v} ELSE 0 END"
    named = " + ".join(one(t, 1) for t in ("pages <> ''", "sections <> ''", "tables <> ''", "n_quotes > 0", "years <> ''", "dates <> ''", "prefer_table", "require_evidence"))
    score = " + ".join([one("n_tokens > 18", 1.0), one(f"{d.size(d.distinct(d.tagged(entity_rules(d), 'q')))} >= 3", 0.8), one(f"{named} >= 2", 0.7), one("comparison > 0", 0.8), one("reasoning > 0", 0.7), one("summary > 0", 0.6), one("table_query > 0", 0.6), one(d.matches("s", r"\bva\b|\band\b|\bhoac\b|\bor\b"), 0.4)])
    return f"""
WITH {_classified(d)}, {_filters(d)}, scored AS (SELECT *, round(cast({score} AS DOUBLE), 4) AS complexity FROM filtered),
leveled AS (SELECT *, CASE WHEN complexity >= 2.0 THEN 'high' WHEN complexity >= 0.8 THEN 'medium' ELSE 'low' END AS level, query_type = 'metadata' OR intent = 'metadata_query' AS meta, query_type = 'table' OR intent = 'table_query' AS tab, query_type = 'graph' OR intent = 'graph_query' AS gra FROM scored),
routed AS (SELECT *, CASE WHEN level = 'high' THEN 'hybrid' WHEN tab THEN 'table' WHEN gra THEN 'graph' WHEN meta THEN 'metadata' ELSE 'hybrid' END AS route FROM leveled)
SELECT query_id, route, level, complexity, cast(CASE WHEN level = 'high' THEN 40 WHEN query_type IN ('summary', 'comparison', 'analysis', 'procedure', 'count', 'lookup') THEN 30 ELSE 20 END AS BIGINT) AS top_k,
  cast(CASE WHEN level = 'high' THEN 150 WHEN pages <> '' OR sections <> '' THEN 60 WHEN query_type IN ('summary', 'comparison', 'analysis', 'procedure') THEN 120 ELSE 80 END AS BIGINT) AS candidate_pool,
  route = 'hybrid' AND NOT meta AS use_bm25, route = 'hybrid' AND NOT meta AS use_vector, route = 'graph' OR (route = 'hybrid' AND (gra OR level = 'high')) AS use_graph,
  route IN ('metadata', 'table') OR (route = 'hybrid' AND (meta OR query_type IN ('count', 'lookup') OR pages <> '' OR sections <> '' OR level = 'high')) AS use_metadata, route = 'table' OR (route = 'hybrid' AND (tab OR prefer_table)) AS use_table FROM routed"""


def _evidence(d: Dialect) -> str:
    """CTE evidence: the ten best documents of each query as scored evidence."""
    return f"""{_search(d)}, top AS (SELECT * FROM r WHERE rk <= 10), qn AS (SELECT item_id, count(*) AS n_terms FROM q GROUP BY item_id),
ov AS (SELECT top.item_id, top.doc_id, count(*) AS hit FROM top JOIN q ON top.item_id = q.item_id JOIN tf ON tf.doc_id = top.doc_id AND tf.term = q.term GROUP BY top.item_id, top.doc_id),
evidence AS (SELECT top.item_id, top.doc_id, top.rk, round(cast(hit AS DOUBLE) / n_terms, 4) AS overlap, round(top.score + 1.25 * round(cast(hit AS DOUBLE) / n_terms, 4) + 0.75 * 0.70 + 0.5 * 1.20, 6) AS evidence_score
  FROM top JOIN ov ON top.item_id = ov.item_id AND top.doc_id = ov.doc_id JOIN qn ON top.item_id = qn.item_id)"""


def evidence_rank(d: Dialect) -> str:
    """Score of each piece of evidence: retrieval, shared query terms, confidence and source."""
    return f"WITH {_evidence(d)} SELECT item_id, doc_id, overlap, evidence_score, cast(row_number() OVER (PARTITION BY item_id ORDER BY evidence_score DESC, doc_id) AS BIGINT) AS rk FROM evidence"


def prompt_context(d: Dialect) -> str:
    """Evidence blocks in order until 12,000 characters would be exceeded."""
    return f"""
WITH {_evidence(d)}, b AS (SELECT e.item_id, e.doc_id, e.evidence_score, cast(length({d.tidy('m.text')}) AS BIGINT) AS n_chars FROM evidence e JOIN {d.t('documents')} m ON m.doc_id = e.doc_id),
c AS (SELECT *, cast(sum(n_chars) OVER (PARTITION BY item_id ORDER BY evidence_score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM b)
SELECT item_id, doc_id, n_chars, upto, upto <= 12000 AS used FROM c"""


def prompt_truncate(d: Dialect) -> str:
    """Every text as a prompt of at most 24,000 characters: 35 percent head and the tail around a notice."""
    return f"""
WITH n AS (SELECT doc_id, {d.tidy('text')} AS s FROM {d.t('documents')}),
c AS (SELECT doc_id, length(s) > 24000 AS truncated, CASE WHEN length(s) > 24000 THEN concat(substr(s, 1, 8400), '...', substr(s, length(s) - 15479)) ELSE s END AS prompt FROM n)
SELECT doc_id, truncated, cast(length(prompt) AS BIGINT) AS n_chars, {d.sha('prompt')} AS digest FROM c"""


def extractive_answer(d: Dialect) -> str:
    """The six best sentences of the evidence of each query, three of a document at most, equal ones once."""
    parts = d.explode(f"(SELECT e.item_id, e.doc_id, e.evidence_score, {d.tidy('m.text')} AS s FROM evidence e JOIN {d.t('documents')} m ON m.doc_id = e.doc_id) x", "item_id, doc_id, evidence_score", d.sentences("s"), "p", "part")
    cut = d.explode("long_parts", "item_id, doc_id, evidence_score, p", f"CASE WHEN length(part) > 500 THEN {d.splits('part', '[;,] +')} ELSE {d.array('part')} END", "p2", "sentence")
    words = d.find_all("form", "[^ ]+")
    asked = f"SELECT item_id, {'collect_set' if d.spark else 'list'}(term) AS terms FROM q GROUP BY item_id"
    return f"""
WITH {_evidence(d)}, long_parts AS ({parts}), pieces AS ({cut}), a AS ({asked}),
v AS (SELECT item_id, doc_id, evidence_score, p, p2, trim(sentence) AS sentence, {d.match('sentence')} AS form FROM pieces WHERE length(trim(sentence)) BETWEEN 25 AND 500 AND {d.count('sentence', r'[\p{L}\p{N}_]+')} >= 4),
g AS (SELECT v.*, round(1.2 * round(cast({d.size(d.common(d.distinct(words), 'a.terms'))} AS DOUBLE) / {d.size('a.terms')}, 6) + 0.7 * evidence_score + 0.3 * 0.70 + 0.15 * least(length(sentence) / cast(180 AS DOUBLE), 1), 6) AS score FROM v JOIN a ON v.item_id = a.item_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, p, p2) AS rd FROM g),
u AS (SELECT *, round(score * evidence_score, 5) AS final, row_number() OVER (PARTITION BY item_id, form ORDER BY round(score * evidence_score, 5) DESC, doc_id, p, p2) AS rf FROM k WHERE rd <= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id, p, p2) AS rk FROM u WHERE rf = 1)
SELECT item_id, cast(rk AS BIGINT) AS rk, doc_id, sentence, final AS score FROM o WHERE rk <= 6"""


def claim_support(d: Dialect) -> str:
    """Sentences of the items as claims: the share of their index terms in the evidence; under 0.35 is weakly supported."""
    claims = d.explode(f"(SELECT item_id, {d.tidy('text')} AS s FROM {d.t('benchmark')} WHERE item_id % 100 = 0) x", "item_id", d.sentences("s"), "p", "claim")
    terms = d.explode(f"(SELECT item_id, p, {d.match('claim')} AS n FROM c) y", "item_id, p", d.find_all("n", "[a-z0-9_]{2,}"), "p2", "term")
    stop = ", ".join(f"'{w}'" for w in INDEX_STOPWORDS)
    return f"""
WITH {_evidence(d)}, c AS (SELECT * FROM ({claims}) z WHERE length(claim) BETWEEN 25 AND 500), t AS (SELECT DISTINCT item_id, p, term FROM ({terms}) w WHERE term NOT IN ({stop})),
e AS (SELECT DISTINCT evidence.item_id, tf.term FROM evidence JOIN tf ON tf.doc_id = evidence.doc_id)
SELECT t.item_id, t.p AS claim, round(cast(count(e.term) AS DOUBLE) / count(*), 4) AS support, cast(count(e.term) AS DOUBLE) / count(*) < 0.35 AS weakly_supported FROM t LEFT JOIN e ON t.item_id = e.item_id AND t.term = e.term GROUP BY t.item_id, t.p"""


QUERIES = [query_classify, query_filters, route_plan, evidence_rank, prompt_context, prompt_truncate, extractive_answer, claim_support]
