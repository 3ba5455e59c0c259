"""Virtual pages and packed chunks: lines of a text packed in order up to a limit of characters.

Packing is a fold over the lines of one text. Spark folds in the JVM and extends the
list of first lines only where a page begins; DuckDB walks the lines recursively.
"""

from __future__ import annotations

from folioforge.functions.dialect import Dialect

PAGE_CHARS, CHUNK_CHARS, OVERLAP = 4000, 1800, 180


def _packed(d: Dialect, units: str, limit: int, gap: int, carried: int) -> str:
    """CTE packed(doc_id, no, texts): consecutive units of at most ``limit`` characters, each counted with ``gap``; a new pack starts with ``carried`` characters of the one before."""
    if d.spark:
        full = f"s.n > 0 AND s.len + length(x) + {gap} > {limit}"
        fold = f"""aggregate(us, named_struct('n', 0, 'len', 0, 'starts', array(1)), (s, x) -> CASE WHEN {full}
  THEN named_struct('n', s.n + 1, 'len', least(s.len, {carried}) + length(x) + {gap}, 'starts', concat(s.starts, array(s.n + 1))) ELSE named_struct('n', s.n + 1, 'len', s.len + length(x) + {gap}, 'starts', s.starts) END)"""
        return f"""units AS ({units}), folded AS (SELECT doc_id, us, {fold}.starts AS starts FROM units),
packed AS (SELECT doc_id, no, slice(us, first, coalesce(try_element_at(starts, no + 2), size(us) + 1) - first) AS texts FROM folded LATERAL VIEW posexplode(starts) x AS no, first)"""
    return f"""units AS ({units}), each AS (SELECT doc_id, unnest(range(0, len(us))) AS i, unnest(us) AS u FROM units),
walk AS (SELECT doc_id, i, u, 0 AS no, length(u) + {gap} AS size FROM each WHERE i = 0 UNION ALL
  SELECT e.doc_id, e.i, e.u, w.no + CASE WHEN w.size + length(e.u) + {gap} > {limit} THEN 1 ELSE 0 END, CASE WHEN w.size + length(e.u) + {gap} > {limit} THEN least(w.size, {carried}) ELSE w.size END + length(e.u) + {gap} FROM walk w JOIN each e ON e.doc_id = w.doc_id AND e.i = w.i + 1),
packed AS (SELECT doc_id, no, list(u ORDER BY i) AS texts FROM walk GROUP BY doc_id, no)"""


def _with(d: Dialect) -> str:
    return "WITH" if d.spark else "WITH RECURSIVE"


def virtual_pages(d: Dialect) -> str:
    """Pages of every text: lines in order, up to 4,000 characters with their line ends; a longer line is a page."""
    text = "coalesce(text, '')"
    units = f"SELECT doc_id, {d.lines(text)} AS us FROM {d.t('documents')}"
    page = "array_join(texts, '\\n')" if d.spark else "array_to_string(texts, chr(10))"
    return f"{_with(d)} {_packed(d, units, PAGE_CHARS, 1, 0)} SELECT doc_id, cast(no + 1 AS BIGINT) AS page_number, {d.size('texts')} AS n_lines, cast(length({page}) AS BIGINT) AS n_chars, {d.sha(page)} AS digest FROM packed"


def packed_chunks(d: Dialect) -> str:
    """Chunks of every text: non-blank lines in order up to 1,800 characters, with 180 characters carried over; longer lines are cut with the same overlap.

    ``parent`` is true for the chunks of a text that has more than one: its parent chunk is the text.
    """
    step = CHUNK_CHARS - OVERLAP
    last = f"cast(ceil((length(x) - {CHUNK_CHARS}) / cast({step} AS DOUBLE)) AS BIGINT)"
    steps = f"sequence(0L, {last})" if d.spark else f"range(0, {last} + 1)"
    cut = f"CASE WHEN length(x) <= {CHUNK_CHARS} THEN {d.array('x')} ELSE {d.map(steps, 'k', f'substr(x, cast(k * {step} + 1 AS INT), {CHUNK_CHARS})')} END"
    kept = d.keep(d.map(d.lines(d.tidy("text")), "x", "trim(x)"), "x", "x <> ''")
    units = f"SELECT doc_id, flatten({d.map('ls', 'x', cut)}) AS us FROM (SELECT doc_id, {kept} AS ls FROM {d.t('documents')}) q WHERE {d.size('ls')} > 0"
    chunk = "array_join(texts, '\\n')" if d.spark else "array_to_string(texts, chr(10))"
    return f"""{_with(d)} {_packed(d, units, CHUNK_CHARS, 2, OVERLAP)} SELECT doc_id, cast(no AS BIGINT) AS chunk_order, {d.size('texts')} AS n_units, cast(length({chunk}) AS BIGINT) AS n_chars,
  concat('chunk_', substr({d.sha(f"concat(cast(doc_id AS STRING), '|', cast(no AS STRING), '|', {chunk})")}, 1, 16)) AS chunk_id, count(*) OVER (PARTITION BY doc_id) > 1 AS parent FROM packed"""


QUERIES = [virtual_pages, packed_chunks]
