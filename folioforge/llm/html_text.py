"""Main text of web pages from flat text blocks.

A page is cut into text blocks at block-level tags. A block's features are its
word count and link density, those of the block before and after, and three cues
of its containers: whether one announces something other than the article (``nav``,
``footer``, class and id words such as ``sidebar``), whether it is a form (which
may wrap a whole page), and whether it stands in ``article`` (2) or ``main`` (1). A
decision tree, grown in numpy by Gini impurity on the small labelled table below,
tells content from the rest; content blocks are joined in page order. The table
holds pages without any cue and pages whose cues mislead (forms around articles,
menus within ``main``), so there the counts and densities decide.

Edge cases: null or empty html, and pages without content blocks, give an empty
text; an unclosed tag, comment, script or style runs to the end of its container or
of the page, other unclosed unseen elements hide nothing; a quote opens an attribute
value only after ``=``, and one that is never closed ends with its tag; a head
without end tag ends where its content does; extra columns are ignored; repeated
rows each appear; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.llm.common import prepare, table

#: Comment; other declaration or stray end; tag (name, attributes); text. A quote counts only after "=".
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![A-Za-z]))[^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+)(?:>|\Z)|[^<]+|<""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]++)))?+""")
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements whose text is never shown; their content is skipped to the closing tag.
_UNSEEN = frozenset("script style noscript template svg math iframe object canvas audio video select textarea title".split())
#: Unseen elements whose content is text: no tag counts in it but their own closing one.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.IGNORECASE | re.ASCII) for t in "script style noscript iframe textarea title".split()}
#: In a script, "<!--" and "<script" open a part in which "</script" closes only the inner one.
_SCRIPT = re.compile(r"<!--(?!-?>)|-->|<(/?)script(?=[\s/>]|\Z)", re.IGNORECASE | re.ASCII)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CONTENT_TAGS = frozenset(("article", "main"))
_OTHER_TAGS = frozenset("nav footer aside button menu dialog".split())
_FORM_TAGS = frozenset(("form", "fieldset"))
#: Words of class, id and role that announce something other than the article.
CUES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header hidden "
    "login menu modal nav navbar navigation newsletter notice pagination popup promo promoted recommended related search share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription tags toolbar widget alert reply replies respond masthead copyright legal complementary contentinfo".split()
)
_SPACE = re.compile(r"\s+")
_CLOSED_BY = {"p": _BLOCK, "li": frozenset(("li",)), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",))}


#: A cue after one of these says what a wrapper has or lacks, not what it is.
_NOT_NAMES = frozenset("has with no without is not hide show".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    other: bool
    form: bool
    content: int


def _cue(value: str) -> bool:
    """Whether a class, id or role names something other than the article."""
    for name in value.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
        if parts and parts[0] not in _NOT_NAMES and not CUES.isdisjoint(parts):
            return True
    return False


def _other(tag: str, attributes: str, within: int) -> bool:
    """Whether an element announces something other than the article it may stand in (``within``: 2 article, 1 main)."""
    if tag in _OTHER_TAGS or (tag == "header" and not within):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        elif name in ("class", "id", "role") and not (tag == "header" and within) and _cue(value):
            # An article may carry class words of its theme; only a reader's comment is none.
            if tag != "article" or re.search(r"\b(comments?|reply|replies|respond)\b", value):
                return True
    return False


def _raw_end(html: str, tag: str, at: int) -> int:
    """Where the closing tag of a raw-text element stands, or the end of the page."""
    if tag != "script":
        m = _RAW[tag].search(html, at)
        return m.start() if m else len(html)
    depth = 0  # 1 in a comment, 2 in a script of that comment
    for m in _SCRIPT.finditer(html, at):
        if m[0] == "<!--":
            depth = max(depth, 1)
        elif m[0] == "-->":
            depth = 0
        elif not m[1]:
            depth = 2 if depth else 0
        elif depth < 2:
            return m.start()
        else:
            depth = 1
    return len(html)


class _Ends:
    """Whether an end tag follows a place; each name is searched once over the page."""

    def __init__(self, html: str):
        self.html, self.found = html, {}

    def follow(self, tag: str, at: int) -> bool:
        known = self.found.get(tag, -1)
        if known is not None and known < at:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE | re.ASCII).search(self.html, at)
            known = self.found[tag] = m.start() if m else None
        return known is not None


def blocks(html: str) -> list[Block]:
    """Flat text blocks in page order."""
    found: list[Block] = []
    # Containers: tag, other, form, content; how many of each tag are open.
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
    opened: Counter[str] = Counter()
    ends = _Ends(html)
    text: list[str] = []
    linked: list[str] = []
    links, skip, depth, at = 0, "", 0, 0

    def flush() -> None:
        if text:
            plain = _SPACE.sub(" ", unescape("".join(text))).strip()
            if plain:
                n = plain.count(" ") + 1
                found.append(Block(plain, n, min(n, len(unescape(" ".join(linked)).split())), *stack[-1][1:]))
            text.clear()
            linked.clear()

    def leave(tag: str) -> None:
        while True:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == tag:
                return

    while m := _TOKEN.match(html, at):
        token, tag, at = m[0], m[1], m.end()
        tag = tag and tag.lower()
        closing, alone = token[1:2] == "/", token.endswith("/>")
        if tag in _RAW and not closing and not alone:
            at = _raw_end(html, tag, at)
        if skip:
            if tag == skip and not alone:
                depth += -1 if closing else 1
                if not depth:
                    skip = ""
            continue
        if tag is None:
            if token.startswith(("<!", "<?", "</")):
                continue
            text.append(token)
            if links:
                linked.append(token)
        elif tag in _UNSEEN:
            if tag in _BLOCK:
                flush()
            if not closing and not alone and (tag in _RAW or ends.follow(tag, at)):
                skip, depth = tag, 1
        elif tag == "head":
            # What may stand in a head is unseen anyway; the first other thing is the body's.
            flush()
        elif tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            text.append(" ")
        elif tag in _VOID:
            if tag in _BLOCK:
                flush()
                links = 0
        elif closing:
            if tag in _BLOCK:
                flush()
                links = 0
            if opened[tag]:
                flush()
                leave(tag)
        else:
            _, other, form, content = stack[-1]
            cue = _other(tag, m[2], content)
            if tag in _BLOCK or cue:
                flush()
                links = 0
                while len(stack) > 1 and tag in _CLOSED_BY.get(stack[-1][0], ()):
                    opened[stack.pop()[0]] -= 1
                _, other, form, content = stack[-1]
                here = 2 if tag == "article" else max(content, 1) if tag == "main" else content
                # An article or main within a form is what the form wraps.
                stack.append((tag, other or cue, (form or tag in _FORM_TAGS) and tag not in _CONTENT_TAGS, here))
                opened[tag] += 1
            elif opened[tag]:
                # An inline element within one of its name that is on the stack: their ends must pair.
                stack.append((tag, other, form, content))
                opened[tag] += 1
    flush()
    return found


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "other", "form", "content")


def features(page: list[Block]) -> np.ndarray:
    """Per block: words and link density of it, of the one before and of the one after, and the containers' cues."""
    if not page:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in page], float)
    density = np.array([b.linked for b in page]) / words
    before = lambda x: np.concatenate(([0.0], x[:-1]))
    after = lambda x: np.concatenate((x[1:], [0.0]))
    return np.stack([words, density, before(words), before(density), after(words), after(density), [b.other for b in page], [b.form for b in page], [b.content for b in page]], axis=1)


@dataclass
class Node:
    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Node:
    """A decision tree by Gini impurity; ties go to the first feature and cut."""
    node = Node(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0) or len(y) < 2 * least:
        return node
    gini = lambda v: 0.0 if not len(v) else 2 * v.mean() * (1 - v.mean()) * len(v)
    best = gini(y) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            if least <= low.sum() <= len(y) - least and (g := gini(y[low]) + gini(y[~low])) < best:
                best, node.feature, node.cut = g, f, float(cut)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def decide(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.share > 0.5)
    low = x[:, node.feature] <= node.cut
    out = np.zeros(len(x), bool)
    out[low], out[~low] = decide(node.low, x[low]), decide(node.high, x[~low])
    return out


#: The labelled table, a page a line: parts of label (y article, n not), container (within another after @) and blocks as words/linked words.
LABELLED = """
n nav 1/1 2/2 1/1 | n ad 12/0 | y article 6/0 60/0 1/0 35/0 2/0 | n footer 18/0 3/0 2/2
n nav 1/1 1/1 1/1 1/1 | n ad 7/0 3/0 | y article 9/0 80/0 120/0 4/0 | n comments 30/0 4/0 55/0 | n footer 8/0
n nav 2/2 | y article 1/0 1/0 1/0 | n footer 3/0
y article 10/0 | y article 6/0 14/0 1/0 | y article 19/0
n nav 1/1 | y article 8/0 17/0
n nav 2/2 2/2 | y article 12/0 5/0 9/0 2/0 15/0
n ad 11/0 | y main 7/0 16/0
y article 5/0 | y article 9/0 6/0 | y article 25/0 7/0
n nav 1/1 | y article 6/0 5/0
n footer 9/0 | y article 8/0 6/0
y main 40/0 6/0
n div 2/2 1/1 | y main 8/0 5/0
n nav 1/1 2/2 | n div 6/0
n div 7/0
y main 5/0 9/0
y article 4/4 9/9 2/2 3/3 1/1
n nav 2/2 1/1 | y article 90/0 | n nav 2/2 | n comments 80/0 5/4 70/0 20/20 90/0
y article 8/0 40/0 | n ad@article 5/5 12/0 | y article 3/3 60/0 2/0 | n nav@article 2/2 4/4 1/1 | y article 9/0 | n comments@article 50/0 20/9 3/0
y article 5/0 30/2 | n form@article 6/0 2/0 3/3 | y article 12/0 5/5 | n nav@article 3/3 3/3
y main 4/0 21/0 | n ad@main 9/0 4/4 33/0 | y main 2/0 70/5 | n form@main 5/0 4/4
n aside 7/7 | y main 75/0 80/9 | n footer 6/5 95/0
n form 3/3 | y article 70/0 | n form 2/2 70/0
n div 3/3 | y div 100/0 | n div 3/3 | n footer 80/0
n header 4/0 12/0 | n nav 3/3 2/2 | y article 7/0 20/0 17/8 3/0 5/5 2/2 3/3 1/0 | n aside 2/0 25/0 6/6 | n footer 40/0
n nav 1/1 1/1 | y article 2/0 40/0 | n ad 9/0 | y article 33/2 1/1 50/0 | n comments 62/0 41/0 12/1 | n footer 5/5 9/0
n header 2/0 30/0 | y main 6/0 1/0 90/0 3/0 | n ad 20/0 | y main 12/0 48/3 2/0 | n aside 3/0 70/0 45/0 | n footer 3/3
n nav 2/2 2/2 | y main 5/0 66/0 15/0 7/0 | n main 3/3 2/2 4/4 3/3 | n footer 10/0 2/2
n main 1/1 1/1 2/2 1/1 | y main 8/0 55/0 31/0 70/4 | n main 2/2 5/5 4/4 | n footer 25/2
n main 2/2 3/3 | y main 4/0 6/0 2/0 40/0 5/0 | n main 4/4 6/6 2/2
n aside 50/0 44/0 | y main 3/0 1/0 2/0 1/0 | n footer 30/0 31/0
n form 3/0 1/0 2/0 | y article 5/0 30/0 8/0 | n form 8/0 1/0 | n footer 6/0
n form 2/0 1/0 1/0 | n form 6/1 2/0 4/0 | y main 9/0 3/0 44/0 | n form 12/0 3/0 1/0
n nav 1/1 | n form 5/0 9/0
n nav 3/3 | n form 16/0
n form 1/1 2/2 1/1 | y form 52/0 75/2 33/0 60/0 | n form 3/3 4/2 2/2
n form 4/4 3/3 | y form 48/0 39/0 90/1 | n form 5/2 2/0 1/0
n nav 3/3 3/3 | y div 45/0 38/0 60/0 | n div 4/4 7/3
n div 5/5 | y div 45/0 38/0 60/0 | n div 4/4 7/3
n div 1/1 2/2 1/1 1/1 | y div 7/0 30/0 70/0 25/0 | n div 3/0 5/5
n div 2/2 2/2 3/3 | y div 5/0 52/1 14/0 80/0 | n div 5/3 4/4 7/7 2/0
n div 1/1 1/1 1/1 | y div 9/0 41/0 8/0 33/2 64/0 | n div 11/6 3/3
n div 2/0 3/3 4/4 | y div 6/0 95/3 12/0 40/0 28/0 | n div 2/2 2/2 2/2 6/0
n div 1/1 3/3 | y div 11/0 24/0 26/0 31/1 | n div 4/0 3/3 8/8 6/6
n div 2/2 1/1 4/0 | y div 30/0 18/0 47/5 22/0 | n div 5/5 9/9 3/0
n div 6/6 5/5 7/7 8/8 6/6 | y div 8/0 61/0 39/2 16/0 44/0 | n div 7/7 6/6 9/9 5/5
n div 14/12 | y div 55/0 73/6 48/0 | n div 20/16 9/7
n div 3/3 1/0 | y div 120/4 | n div 2/2 4/4
n div 1/1 1/1 | y div 6/0 150/9 | n div 10/4 2/2 1/0
n main 4/4 2/2 | y main 5/0 60/15 45/12 80/20 30/8 | n main 9/6 12/9
n div 2/2 2/2 | y div 50/11 70/0 64/18 38/10 | n div 16/11 8/6 4/4
n div 9/7 6/5 | y div 8/0 40/12 55/14 61/3 | n div 13/8 7/6
n div 3/0 2/2 2/2 2/2 | y div 10/0 35/0 9/0 50/0 7/0 42/1 | n div 3/0 6/6 7/7 5/5
"""
_OTHER_NAMES = frozenset("nav ad comments footer header aside".split())


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the table's blocks."""
    x, y = [], []
    for line in LABELLED.strip().splitlines():
        page: list[Block] = []
        for part in line.split("|"):
            label, name, *sizes = part.split()
            own, _, around = name.partition("@")
            for words, linked in (map(int, s.split("/")) for s in sizes):
                page.append(Block("", words, linked, own in _OTHER_NAMES, own == "form", {"article": 2, "main": 1}.get(around or own, 0)))
                y.append(float(label == "y"))
        x.append(features(page))
    return np.concatenate(x), np.array(y)


_tree: Node | None = None


def tree() -> Node:
    """The tree of the labelled table; grown once in each worker."""
    global _tree
    if _tree is None:
        _tree = grow(*labelled())
    return _tree


def main_text(html: str) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, good in zip(page, decide(tree(), features(page)), strict=True) if good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h or "") for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    prepare(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    """Contract of query 2."""
    return extract(table(spark, sf_dir, "pages"))
