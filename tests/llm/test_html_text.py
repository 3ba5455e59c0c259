"""Main text against pages built from known blocks, markup faults, and pages without cues."""

import random
from html import escape

import pytest

from folioforge.llm import html_text

ARTICLE = "<article><h1>A title</h1><p>one two three</article>"


def used(node):
    return set() if node.feature < 0 else {html_text.FEATURES[node.feature]} | used(node.low) | used(node.high)


def test_tree_uses_counts_and_neighbours():
    assert {"density", "words", "words_after"} <= used(html_text.tree()) or {"density", "words", "words_before"} <= used(html_text.tree())
    x, y = html_text.labelled()
    assert (html_text.decide(html_text.tree(), x) == (y > 0.5)).mean() > 0.98


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<script>for(i=0;i<n;i++){x=1}</script>" + ARTICLE, "A title\none two three"),
        ("<html><head><title>t</title><meta charset=x>" + ARTICLE, "A title\none two three"),
        ("<article><p><a href=x title=don't>a link</a> and it's text</p><p>more", "a link and it's text\nmore"),
        ('<article><p title="abc>text here</p></article>', "text here"),
        ("<article><p title='abc>text here</p></article>", "text here"),
        ('<article><p title="a > b" data-x=\'c > d\'>text here</p></article>', "text here"),
        ("<article><header><h1>Head line</h1></header><p>text here</article>", "Head line\ntext here"),
        ("<header><p>The name of this site and its motto of the day</p></header>" + ARTICLE, "A title\none two three"),
        ("<form id=aspnetForm><input><main><h1>T</h1><p>text one two three</main></form>", "T\ntext one two three"),
        ("<form>Search the site</form>" + ARTICLE, "A title\none two three"),
        ("<div class='page has-sidebar'>" + ARTICLE + "</div>", "A title\none two three"),
        ("<article><p>a <span class=ad><span>x</span> y</span> b</article>", "a\nb"),
        ("<article><svg><svg></svg>no</svg><video src=x><p>text here</article>", "text here"),
        ("<article><p>x</p><section id=comments><article class=comment><p>" + "w " * 40 + "</article></section></article>", "x"),
        ("<article><p>a &lt; b &amp;amp; c<!-- > --> d<!--> e</> f</3 g> h<br>i\n\t j", "a < b &amp; c d e f h i j"),
        ("<article><p>2 <3 and a<b c", "2 <3 and a"),
        ("", ""),
        ("<!-- <p>a", ""),
    ],
)
def test_markup(page, text):
    assert html_text.main_text(page) == text


def test_generated_pages():
    rng = random.Random(7)
    words = ["alpha", "bêta", "don't", "a<b", 'say "x"', "R&D", "5 > 4", "naïve", "—"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    def block(t):
        tag = rng.choice(["p", "h2", "blockquote", "pre", "div", "li", "td"])
        attributes = rng.choice(["", " class=x", ' title="a > b"', " data-a='it\"s'", " id=p" + str(rng.randrange(9))])
        inside = escape(t, quote=rng.random() < 0.5).replace(" ", rng.choice([" ", "\n ", "\t"]))
        return f"<{tag}{attributes}>{rng.choice(['', '<!-- <p>no --> ', '<script>a<b</script>'])}{inside}" + (f"</{tag}>" if tag == "div" or rng.random() < 0.7 else "")

    noise = {
        "nav": lambda: "<nav><ul>" + "".join(f"<li><a href=/{k}>{escape(text(2))}</a>" for k in range(4)) + "</ul></nav>",
        "ad": lambda: f"<div class='{rng.choice(['ad', 'sidebar-right', 'cookie-notice', 'newsletter'])}'>{escape(text(30))}</div>",
        "comments": lambda: f"<section id=comments><p>{escape(text(60))}</p><p>{escape(text(3))}</p></section>",
        "form": lambda: f"<form><label>{escape(text(3))}</label><input name=a value='x>'><button>Go</button></form>",
        "script": lambda: "<script>if(a<b){document.write('<p>'+c)}</script><style>a>b{}</style><template><p>t</template>",
    }
    for _ in range(300):
        body = [text(rng.choice([1, 2, 8, 40, 90])) for _ in range(rng.randint(1, 7))]
        inner = "".join(block(t) + (noise[rng.choice(["ad", "script", "comments"])]() if rng.random() < 0.2 else "") for t in body)
        around = lambda: "".join(noise[k]() for k in rng.sample(sorted(noise), 2))
        page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{around()}<article>{inner}</article>{around()}<footer>{escape(text(20))}</footer>"
        assert html_text.main_text(page) == "\n".join(body)


def test_pages_without_cues():
    """Only counts and densities tell: measured over blocks of pages of plain divisions."""
    rng = random.Random(9)
    right = total = 0
    for _ in range(200):
        plan = [(0, rng.randint(1, 4), 1.0) for _ in range(rng.randint(2, 6))]
        plan += [(1, rng.randint(20, 120), rng.choice([0, 0, 0.05, 0.2])) for _ in range(rng.randint(3, 9))]
        plan += [(0, rng.randint(2, 12), rng.uniform(0.6, 1)) for _ in range(rng.randint(1, 5))]
        page = ""
        for k, (_, n, share) in enumerate(plan):
            m = round(n * share)
            page += "<div>" + f"t{k} " + "w " * (n - m) + (f"<a href=/>{'l ' * m}</a>" if m else "") + "</div>"
        got = {line.split()[0] for line in html_text.main_text(page).split("\n") if line}
        right += sum((f"t{k}" in got) == bool(y) for k, (y, _, _) in enumerate(plan))
        total += len(plan)
    assert right / total >= 0.9, right / total


def test_unclosed_tags_are_linear():
    assert html_text.main_text("<div>" * 20_000 + "</span>" * 20_000 + "<svg>" * 20_000 + ARTICLE) == "A title\none two three"


def test_rows(spark):
    rows = [(1, None, None, "t"), (2, "u", ARTICLE, "t"), (2, "u", ARTICLE, "t"), (None, "v", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(df).collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (2, "u", "A title\none two three", 21), (2, "u", "A title\none two three", 21), (None, "v", "", 0)], key=repr)
    assert html_text.extract(df.limit(0)).count() == 0
