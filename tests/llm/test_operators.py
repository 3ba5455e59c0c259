"""Operators against brute force, on small fixtures with nulls, empty and long texts, repeats and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from folioforge.llm import decontam, encoding, html_text, langid, packing, pii, quality_rules, simhash, token_store, url_graph, warc
from folioforge.llm.common import new_folder

WORDS = [f"w{k}" for k in range(400)]


def texts():
    rng = random.Random(4)
    made = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (0, 1, 2, 3, 5, 60, 200, 3000)]
    made += [made[5]] * 3 + [made[6] + " w1", made[6][:-3] + " w9", None, "", " \n\t ", "a b c " * 40, "\n".join(["same line here"] * 9)]
    near = made[7].split()
    for k in range(12):
        near[k * 7] = "x"
        made.append(" ".join(near))
    return made


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, "s", 0, "clash", 1) for k, t in enumerate(texts())]
    rows += [rows[5], (None, "null id text with words", "en", "s", 0, "c", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, n_words int").repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket_rows", [8192, 4])
def test_simhash(docs, bucket_rows):
    got = simhash.near_duplicates(docs, bucket_rows=bucket_rows).collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    want = sorted(((d, f, least[r]) for (d, f), r in zip(rows, root, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == want


def test_bit_slices_find_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = np.sort(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for _ in range(10)]))
    planes = simhash.Planes(fps)
    for d in (1, 5, 63, 64, 130):
        n = len(fps) - d
        mask = np.arange(len(fps)) < n
        want = [i for i in range(n) if (int(fps[i]) ^ int(fps[i + d])).bit_count() <= 2]
        assert simhash.close_at(planes, d, mask, 2).tolist() == want


def test_quality_counts(spark, docs, none):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(10)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    for k, t in enumerate(texts()):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        at = {i + j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[g] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        assert (got[k].n_words, got[k].n_repeat_words, got[k].n_dup_lines) == (len(w), len(at), len(lines) - len(set(lines)))
        assert got[k].base_failed == (len(w) < 50 or 2 * len(at) > len(w))
    assert quality_rules.judge(none, labels).count() == 0


def test_quality_cutoffs_are_controlled(spark):
    rows = [(k, "en", False, 0.0 if k % 10 else 3.0, 0.0, 0.0, 0.0) for k in range(4000)]
    m = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, symbols double, repeats double, dup_lines double, capitals double")
    bad_only = spark.createDataFrame([(k, int(k % 10 > 0)) for k in range(4000)], "doc_id long, quality int")
    all_good = bad_only.selectExpr("doc_id", "1 AS quality")
    assert [(r.rule, r.cutoff) for r in quality_rules.cutoffs(m, bad_only).collect()] == [("symbols", 2.0)]
    assert quality_rules.cutoffs(m, all_good).count() == 0


def test_decontamination(spark, docs, none):
    rng = random.Random(2)
    item = [f"b{rng.randrange(60)}" for _ in range(40)]
    near = item[:20] + ["zz"] + item[21:]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "only three words")], "item_id long, text string")
    rows = [(100, "q " * 30 + " ".join(item).upper() + " r" * 9), (101, "s " * 5 + " ".join(near)), (102, " ".join(item[:20])), (103, "x only three words"), (104, "only three words")]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.similarity) for r in decontam.contaminated(docs.select("doc_id", "text").union(more), items).collect()}

    def grams(w, width):
        return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))

    want = set()
    for d, t in rows:
        for i, b in ((1, item), (3, ["only", "three", "words"])):
            w = t.lower().split()
            best = 0
            for s in range(max(1, len(w) - len(b) + 1)):
                x, y = (grams(v, min(5, len(b))) for v in (w[s : s + len(b)], b))
                best = max(best, sum((x & y).values()) / sum((x | y).values()))
            if best >= 0.8:
                want.add((d, i, round(best, 6)))
    assert got == want
    assert decontam.contaminated(none, items).count() == 0


def test_decontamination_of_short_items(spark, tmp_path):
    items = [(1, "Alone"), (2, "two words"), (3, "only three words"), (4, "these are four words"), (5, "now there are five words"), (6, " ")]
    texts = ["x only THREE words", "only three words", "two words, two words two words", "words two", "so these are four words and now there are five words alone", "only three", "three words", None, "alone"]
    rows = [*enumerate(texts), (None, "y alone")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for d, t in rows:
        w = (t or "").lower().split()
        for i, b in items:
            b = b.lower().split()
            at = [s for s in range(len(w) - len(b) + 1) if w[s : s + len(b)] == b]
            if b and at:
                want.add((d, i, 1.0, at[0], len(b)))
    assert {tuple(r) for r in decontam.op4_decontamination(spark, str(tmp_path)).collect()} == want


@pytest.fixture(scope="module")
def tokenizer():
    return encoding.Encoder(encoding.default_path()).tokenizer


def test_encoder_equals_library(tokenizer):
    import pyarrow as pa

    rng = random.Random(3)
    some = ["", None, "İstanbul ΣΑΣ", "x y \x85z\x1cq", "<|endoftext|> a", "don't I'll"] + ["".join(rng.choice("aB é'sÀ́ \n\t12.,İΣ中 ") for _ in range(40)) for _ in range(500)]
    ids, bounds = encoding.encoder(encoding.default_path()).encode(pa.array(some))
    assert [ids[a:z].tolist() for a, z in zip(bounds, bounds[1:], strict=False)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]


def test_packing(docs, none, tokenizer):
    got = packing.pack(docs, island_items=6).toPandas()
    want = []
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k, 2048 * k, len(p), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // 2048)) for p in [ids[2048 * k : 2048 * k + 2048]]]
    seen = [(None if d != d else int(d), *x) for d, *x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(map(repr, seen)) == sorted(map(repr, want))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert packing.pack(none).count() == 0


def test_token_store(spark, docs, none, tokenizer):
    folder = new_folder(spark, "test")
    manifest = token_store.write_store(docs, folder, shards=3)
    got = token_store.read_store(manifest, folder).toPandas().sort_values("start")
    assert got.start.tolist() == [0, *got.n_tokens.cumsum().tolist()[:-1]]
    ids = [d for d in got.doc_id.tolist() if d == d]
    assert ids == sorted(ids) and len(got) == docs.count()
    want = Counter(zlib.crc32(np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in docs.collect())
    assert Counter(got.ids_crc32.tolist()) == want
    assert token_store.lookup(manifest, folder, 7).tolist() == [*tokenizer.encode(texts()[7], add_special_tokens=False).ids, 2]
    assert token_store.lookup(manifest, folder, 10**9) is None
    assert token_store.read_store(token_store.write_store(none, new_folder(spark, "test")), folder).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(2).integers(-(2**62), 2**62, 5000))
    assert sorted(token_store.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_pii_equals_patterns(docs, none):
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("@.+-1259 a(0") for _ in range(rng.randint(0, 30)))
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == plain_spans(t)
    card = "card 4111 1111 1111 1111, 0" + "0" * 5000 + "1.2.3.4"
    assert [s for s in pii.spans(card) if s[0] in pii.BASE] == [("ip", 26, len(card)), ("card", 5, 24)]
    assert pii.masked("mail a.b@c.de or DE89 3704 0044 0532 0130 00 now") == "mail <EMAIL> or <ACCOUNT> now"
    assert pii.masked("a clean text, token of 3 words") == "a clean text, token of 3 words"
    assert pii.find(docs).count() == docs.count() and pii.find(none).count() == 0


def test_html(spark):
    page = "<html><head><title>t</title><style>x</style></head><body><nav><a href=/>m</a></nav><article><h1>A &amp; B</h1><p>one<b>two</b>\n three<p>El.<div class='ad'>buy</div><script>1</script></article><footer>f</footer>"
    assert html_text.main_text(page) == "A & B\nonetwo three\nEl."
    assert html_text.main_text("<div><a href=/>x y</a></div>") == html_text.main_text("") == html_text.main_text("<!-- <p>a") == ""
    df = spark.createDataFrame([(1, None, None), (2, "u", page)], "page_id long, url string, html string")
    assert [(r.page_id, r.n_chars) for r in html_text.extract(df).orderBy("page_id").collect()] == [(1, 0), (2, 22)]


@pytest.mark.parametrize(
    "before",
    [
        "<script>for(i=0;i<n;i++){f(i);}</script>",
        "<head><title>a<b</title><script>if(a<b){}</script></head>",
        "<html><head class='ad'><title>t</title><meta charset=x><style>a<b{}</style>",
        "<head><script>x='<p>'</SCRIPT ><template><p>no</template>",
        "<textarea>a<b</textarea><svg><style>a<b</style></svg>",
        "<script><!-- <script>a<b</script> c<d --></script>",
        "<script><!-- a<b </script>",
    ],
)
def test_html_raw_text(before):
    assert html_text.main_text(before + "<article><h1>A title</h1><p>one two three</article>") == "A title\none two three"
    assert html_text.main_text("<article><p>one two three</p></article><script>a<b") == "one two three"


def test_warc_round_trip(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k % 7} é</p>" * (k % 7)) for k in range(40)] + [(99, None, None), (3, "again", "<p>3 é</p>" * 3), (None, "n", "only"), (None, "n", "<p>1 é</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = new_folder(spark, "test")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(df, folder), folder).collect()), key=repr)
    least = {}
    for p, _, h in rows:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    want = []
    for p, _, h in rows:
        b, first = (h or "").encode(), least.get(h or "")
        again = first is not None and first != p
        want.append((p, len(b), warc.digest(b), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)


def test_language_id(spark, docs, none):
    rng = random.Random(5)
    words = {"aa": ["abra", "bacad", "cabda"], "zz": ["zyx", "xyzyx", "wyzzy"]}
    rows = [(k, " ".join(rng.choice(words[g]) for _ in range(20)), g) for k in range(300) for g in [rng.choice(["aa", "zz"])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = langid.identify(df, model, "lang").collect()
    assert sum(r.lang == r["__lang_pred"] for r in got) >= 0.98 * len(got) and all(0 <= r["__score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, "12 !?")], "doc_id long, text string")
    assert {r["__lang_pred"] for r in langid.identify(odd, model).collect()} == {"und"}
    assert langid.fit(none) is None and langid.identify(none, None).count() == 0


def test_url_graph(spark):
    rows = [(1, "https://A.example.ORG/es/x?y", ""), (2, "http://x.com/de/", ""), (3, "http://far.net/p", '<a href="http://x.com/q">'), (4, None, None), (5, "no scheme", ""), (6, "http://org", ""), (7, "http://a.net#f", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_graph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2] == ("x.com", "/de/", "com/de/", "block")
    assert got[3] == ("far.net", "/p", None, "block") and got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("org", "", None, "allow") and got[7] == ("a.net", "", None, "allow")


def test_url_graph_is_local(spark):
    to = lambda *hosts: "".join(f'<a href="http://{h}/">' for h in hosts)
    rows = [(0, "http://x.com/de/", "")] + [(k, f"http://near{k}.net/", to("x.com")) for k in range(1, 101)]
    chain = [f"chain{k}.net" for k in range(12)] + ["x.com"]
    rows += [(200 + k, f"http://{a}/", to(b)) for k, (a, b) in enumerate(zip(chain, chain[1:], strict=False))]
    rows += [(302, "http://free.net/", "")]
    others = [(1000 + k, f"http://o{k}.com/de/", "") for k in range(2000)]
    verdicts = lambda r: {x.page_id: x.verdict for x in url_graph.judge(spark.createDataFrame(r, "page_id long, url string, html string")).collect() if x.page_id < 1000}
    want = {k: "allow" if k == 302 else "block" for k, _, _ in rows}
    assert verdicts(rows + others) == want


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) == len(groups)


def test_pipeline_decontamination_keeps_clean_rows(spark, docs):
    folder = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(k, t, "en", "s", len(t), c, 1) for k in (None, 7) for c, t in (("hit", f"so {item} it goes"), ("clean", "some clean text of this very id"), ("clean", "another clean text of this very id"))]
    got = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, docs.schema), folder)
    assert got.columns == docs.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(r) for r in rows if r[5] == "clean")


def test_pipeline_runs(spark, tmp_path):
    from folioforge.llm.common import materialize

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, df, "/root/testdata/sf0.001"), "test")
        assert out.columns == df.columns and 0 < out.count() <= df.count()
        df = out
