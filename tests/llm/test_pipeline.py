"""Each stage of the pipeline, and all together, against brute force over rows with nulls, ties, repeats and clashing columns."""

import random
import re

import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from folioforge.llm import encoding, langid, pii
from folioforge.llm.common import materialize

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    some = [tuple(r) for r in df.orderBy("doc_id").limit(120).collect()]
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    rng = random.Random(2)
    long = " ".join(w for r in some[:40] for w in r[1].split())
    odd = [(None, some[3][1], "en", "s", 1), (7, f"{some[5][1]} {item} more", "en", "s", 1), (7, some[8][1][::-1], "en", "s", 1), (900, None, "en", "s", None), (901, "", None, None, 0), (902, "123 456", "en", "s", 7)]
    odd += [(903, long, "en", "s", len(long)), some[4], some[4], (904, some[4][1], "fr", "t", 0), (905, some[9][1] + " mail a.b@c.org or +1 (212) 555-0100 now", "en", "s", 1)]
    odd += [(906 + k, item if k else item.upper(), "es", "s", 1) for k in range(2)] + [(None, "un texte sans numéro " + rng.choice(some)[1], "fr", "s", 1)]
    rows = [(*r, "clash", 5) for r in [*some, *odd]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, item_id int").repartition(3)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def fingerprint(t):
    w = words(t)
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]


def holds(t, items):
    from collections import Counter

    w = words(t)
    for b in items:
        if not set(grams(w)) & set(grams(b)):
            continue
        for s in range(max(1, len(w) - len(b) + 1)):
            x, y = Counter(grams(w[s : s + len(b)])), Counter(grams(b))
            if sum((x & y).values()) >= 0.8 * sum((x | y).values()) - 1e-12:
                return True
    return False


def test_stages(spark, docs):
    items = [words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    model = langid.fit(docs)
    df, stages = docs, dict(corpus_pipeline.STAGES)

    out = materialize(stages["language"](spark, df, FOLDER), "test")
    found = langid.identify(docs, model, "lang", "source", "n_chars", "fingerprint", "item_id").where("NOT __rejected").select(*docs.columns)
    assert out.columns == docs.columns and plain(out) == plain(found)
    assert not [r for r in out.collect() if not any(c.isalpha() for c in r.text or "")]
    df = out

    out = materialize(stages["near_duplicates"](spark, df, FOLDER), "test")
    rows = plain(df)
    fps = [fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    order = lambda r: (r[0] is None, r[0] or 0)
    groups = {}
    for r, k in zip(rows, root, strict=True):
        groups.setdefault(k, []).append(r)
    kept = plain(out)
    assert len(kept) == len(groups) and sorted(map(order, kept)) == sorted(min(map(order, g)) for g in groups.values())
    assert all(r in rows for r in kept)
    df = out

    out = materialize(stages["decontamination"](spark, df, FOLDER), "test")
    assert plain(out) == [r for r in plain(df) if not holds(r[1], items)] and out.count() < df.count()
    df = out

    out = materialize(stages["personal_data"](spark, df, FOLDER), "test")
    assert plain(out) == sorted(((r[0], pii.masked(r[1]), r[2], r[3], len(pii.masked(r[1])), *r[5:]) for r in plain(df)), key=repr)
    df = out

    got = stages["packed"](spark, df, FOLDER).toPandas()
    tokenizer = encoding.Encoder(encoding.default_path()).tokenizer
    total = sum(len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in plain(df))
    assert got.length.sum() == total and got.sequence_id.nunique() <= -(-total // 2048) + 1
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048


def test_personal_data_of_null_text(spark, docs):
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.personal_data(spark, docs.where("doc_id IN (900, 901)"), FOLDER).collect()}
    assert got == {900: (None, None), 901: ("", 0)}


def test_empty_tables(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_run_equals_its_stages(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        df = materialize(stage(spark, df, FOLDER), "test")
    got = corpus_pipeline.run(spark, FOLDER)
    assert plain(got.select("doc_id", "piece", "start", "length", "ids_crc32")) == plain(df.select("doc_id", "piece", "start", "length", "ids_crc32"))
