"""Statements that go beyond their DuckDB form, against plain Python."""

from folioforge.plans import catalog


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_neighbours_over_block_edges(spark, tmp_path):
    ids = {"a": [3, 999, 1000, 1500, 5200], "b": [40, 9000], None: [7, 2001]}
    docs = [(k, "rarest term" if k in (999, 1500, 5200, 40, 2001) else "other words", "en", s, 1) for s, ks in ids.items() for k in ks]
    got = {(r.doc_id, r.hop) for r in catalog.run("context_expand", spark, write(spark, tmp_path, docs, [(0, "rarest")])).collect()}
    hits = {k for k, t, *_ in docs if t == "rarest term"}
    near = {x for ks in ids.values() for a, z in zip(ks, ks[1:], strict=False) for k, x in ((a, z), (z, a)) if k in hits}
    assert got == {(k, 0) for k in hits} | {(k, 1) for k in near - hits}


def test_quotes_with_altered_start(spark, tmp_path):
    quote = "alpha beta gamma delta epsilon zeta theta iota kappa lambda"
    items = [(1, quote), (2, "zeta theta"), (3, "of it"), (4, "one two three four five six seven eight nine ten"), (5, None)]
    docs = [(1, f"so {quote} ends"), (2, "ALPHA beta changed delta epsilon zeta theta iota kappa lambda"), (3, "alpha beta gamma delta and nothing more"), (4, "seven eight nine ten"), (5, "part of it"), (6, None)]
    got = {(r.item_id, r.doc_id, r.status) for r in catalog.run("citation_check", spark, write(spark, tmp_path, [(k, t, "en", "s", 1) for k, t in docs], items)).collect()}
    found, fuzzy, missed = "verified_exact", "verified_fuzzy", "page_available_quote_not_found"
    assert got == {(1, 1, found), (1, 2, fuzzy), (1, 3, missed), (2, 1, found), (2, 2, found), (3, 5, found)}


def test_category_of_long_texts(spark, tmp_path):
    docs = [(1, "word " * 4000 + "hop dong", "en", "s", 1), (2, "word " * 4000, "en", "s", 1)]
    got = {r.doc_id: r.category for r in catalog.run("quality_flags", spark, write(spark, tmp_path, docs, [(0, "x")])).collect()}
    assert got == {1: "contract", 2: "document"}
