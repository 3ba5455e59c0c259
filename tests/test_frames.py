"""Operators on frames, and hand-derived rows of statements."""

import os

import pytest
from pyspark.sql import functions as F

from folioforge.operators import evidence, merging, selection
from folioforge.plans import catalog

DATA = "/root/testdata/sf0.001"


def folder(spark, path, docs=None, items=None, **tables):
    if docs is not None:
        spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    if items is not None:
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    for t in catalog.TABLES:
        if not os.path.exists(f"{path}/{t}.parquet"):
            os.symlink(f"{DATA}/{t}.parquet", f"{path}/{t}.parquet")
    return str(path)


def rows(spark, path, name, *cols):
    return sorted((tuple(r[c] for c in cols) for r in catalog.run(name, spark, path).collect()), key=repr)


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", [1, 2], {"k": "x"}), (2, "b", [3], {"k": "7"}), (3, None, [], {}), (4, "a", None, None)], "id int, kind string, pages array<int>, meta map<string,string>")
    ids = lambda f, **k: sorted(r.id for r in selection.passes(df, f, **k).collect())
    assert ids(None) == ids({}) == ids({"kind": None}) == [1, 2, 3, 4]
    assert ids({"kind": "a"}) == [1, 4] and ids({"kind": ["a", "b"], "pages": [2, 3]}) == [1, 2]
    assert ids({"pages": 3}) == [2] and ids({"pages": []}) == [] == ids({"kind": []})
    assert ids({"k": 7}, metadata="meta") == [2] and ids({"k": 7}) == []
    assert selection.merge_filters({"page": 1}, page=[2], table=["t"], none=None) == {"page": 1, "table": ["t"]}


def test_merging(spark):
    df = spark.createDataFrame([(1, None, 2), (1, None, 1), (2, "x", 1)], "k int, t string, o int")
    assert sorted(merging.first_of(df, [F.col("k"), F.col("t")], F.col("o")).collect()) == [(1, None, 1), (2, "x", 1)]
    assert df.select(merging.merge_unique(F.array(F.lit(2), F.lit(1)), F.array(F.lit(1), F.lit(3))).alias("u")).first().u == [2, 1, 3]


def test_boxes_grow_to_a_fixed_point(spark):
    # The first two join by their gap; only then the third is near enough; the fourth stands aside.
    boxes = [[0, 0, 100, 10], [10, 30, 110, 40], [0, 60, 90, 70], [300, 0, 310, 10]]
    assert merging.join_boxes(boxes) == [([0, 0, 110, 70], 3), ([300, 0, 310, 10], 1)]
    df = spark.createDataFrame([(p, *map(float, b)) for p in (1, 2) for b in boxes], "page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.page, r.x1, r.n) for r in merging.merge_boxes(df).collect()) == [(p, x, n) for p in (1, 2) for x, n in ((110.0, 3), (310.0, 1))]
    assert merging.merge_boxes(df.limit(0)).count() == 0


def test_checks():
    assert evidence.combine_checks({}) == 0
    got = evidence.combine_checks({"quote_in_page": ("exact", 0.95), "page_reference": ("ok", 0.55), "bbox": ("no_bbox", 0.0)})
    assert got == pytest.approx((0.95 * 3 + 0.55 * 1.5) / 4.5)
    assert evidence.record_key(" Unit  Price (VND) ") == "unit_price_vnd"


def test_section_levels(spark, tmp_path):
    path = folder(spark, tmp_path, [(1, "1 One\n1.1 One one\n1.1.1 Deep\n2 Two\n2.1 Two one"), (2, None), (3, "")])
    assert rows(spark, path, "section_tree", "section", "level", "parent") == [(1, 1, 0), (2, 2, 1), (3, 3, 2), (4, 1, 0), (5, 2, 4)]


def test_entities_end_with_words(spark, tmp_path):
    path = folder(spark, tmp_path, [(1, "5 đi mua, 1/2/20201, 3/4/2020 5/6/2021 và 7 đồng")])
    found = rows(spark, path, "entities", "kind", "entity")
    assert [e for k, e in found if k == "date"] == ["3/4/2020", "5/6/2021"] and [e for k, e in found if k == "money"] == ["7 dong"]


def test_running_means(spark, tmp_path):
    # Tops 0, 2, 4: the third is within 3 of the mean 1 of the first two, 9 is not.
    line = [(1, 0, y, k, 50.0, 1.0, 0.0, 0.0, "A", "F", None) for k, y in ((1, 0), (3, 2), (5, 4), (7, 9))]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    path = folder(spark, tmp_path, lineitem=(line, schema))
    assert rows(spark, path, "baseline_lines", "cluster", "position", "n") == [(1, 2.0, 3), (2, 9.0, 1)]


def test_lists_and_kinds_of_lines(spark, tmp_path):
    path = folder(spark, tmp_path, [(1, "- one\n- two\n1) three\n2) four\nplain\nplain\nplain\n- five"), (2, "3/10\ntrang 4\n- 5 -\nnăm 2020\nHình 2 một sơ đồ\na wide line of text that stands below it")])
    assert rows(spark, path, "list_groups", "doc_id", "list_no", "kind", "items") == [(1, 1, "bullet", 2), (1, 2, "number", 2), (1, 3, "bullet", 1), (2, 1, "bullet", 1)]
    assert rows(spark, path, "line_kinds", "doc_id", "line_no", "page_number") == [(2, 0, True), (2, 1, True), (2, 2, True), (2, 3, False)]
    assert [r[:2] for r in rows(spark, path, "caption_links", "doc_id", "line_no", "target")][-1] == (2, 4)


def test_markers(spark, tmp_path):
    path = folder(spark, tmp_path, [(1, "see [tr.3] and [tr.3], [12], 【4】 and [page 7]")])
    assert rows(spark, path, "marker_mentions", "hit", "n") == [("0|[tr.3]", 2), ("2|[page 7]", 1), ("3|[12]", 1), ("4|【4】", 1)]


def test_expansion_prefers_the_nearest_kind(spark, tmp_path):
    text = "\n".join(["A section", *(f"a line of text that is long enough to be chunk number {k}, rarest" for k in range(4)), "Another one", "a line that is long enough to stand in another section."])
    path = folder(spark, tmp_path, [(1, text), (2, "nothing of it")], [(0, "rarest")])
    got = {r[0]: r[1:] for r in rows(spark, path, "expand_chunks", "line_no", "kinds", "score")}
    best = got[2][1]
    assert got[2][0] == "original" and got[1] == ("neighbor+same_page+same_section", pytest.approx(0.72 * best, abs=1e-4)) and got[4][0] == "same_page+same_section" and got[6][0] == "same_page"


def test_index_follows_the_documents(spark, tmp_path):
    path = folder(spark, tmp_path, [(1, "rarest word")], [(0, "rarest")])
    assert rows(spark, path, "bm25_search", "doc_id") == [(1,)]
    spark.createDataFrame([(5, "rarest thing", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    assert rows(spark, path, "bm25_search", "doc_id") == [(5,)]
