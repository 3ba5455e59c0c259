"""Hand-derived results on small tables with the cases the test data lacks: contents lines, captions, Vietnamese forms, nulls, empty and repeated rows."""

import os

import duckdb
import pytest

from folioforge.plans import catalog

DATA = "/root/testdata/sf0.001"
DOCS = [
    (0, "Mục lục\n1. Giới thiệu ..... 3\n1.2 Phạm vi … 12\nKết luận ...... 40\nBảng 1 Số liệu\na | b\nHình 2: sơ đồ\n", "vi", "s"),
    (1, None, None, None),
    (2, "", "en", "s"),
    (3, "Theo Quyết định số 12/QĐ-CP ngày 3 tháng 4 năm 2020, xem trang 5 và Bảng 2.1; 1.500 đồng, 12,5 %, a.b@c.org, https://x.org/a?b=1.", "vi", "s"),
    (4, "Theo Quyết định số 12/QĐ-CP ngày 3 tháng 4 năm 2020, xem trang 5 và Bảng 2.1; 1.500 đồng, 12,5 %, a.b@c.org, https://x.org/a?b=1.", "vi", "t"),
    (5, "Hợp đồng\n• một\n- hai\n(3) ba\nIV. Bốn\n" + "x" * 9000, "vi", "t"),
]
TURNS = [
    (0, 0, "user", "So sánh bảng 1 và bảng 2 trang 3-5, năm 2021?"),
    (0, 1, "assistant", "các đơn vị của"),
    (0, 2, "user", "nhà nước thực hiện"),
    (1, 0, "user", "Chương II Quy định chung."),
    (1, 1, "assistant", "Điều khoản mới."),
    (2, 0, "user", None),
    (2, 1, "assistant", ""),
]
NEEDS = ("documents", "conversations", "benchmark", "labels", "pages", "embeddings")


def _folder(spark, path, docs, turns):
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(0, "Quyết định số 12 của nhà nước."), (1, None), (100, "")] if docs else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for t in catalog.TABLES:
        if not os.path.exists(f"{path}/{t}.parquet"):
            os.symlink(f"{DATA}/{t}.parquet", f"{path}/{t}.parquet")
    c = duckdb.connect()
    for t in catalog.TABLES:
        at = f"{path}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    return c


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    return path, _folder(spark, path, DOCS, TURNS)


def _names():
    return [n for n, sql in catalog.oracle_sql().items() if any(f"FROM {t}" in sql or f"JOIN {t}" in sql for t in NEEDS)]


def _same(spark, path, duck, name):
    got, want = catalog.run(name, spark, path).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert sorted(got.columns) == cols
    assert rows(got) == rows(want), name


@pytest.mark.parametrize("name", _names())
def test_odd_rows(spark, small, name):
    _same(spark, *small, name)


def test_empty_tables(spark, tmp_path):
    duck = _folder(spark, str(tmp_path), [], [])
    for name in ("entities", "virtual_pages", "packed_chunks", "bm25_search", "hybrid_rrf", "query_classify", "extractive_answer", "section_tree", "paragraph_continuation"):
        _same(spark, str(tmp_path), duck, name)


def _rows(spark, small, name, *cols):
    return sorted(tuple(r[c] for c in cols) for r in catalog.run(name, spark, small[0]).collect())


def test_contents(spark, small):
    assert _rows(spark, small, "toc_lines", "line_no", "section_number", "target_page", "level", "title") == [(1, "1.", 3, 1, "Giới thiệu"), (2, "1.2", 12, 2, "Phạm vi"), (3, "", 40, 1, "Kết luận")]


def test_captions(spark, small):
    assert _rows(spark, small, "captions", "line_no", "kind", "nearest") == [(4, "table_caption", 5), (6, "figure_caption", 5)]


def test_entities(spark, small):
    found = {(k, e) for d, k, e in _rows(spark, small, "entities", "doc_id", "kind", "entity") if d == 3}
    assert {("decision", "quyet dinh so 12/qd-cp"), ("date", "ngay 3 thang 4 nam 2020"), ("percentage", "12 5 %"), ("email", "a.b c.org"), ("table_reference", "bang 2.1")} <= found
    assert ("decision", "quyet dinh so 12/qd-cp", 2) in _rows(spark, small, "entity_links", "kind", "entity", "documents")


def test_references(spark, small):
    found = {(k, r) for d, k, r in _rows(spark, small, "references", "doc_id", "kind", "target") if d == 3}
    assert {("page_reference", "5"), ("table_reference", "2.1")} <= found


def test_continuation(spark, small):
    # no mark .25 (connector) + lower case .22 + next turn .08 + completion .12
    assert (0, 1, 0.67) in _rows(spark, small, "paragraph_continuation", "conv_id", "turn", "score")
    assert not [r for r in _rows(spark, small, "paragraph_continuation", "conv_id", "turn") if r[0] == 1]


def test_queries(spark, small):
    kinds = {r[0]: r[1:] for r in _rows(spark, small, "query_classify", "query_id", "intent", "query_type", "query_scope")}
    assert kinds["c:0:0"] == ("table_query", "table", "page") and kinds["c:0:2"][0] == "factual"
    named = {r[0]: r[1:] for r in _rows(spark, small, "query_filters", "query_id", "page_ranges", "pages", "tables", "years")}
    assert named["c:0:0"] == ("trang 3-5", "3", "1,2", "2021")
    plan = {r[0]: r[1:] for r in _rows(spark, small, "route_plan", "query_id", "route", "level", "complexity")}
    assert plan["c:0:0"] == ("hybrid", "high", 2.5)


def test_pages(spark, small):
    assert [r[1:] for r in _rows(spark, small, "virtual_pages", "doc_id", "page_number", "n_chars") if r[0] == 5] == [(1, 35), (2, 9000)]
    assert [r[1:] for r in _rows(spark, small, "packed_chunks", "doc_id", "chunk_order", "n_chars") if r[0] == 5][:2] == [(0, 35), (1, 1800)]
