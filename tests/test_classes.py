"""Queries on parts at many copies: the rows of DuckDB, and few rows through exchanges."""

import duckdb
import pytest

from folioforge.plans import catalog

PARTS, TABLES, LINES = 20_000, 2_000, 40_000


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Parts of 40 kinds, 200 of which ask; suppliers with all parts of one of five groups of kinds; odd rows."""
    path, words = str(tmp_path_factory.mktemp("copies")), ["red", "hot", "old", "gear", "rod", "ring", "red gear", "HOT  rod"]
    part = [(p, words[p % 8], f"Brand#{10 + p % 5}", ["SMALL", "LARGE", "red"][p % 3], 1 + p % 4) for p in range(PARTS)]
    part += [(PARTS, None, None, None, None), (PARTS + 100, "hot", None, None, 2), (PARTS + 1, "", "Brand#10", "LARGE", None)]
    lines = [(i // 4, (i % 5) * 7 + 40 * (i * 13 % 500), i % TABLES) for i in range(LINES)] + [(1, PARTS, 3), (1, PARTS + 100, 4), (2, PARTS + 1, 5), (2, 10**7, 6), (2, 7, 10**7), (2, 7, 7), (2, 7, 7)]
    rows = {
        "part": (part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"), "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long"),
        "supplier": ([(s, f"Supplier#{s % 50:09d}" if s % 9 else "red rod", s % 5) for s in range(TABLES)], "s_suppkey long, s_name string, s_nationkey long"), "nation": ([(n, f"NATION {n} RED") for n in range(5)], "n_nationkey long, n_name string"),
    }
    con = duckdb.connect()
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    return path, con


def exchanged(spark):
    """Rows written to exchanges by all stages so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["graph_retrieval", "graph_seeds", "node_text_scan", "graph_search", "table_retrieval"])
def test_copies(spark, copies, name):
    path, con = copies
    before = exchanged(spark)
    got = catalog.run(name, spark, path).toPandas()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert exchanged(spark) - before < 260_000
    want = con.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert len(want) and rows(got) == rows(want)
