"""Every statement of the operators, as a Spark query and as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.functions import scratch
from folioforge.functions.dialect import Dialect
from folioforge.operators import context, evidence, expansion, graph, layout, merging, pages, retrieval, selection, semantics, tables, text, understanding

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
STATEMENTS = {f.__name__: f for m in (text, retrieval, graph, tables, semantics, context, understanding, pages, selection, merging, layout, expansion, evidence) for f in m.QUERIES}
_SPARK, _DUCKDB = Dialect(True, "ff_"), Dialect(False)
#: Tables that are written once: their statements and the tables whose files they depend on.
DERIVED = {n: (f, ("documents",)) for n, f in retrieval.INDEXES.items()} | expansion.DERIVED


_made: dict[tuple, DataFrame] = {}


def _written(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, written once in a session for as long as the tables it comes from stay the same."""
    make, bases = DERIVED[name]
    key = (spark.sparkContext.applicationId, name, *(scratch.state_of(spark, f"{sf_dir}/{t}.parquet") for t in bases))
    if key not in _made:
        sql = make(_SPARK)
        _open(spark, sf_dir, sql)
        made = spark.sql(sql)
        if name == "ff_postings":  # searches ask for terms: files hold ranges of them
            made = made.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        _made[key] = scratch.written(made, name)
    return _made[key]


def _open(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """The tables a statement names, as views."""
    for name in DERIVED:
        if name in sql:
            _written(spark, sf_dir, name).createOrReplaceTempView(name)
    for t in TABLES:
        if f"ff_{t}" in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"ff_{t}")


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement over the tables of a folder; only the tables it names are opened."""
    sql = STATEMENTS[name](_SPARK)
    _open(spark, sf_dir, sql)
    return spark.sql(sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: lambda spark, sf_dir, n=n: run(n, spark, sf_dir) for n in STATEMENTS}


def oracle_sql() -> dict[str, str]:
    return {n: f(_DUCKDB) for n, f in STATEMENTS.items()}
