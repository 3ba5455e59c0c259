"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch, so that a batch of long texts stays bounded; rows of a side up to which it is broadcast.
ARROW_ROWS, BROADCAST_ROWS = 500, 1_000_000
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the session names it.

    Only where neither ``spark.checkpoint.dir`` nor a checkpoint folder is set
    and the master is local (tests on one machine) a temporary folder is made and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{where}")
        where = f"file://{where}"
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/folioforge/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Bounded Arrow batches, and this package sent to the executors once.

    The batch size is lowered for the rest of the session, as plans are run after this returns.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_folioforge_shipped", False):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="folioforge-zip-"), "folioforge"), "zip", _ROOT, "folioforge")
    sc.addPyFile(made)
    sc._folioforge_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast where its counted size allows it; beyond, Spark picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words_of(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
