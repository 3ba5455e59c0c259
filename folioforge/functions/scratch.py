"""Tables written once and read many times, in the folder the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir`` or checkpoint folder; only on a local master without either, a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{made}")
        where = f"file://{made}"
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back."""
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/folioforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of the files at a path: what a table derived from them depends on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files))
