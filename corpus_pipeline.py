"""A training corpus from raw documents: five stages, each one operator applied to all rows the stage before it kept.

Every stage but the last returns the columns of ``documents`` (and any others its
input has); the last returns the packed pieces. Rows are judged one by one, whatever
ids they share, so a null or repeated doc_id decides nothing for another text. An
empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontam, langid, packing, pii, simhash
from folioforge.llm.common import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected; the others pass unchanged.

    Null, empty and letterless texts are rejected; without any labelled document all are.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = langid.identify(docs, langid.fit(docs), *others)
    return found.where(~F.col("__rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that SimHash links: the smallest doc_id, a null one only if no other is there.

    Of rows equal in id and fingerprint one stays; blank texts are one group.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; each row is judged by itself, whatever ids it shares.

    Null and blank texts hold none and stay; without benchmark items all stay.
    """
    # The numbers are written out with the rows, so that every read sees the same ones.
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "decontam-rows")
    found = decontam.contaminated(rows.select(F.col("__row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__hit")).distinct()
    found = materialize(found, "contaminated")
    return rows.join(found, F.col("__row") == F.col("__hit"), "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; n_chars follows the new text (null for a null text). No row goes."""
    found = pii.mask(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece; a null or empty text is one piece that holds only the end id."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: Hashing, training and packing are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
