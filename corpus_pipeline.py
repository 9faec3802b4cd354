"""The corpus pipeline: quality classifier, exact and near deduplication, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as
Parquet and read again as the ``docs`` of the next.  All but the last return the
columns of ``docs``.  Decisions are tied to rows, not to ids, so null and
repeated ids keep their rows apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import exact, kneser, mixing, near, packing
from webquarry.llm.common import ROW, table, with_row_id
from webquarry.session import durable


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose row id is in ``kept``."""
    return docs.join(kept.select(*ROW), list(ROW), "left_semi").drop(*ROW)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier, trained on the labelled rows of ``docs``, accepts."""
    rows = with_row_id(docs)
    return _keep(rows, kneser.quality_classifier(rows, table(spark, sf_dir, "labels")).where("kept"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of equal texts."""
    rows = with_row_id(docs)
    return _keep(rows, exact.exact_dedup(rows).where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of near-duplicates: SimHash over three words, two bits.

    Of a group the smallest id stays, a null id only if there is no other; of repeated rows one
    stays.  Null and empty texts form one group.
    """
    rows = with_row_id(docs)
    return _keep(rows, near.near_groups(rows, words_per_shingle=3, lanes=1, radius=2).where("kept"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of every row as the mix takes; repeated rows are mixed one by one.

    Empty and null texts have no words, so the mix takes one copy of each or none, as it rounds their rate.
    """
    rows = with_row_id(docs)
    taken = mixing.mix(rows).where("copies > 0").select(F.sequence(F.lit(1), F.col("copies").cast("int")).alias("__taken"), *ROW)
    copies = rows.join(taken, list(ROW))
    return copies.withColumn("__taken", F.explode("__taken")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of every piece of every row; copies of a document lie in different bins.

    Null and empty texts are packed as items of size 0; an empty table gives no bins.
    """
    packed = packing.pack(docs)
    return packed.select(F.col("id").alias("doc_id"), "size", "piece", "pieces", "piece_size", "bin_id", "bin_place", "bin_used")


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: The model, the near groups and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
