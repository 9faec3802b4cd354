"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webquarry.session import durable

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ROW = ("__row_file", "__row_no")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def with_row_id(docs: DataFrame) -> DataFrame:
    """``docs`` and two columns that tell its rows apart, equal whenever the rows are read again.

    A file scan knows the file and the position of each row.  Any other input
    has no lasting order, so it is stored once and numbered there.  Rows that
    are numbered already are left as they are.
    """
    if set(ROW) <= set(docs.columns):
        return docs
    plan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName()
    if plan == "LogicalRelation" and "_metadata" not in docs.columns:
        return docs.select(
            "*",
            F.xxhash64("_metadata.file_path").alias(ROW[0]),
            F.col("_metadata.row_index").alias(ROW[1]),
        )
    numbered = docs.select("*", F.lit(0).cast("long").alias(ROW[0]), F.monotonically_increasing_id().alias(ROW[1]))
    return durable(numbered)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table written by ``durable`` that nothing reads any more."""
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches with rows; an empty one has no column types to give back."""
    return (b for b in batches if not b.empty)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no group of equal ``keys`` is split between two of them."""
    held: list[pd.DataFrame] = []
    for batch in filled(batches):
        last = batch[keys].iloc[-1]
        tail = (batch[keys] == last).all(axis=1).to_numpy()
        cut = len(batch) - int(tail[::-1].cumprod().sum())
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = [batch.iloc[cut:]]
        elif held and (held[-1][keys].iloc[-1] != last).any():
            yield pd.concat(held, ignore_index=True)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def dense_order(df: DataFrame, column: str, name: str) -> DataFrame:
    """Number distinct values in ascending order from 0, null last, without sorting them in one task."""
    ordered = durable(
        df.select(column).distinct().sort(F.col(column).asc_nulls_last()).select(column, F.spark_partition_id().alias("part"))
    )
    sizes = ordered.groupBy("part").count()
    # One row per partition of the sort.
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("count").over(so_far), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col(column).asc_nulls_last())) - 1
    return ordered.join(before, "part").select(column, (inside + F.col("before")).cast("long").alias(name))
