"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_one_per_key(rows: DataFrame, lookup: DataFrame, key: str, how: str = "left", salts: int = 1) -> DataFrame:
    """Join big ``rows`` with a ``lookup`` holding at most one row per key.

    Both sides are evaluated once.  A partition that a hot key makes too large is
    split when the join runs (``spark.sql.adaptive.skewJoin``), its single lookup
    row going to every part.  Where that rule cannot apply, ``salts`` above 1
    spreads every key over so many tasks from the start, at the price of as many
    copies of the lookup.
    """
    if salts == 1:
        return rows.join(lookup, key, how)
    others = [c for c, t in rows.dtypes if c != key and "map<" not in t]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "salt"], how).drop("salt")
