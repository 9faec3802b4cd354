"""Exact deduplication through an extendible-hash index on shared files.

Built from DataFrame operations only.  Every whole text gets a 64-bit hash; the
directory takes as many leading bits of it as it needs, doubling wherever a
bucket is overfull; owner tasks write the entries of their key range; entries
that share a hash form a chain and are told apart by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquarry.llm.common import ROW, SPACE, text_of, with_row_id
from webquarry.session import durable

SLOT_BITS = 16


def normalised(column: str = "text") -> Column:
    """White space runs become one space; null is the empty text."""
    return F.regexp_replace(text_of(column), SPACE, " ")


def slot(key: Column) -> Column:
    """The leading bits of a hash, as a number."""
    return F.shiftrightunsigned(key, 64 - SLOT_BITS).cast("int")


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """``slot, first_slot, depth``: the bucket of each occupied slot of a fully doubled directory.

    A bucket of depth d holds the keys that share d leading bits.  It is split,
    doubling the directory where needed, as long as it has more than
    ``capacity`` keys and bits are left; beyond that it overflows into a chain.
    At most ``2**SLOT_BITS`` rows come back whatever the input.
    """
    used = keys.groupBy(slot(F.col("key")).alias("slot")).agg(F.count("*").alias("n"))
    levels = used.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(SLOT_BITS - 1))).alias("d")).withColumn(
        "prefix", F.expr(f"shiftright(slot, {SLOT_BITS} - d)")
    )
    overfull = levels.groupBy("d", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") > capacity).drop("n")
    # A table of at most two rows per slot goes to every task.
    split = levels.join(F.broadcast(overfull.withColumn("split", F.lit(1))), ["d", "prefix"], "left")
    depth = split.groupBy("slot").agg(F.coalesce(F.max(F.when(F.col("split") == 1, F.col("d") + 1)), F.lit(0)).alias("depth"))
    first = F.expr(f"shiftleft(shiftright(slot, {SLOT_BITS} - depth), {SLOT_BITS} - depth)")
    return depth.select("slot", first.alias("first_slot"), "depth")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 65_536):
    """The row hashes and the index entries, both as tables on shared files.

    Rows: ``id, key, digest`` and the row id.  Entries: ``first_slot, depth, key,
    chain, digest, n_bytes, copies``, one per different text, in files of one
    key range each.
    """
    body = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("body"), *ROW)
    hashed = body.withColumn("key", F.xxhash64("body"))
    rows = durable(hashed.select("id", "key", F.sha2("body", 256).alias("digest"), *ROW))
    # The copies of a text meet before the exchange, so a text that fills a third of all rows moves once
    # per task.  The aggregation compares the bytes of texts that share a key.
    texts = hashed.groupBy("key", "body").agg(F.count("*").alias("copies"))
    entries = texts.select("key", F.sha2("body", 256).alias("digest"), F.octet_length("body").alias("n_bytes"), "copies")
    buckets = F.broadcast(durable(directory(rows.select("key").distinct(), capacity)))
    placed = entries.withColumn("slot", slot(F.col("key"))).join(buckets, "slot", "left").drop("slot")
    # Hashes are even, so equal ranges of slots are equal shares; no sampling pass is needed.
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owner = F.floor(slot(F.col("key")) * F.lit(owners) / 2**SLOT_BITS)
    owned = placed.withColumn("owner", owner).repartition(owners, "owner")
    chain = F.row_number().over(Window.partitionBy("owner", "first_slot", "key").orderBy("digest"))
    index = durable(owned.withColumn("chain", chain).sortWithinPartitions("owner", "first_slot", "key", "chain").drop("owner"))
    return rows, index


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 65_536) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, digest, n_bytes`` and the row id.

    Texts are equal when they agree after white space runs became one space; null
    counts as empty.  Of equal texts the row with the smallest id stays, a null
    id only if there is no other; of rows repeated with that id one stays.
    ``keep_id`` is null if all ids of the group are.  An empty table gives an
    empty result; other columns of ``docs`` are not read.
    """
    rows, index = build_index(with_row_id(docs), id_col, text_col, capacity)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), *ROW)
    heads = rows.groupBy("key", "digest").agg(F.min(order).alias("head"))
    groups = index.join(heads, ["key", "digest"]).select("key", "digest", "head", F.col("copies").alias("group_size"), "n_bytes")
    return rows.join(groups, ["key", "digest"]).select(
        "id",
        F.col("head.id").alias("keep_id"),
        "group_size",
        ((F.col(ROW[0]) == F.col(f"head.{ROW[0]}")) & (F.col(ROW[1]) == F.col(f"head.{ROW[1]}"))).alias("kept"),
        "digest",
        F.col("n_bytes").cast("long").alias("n_bytes"),
        *ROW,
    )
