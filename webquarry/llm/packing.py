"""Conflict-constrained best-fit packing of documents into bins of fixed size.

Items are dealt to shards of bounded size, and every shard is packed by one
task: the largest items first, each into the open bin with the least room that
it fits.  Open bins are ordered by room and carry bitmaps of the sources and of
the duplicate clusters in them; where the tightest bin conflicts, the search
goes on to the next one in the order until a bin fits, and else opens a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import ROW, SPACE, text_of, whole_groups, with_row_id, word_count
from webquarry.llm.near import near_groups
from webquarry.session import durable


class Bin:
    """Room left, the bitmap of clusters, and one bitmap of sources per permitted occurrence."""

    __slots__ = ("number", "room", "clusters", "sources")

    def __init__(self, number: int, room: int, per_source: int):
        self.number, self.room, self.clusters = number, room, 0
        self.sources = [0] * per_source

    def takes(self, source: int, cluster: int) -> bool:
        return not (self.clusters & cluster) and not (self.sources[-1] & source)

    def put(self, size: int, source: int, cluster: int) -> None:
        self.room -= size
        self.clusters |= cluster
        for level, bitmap in enumerate(self.sources):
            if not bitmap & source:
                self.sources[level] |= source
                break


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[int]:
    """The bin number of every item, items given largest first and none larger than ``capacity``.

    Items without a cluster (None) conflict with nothing but a full source.
    Bins are looked up in an order of (room, number), so the first one found is
    the tightest; ties go to the oldest bin.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    repeated = [c for c, n in seen.items() if n > 1 and c is not None]
    cluster_bit = {c: 1 << i for i, c in enumerate(repeated)}
    bins: list[Bin] = []
    order: list[tuple[int, int]] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = source_bit[source], cluster_bit.get(cluster, 0)
        at = bisect_left(order, (size, -1))
        while at < len(order) and not bins[order[at][1]].takes(s, c):
            at += 1
        if at < len(order):
            chosen = bins[order.pop(at)[1]]
        else:
            chosen = Bin(len(bins), capacity, per_source)
            bins.append(chosen)
        chosen.put(size, s, c)
        if chosen.room > 0:
            insort(order, (chosen.room, chosen.number))
        out.append(chosen.number)
    return out


def copies_cluster(text_col: str = "text") -> Column:
    """A number shared by texts that agree but for case and white space."""
    return F.xxhash64(F.lower(F.regexp_replace(text_of(text_col), SPACE, " ")))


def near_clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``cluster`` and the row id of the rows that have near copies, by SimHash components.

    ``docs`` has row ids.  A component without any id is named by its fingerprint.
    """
    groups = near_groups(docs, id_col, text_col).where("group_size > 1")
    return groups.select(F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint")).alias("cluster"), *ROW)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: Column | DataFrame | None = None,
    capacity: int = 8192,
    per_source: int = 8,
    shard_items: int = 4096,
) -> DataFrame:
    """``id, size, piece, pieces, piece_size, bin_id, bin_place, bin_used`` and the row id, one row per packed piece.

    ``size`` counts words.  A document larger than ``capacity`` is cut into pieces
    of that size and a rest, each packed as an item; nothing is dropped, and
    every document is packed whole.  A bin holds at most one item of a
    duplicate cluster and ``per_source`` items of a source.  ``cluster`` is any
    hashable column, null for none, or a table of ``cluster`` and row ids, at most
    one row each, such as :func:`near_clusters` gives for ``docs`` with row ids; by
    default texts that agree but for case and white space form one.  Pieces of one document count as one cluster, so
    they lie in different bins.  A null source is a source of its own.  Null and
    empty texts have size 0 and are packed too.  A bin's number is its shard's
    and its own; rows stay apart whatever their id, an empty table gives an
    empty result, and other columns are not read.  Very long texts are counted whole;
    ties of size are packed in the order of row ids.
    """
    apart = isinstance(cluster, DataFrame)
    own = copies_cluster(text_col) if cluster is None else F.lit(None) if apart else cluster
    n_words = word_count(text_col)
    rows = with_row_id(docs).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        n_words.alias("size"),
        own.cast("string").alias("cluster"),
        *ROW,
    )
    if apart:
        rows = rows.drop("cluster").join(cluster.select(F.col("cluster").cast("string"), *ROW), list(ROW), "left")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    cut = rows.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    part = F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("long")
    fallback = F.when(F.col("pieces") > 1, F.concat_ws("-", F.lit("row"), *ROW))
    items = durable(
        cut.withColumn("piece_size", part)
        .withColumn("cluster", F.coalesce("cluster", fallback))
        .withColumn("source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    )
    shards = max(1, -(-items.count() // shard_items))
    # A row's place in its file decides its shard, so no source or cluster gathers anywhere.
    shard = F.pmod(F.xxhash64(*ROW, "piece"), F.lit(shards)).cast("long")
    columns = ["shard", "id", "size", "piece", "pieces", "piece_size", "source", "cluster", *ROW]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in whole_groups(batches, ["shard"]):
            for number, group in batch.groupby("shard", sort=False):
                clusters = [None if c is None or c != c else c for c in group["cluster"]]
                bins = best_fit(group["piece_size"].tolist(), group["source"].tolist(), clusters, capacity, per_source)
                out = group[["id", "size", "piece", "pieces", "piece_size", *ROW]].assign(bin=bins)
                out["bin_place"] = out.groupby("bin").cumcount()
                out["bin_used"] = out.groupby("bin")["piece_size"].transform("sum")
                out["bin_id"] = [f"{number}-{b}" for b in bins]
                yield out.drop(columns="bin")

    ordered = (
        items.withColumn("shard", shard).select(*columns).repartition("shard").sortWithinPartitions("shard", F.desc("piece_size"), *ROW, "piece")
    )
    schema = "id long, size long, piece int, pieces int, piece_size long, " + ", ".join(f"`{c}` long" for c in ROW)
    return ordered.mapInPandas(packed, f"{schema}, bin_place long, bin_used long, bin_id string")
