"""SimHash near-duplicates: sharded BK-trees over Hamming distance.

A fingerprint is one or more 64-bit lanes, each the bit majority over the hashes
of a text's word shingles.  Fingerprints within a radius link; a document
belongs to the component of its fingerprint.

Comparing every fingerprint with every tree would be quadratic, and broadcasting
all trees has no bound, so a shard tree meets its queries by a shuffle: a shard
holds the fingerprints that agree on some bits.

* Up to radius 3 the shards are exact.  Fingerprints that differ in at most r bits
  agree on one of r + 1 bands, so every link lies inside some shard.
* For a wider radius, samples of bits are taken.  Their width follows from the number
  of fingerprints, so that an average shard stays small, and their number from
  the ``recall`` asked for at the radius: fingerprints whose share of differing
  bits is p meet in a sample of k bits with probability ``(1 - p) ** k``.

A shard with more than ``tree_rows`` fingerprints is sharded again on further bits.
In every shard a BK-tree is built, children keyed by their distance to the
parent, and searched along edges within the radius.  The links of a shard leave
it as one tie per fingerprint, which keeps its components without listing pairs.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import ROW, filled, text_of, whole_groups, with_row_id
from webquarry.llm.graph import components
from webquarry.session import durable

SEED = 42
LEVELS = 4
BLOCK = 1 << 15
SHARD_ROWS = 16
DEEPER_BITS = 8


def shingles(text: str, words_per_shingle: int) -> np.ndarray:
    """The hashes of a text's word shingles in order; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    w = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - w + 1].tolist(), ends[w - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, len(words) - w + 1)


def lanes_of(base: np.ndarray, lanes: int) -> list[int]:
    """The fingerprint of shingle hashes as unsigned 64-bit lanes; all zero without any."""
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(base), BLOCK):
            h = base[at : at + BLOCK]
            if lane:
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * lane)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(31)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(base), bitorder="little").tobytes(), "little"))
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int, lanes: int) -> DataFrame:
    """``id, print`` and the row id; ``print`` holds the lanes as hexadecimal digits."""
    keep = [c for c in ROW if c in docs.columns]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), *keep)
    columns = ["id", *keep]

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filled(batches):
            prints = ["".join(f"{x:016x}" for x in lanes_of(shingles(t, words_per_shingle), lanes)) for t in batch["text"]]
            yield batch[columns].assign(print=prints)

    schema = ", ".join(f"`{c}` long" for c in columns) + ", print string"
    return rows.mapInPandas(marked, schema)


class BKTree:
    """A metric tree over Hamming distance; a child hangs on the edge of its distance to the parent."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.edges: list[dict[int, int]] = []

    def within(self, code: int, radius: int) -> list[int]:
        """Positions of all codes at most ``radius`` bits away."""
        found, todo = [], [0] if self.codes else []
        while todo:
            at = todo.pop()
            d = (self.codes[at] ^ code).bit_count()
            if d <= radius:
                found.append(at)
            todo += [child for edge, child in self.edges[at].items() if d - radius <= edge <= d + radius]
        return found

    def insert(self, code: int) -> None:
        self.codes.append(code)
        self.edges.append({})
        new = len(self.codes) - 1
        at = 0
        while at != new:
            at = self.edges[at].setdefault((self.codes[at] ^ code).bit_count(), new)


def shard_links(codes: list[int], nodes: list[int], radius: int) -> list[tuple[int, int]]:
    """Ties ``(node, least node)`` that connect what is connected inside one shard."""
    top = list(range(len(codes)))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    order = sorted(range(len(codes)), key=nodes.__getitem__)
    tree, place = BKTree(), []
    for x in order:
        for hit in tree.within(codes[x], radius):
            a, b = root(place[hit]), root(x)
            if a != b:
                low, high = (a, b) if nodes[a] < nodes[b] else (b, a)
                top[high] = low
        tree.insert(codes[x])
        place.append(x)
    return [(nodes[x], nodes[root(x)]) for x in range(len(codes)) if root(x) != x]


def bit_choices(bits: int, radius: int, tables: int, sample_bits: int, level: int, path: int, deeper: int = 8) -> list[list[int]]:
    """The bit positions of each shard table at a level, below the table numbered ``path``; ``deeper`` tables below level 0."""
    if radius <= 3:
        free, trail = list(range(bits)), []
        for _ in range(level):
            trail.append(path % (radius + 1))
            path //= radius + 1
        for step in reversed(trail):
            cut = np.array_split(free, radius + 1)[step].tolist()
            free = [p for p in free if p not in cut]
        return [x.tolist() for x in np.array_split(free, radius + 1)]
    pick = random.Random(f"{level}-{path}")
    n, k = (tables, sample_bits) if level == 0 else (deeper, DEEPER_BITS)
    return [sorted(pick.sample(range(bits), k)) for _ in range(n)]


def shard_rows(level: int, bits: int, radius: int, tables: int, sample_bits: int, deeper: int = 8):
    """A function of batches that puts every fingerprint into its shards of one level."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filled(batches):
            raw = b"".join(batch["code"])
            grid = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(batch), -1), axis=1)
            for path, at in batch.groupby("path").indices.items():
                choices = bit_choices(bits, radius, tables, sample_bits, level, int(path), deeper)
                part = batch.iloc[at]
                for j, positions in enumerate(choices):
                    weights = np.left_shift(np.uint64(1), np.arange(len(positions), dtype=np.uint64))
                    own = (grid[at][:, positions].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
                    mixed = (part["shard"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ own
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    yield pd.DataFrame(
                        {
                            "path": np.int64(path * len(choices) + j),
                            "shard": mixed.view(np.int64),
                            "code": part["code"].to_numpy(),
                            "node": part["node"].to_numpy(),
                        }
                    )

    return spread


def tree_links(radius: int):
    """A function of sorted batches that builds and searches the tree of every shard."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in whole_groups(batches, ["path", "shard"]):
            shards = batch[["path", "shard"]].to_numpy()
            cuts = np.flatnonzero((shards[1:] != shards[:-1]).any(axis=1)) + 1
            codes = [int.from_bytes(x) for x in batch["code"]]
            nodes = batch["node"].tolist()
            ties: list[tuple[int, int]] = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if e - s > 1:
                    ties += shard_links(codes[s:e], nodes[s:e], radius)
            if ties:
                yield pd.DataFrame(sorted(set(ties)), columns=["a", "b"])

    return search


def sampling(count: int, bits: int, radius: int, recall: float) -> tuple[int, int]:
    """Number and width of the bit samples for ``count`` fingerprints."""
    width = max(1, min(bits, math.ceil(math.log2(max(2, count / SHARD_ROWS)))))
    meet = (1 - radius / bits) ** width
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))), width


def deeper_tables(bits: int, radius: int, recall: float) -> int:
    """Number of tables of a level below the first."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - radius / bits) ** DEEPER_BITS)))


def shard_levels(nodes: DataFrame, bits: int, radius: int, recall: float, tree_rows: int) -> Iterator[DataFrame]:
    """The shards ``path, shard, code, node`` to search, level by level; a pair at the radius meets with ``recall`` over all levels."""
    each = recall ** (1 / LEVELS)
    tables, width = sampling(nodes.count(), bits, radius, each) if radius > 3 else (0, 0)
    deeper = deeper_tables(bits, radius, each) if radius > 3 else 0
    rows = nodes.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("shard"), F.unhex("print").alias("code"), "node")
    keys = ["path", "shard"]
    for level in range(LEVELS):
        spread = shard_rows(level, bits, radius, tables, width, deeper)
        placed = rows.mapInPandas(spread, "path long, shard long, code binary, node long")
        hot = durable(placed.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > tree_rows).select(*keys))
        done = level == LEVELS - 1 or hot.isEmpty()
        yield placed if done else placed.join(hot, keys, "left_anti")
        if done:
            return
        rows = durable(placed.join(hot, keys, "left_semi"))


def searched(shards: DataFrame, search, schema: str) -> DataFrame:
    keys = ["path", "shard"]
    return durable(shards.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(search, schema))


def print_links(nodes: DataFrame, bits: int, radius: int, recall: float, tree_rows: int) -> DataFrame:
    """Ties between the nodes of distinct fingerprints ``print, node``."""
    found = None
    for shards in shard_levels(nodes, bits, radius, recall, tree_rows):
        ties = searched(shards, tree_links(radius), "a long, b long")
        found = ties if found is None else found.union(ties)
    return found


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 3,
    lanes: int = 1,
    radius: int = 2,
    recall: float = 0.95,
    tree_rows: int = 2048,
) -> DataFrame:
    """One row per row of ``docs``: ``id, fingerprint, component_id, group_size, kept`` and the row id.

    ``component_id`` is the smallest id that links reach.  Rows with a null id take
    part through a number of their own, so their component has a null id only
    if no row of it has one.  One row of each component is kept: the one with
    the smallest id, and of repeated rows the first.  Null and empty texts have
    the fingerprint zero and link like any other.  A bit set in exactly half the
    hashes is 0.  Very long texts are hashed whole, their counts in blocks.  An empty table gives an
    empty result; other columns of ``docs`` are not read.  ``recall`` counts for
    a radius above 3 only, and for pairs at the radius; closer ones meet more often.
    """
    docs = with_row_id(docs)
    marked = durable(fingerprints(docs, id_col, text_col, words_per_shingle, lanes))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), *ROW)
    # A distinct fingerprint is one node; its number only has to be unique.
    heads = durable(marked.groupBy("print").agg(F.min(order).alias("head"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    ties = print_links(heads.select("print", "node"), 64 * lanes, radius, recall, tree_rows)
    tied = heads.join(components(ties), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = tied.groupBy("component").agg(F.min("head").alias("least"), F.sum("copies").alias("group_size"))
    named = tied.join(least, "component").select("print", "least", "group_size")
    return marked.join(named, "print").select(
        "id",
        F.col("print").alias("fingerprint"),
        F.col("least.id").alias("component_id"),
        "group_size",
        ((F.col(ROW[0]) == F.col(f"least.{ROW[0]}")) & (F.col(ROW[1]) == F.col(f"least.{ROW[1]}"))).alias("kept"),
        *ROW,
    )
