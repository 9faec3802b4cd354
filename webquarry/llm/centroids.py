"""Centroid clustering in whole numbers, filtered by PCA-rotated coordinates.

The vectors are rotated onto the axes of their covariance once.  The leading
coordinates and the norm of the rest are stored beside the whole numbers.  For
a vector x and a centroid c with leading parts Px, Pc and residual norms Rx, Rc,

    |x - c|^2  >=  |Px - Pc|^2 + (Rx - Rc)^2

so a centroid whose bound lies above the distance to the most promising one
cannot be nearer.  The centroids that survive are measured in whole numbers, and
only those figures decide.  Rounding of the rotation is covered by a slack that
lowers every bound; more slack only means more survivors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import ROW, drop_table, with_row_id
from webquarry.session import durable

#: Components this large in magnitude are not taken: with less, no squared distance of 64 components leaves a long.
LIMIT = 1 << 27
BLOCK = 1 << 13
#: Relative slack of the bounds, far above the error of a rotation in double precision.
SLACK = 1e-9


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """``id, q`` and the row id of the vectors taken; ``q`` holds ``floor(scale * x)``."""
    x = F.col("x")
    rows = with_row_id(vectors).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), *ROW)
    # NaN sorts above every number, so it fails the comparison as the infinities do.
    fits = F.forall(x, lambda v: F.coalesce((v < LIMIT / scale) & (v >= -LIMIT / scale), F.lit(False)))
    return rows.where((F.size(x) == size) & fits).select("id", F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("q"), *ROW)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a list column without nulls."""
    return np.asarray(column.flatten()).reshape(-1, size)


def summed_moments(vectors: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sums and cross products of all vectors: ``size ** 2`` figures whatever the input."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = matrix(batch.column("q"), size).astype(np.float64)
            n, sums, products = n + len(x), sums + x.sum(axis=0), products + x.T @ x
        if n:
            values = np.concatenate([[n], sums, products.ravel()])
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(values)), pa.int32()), "value": pa.array(values)})

    parts = vectors.select("q").mapInArrow(partial, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    values = np.zeros(1 + size + size * size)
    for row in parts.collect():
        values[row["at"]] = row["value"]
    return int(values[0]), values[1 : 1 + size], values[1 + size :].reshape(size, size)


class Rotation:
    """Orthonormal axes, those of the largest variance first, and the mean they start from."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray, leading: int):
        self.mean = sums / max(n, 1)
        spread = products / max(n, 1) - np.outer(self.mean, self.mean)
        self.axes = np.linalg.eigh(spread)[1][:, ::-1].copy()
        self.leading = leading

    def parts(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leading coordinates and the norm of the others."""
        turned = (q - self.mean) @ self.axes
        return turned[:, : self.leading], np.linalg.norm(turned[:, self.leading :], axis=1)


def rotated(vectors: DataFrame, rotation: Rotation) -> DataFrame:
    """``vectors`` with ``lead``, ``rest``: the stored form that every round reads."""
    size = len(rotation.mean)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotation.parts(matrix(batch.column("q"), size))
            offsets = pa.array(np.arange(0, lead.size + 1, lead.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(lead.ravel())), pa.array(rest)], [*batch.schema.names, "lead", "rest"]
            )

    fields = "id long, q array<int>, " + ", ".join(f"`{c}` long" for c in ROW)
    return vectors.select("id", "q", *ROW).mapInArrow(turned, fields + ", lead array<double>, rest double")


class Centroids:
    """Whole-number centroids with their rotated parts."""

    def __init__(self, whole: np.ndarray, rotation: Rotation):
        self.whole = whole.astype(np.int64)
        self.lead, self.rest = rotation.parts(whole)

    def bounds(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """A number per vector and centroid that the squared distance does not fall below."""
        apart = np.square(lead[:, None, :] - self.lead[None]).sum(axis=2) + np.square(rest[:, None] - self.rest[None])
        reach = np.square(lead).sum(axis=1) + np.square(rest)
        own = np.square(self.lead).sum(axis=1) + np.square(self.rest)
        return apart - SLACK * (reach[:, None] + own[None] + 1.0)

    def nearest(self, q: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of each vector, the smaller number on ties, and how many distances were measured."""
        low = self.bounds(lead, rest)
        rows = np.arange(len(q))
        first = low.argmin(axis=1)
        near = self.measured(q, rows, first)
        alive = low <= near[:, None]
        alive[rows, first] = False
        at, other = np.nonzero(alive)
        row, number = np.concatenate([rows, at]), np.concatenate([first, other])
        distance = np.concatenate([near, self.measured(q, at, other)])
        best = np.lexsort((number, distance, row))
        best = best[np.concatenate([[True], row[best][1:] != row[best][:-1]])]
        return number[best], distance[best], len(row)

    def measured(self, q: np.ndarray, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Exact squared distances of pairs."""
        out = np.empty(len(rows), np.int64)
        for start in range(0, len(rows), BLOCK):
            part = slice(start, start + BLOCK)
            apart = q[rows[part]].astype(np.int64) - self.whole[centroids[part]]
            out[part] = (apart * apart).sum(axis=1)
        return out


def blocks(batch: pa.RecordBatch, size: int, leading: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The figures of a batch in blocks that bound the memory of the bounds."""
    q, lead = matrix(batch.column("q"), size), matrix(batch.column("lead"), leading)
    rest = np.asarray(batch.column("rest"))
    for at in range(0, len(q), BLOCK):
        yield at, q[at : at + BLOCK], lead[at : at + BLOCK], rest[at : at + BLOCK]


def moved(stored: DataFrame, centroids: Centroids) -> np.ndarray:
    """The centroids after one round: floors of the exact means; a centroid without vectors stays."""
    k, size = centroids.whole.shape
    leading = centroids.lead.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            for _, q, lead, rest in blocks(batch, size, leading):
                number, _, _ = centroids.nearest(q, lead, rest)
                by = number.argsort(kind="stable")
                used, starts = np.unique(number[by], return_index=True)
                sums[used] += np.add.reduceat(q[by].astype(np.int64), starts, axis=0)
                count += np.bincount(number, minlength=k)
        some = np.flatnonzero(count)
        if len(some):
            values = np.concatenate([count[some, None], sums[some]], axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "cluster": pa.array(np.repeat(some, size + 1), pa.int32()),
                    "at": pa.array(np.tile(np.arange(size + 1), len(some)), pa.int32()),
                    "value": pa.array(values.ravel()),
                }
            )

    parts = stored.select("q", "lead", "rest").mapInArrow(partial, "cluster int, at int, value long")
    whole = F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    totals = {(r["cluster"], r["at"]): int(r["value"]) for r in parts.groupBy("cluster", "at").agg(whole).collect()}
    out = centroids.whole.copy()
    for c in range(k):
        n = totals.get((c, 0))
        if n:
            out[c] = [totals[c, d + 1] // n for d in range(size)]
    return out


def assigned(stored: DataFrame, centroids: Centroids) -> DataFrame:
    """``id, cluster, distance`` and the row id."""
    size, leading = centroids.whole.shape[1], centroids.lead.shape[1]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, q, lead, rest in blocks(batch, size, leading):
                number, distance, _ = centroids.nearest(q, lead, rest)
                part = batch.slice(at, len(q))
                columns = [part.column("id"), pa.array(number, pa.int32()), pa.array(distance), *[part.column(c) for c in ROW]]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance", *ROW])

    return stored.mapInArrow(named, "id long, cluster int, distance long, " + ", ".join(f"`{c}` long" for c in ROW))


def centroid_digest(centroid: np.ndarray) -> str:
    """Hexadecimal SHA-256 of the components as decimal numbers, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def centroid_clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    size: int = 64,
    scale: int = 256,
    clusters: int = 40,
    rounds: int = 5,
    salt: str = "2:",
    leading: int = 16,
) -> DataFrame:
    """One row per vector taken: ``id, cluster, distance, cluster_size, cluster_inertia, inertia, centroid, centroid_sha256`` and the row id.

    A vector is taken if it has exactly ``size`` components, all of them finite and below 2**27 / ``scale`` in magnitude;
    larger ones have distances that no long holds and are left out like infinite ones.  Null,
    shorter and longer vectors are left out too.  Components become ``floor(scale * x)`` and all
    decisions are made on those whole numbers.  The first centroids are the vectors with the
    smallest SHA-256 of ``salt`` and their id (nothing for a null id), equal digests by their components; fewer
    vectors than ``clusters`` give as many centroids as there are.  A vector goes to the nearest
    centroid, the one of the smaller number on ties; ``rounds`` times every centroid moves to the floor of
    the mean of its vectors, one without vectors stays.  Repeated rows count as often as they occur and
    stay apart.  An empty table gives an empty result; other columns are not read.

    The driver sees ``size ** 2`` moments, and ``clusters * size`` sums a round.
    """
    whole = whole_vectors(vectors, id_col, vector_col, size, scale)
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = whole.select("q", digest.alias("digest")).orderBy("digest", "q").limit(clusters).collect()
    start = np.array([r["q"] for r in first], np.int64).reshape(-1, size)
    rotation = Rotation(*summed_moments(whole, size), min(leading, size - 1))
    stored = durable(rotated(whole, rotation))
    centroids = Centroids(start, rotation)
    if len(start):
        for _ in range(rounds):
            centroids = Centroids(moved(stored, centroids), rotation)
        found = durable(assigned(stored, centroids))
        drop_table(stored)
    else:
        found = whole.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), *ROW)
    exact = F.col("distance").cast("decimal(38,0)")
    sums = {r["cluster"]: (r["n"], int(r["total"])) for r in found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(exact).alias("total")).collect()}
    inertia = sum(total for _, total in sums.values())
    # One row per centroid.
    notes = found.sparkSession.createDataFrame(
        [(c, n, total, inertia, centroids.whole[c].tolist(), centroid_digest(centroids.whole[c])) for c, (n, total) in sorted(sums.items())],
        "cluster int, cluster_size long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string",
    )
    return found.join(F.broadcast(notes), "cluster").select(
        "id", "cluster", "distance", "cluster_size", "cluster_inertia", "inertia", "centroid", "centroid_sha256", *ROW
    )
