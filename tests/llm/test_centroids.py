import hashlib
import math
import random

import numpy as np
import pytest

from webquarry.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, id int, q string, cluster string, lead int, digest string"


def table(spark, rows):
    """Vectors with extra columns named like the operator's own."""
    return spark.createDataFrame([(i, v, 1, 2, "q", "c", 3, "d") for i, v in rows], SCHEMA)


def brute(rows, size, clusters, rounds):
    """``(vec_id, cluster, distance)`` and the centroids, by plain loops over whole numbers."""
    taken = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in v)
    ]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    middle = [q for _, q in sorted(taken, key=key)[:clusters]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        found = [nearest(q)[1] for _, q in taken]
        for n in range(len(middle)):
            own = [q for (_, q), f in zip(taken, found, strict=True) if f == n]
            if own:
                middle[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, nearest(q)[1], nearest(q)[0]) for i, q in taken], middle


def check(spark, rows, size, clusters, rounds=5, leading=3):
    got = centroids.centroid_clusters(table(spark, rows), size=size, clusters=clusters, rounds=rounds, leading=leading).collect()
    want, middle = brute(rows, size, clusters, rounds)
    assert sorted(map(repr, want)) == sorted(repr((r["id"], r["cluster"], r["distance"])) for r in got)
    assert {r["inertia"] for r in got} <= {sum(d for _, _, d in want)}
    for r in got:
        c = r["cluster"]
        assert r["cluster_inertia"] == sum(d for _, n, d in want if n == c)
        assert r["centroid"] == middle[c]
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()
    return got


def test_against_brute_force(spark):
    pick = random.Random(4)
    rows = [(i, [pick.gauss(i % 5, 0.3) * (1 + j % 3) for j in range(8)]) for i in range(300)]
    check(spark, rows, 8, 12)
    # Leading coordinates may be few or all but one.
    check(spark, rows[:80], 8, 7, leading=1)
    check(spark, rows[:80], 8, 7, leading=20)


def test_odd_vectors_ties_and_repeats(spark):
    one = [0.5, -0.25, 0.0, 1.0]
    rows = [(i, one) for i in (1, 2, 2, None, None)] + [(7, [-x for x in one]), (8, [0.0] * 4), (9, [-0.001] * 4)]
    odd = [None, [], one[:3], [*one, 1.0], [1.0, None, 0.0, 0.0], [math.nan, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0], [1e30, 0.0, 0.0, 0.0]]
    rows += [(100 + i, v) for i, v in enumerate(odd)]
    # Points on a line between two centroids tie; the smaller number wins.
    rows += [(200 + i, [float(x), 0.0, 0.0, 0.0]) for i, x in enumerate((-2, -1, 0, 1, 2, 0, 0))]
    for clusters in (1, 2, 5, 40):
        got = check(spark, rows, 4, clusters)
        assert len(got) == len(rows) - len(odd)


def test_large_components_stay_exact(spark):
    pick = random.Random(6)
    rows = [(i, [pick.choice((-1, 1)) * (524287.0 - pick.randrange(3)) for _ in range(4)]) for i in range(60)]
    check(spark, rows, 4, 9)


def test_no_vectors(spark):
    got = centroids.centroid_clusters(table(spark, []))
    assert got.count() == 0 and got.columns[:4] == ["id", "cluster", "distance", "cluster_size"]
    assert centroids.centroid_clusters(table(spark, [(1, None), (2, [1.0])])).count() == 0


def test_bounds_hold_and_cut_work():
    pick = np.random.default_rng(3)
    axes = np.linalg.qr(pick.normal(size=(64, 64)))[0]
    q = np.floor(256 * (pick.normal(size=(4000, 64)) * np.geomspace(1, 0.02, 64)) @ axes).astype(np.int64)
    rotation = centroids.Rotation(len(q), q.sum(axis=0).astype(float), (q.T @ q).astype(float), 16)
    middle = centroids.Centroids(q[:40], rotation)
    lead, rest = rotation.parts(q)
    exact = np.square(q[:, None] - q[None, :40]).sum(axis=2)
    assert (middle.bounds(lead, rest) <= exact).all()
    number, distance, measured = middle.nearest(q, lead, rest)
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert measured < 0.2 * exact.size


@pytest.mark.parametrize("rows", [0, 1, 500])
def test_query_against_its_sql(spark, sf, tmp_path, rows):
    import duckdb

    from webquarry.llm import queries

    spark.read.parquet(f"{sf}/embeddings.parquet").limit(rows).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op11_centroids(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(queries.ORACLE["op11_centroids"]).df()[list(got.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
