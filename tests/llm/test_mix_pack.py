import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webquarry.llm import mixing, packing
from webquarry.llm.common import with_row_id


def documents(spark, rows):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame(
        [(*r, 1, "x", 3) for r in rows], "doc_id long, text string, lang string, source string, size int, cluster string, rate int"
    )


def text(n, tag=""):
    return " ".join(f"w{tag}{i}" for i in range(n))


def slow_targets(sizes, weights, cap):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        level = (total - sum(cap * sizes[s] for s in stopped)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in stopped else weight[s] * level for s in names}
        stopped |= above


def slow_tilt(sizes, target, cap):
    """The multiplier of one source, by bisection."""
    low, high = -50.0, 50.0
    for _ in range(300):
        middle = (low + high) / 2
        taken = sum(s * min(cap, math.exp(min(middle * s, 50))) for s in sizes)
        low, high = (middle, high) if taken < target else (low, middle)
    return middle


@pytest.fixture(scope="module")
def mixed_rows():
    pick = random.Random(1)
    rows = []
    for i in range(600):
        source = pick.choices(["a", "b", "c", "Z", "é", None, "tiny"], weights=[50, 10, 10, 10, 10, 5, 1])[0]
        rows.append((i, text(pick.choice((3, 10, 40, 200)), str(i)), "en", source))
    return rows + [(700, None, "en", "a"), (701, "", "en", "b"), (702, None, None, "empty"), (5, rows[5][1], "en", rows[5][3]), (None, text(9), "en", "c")]


def test_mix_against_brute_force(spark, mixed_rows):
    got = mixing.mix(documents(spark, mixed_rows), block_rows=50).collect()
    assert len(got) == len(mixed_rows)
    sizes = defaultdict(list)
    for _, t, _, s in mixed_rows:
        sizes[s].append(len((t or "").split()))
    goals = slow_targets({s: sum(x) for s, x in sizes.items()}, (5, 2, 1), 3)
    taken = defaultdict(int)
    for r in got:
        s = r["source"]
        assert r["source_size"] == sum(sizes[s]) and r["target"] == pytest.approx(goals[s])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"])
        taken[s] += r["taken"]
    assert sum(goals.values()) == pytest.approx(sum(map(sum, sizes.values())))
    for s, goal in goals.items():
        # Every block of a source is off by less than its smallest document that can still round.
        assert abs(taken[s] - goal) <= max(15, 0.03 * goal), (s, taken[s], goal)
    tilt = slow_tilt([x for x in sizes["a"] if x], goals["a"], 3)
    for r in got:
        if r["source"] == "a" and r["size"]:
            assert r["rate"] == pytest.approx(min(3, math.exp(tilt * r["size"])), rel=1e-5)


def test_mix_reruns_agree_and_nothing_in_nothing_out(spark, mixed_rows, tmp_path):
    documents(spark, mixed_rows).repartition(3).write.parquet(str(tmp_path / "d"))
    runs = [
        sorted(repr((r["id"], r["copies"])) for r in mixing.mix(spark.read.parquet(str(tmp_path / "d"))).collect()) for _ in range(2)
    ]
    assert runs[0] == runs[1]
    assert mixing.mix(documents(spark, [])).count() == 0


def slow_best_fit(items, capacity, per_source):
    bins = []
    for size, source, cluster in items:
        fits = [
            b for b in bins
            if b["room"] >= size and b["sources"][source] < per_source and (cluster is None or cluster not in b["clusters"])
        ]
        if fits:
            best = min(fits, key=lambda b: (b["room"], b["n"]))
        else:
            best = {"n": len(bins), "room": capacity, "sources": Counter(), "clusters": set()}
            bins.append(best)
        best["room"] -= size
        best["sources"][source] += 1
        best["clusters"].add(cluster)
        yield best["n"]


def test_best_fit_against_a_scan_of_all_bins():
    pick = random.Random(2)
    for _ in range(60):
        n = pick.randrange(1, 60)
        items = sorted(((pick.randrange(0, 30), pick.choice("abc"), pick.choice((None, 1, 2, 3))) for _ in range(n)), key=lambda x: -x[0])
        per_source = pick.choice((1, 2, 5))
        got = packing.best_fit([x[0] for x in items], [x[1] for x in items], [x[2] for x in items], 30, per_source)
        # A full bin takes nothing more, not even an empty text.
        want = list(slow_best_fit(items, 30, per_source))
        if all(x[0] for x in items):
            assert got == want
        assert len(got) == n


def test_packing_is_whole_and_without_conflicts(spark):
    pick = random.Random(3)
    rows = [(i, text(pick.choice((1, 5, 30, 90)), str(i % 50)), "en", pick.choice(["a", "a", "b", None])) for i in range(400)]
    rows += [(900, text(250), "en", "a"), (None, None, None, None), (901, "", "en", "b"), (3, rows[3][1], "en", rows[3][3])]
    got = packing.pack(documents(spark, rows), capacity=100, per_source=3, shard_items=64).collect()
    pieces = defaultdict(int)
    for r in got:
        pieces[(r["id"], r["__row_no"])] += r["piece_size"]
    assert sorted(pieces.values()) == sorted(len((t or "").split()) for _, t, _, _ in rows)
    source = {i: s for i, _, _, s in rows}
    body = {i: (t or "").lower() for i, t, _, _ in rows}
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    for inside in bins.values():
        assert sum(r["piece_size"] for r in inside) == inside[0]["bin_used"] <= 100
        assert max(Counter(source[r["id"]] for r in inside).values()) <= 3
        texts = Counter(body[r["id"]] for r in inside)
        assert max(texts.values()) == 1
        assert sorted(r["bin_place"] for r in inside) == list(range(len(inside)))
    assert len([r for r in got if r["id"] == 900]) == 3
    assert packing.pack(documents(spark, [])).count() == 0


def test_near_copies_lie_in_different_bins(spark):
    pick = random.Random(7)
    rows = [(i, " ".join(f"w{pick.randrange(10**6)}" for _ in range(60)), "en", pick.choice("abc")) for i in range(60)]
    body = [f"k{pick.randrange(10**6)}" for _ in range(20_000)]
    near = [(100 + i, " ".join([*body, *["end"] * (i % 2)]), "en", "abc"[i % 3]) for i in range(12)]
    # Rows without any id, and one that only its copy's id names.
    near += [(None, "Same Text here", "en", "a"), (None, "same  text HERE", "en", "b"), (None, " ".join(body), "en", "c")]
    docs = with_row_id(documents(spark, rows + near))
    clusters = packing.near_clusters(docs)
    of = {(r["__row_file"], r["__row_no"]): r["cluster"] for r in clusters.collect()}
    assert sorted(Counter(of.values()).values()) == [2, 13]
    got = packing.pack(docs, cluster=clusters, capacity=50_000, per_source=100).collect()
    assert len(got) == len(rows) + len(near)
    seen = Counter((r["bin_id"], of.get((r["__row_file"], r["__row_no"]), r["__row_no"])) for r in got)
    assert max(seen.values()) == 1 and len({r["bin_id"] for r in got}) >= 13
    empty = with_row_id(documents(spark, []))
    assert packing.pack(empty, cluster=packing.near_clusters(empty)).count() == 0


def test_pipeline_stages_fit_together(spark, sf, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # Rows with nulls, repeats and odd texts go through every stage.
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (7, "z " * 3000, "xx", None, 6000)], docs.schema
    )
    # The longest texts again with a word more: few shingles differ, so the fingerprints are near.
    longest = docs.orderBy(F.desc("n_chars")).limit(20)
    near = longest.select((F.col("doc_id") + 10_000).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text"), "lang", "source", "n_chars")
    docs = docs.union(odd).union(near)
    columns, counts = docs.columns, [docs.count()]
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs.write.parquet(str(tmp_path / name))
        out = stage(spark, spark.read.parquet(str(tmp_path / name)), sf)
        if at < 4:
            assert out.columns == columns
        docs = out
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0
    assert set(docs.columns) >= {"doc_id", "bin_id"}


def test_empty_documents_go_through_the_pipeline(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
