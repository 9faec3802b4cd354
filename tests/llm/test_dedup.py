import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash

from webquarry.llm import exact, graph, near
from webquarry.llm.common import whole_groups

WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed=3):
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        if out and pick.random() < 0.5:
            base = pick.choice(out).split(" ")
            if pick.random() < 0.6 and len(base) > 1:
                base[pick.randrange(len(base))] = pick.choice(WORDS)
            out.append(" ".join(base))
        else:
            out.append(" ".join(pick.choices(WORDS, k=pick.choice((1, 2, 3, 8, 120, 300)))))
    return out


def clashing(spark, rows):
    """Documents with extra columns named like the operators' own."""
    full = [(*r, 1, "x", "y", 2, 3) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, key int, digest string, print string, node int, n int")


EDGE = [(5, "a  b"), (3, "a b"), (None, "a b"), (3, "a\tb"), (7, None), (2, ""), (None, None), (9, " "), (3, "a b"), (1, "x" * 200_000)]


def test_exact_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts(300))] + [(None, "lone"), (None, "lone")]
    for rows in (rows, EDGE):
        got = exact.exact_dedup(clashing(spark, rows), capacity=10).collect()
        groups = defaultdict(list)
        for i, t in rows:
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
        want = []
        for body, ids in groups.items():
            keep = min((i for i in ids if i is not None), default=None)
            want += [(i, keep, len(ids), hashlib.sha256(body.encode()).hexdigest()) for i in ids]
        assert sorted(map(repr, want)) == sorted(repr((r["id"], r["keep_id"], r["group_size"], r["digest"])) for r in got)
        kept = [r for r in got if r["kept"]]
        assert len(kept) == len(groups) == len({r["digest"] for r in kept})
        assert all(r["id"] == r["keep_id"] for r in kept)


def test_exact_of_nothing(spark):
    assert exact.exact_dedup(clashing(spark, [])).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS key")
    buckets = exact.directory(keys, 100)
    placed = keys.withColumn("slot", exact.slot(keys["key"])).join(buckets, "slot")
    sizes = placed.groupBy("first_slot", "depth").count().collect()
    assert max(r["count"] for r in sizes) <= 100 and sum(r["count"] for r in sizes) == 5000
    # Buckets are disjoint ranges of slots.
    spans = sorted((r["first_slot"], r["first_slot"] + 2 ** (16 - r["depth"])) for r in sizes)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_index_tells_collisions_apart(spark, monkeypatch):
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: exact.F.length("body").cast("long"))
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0L AS __row_file", "doc_id AS __row_no")
    got = {r["id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_dedup(docs).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def slow_print(text, w):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    w = min(w, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + w]).encode(), 42) for i in range(len(words) - w + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, radius):
    ids = sorted(prints)
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= radius:
                low, high = sorted((root(a), root(b)))
                top[high] = low
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("tree_rows", [2048, 3])
def test_near_against_brute_force(spark, tree_rows):
    rows = [(i, t) for i, t in enumerate([*texts(250), "", None, "É A", "é a", "Word", "word"])]
    got = near.near_groups(clashing(spark, rows), tree_rows=tree_rows).collect()
    prints = {i: slow_print(t, 3) for i, t in rows}
    want = brute_components(prints, 2)
    assert {r["id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["id"]: r["component_id"] for r in got} == want
    assert sum(r["kept"] for r in got) == len(set(want.values()))
    assert all(r["id"] == r["component_id"] for r in got if r["kept"])


def test_near_with_nulls_and_repeats(spark):
    got = near.near_groups(clashing(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by = {r["fingerprint"]: r for r in got}
    assert by["0" * 16]["component_id"] == 2 and by["0" * 16]["group_size"] == 4
    assert sum(r["kept"] for r in got) == len({(r["component_id"]) for r in got})
    assert near.near_groups(clashing(spark, [])).count() == 0
    lone = near.near_groups(clashing(spark, [(None, "q q q"), (None, "q q q")])).collect()
    assert [r["component_id"] for r in lone] == [None, None] and sum(r["kept"] for r in lone) == 1


def test_wide_radius_finds_similar_texts(spark):
    pick = random.Random(1)
    rows, pairs = [], []
    for i in range(0, 120, 2):
        base = [f"t{pick.randrange(5000)}" for _ in range(300)]
        other = list(base)
        for at in pick.sample(range(300), 4):
            other[at] = "changed"
        rows += [(i, " ".join(base)), (i + 1, " ".join(other))]
        pairs.append((i, i + 1))
    got = {r["id"]: r["component_id"] for r in near.near_groups(clashing(spark, rows), words_per_shingle=5, lanes=4, radius=44).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert found >= 0.9 * len(pairs)
    assert len(set(got.values())) == len(rows) - found


def test_bands_cover_every_close_pair():
    pick = random.Random(5)
    for _ in range(200):
        code = pick.getrandbits(64)
        other = code ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64))
        path = 0
        for level in range(near.LEVELS):
            choices = near.bit_choices(64, 2, 0, 0, level, path)
            same = [j for j, bits in enumerate(choices) if all((code ^ other) >> b & 1 == 0 for b in bits)]
            assert same
            path = path * len(choices) + same[0]


def test_bk_tree_against_a_scan():
    pick = random.Random(2)
    codes = [pick.getrandbits(64) for _ in range(50)]
    codes += [c ^ (1 << pick.randrange(64)) for c in codes] + codes[:5]
    tree = near.BKTree()
    for c in codes:
        tree.insert(c)
    for radius in (0, 1, 2, 30):
        for c in codes[:20]:
            assert sorted(tree.within(c, radius)) == [i for i, x in enumerate(codes) if (x ^ c).bit_count() <= radius]


def test_components_of_a_long_path(spark):
    links = spark.range(300).selectExpr("id AS a", "id + 1 AS b").union(spark.range(500, 510).selectExpr("id AS a", "500L AS b"))
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{i: 500 for i in range(501, 510)}}


def test_groups_stay_whole_across_batches():
    import pandas as pd

    keys = [1] * 5 + [2] * 3 + [3] * 9 + [4]
    for size in (1, 2, 4, 7, 50):
        batches = [pd.DataFrame({"k": keys[i : i + size]}) for i in range(0, len(keys), size)]
        out = list(whole_groups(iter(batches), ["k"]))
        assert [k for b in out for k in b["k"]] == keys
        assert sum(b["k"].nunique() for b in out) == 4


def test_pipeline_stage_keeps_one_of_each_group(spark):
    """The stage is the operator with three words and two bits, whatever other columns the documents have."""
    import corpus_pipeline

    rows = [(i, t) for i, t in enumerate([*texts(200), "", None])] + [(None, "lone pair here"), (3, "x y z"), (3, "x y z")]
    docs = clashing(spark, rows).selectExpr("*", "1 AS copies", "'z' AS component_id", "true AS kept", "'f' AS fingerprint")
    kept = corpus_pipeline.near_stage(spark, docs, "")
    assert kept.columns == docs.columns
    prints = dict(enumerate(slow_print(t, 3) for _, t in rows))
    want = brute_components(prints, 2)
    got = kept.collect()
    assert len(got) == len(set(want.values()))
    by_print = {}
    for at, (i, t) in enumerate(rows):
        by_print.setdefault(want[at], []).append((i is None, i or 0, t))
    assert sorted(repr((r["doc_id"], r["text"])) for r in got) == sorted(repr((m[1] if not m[0] else None, m[2])) for m in (min(x, key=lambda y: y[:2]) for x in by_print.values()))


def test_deeper_levels_keep_the_recall():
    each = 0.95 ** (1 / near.LEVELS)
    n = near.deeper_tables(256, 55, each)
    assert len(near.bit_choices(256, 55, 3, 4, 1, 0, n)) == n
    assert 1 - (1 - (1 - 55 / 256) ** near.DEEPER_BITS) ** n >= each
