import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from webquarry.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, term int, total string, value int, p string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def table(spark, rows):
    """Documents with extra columns named like the operator's own."""
    return spark.createDataFrame([(i, *r, 1, 2, "t", 3, "p") for i, r in enumerate(rows)], SCHEMA)


def brute(rows, min_docs, top):
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    lower = lambda m: m[0].lower()
    found = [(TERM.findall(re.sub("[A-Z]", lower, t)), g, s) for t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in found}:
        docs, counts, whole = Counter(), defaultdict(Counter), Counter()
        for words, g, s in found:
            if g == lang:
                docs.update(set(words))
                counts[s].update(words)
                whole.update(words)
        kept = [t for t, n in docs.items() if n >= min_docs]
        v = len(kept)
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v) for t in kept} for s, c in counts.items()}
        q = {t: 1 + 10**9 * (whole[t] + 2) // (sum(whole[x] for x in kept) + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(-sum(f(p[s][t], p[h][t]) for t in kept), h.encode(), h) for h in counts if h != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            out += [(lang, s, "pair", x, -v_, i) for i, (v_, _, x) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", x, -v_, i) for i, (v_, _, x) in enumerate(sorted(terms)[:top], 1)]
    return out


def check(spark, rows, min_docs=10, top=10):
    got = divergence.source_divergence(table(spark, rows), min_docs=min_docs, top_terms=top).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, min_docs, top))
    return got


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)] + ["É", "é", "日本", "Straße", "naïve", "Ab", "aB"]
    out = []
    for i in range(600):
        source = pick.choices(["a", "b", "c", "B", "é", None, "rare"], weights=[9, 3, 3, 3, 3, 2, 0.2])[0]
        lang = pick.choices(["en", "de", None, "xx"], weights=[6, 3, 1, 0.2])[0]
        start = 0 if source == "a" else pick.randrange(200)
        out.append((pick.choice((" ", "-", "1", "\n")).join(pick.choices(words[start:], k=pick.randrange(1, 60))), lang, source))
    out += [(None, "en", "none"), ("", "en", "none"), ("12 34 @[]", "zz", "digits"), (None, None, None), ("lone words", "zz", "other")]
    return out + out[:40] + [("w" * 5000 + " " + "x y " * 50_000, "en", "long")]


@pytest.mark.parametrize("block, columns", [(256, 4096), (7, 16)])
def test_against_brute_force(spark, rows, monkeypatch, block, columns):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    got = check(spark, rows)
    assert {r["part"] for r in got} == {"pair", "term"}
    check(spark, rows[:100], min_docs=1, top=3)


def test_counts_sent_in_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    check(spark, rows[:200])


def test_languages_without_kept_terms(spark):
    got = check(spark, [("a b", "en", "x"), ("c", "en", "y"), (None, "en", "z"), ("q", "fr", "x")])
    assert [r["value"] for r in got] == [0] * 6


def test_no_documents(spark):
    got = divergence.source_divergence(table(spark, []))
    assert got.count() == 0 and got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_products_against_a_loop():
    pick = np.random.default_rng(1)
    counts = [pick.integers(0, 9, 50) for _ in range(6)]
    table_of = [pick.permutation(1000)[:9] + 1 for _ in counts]
    p = [t[c] for t, c in zip(table_of, counts, strict=True)]
    want = [[int(((a - b) ** 2 // (a + b)).sum()) for b in p] for a in p]
    assert divergence.priced(counts, p).tolist() == want


def test_prices_are_exact_for_huge_counts(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**14 + 1, 7), (0, 0, 1), (999, 1000, 3)], "n long, total long, size long")
    got = [r[0] for r in df.select(divergence.level_price(df["n"], df["total"], df["size"])).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in [(10**13, 3 * 10**14 + 1, 7), (0, 0, 1), (999, 1000, 3)]]
    assert divergence.terms("Aa1É b c") == ["aa".encode(), "É".encode(), "b c".encode()]
