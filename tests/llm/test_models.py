import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from webquarry.llm import cascade, kneser, toxicity


def documents(spark, rows):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame(
        [(*r, 1, "x", 0.5) for r in rows], "doc_id long, text string, lang string, id int, chunk string, perplexity double"
    )


def slow_symbols(text):
    """One number for a code point from 1 to 1983, two for any other."""
    out = []
    for c in map(ord, text):
        out += [c] if 0 < c < 1984 else [1984 + c // 1024, 3072 + c % 1024]
    return out


def slow_model(texts, order):
    """Interpolated modified Kneser-Ney over the symbols of texts, by plain counting."""
    top = Counter()
    for t in texts:
        padded = [0] * (order - 1) + slow_symbols(t)
        top.update(tuple(padded[i : i + order]) for i in range(len(padded) - order + 1))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts = {}
    for n, c in counts.items():
        of = Counter(c.values())
        if not (of[1] and of[2] and of[3]):
            cuts[n] = (0.5, 1.0, 1.5)
            continue
        y = of[1] / (of[1] + 2 * of[2])
        raw = [1 - 2 * y * of[2] / of[1], 2 - 3 * y * of[3] / of[2], 3 - 4 * y * of[4] / of[3]]
        cuts[n] = tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))
    after = {n: defaultdict(list) for n in counts}
    for n, c in counts.items():
        for g, k in c.items():
            after[n][g[:-1]].append(k)

    def p(g):
        n = len(g)
        below = p(g[1:]) if n > 1 else 1 / 4096
        ks = after[n].get(g[:-1])
        if not ks:
            return below
        total, c = sum(ks), counts[n].get(g, 0)
        cut = cuts[n][min(c, 3) - 1] if c else 0
        left = sum(cuts[n][min(k, 3) - 1] for k in ks)
        return max(c - cut, 0) / total + left / total * below

    def perplexity(t):
        padded = [0] * (order - 1) + slow_symbols(t)
        logs = [math.log(p(tuple(padded[i : i + order]))) for i in range(len(padded) - order + 1)]
        return math.exp(-sum(logs) / len(t))

    return perplexity


WORDS = "the of and river stone window letter morning garden table water light".split()


def prose(pick, n):
    return " ".join(pick.choices(WORDS, k=n))


def test_perplexity_against_brute_force(spark):
    pick = random.Random(1)
    rows = [(i, prose(pick, 30), "en") for i in range(40)] + [(100 + i, "".join(pick.choices("qxz%€汉", k=60)), "en") for i in range(5)]
    rows += [(200 + i, "".join(pick.choices("山川日月木水火土😀\0ह", k=40)), "ja") for i in range(12)]
    rows += [(300, "", "ja"), (301, None, "ja")]
    known = {*range(30), *range(200, 208)}
    trusted = spark.createDataFrame([(i,) for i in known], "id long")
    for order, chunk in ((4, 8_000_000), (3, 500)):
        got = kneser.perplexities(documents(spark, rows), trusted, "doc_id", "text", "lang", order, chunk).collect()
        slow = slow_model([t for i, t, _ in rows if i in known], order)
        want = {i: slow(t) for i, t, _ in rows if t}
        assert {r["id"]: pytest.approx(r["perplexity"], rel=1e-9) for r in got if r["perplexity"] is not None} == want


def test_every_code_point_has_symbols_of_its_own():
    every = "".join(map(chr, range(0x110000)))
    codes = kneser.symbols(every)
    assert codes.min() > 0 and codes.max() == kneser.SYMBOLS - 1 and codes.tolist() == slow_symbols(every)
    wide = codes >= kneser.LEAD
    pairs = codes[wide].reshape(-1, 2)
    assert (pairs[:, 0] < kneser.TRAIL).all() and (pairs[:, 1] >= kneser.TRAIL).all()
    assert len(np.unique(pairs, axis=0)) == len(pairs) == 0x110000 - 1983


def test_languages_beyond_the_alphabets_are_told_apart(spark):
    pick = random.Random(8)
    rows = [(i, "".join(pick.choices(["山の上に", "川を渡る", "朝の光が", "窓を開け", "水を飲む"], k=20)), "ja") for i in range(120)]
    rows += [(1000 + i, "".join(chr(pick.randrange(0x4E00, 0x9F00)) for _ in range(80)), "ja") for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    kept = {r["id"]: r["kept"] for r in kneser.quality_classifier(documents(spark, rows), labels).collect()}
    assert sum(kept[i] for i in range(120)) >= 115 and not any(kept[1000 + i] for i in range(10))


def test_probabilities_sum_to_one(spark):
    pick = random.Random(2)
    counts = Counter()
    for _ in range(50):
        for _, grams in kneser.gram_steps([prose(pick, 10)], 3):
            counts.update(grams.tolist())
    model = kneser.Model(spark.createDataFrame(list(counts.items()), "gram long, c long"), 3)
    context = ord("t") << 12 | ord("h")
    asked = spark.range(4096).selectExpr(f"{context << 12} + id AS gram")
    assert sum(r["p"] for r in model.log_probabilities(asked).collect()) == pytest.approx(1.0)


def test_classifier_rejects_junk_and_keeps_rows_apart(spark):
    pick = random.Random(3)
    rows = [(i, prose(pick, 40), ("en", "de", None)[i % 3]) for i in range(240)]
    junk = [(1000 + i, "".join(pick.choices("#%&|qxz0189", k=200)), "en") for i in range(20)]
    odd = [(2000, None, "en"), (2001, "", None), (None, prose(pick, 40), "en"), (230, "%%%% ####" * 10, "en"), (230, "%%%% ####" * 10, "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1000, 0, 0), (None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = kneser.quality_classifier(documents(spark, rows + junk + odd), labels).collect()
    assert len(got) == len(rows) + len(junk) + len(odd)
    kept = Counter((r["id"], r["kept"]) for r in got)
    assert sum(kept[(i, True)] for i in range(240)) >= 235
    assert not any(kept[(1000 + i, True)] for i in range(20)) and kept[(230, False)] == 2
    assert kept[(2000, False)] == kept[(2001, False)] == kept[(None, True)] == 1
    assert all((r["perplexity"] is None) == (r["n_chars"] == 0) for r in got)


def test_classifier_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert kneser.quality_classifier(documents(spark, []), labels).count() == 0
    got = kneser.quality_classifier(documents(spark, [(1, "abc", "en"), (2, None, None)]), labels).collect()
    assert {(r["id"], r["kept"]) for r in got} == {(1, True), (2, False)}


def test_long_text_in_pieces(monkeypatch):
    text = prose(random.Random(4), 500)
    whole = np.concatenate([g for _, g in kneser.gram_steps([text, "ab", text], 4)])
    monkeypatch.setattr(kneser, "STEP", 100)
    parts = list(kneser.gram_steps([text, "ab", text], 4))
    assert len(parts) > 5 and (np.concatenate([g for _, g in parts]) == whole).all()


def slow_marginals(scores, trans):
    weights = {}
    for states in itertools.product((0, 1), repeat=len(scores)):
        w = 1.0
        for t, s in enumerate(states):
            w *= math.exp(scores[t]) if s else 1.0
            if t:
                w *= trans[states[t - 1], s]
        weights[states] = w
    total = sum(weights.values())
    return [sum(w for s, w in weights.items() if s[t]) / total for t in range(len(scores))]


def test_marginals_against_all_paths():
    pick = np.random.default_rng(5)
    trans = pick.uniform(0.2, 3, (2, 2))
    texts = [pick.normal(0, 2, n) for n in (1, 7, 3, 10, 1, 1, 5)]
    first = np.concatenate([np.arange(len(t)) == 0 for t in texts])
    got = toxicity.marginals(np.concatenate(texts), first, trans)
    want = [p for t in texts for p in slow_marginals(t, trans)]
    assert np.allclose(got, want)


def test_long_chain_stays_finite():
    scores = np.random.default_rng(6).normal(0, 8, 300_000)
    p = toxicity.marginals(scores, np.arange(300_000) == 0, np.array([[1.0, 0.01], [0.2, 5.0]]))
    assert np.isfinite(p).all() and p.min() >= 0 and p.max() <= 1


SLURS = ("blargo", "snivvel", "grottax")


def test_toxic_texts_are_found_with_their_offsets(spark):
    pick = random.Random(7)
    rows, labels = [], []
    for i in range(800):
        words = pick.choices(WORDS, k=60)
        toxic = i % 8 == 0
        if toxic:
            for at in pick.sample(range(60), 3):
                words[at] = pick.choice(SLURS) + pick.choice(("", "en", "ius", "ta"))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic)))
    rows += [(None, None, None), (900, "", "en"), (901, "BLARGOid! the river", "xx"), (1, rows[1][1], "en")]
    docs = documents(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([by[i]["predicted"] == (i % 8 == 0) for i in held]) > 0.97
    assert by[900]["predicted"] == by[None]["predicted"] == 0 and by[900]["score"] == by[None]["score"]
    assert by[901]["predicted"] == 1 and [(s["start"], s["end"]) for s in by[901]["spans"]] == [(0, 8)]
    text = rows[8][1]
    assert all(any(text[s["start"] : s["end"]].startswith(x) for x in SLURS) for s in by[8]["spans"]) and by[8]["spans"]


def test_toxicity_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, [(1, "some words", "en")])
    model = toxicity.train(docs, labels)
    assert [r["predicted"] for r in toxicity.toxicity(docs, model).collect()] == [0]
    assert toxicity.toxicity(documents(spark, []), model).count() == 0


def slow_figures(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


CASES = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t", "en"), (4, "a b c a b c", "en"), (5, "x y x y x y x", "en"), (6, "l 1\nl 1\n\n \nl 2\nl 1", "en"),
    (7, "é€汉 #*$ %&|<> z", "en"), (8, " ".join(f"w{i}" for i in range(80)), "en"), (9, "a " * 100, "en"), (10, "%% " * 30 + " ".join(map(str, range(70))), "en"),
    (11, " ".join(f"CAPS{chr(65 + i % 26)}{i}" for i in range(90)), "en"), (8, " ".join(f"w{i}" for i in range(80)), "en"), (None, "same line here\n" * 3 + " ".join(f"v{i}" for i in range(70)), "en"),
    (12, "y" * 300_000, "en"),
    (13, "\n".join(f" {'-*•'[i % 3]} item{i} of{i} list{i}" for i in range(40)), "en"),
    (14, "\n".join(f"more{i} to{i} read{i}{('...', '… ')[i % 2]}" for i in range(40)), "en"),
    (15, " ".join(f"w{i} and x{i} and" for i in range(40)), "en"),
    (16, " ".join(f"w{i} {i}.{i} \x01{i}" for i in range(40)), "en"),
    (17, " ".join(f"слово{i} 山{i} é{i}" for i in range(40)), "en"),
]


def test_cascade_figures_and_verdicts(spark):
    got = cascade.quality_cascade(documents(spark, CASES)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(map(repr, ((i, *slow_figures(t)) for i, t, _ in CASES))) == sorted(repr((r["id"], *(r[n] for n in names))) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["id"]].append(r)
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
        assert r["kept"] == (r["rejected_by"] is None)
    assert by[8][0]["kept"] and len(by[8]) == 2 and by[9][0]["base_failed"]
    assert by[10][0]["rejected_by"] in ("symbols", "short_words", "without_letter", "top_word")
    assert by[11][0]["rejected_by"] == "capitals" and by[None][0]["rejected_by"] == "dup_lines"
    assert by[13][0]["rejected_by"] == "bullets" and by[14][0]["rejected_by"] == "ellipses" and by[15][0]["rejected_by"] == "top_word"
    assert by[16][0]["rejected_by"] == "without_letter" and by[17][0]["kept"]
    assert cascade.quality_cascade(documents(spark, [])).count() == 0


def test_rule_figures_against_plain_counting():
    import re

    pick = random.Random(9)
    for _ in range(300):
        text = "".join(pick.choices(["a", "Z", "7", "é", "-", "*", "•", "...", "…", " ", "\n", "\t", "\x01", "\x7f", "the "], k=pick.randrange(60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x.strip(" \t\n\x0b\x0c\r") for x in text.split("\n")]
        t = cascade.Text(text)
        assert t.n_without_letter == sum(not re.search(r"[A-Za-z\x80-\U0010ffff]", w) for w in words)
        assert t.n_bullets == sum(x[:1] in ("-", "*", "•") for x in lines if x)
        assert t.n_ellipses == sum(x.endswith(("...", "…")) for x in lines)
        assert t.top_word == max(map(words.count, words), default=0)


def test_rules_run_by_rejections_per_second_of_what_is_left():
    rules = dict.fromkeys("abcd")
    seconds = {"a": 1.0, "b": 0.5, "c": 4.0, "d": 0.1}

    def group(hits, n):
        return frozenset(hits), n, {k: n * x for k, x in seconds.items()}

    # b rejects most per second; nearly all of what a rejects is then gone, so c comes next although a rejects more by itself.
    measured = [group("ab", 40), group("b", 10), group("a", 1), group("c", 20), group("", 100)]
    assert cascade.rule_order(measured, rules) == ["b", "c", "a", "d"]
    assert cascade.rule_order([], rules) == list("abcd")


def test_measured_costs_leave_out_the_base_figures(spark):
    import time

    def slow(t):
        time.sleep(0.002)
        return t.n_words > 100

    rules = {"slow": slow, "free": lambda t: t.n_words > 100, "none": lambda t: False}
    docs = documents(spark, CASES)
    measured = cascade.measure(docs, "text", rules)
    passing = sum(not cascade.Text(t or "").base_failed for _, t, _ in CASES)
    assert sum(n for _, n, _ in measured) == passing and {h for h, _, _ in measured} <= {frozenset(), frozenset(("slow", "free"))}
    order = cascade.rule_order(measured, rules)
    assert order[0] == "free" and order[-1] == "slow"
    got = cascade.quality_cascade(docs, rules=rules).collect()
    assert not any(r["rejected_by"] == "slow" for r in got) and any(r["rejected_by"] == "free" for r in got)


def test_rules_behind_a_rejection_are_not_evaluated():
    called = []
    rules = {name: lambda t, name=name: bool(called.append(name)) or name == "b" for name in "abc"}
    assert cascade.rejecting(cascade.Text("x"), ["a", "b", "c"], rules) == "b" and called == ["a", "b"]


def test_order_of_rules_changes_no_verdict(spark, monkeypatch):
    docs = documents(spark, CASES)
    kept = []
    for names in (list(cascade.RULES), list(cascade.RULES)[::-1]):
        monkeypatch.setattr(cascade, "rule_order", lambda *a, names=names: names)
        kept.append(sorted(repr((r["id"], r["kept"])) for r in cascade.quality_cascade(docs).collect()))
    assert kept[0] == kept[1]


def test_sampled_classes_keep_their_shares(spark):
    pick = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        words = prose(pick, 20).split()
        if i % 10 == 0:
            words[5] = "ambiguous"
            words[6] = "slurword" if i % 20 == 0 else words[6]
        elif pick.random() < 0.15:
            words[5] = "ambiguous"
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(i % 10 == 0)))
    schema = "doc_id long, quality int, toxic int"
    docs = documents(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, schema))
    many = documents(spark, [(1000 * k + i, t, g) for k in range(10) for i, t, g in rows])
    more = spark.createDataFrame([(1000 * k + i, q, x) for k in range(10) for i, q, x in labels], schema)
    sampled = toxicity.train(many, more, max_toxic=10_000, max_clean=600)
    want = {r["id"]: r["predicted"] for r in toxicity.toxicity(docs, model).collect()}
    assert {r["id"]: r["predicted"] for r in toxicity.toxicity(docs, sampled).collect()} == want
    assert sum(want.values()) == 30


def test_registered_query_gives_the_offsets(spark, tmp_path):
    from webquarry.llm import queries

    pick = random.Random(13)
    texts = {i: prose(pick, 30) + (f" slurword {prose(pick, 5)}" if i % 8 == 0 else "") for i in range(400)}
    documents(spark, [(i, t, "en") for i, t in texts.items()]).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in texts], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op8_toxicity(spark, str(tmp_path)).collect()
    found = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for r in got}
    assert found == {i: ["slurword"] if i % 8 == 0 else [] for i in texts}
