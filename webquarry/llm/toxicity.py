"""Toxic spans by a linear-chain conditional random field.

Labels mark documents, so tokens get theirs from evidence: a word or word start
that occurs in toxic documents far more than chance allows marks its tokens in
toxic documents.  The field has two states, weights for words and word starts,
and transitions; it is fitted on a bounded sample of windows.  Forward-backward
marginals of every token of every whole text are summed into a calibrated score
and give the offending offsets.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import ROW, filled, text_of
from webquarry.session import durable

TOKEN = re.compile(r"[^\W_]+")
STARTS = (4, 5, 6)
WINDOW = 32
STEP = 1 << 20
MEMO = 500_000


def features(token: str) -> list[str]:
    """The word, and its starts where it is longer."""
    word = token.lower()
    return [f"={word}", *(f"{word[:n]}-" for n in STARTS if len(word) >= n)]


def linked(m00: np.ndarray, m01: np.ndarray, m10: np.ndarray, m11: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors ``v_t = M_t v_(t-1)``, normalised, of a long chain of 2 x 2 matrices, from (1, 1).

    The chain is cut into about sqrt(n) blocks.  Their products are taken side by
    side, chained, and every block is run again from its own start.
    """
    n = len(m00)
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    pad = blocks * size - n

    def grid(x: np.ndarray, fill: float) -> np.ndarray:
        return np.ascontiguousarray(np.concatenate([x, np.full(pad, fill)]).reshape(blocks, size).T)

    a, b, c, d = grid(m00, 1.0), grid(m01, 0.0), grid(m10, 0.0), grid(m11, 1.0)
    p, q, r, s = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for j in range(size):
        p, q, r, s = a[j] * p + b[j] * r, a[j] * q + b[j] * s, c[j] * p + d[j] * r, c[j] * q + d[j] * s
        scale = 1.0 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    x, y = np.ones(blocks), np.ones(blocks)
    for k in range(1, blocks):
        u, v = p[k - 1] * x[k - 1] + q[k - 1] * y[k - 1], r[k - 1] * x[k - 1] + s[k - 1] * y[k - 1]
        x[k], y[k] = u / (u + v), v / (u + v)
    top, low = np.empty((size, blocks)), np.empty((size, blocks))
    for j in range(size):
        x, y = a[j] * x + b[j] * y, c[j] * x + d[j] * y
        scale = 1.0 / (x + y)
        x, y = x * scale, y * scale
        top[j], low[j] = x, y
    return top.T.reshape(-1)[:n], low.T.reshape(-1)[:n]


def marginals(scores: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The probability of the toxic state of every token.

    ``scores`` are log-odds of the tokens of many texts one after the other,
    ``first`` marks the first token of each text, ``trans[a, b]`` is the factor of
    state b after state a (0 clean, 1 toxic).
    """
    if not len(scores):
        return np.zeros(0)
    psi = np.exp(np.clip(scores, -30, 30))
    # Forward: a first token forgets what was before.
    m00 = np.where(first, psi, psi * trans[1, 1])
    m01 = np.where(first, psi, psi * trans[0, 1])
    m10 = np.where(first, 1.0, trans[1, 0])
    m11 = np.where(first, 1.0, trans[0, 0])
    toxic, clean = linked(m00, m01, m10, m11)
    # Backward, over the reversed chain: the last token of a text has nothing after it.
    after = np.concatenate([psi[1:], [1.0]])
    last = np.concatenate([first[1:], [True]])
    b00 = np.where(last, 1.0, trans[1, 1] * after)[::-1]
    b01 = np.where(last, 1.0, trans[1, 0])[::-1]
    b10 = np.where(last, 1.0, trans[0, 1] * after)[::-1]
    b11 = np.where(last, 1.0, trans[0, 0])[::-1]
    on, off = (x[::-1] for x in linked(b00, b01, b10, b11))
    return toxic * on / (toxic * on + clean * off)


@dataclass
class Field:
    """The fitted weights: bounded by the number of features kept."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    trans: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    calibration: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def memo(self) -> dict[str, float]:
        """Log-odds of tokens, computed when first asked for."""
        weights, bias = self.weights, self.bias

        class Memo(dict):
            def __missing__(self, token: str) -> float:
                value = bias + sum(weights.get(f, 0.0) for f in features(token))
                if len(self) >= MEMO:
                    self.clear()
                self[token] = value
                return value

        return Memo()

    def tag(self, texts: list[str], memo: dict[str, float]) -> Iterator[tuple[np.ndarray, int]]:
        """The marginals of every text's tokens; many texts go through one chain."""
        held: list[list[float]] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            lengths = [len(h) for h in held]
            scores = np.fromiter((x for h in held for x in h), float, sum(lengths))
            first = np.zeros(len(scores), bool)
            starts = np.cumsum([0, *lengths[:-1]])
            first[starts[np.asarray(lengths) > 0]] = True
            whole = marginals(scores, first, self.trans)
            for s, n in zip(starts.tolist(), lengths, strict=True):
                yield whole[s : s + n]

        for text in texts:
            held.append(list(map(memo.__getitem__, TOKEN.findall(text))))
            size += len(held[-1])
            if size >= STEP:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def score(self, p: np.ndarray) -> float:
        a, b, c = self.calibration
        x = a + b * math.log1p(float(p.sum())) + c * (float(p.max()) if len(p) else 0.0)
        return 1.0 / (1.0 + math.exp(-min(max(x, -700.0), 700.0)))


def spans(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
    """``start, end, probability`` of runs of tokens that are toxic at 0.5 or more."""
    found: list[tuple[int, int, float]] = []
    was = False
    for at, token in enumerate(TOKEN.finditer(text)):
        if p[at] >= 0.5:
            if was:
                found[-1] = (found[-1][0], token.end(), max(found[-1][2], float(p[at])))
            else:
                found.append((token.start(), token.end(), float(p[at])))
        was = p[at] >= 0.5
    return found


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_toxic: int, max_clean: int) -> DataFrame:
    """``id, toxic, weight, text`` of labelled rows outside the held-out fifth, about the given numbers at most.

    The weights give the classes the shares they have among all such rows; their mean is about 1.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = durable(known.where(F.crc32(F.col("id").cast("string")) % 5 != 0))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    share = {k: max(1, int(min(1.0, most / max(1, counts.get(k, 0))) * 1_000_000)) for k, most in ((1, max_toxic), (0, max_clean))}
    mean = sum(counts.get(k, 0) * share[k] for k in share) / max(1, sum(counts.get(k, 0) for k in share))
    weight = F.when(F.col("toxic") == 1, mean / share[1]).otherwise(mean / share[0])
    few = known.where(drawn < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # At most about max_toxic + max_clean ids, whatever the input.
    return durable(rows.join(F.broadcast(few), "id").select("id", "toxic", weight.alias("weight"), "text"))


def evidence(sample: DataFrame, max_features: int, least: float, purity: float) -> list[tuple[str, float, float]]:
    """Features whose share of toxic documents no chance explains: ``feature, toxic, clean`` documents by weight."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {0: Counter(), 1: Counter()}
        for batch in filled(batches):
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                totals[int(toxic)].update({f for t in set(TOKEN.findall(text)) for f in features(t)})
        names = list(totals[0].keys() | totals[1].keys())
        if names:
            yield pd.DataFrame({"feature": names, "pos": [totals[1][n] for n in names], "neg": [totals[0][n] for n in names]})

    parts = sample.select("toxic", "text").mapInPandas(count, "feature string, pos long, neg long")
    # All rows of a class have the same weight.
    of = {r["toxic"]: r["w"] for r in sample.groupBy("toxic").agg(F.max("weight").alias("w")).collect()}
    sums = parts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos > 2")
    sums = sums.select("feature", (F.col("pos") * of.get(1, 1.0)).alias("pos"), (F.col("neg") * of.get(0, 1.0)).alias("neg"))
    base = sample.agg(F.sum(F.col("toxic") * F.col("weight")) / F.sum("weight")).first()[0] or 0.0
    if not 0 < base < 1:
        return []
    n, share = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    other = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    gain = n * (share * F.log(share / base) + other)
    best = sums.where((share > purity) & (gain > least)).orderBy(F.desc(gain), "feature").limit(max_features)
    return [(r["feature"], r["pos"], r["neg"]) for r in best.collect()]


def windows(sample: DataFrame, marked: set[str], max_windows: int) -> tuple[list[list[str]], list[list[int]], list[float]]:
    """Windows of tokens, their states and weights: around marked tokens of toxic texts, and from clean texts."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filled(batches):
            out = []
            for key, toxic, weight, text in zip(batch["id"], batch["toxic"], batch["weight"], batch["text"], strict=True):
                tokens = TOKEN.findall(text)
                if not tokens:
                    continue
                if toxic:
                    hits = [i for i, t in enumerate(tokens) if any(f in marked for f in features(t))]
                    middle = hits[key % len(hits)] if hits else None
                else:
                    middle = (key * 7919) % len(tokens)
                if middle is None:
                    continue
                part = tokens[max(0, middle - WINDOW // 2) : middle + WINDOW // 2]
                states = [int(bool(toxic) and any(f in marked for f in features(t))) for t in part]
                out.append((key, part, states, weight))
            if out:
                yield pd.DataFrame(out, columns=["key", "tokens", "states", "weight"])

    rows = sample.mapInPandas(cut, "key long, tokens array<string>, states array<int>, weight double")
    few = rows.orderBy(F.xxhash64("key"), "key").limit(max_windows).collect()
    return [list(r["tokens"]) for r in few], [list(r["states"]) for r in few], [r["weight"] for r in few]


def fit(tokens: list[list[str]], states: list[list[int]], weights: list[float], names: list[str], steps: int, penalty: float) -> Field:
    """Maximum weighted likelihood with a quadratic penalty, by Adam steps over all windows."""
    each = np.asarray(weights, float)
    number = {name: i + 1 for i, name in enumerate(names)}
    width = 1 + len(STARTS)
    grid = np.zeros((len(tokens), WINDOW, width), np.int64)
    want = np.zeros((len(tokens), WINDOW))
    live = np.zeros((len(tokens), WINDOW), bool)
    for i, (part, tags) in enumerate(zip(tokens, states, strict=True)):
        live[i, : len(part)] = True
        want[i, : len(part)] = tags
        for j, token in enumerate(part):
            for k, f in enumerate(features(token)):
                grid[i, j, k] = number.get(f, 0)
    # Column 0 of the weights belongs to absent features and stays 0; the last five are the bias and the transitions.
    size = len(names) + 1
    w = np.zeros(size + 5)
    w[size] = -2.0
    mean, square = np.zeros_like(w), np.zeros_like(w)
    pairs = live[:, 1:] & live[:, :-1]
    seen = np.array([((want[:, :-1] == a) & (want[:, 1:] == b) & pairs).sum(axis=1) @ each for a in (0, 1) for b in (0, 1)], float)
    for step in range(1, steps + 1):
        scores = w[grid].sum(axis=2) + w[size]
        psi = np.exp(np.clip(scores, -30, 30))
        trans = np.exp(w[size + 1 :]).reshape(2, 2)
        forward = np.zeros((len(tokens), WINDOW, 2))
        backward = np.ones((len(tokens), WINDOW, 2))
        forward[:, 0] = np.stack([np.ones(len(tokens)), psi[:, 0]], axis=1)
        forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, WINDOW):
            now = forward[:, t - 1] @ trans
            now[:, 1] *= psi[:, t]
            forward[:, t] = now / now.sum(axis=1, keepdims=True)
        for t in range(WINDOW - 2, -1, -1):
            nxt = backward[:, t + 1].copy()
            nxt[:, 1] *= psi[:, t + 1]
            now = nxt @ trans.T
            now /= now.sum(axis=1, keepdims=True)
            backward[:, t] = np.where(live[:, t + 1, None], now, 1.0)
        both = forward * backward
        both /= both.sum(axis=2, keepdims=True)
        p = np.where(live, both[:, :, 1], 0.0)
        joint = forward[:, :-1, :, None] * trans[None, None] * backward[:, 1:, None, :]
        joint[:, :, :, 1] *= psi[:, 1:, None]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        expected = np.tensordot(each, np.where(pairs[:, :, None, None], joint, 0.0).sum(axis=1), 1).reshape(-1)
        off = ((p - np.where(live, want, 0.0)) * each[:, None]).reshape(-1)
        gradient = np.zeros_like(w)
        for k in range(width):
            gradient[:size] += np.bincount(grid[:, :, k].reshape(-1), weights=off, minlength=size)
        gradient[size] = off.sum()
        gradient[size + 1 :] = expected - seen
        gradient = gradient / each.sum() + penalty * w
        gradient[0] = 0.0
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        w -= 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Field(dict(zip(names, w[1:size].tolist(), strict=True)), float(w[size]), np.exp(w[size + 1 :]).reshape(2, 2))


def calibrated(model: Field, sample: DataFrame) -> Field:
    """Fit the logistic map from summed and largest marginals to the label, on the bounded sample."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = model.memo()
        for batch in filled(batches):
            ps = list(model.tag(batch["text"].tolist(), memo))
            yield pd.DataFrame(
                {"toxic": batch["toxic"], "weight": batch["weight"], "total": [float(p.sum()) for p in ps], "top": [float(p.max()) if len(p) else 0.0 for p in ps]}
            )

    rows = sample.select("toxic", "weight", "text").mapInPandas(sums, "toxic int, weight double, total double, top double").toPandas()
    x = np.stack([np.ones(len(rows)), np.log1p(rows["total"]), rows["top"]], axis=1)
    y, each = rows["toxic"].to_numpy(float), rows["weight"].to_numpy(float)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (each * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-2])
        w -= np.linalg.solve(hessian, x.T @ (each * (p - y)) + np.array([1e-3, 1e-2, 1e-2]) * w)
    model.calibration = tuple(float(v) for v in w)
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_toxic: int = 6000,
    max_clean: int = 24000,
    max_features: int = 20_000,
    max_windows: int = 20_000,
    steps: int = 120,
    penalty: float = 1e-5,
) -> Field:
    """The field fitted on a bounded sample of labelled rows; without both classes, one that never fires."""
    sample = sample_rows(docs, labels, id_col, text_col, max_toxic, max_clean)
    names = [f for f, _, _ in evidence(sample, max_features, least=12.0, purity=0.75)]
    if not names:
        return Field()
    tokens, states, weights = windows(sample, set(names), max_windows)
    return calibrated(fit(tokens, states, weights, names, steps, penalty), sample)


def toxicity(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """``id, score, predicted, n_toxic, spans`` of every row (and a row id).

    ``n_toxic`` is the expected number of toxic tokens, ``spans`` the offsets of
    those at 0.5 or more in the whole text, in characters.  Only the text is an
    input of the score.  Null and empty texts have no tokens and get the score
    of a text without toxic tokens.  Rows stay apart whatever their id, an
    empty table gives an empty result, and other columns are not read.
    """
    row = [c for c in ROW if c in docs.columns]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), *row)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = model.memo()
        for batch in filled(batches):
            texts = batch["text"].tolist()
            scores, totals, found = [], [], []
            for text, p in zip(texts, model.tag(texts, memo), strict=True):
                scores.append(model.score(p))
                totals.append(float(p.sum()))
                hit = with_spans and len(p) and p.max() >= 0.5
                found.append([{"start": s, "end": e, "p": v} for s, e, v in spans(text, p)] if hit else [])
            yield batch[["id", *row]].assign(score=scores, predicted=[int(s >= 0.5) for s in scores], n_toxic=totals, spans=found)

    schema = (
        "id long, " + "".join(f"`{c}` long, " for c in row) + "score double, predicted int, n_toxic double, "
        "spans array<struct<start: long, end: long, p: double>>"
    )
    return rows.mapInPandas(judged, schema)
