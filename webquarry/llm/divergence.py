"""Divergence of sources by one-hot level products.

Per language, terms and the counts they have in every source form a table.  A
source and a count level make an indicator column: 1 for the terms that occur that
often there.  The columns of a block of terms, multiplied by their transpose, give
the joint table of every two sources: how many terms have level a in the one and
level b in the other.  A divergence that depends on counts alone is then priced
once per cell, and the prices of all blocks add up.

The products are of zeros and ones and at most ``BLOCK`` terms, so single precision
is exact; prices are whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquarry.llm.common import filled, text_of
from webquarry.session import durable

#: Terms of a block, and columns of a product at a time.
BLOCK = 256
COLUMNS = 1 << 12
#: Entries of the counts a task holds before it sends them on.
HELD = 1 << 19
UNIT = 1_000_000_000
#: Bytes that are no part of a term become blanks; A-Z are lower-cased, everything else stays.
TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of letters of ASCII and of any code points beyond it."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """``lang, source, term, n, d``: occurrences and documents; an empty term stands for the group itself.

    Counts are gathered per task before the shuffle, so hot groups and terms move as one row a task or few.
    """
    rows = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (occurrences, documents) in found.items():
                size = len(occurrences)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * size, pa.string()),
                        pa.array([source] * size, pa.string()),
                        pa.array(list(occurrences), pa.binary()).cast(pa.string()),
                        pa.array(list(occurrences.values()), pa.int64()),
                        pa.array([documents[t] for t in occurrences], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "d"],
                )
            found.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "source", "text")]
            for lang, source, text in zip(*columns, strict=True):
                occurrences, documents = found[lang, source]
                own = [*terms(text), b""]
                occurrences.update(own)
                documents.update(set(own))
            if sum(len(c) for c, _ in found.values()) > HELD:
                yield from sent()
        yield from sent()

    parts = rows.mapInArrow(counted, "lang string, source string, term string, n long, d long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def level_price(count: Column, total: Column, size: Column) -> Column:
    """``1 + floor(UNIT * (count + 2) / (total + 2 * size))``, exact."""
    wide = [c.cast("decimal(20,0)") for c in (count, total, size)]
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (wide[0] + F.lit(2)), wide[1] + F.lit(2) * wide[2]) + F.lit(1)


def divergence(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))`` of whole numbers up to UNIT + 1, whose squares fit a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def priced(counts: list[np.ndarray], p: list[np.ndarray]) -> np.ndarray:
    """The divergence of every two sources (rows, columns) over one block of terms.

    ``counts[g]`` and ``p[g]`` hold the level and its probability of every term in source ``g``.
    """
    sources, n_terms = len(counts), len(counts[0])
    at, prices, starts = [], [], [0]
    for own, price in zip(counts, p, strict=True):
        _, first, level = np.unique(own, return_index=True, return_inverse=True)
        at.append(level)
        prices.append(price[first])
        starts.append(starts[-1] + len(first))
    out = np.zeros((sources, sources), np.int64)
    rows = np.arange(n_terms)
    low = 0
    while low < sources:
        # Some sources at a time, as many as their indicator columns allow.
        high = low + 1
        while high < sources and starts[high + 1] - starts[low] <= COLUMNS:
            high += 1
        wide = np.zeros((n_terms, starts[high] - starts[low]), np.float32)
        for h in range(low, high):
            wide[rows, at[h] + starts[h] - starts[low]] = 1
        q = np.concatenate(prices[low:high])
        of = np.repeat(np.arange(low, high), [starts[h + 1] - starts[h] for h in range(low, high)])
        for g in range(high):
            one_hot = np.zeros((len(prices[g]), n_terms), np.float32)
            one_hot[at[g], rows] = 1
            joint = one_hot @ wide
            a, b = np.nonzero(joint)
            apart = prices[g][a] - q[b]
            np.add.at(out[g], of[b], joint[a, b].astype(np.int64) * (apart * apart // (prices[g][a] + q[b])))
        low = high
    return np.triu(out, 1) + np.triu(out, 1).T


def pair_values(levels: DataFrame, sources: dict[str, tuple[list[str], list[int]]]) -> DataFrame:
    """``lang, source, item, value`` of every two sources of a language that has kept terms.

    ``levels`` has a row ``lang, total, entries`` per kept term, the entries being ``(source, n, p)`` of the sources it
    occurs in.  ``sources`` names the sources of a language and the probability of their level 0.
    """

    def block(terms_of: list, names: list[str], zero: list[int]) -> np.ndarray:
        index = {s: i for i, s in enumerate(names)}
        counts = np.zeros((len(names), len(terms_of)), np.int64)
        p = np.repeat(np.array(zero, np.int64)[:, None], len(terms_of), axis=1)
        for t, entries in enumerate(terms_of):
            for e in entries:
                g = index[e["source"]]
                counts[g, t], p[g, t] = e["n"], e["p"]
        return priced(list(counts), list(p))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list] = defaultdict(list)

        def done(lang: str) -> None:
            names, zero = sources[lang]
            own = block(waiting.pop(lang), names, zero)
            sums[lang] = sums[lang] + own if lang in sums else own

        for batch in filled(batches):
            for lang, entries in zip(batch["lang"], batch["entries"], strict=True):
                waiting[lang].append(entries)
                if len(waiting[lang]) == BLOCK:
                    done(lang)
        for lang in list(waiting):
            done(lang)
        for lang, values in sums.items():
            names = sources[lang][0]
            for g, name in enumerate(names):
                rest = [i for i in range(len(names)) if i != g]
                yield pd.DataFrame({"lang": lang, "source": name, "item": [names[i] for i in rest], "value": values[g, rest]})

    # Terms of about the same frequency share a block, so its levels, and with them its columns, are few.
    ordered = levels.repartition("lang", "term").sortWithinPartitions("lang", "total").select("lang", "entries")
    parts = ordered.mapInPandas(products, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = 10,
    top_terms: int = 10,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how sources differ from each other, and by which terms from their language.

    Null text, language and source count as ''.  A language keeps the terms that occur in at least ``min_docs`` of
    its documents.  With V kept terms, a term with n occurrences in a group of N kept occurrences has
    ``p = 1 + floor(1e9 * (n + 2) / (N + 2 * V))``; two such p and q differ by ``floor((p - q)^2 / (p + q))``.
    Part ``pair`` has every other source of the language, the differences summed over all kept terms (0 without
    any); part ``term`` the ``top_terms`` terms of the group that are more frequent than in
    the language.  Ranks go by value, the larger first, and by the bytes of the item on ties.  Repeated rows
    count as often as they occur; very long texts are counted whole.  A group whose texts have no terms is a group too.  An
    empty table gives an empty result; other columns are not read.

    The driver and every task hold the names of the groups, of which the result lists all pairs.
    """
    counts = durable(term_counts(docs, lang_col, source_col, text_col))
    words = counts.where("term <> ''")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d")).where(F.col("d") >= min_docs).drop("d")
    cells = durable(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    terms_of = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("total").alias("lang_n"))
    groups = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(terms_of, "lang", "left")
    zero = level_price(F.lit(0), F.coalesce("group_n", F.lit(0)), F.col("size"))
    groups = durable(groups.withColumn("zero", F.when(F.col("size") > 0, zero)))

    sources: dict[str, tuple[list[str], list[int]]] = {}
    for r in groups.where("zero IS NOT NULL").orderBy("lang", "source").collect():
        names, zeros = sources.setdefault(r["lang"], ([], []))
        names.append(r["source"])
        zeros.append(r["zero"])
    figures = groups.where("zero IS NOT NULL").drop("zero")
    valued = cells.join(figures, ["lang", "source"]).withColumn("p", level_price(F.col("n"), F.col("group_n"), F.col("size")))
    # A term has one entry per source of its language at most.
    levels = valued.groupBy("lang", "term", "total").agg(F.collect_list(F.struct("source", "n", "p")).alias("entries"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    values = pair_values(levels, sources)
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(values, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))

    q = level_price(F.col("total"), F.col("lang_n"), F.col("size"))
    found = valued.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    top = found.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).union(top.select(*columns))
