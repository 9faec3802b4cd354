"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters: an n-gram is ``order`` symbols in 12 bits each,
so suffixes and contexts are bit operations and the tables stay small enough to
be joined in shards.  A code point below ``LEAD`` is one symbol; any other is
two, a leading and a trailing one, so no two code points share their symbols.

Texts are packed once into chunks, stored bucketed by chunk on shared storage.
Training counts the n-grams of the trusted rows of every chunk.  For scoring, a
chunk asks for its different n-grams; the requests of all chunks meet the count
tables of every order in joins on the n-gram, and the answers return to the
chunk, where they are summed per document.  No text is shuffled, and what moves
grows with the number of chunks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import ROW, filled, text_of, with_row_id
from webquarry.session import UrlTables, durable

BITS = 12
SYMBOLS = 1 << BITS
#: First leading and first trailing symbol: 1088 leading ones of 10 bits each reach the last code point.
TRAIL = SYMBOLS - 1024
LEAD = TRAIL - (0x110000 >> 10)
STEP = 1 << 20
PAYLOAD = f"chunk long, ids array<long>, langs array<string>, {', '.join(f'`{c}` array<long>' for c in ROW)}, sizes array<long>, packed binary, grams array<long>"


def symbols(text: str) -> np.ndarray:
    """A text as symbol numbers; 0 is kept for the start, so the null character takes two as well."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wide = (codes >= LEAD) | (codes == 0)
    if not wide.any():
        return codes
    last = np.cumsum(1 + wide) - 1
    out = np.zeros(len(codes) + int(wide.sum()), np.int64)
    out[last] = np.where(wide, TRAIL + (codes & 1023), codes)
    out[last[wide] - 1] = LEAD + (codes[wide] >> 10)
    return out


def pieces(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """``doc, start, symbols`` in pieces of at most ``STEP`` characters, for bounded memory."""
    for doc, text in enumerate(texts):
        for start in range(0, len(text), STEP):
            yield doc, start, symbols(text[start : start + STEP])


def gram_steps(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``docs, grams`` of about ``STEP`` positions at a time: one n-gram per symbol, starts padded."""
    held_docs: list[np.ndarray] = []
    held: list[np.ndarray] = []
    size, tail = 0, np.zeros(order - 1, np.int64)
    for doc, start, codes in pieces(texts):
        if start == 0:
            tail = np.zeros(order - 1, np.int64)
        padded = np.concatenate([tail, codes])
        tail = padded[len(padded) - (order - 1) :]
        grams = np.zeros(len(codes), np.int64)
        for j in range(order):
            grams = (grams << BITS) | padded[j : j + len(codes)]
        held.append(grams)
        held_docs.append(np.full(len(codes), doc, np.int64))
        size += len(codes)
        if size >= STEP:
            yield np.concatenate(held_docs), np.concatenate(held)
            held_docs, held, size = [], [], 0
    if size:
        yield np.concatenate(held_docs), np.concatenate(held)


def unpacked(packed: bytes, sizes: list[int]) -> list[str]:
    text = zlib.decompress(packed).decode("utf-8", "surrogatepass")
    ends = np.cumsum(sizes).tolist()
    return [text[e - n : e] for e, n in zip(ends, sizes, strict=True)]


def listed(batch: pa.RecordBatch, column: str, row: int) -> list[int]:
    return batch.column(column)[row].values.to_numpy().tolist()


def chunked(docs: DataFrame, id_col: str, text_col: str, lang_col: str, order: int, chunk_chars: int) -> DataFrame:
    """Chunks of about ``chunk_chars`` characters with the different n-grams in them."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"), *ROW
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held: list[pd.DataFrame] = []
        size = 0

        def chunk() -> pd.DataFrame:
            part = pd.concat(held, ignore_index=True)
            texts = part["text"].tolist()
            grams = [pd.unique(g) for _, g in gram_steps(texts, order)]
            ids = [None if pd.isna(x) else int(x) for x in part["id"]]
            return pd.DataFrame(
                {
                    "chunk": [number],
                    "ids": [ids],
                    "langs": [part["lang"].tolist()],
                    **{c: [part[c].tolist()] for c in ROW},
                    "sizes": [[len(t) for t in texts]],
                    "packed": [zlib.compress("".join(texts).encode("utf-8", "surrogatepass"), 2)],
                    "grams": [np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)],
                }
            )

        for batch in filled(batches):
            lengths = batch["text"].str.len().to_numpy()
            start = 0
            for at, n in enumerate(lengths.tolist()):
                size += n
                if size >= chunk_chars:
                    held.append(batch.iloc[start : at + 1])
                    yield chunk()
                    held, size, start = [], 0, at + 1
                    number += 1
            if start < len(batch):
                held.append(batch.iloc[start:])
        if held:
            yield chunk()

    return rows.mapInPandas(pack, PAYLOAD)


def trained_counts(chunks: DataFrame, trusted: DataFrame, order: int) -> DataFrame:
    """Counts of the highest-order n-grams in the trusted rows; ``trusted`` has ``chunk, places``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = unpacked(batch.column("packed")[i].as_py(), listed(batch, "sizes", i))
                for _, grams in gram_steps([texts[p] for p in listed(batch, "places", i)], order):
                    codes, names = pd.factorize(grams)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(codes, minlength=len(names)))], ["gram", "c"])

    rows = chunks.select("chunk", "sizes", "packed").join(trusted, "chunk").drop("chunk")
    return rows.mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


class Model:
    """The count tables of every order, from the highest down.

    Lower orders hold continuation counts: how many different symbols precede
    the n-gram.  A context knows its total and how many successors it has with
    one, two, and more counts.
    """

    def __init__(self, counts: DataFrame, order: int):
        self.order = order
        self.counts = {order: durable(counts)}
        for n in range(order - 1, 0, -1):
            suffix = F.col("gram").bitwiseAND((1 << (BITS * n)) - 1)
            self.counts[n] = durable(self.counts[n + 1].groupBy(suffix.alias("gram")).agg(F.count("*").alias("c")))
        sizes = None
        for n, t in self.counts.items():
            part = t.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).select(F.lit(n).alias("order"), "c", "n")
            sizes = part if sizes is None else sizes.union(part)
        found = {(r["order"], r["c"]): r["n"] for r in sizes.collect()}
        self.discounts = {n: self.discount(*(found.get((n, c), 0) for c in (1, 2, 3, 4))) for n in self.counts}

    @staticmethod
    def discount(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
        """The three discounts from how many n-grams occur once to four times; fixed ones where that fails."""
        if not (n1 and n2 and n3):
            return 0.5, 1.0, 1.5
        y = n1 / (n1 + 2 * n2)
        raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))

    def contexts(self, n: int) -> DataFrame:
        many = [F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2)]
        many.append(F.sum((F.col("c") > 2).cast("long")).alias("n3"))
        return self.counts[n].groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("c").alias("total"), *many)

    def log_probabilities(self, grams: DataFrame) -> DataFrame:
        """``gram, p`` for different highest-order n-grams: every order is joined in turn, from the lowest up."""
        asked = {self.order: grams}
        for n in range(self.order - 1, 0, -1):
            suffix = F.col("gram").bitwiseAND((1 << (BITS * n)) - 1)
            asked[n] = asked[n + 1].select(suffix.alias("gram")).distinct()
        below = None
        for n in range(1, self.order + 1):
            d1, d2, d3 = self.discounts[n]
            rows = asked[n].withColumn("context", F.shiftright("gram", BITS))
            rows = rows.join(self.counts[n], "gram", "left").join(self.contexts(n), "context", "left")
            if below is None:
                rows = rows.withColumn("lower", F.lit(1.0 / SYMBOLS))
            else:
                rows = rows.withColumn("gram_below", F.col("gram").bitwiseAND((1 << (BITS * (n - 1))) - 1))
                rows = rows.join(below.select(F.col("gram").alias("gram_below"), F.col("p").alias("lower")), "gram_below")
            cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
            own = F.coalesce(F.greatest(F.col("c") - cut, F.lit(0.0)) / F.col("total"), F.lit(0.0))
            left = (d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")) / F.col("total")
            below = rows.select("gram", F.coalesce(own + left * F.col("lower"), F.col("lower")).alias("p"))
            if n < self.order:
                below = durable(below)
        return below


def scored(chunks: DataFrame, answers: DataFrame, order: int) -> DataFrame:
    """``id, lang, n_chars, perplexity`` and the row id of every text; ``answers`` has ``chunk, found``."""
    schema = f"id long, lang string, {', '.join(f'`{c}` long' for c in ROW)}, n_chars long, perplexity double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = listed(batch, "sizes", i)
                texts = unpacked(batch.column("packed")[i].as_py(), sizes)
                totals = np.zeros(len(texts))
                if batch.column("names")[i].is_valid:
                    names, values = (batch.column(c)[i].values.to_numpy() for c in ("names", "values"))
                    by = np.argsort(names)
                    names, logs = names[by], np.log(values[by])
                    for docs, grams in gram_steps(texts, order):
                        codes, found = pd.factorize(grams)
                        totals += np.bincount(docs, weights=logs[np.searchsorted(names, found)][codes], minlength=len(texts))
                lengths = np.asarray(sizes, dtype=float)
                empty = lengths == 0
                perplexity = np.exp(-totals / np.where(empty, 1.0, lengths))
                columns = [batch.column(c)[i].values for c in ("ids", "langs", *(f"row_{k}" for k in range(len(ROW))), "sizes")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(perplexity, mask=empty)], ["id", "lang", *ROW, "n_chars", "perplexity"]
                )

    rows = chunks.select("chunk", "ids", "langs", *[F.col(c).alias(f"row_{i}") for i, c in enumerate(ROW)], "sizes", "packed")
    both = rows.join(answers, "chunk", "left").drop("chunk")
    return both.mapInArrow(score, schema)


def perplexities(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    order: int,
    chunk_chars: int,
) -> DataFrame:
    """``id, lang, n_chars, perplexity`` and the row id of every row; ``trusted_ids`` has ``id``."""
    tables = UrlTables(docs.sparkSession, "chunk")
    chunks = tables.write(chunked(with_row_id(docs), id_col, text_col, lang_col, order, chunk_chars))
    places = chunks.select("chunk", F.posexplode("ids").alias("place", "id")).join(trusted_ids, "id", "left_semi")
    trusted = places.groupBy("chunk").agg(F.collect_list("place").alias("places"))
    model = Model(trained_counts(chunks, trusted, order), order)
    asked = chunks.select("chunk", F.explode("grams").alias("gram"))
    known = model.log_probabilities(asked.select("gram").distinct())
    found = asked.join(known, "gram").groupBy("chunk").agg(F.collect_list(F.struct("gram", "p")).alias("found"))
    answers = found.select("chunk", F.col("found.gram").alias("names"), F.col("found.p").alias("values"))
    result = durable(scored(chunks, answers, order))
    tables.forget()
    return result


def quality_classifier(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = 4,
    chunk_chars: int = 8_000_000,
    quantile: float = 0.99,
    slack: float = 1.1,
) -> DataFrame:
    """``id, lang, n_chars, perplexity, threshold, kept`` and the row id of every row.

    ``labels`` has ``doc_id, quality``; a document is trusted if all its labels are 1.
    Four fifths of the trusted documents (crc32 of the id not divisible by 5)
    train the model.  The others give each language its threshold: ``slack``
    times the ``quantile`` of their perplexities.  A language without any takes
    the threshold of all languages together; without trusted text at all,
    nothing is rejected but empty texts.  A null language counts as a language.
    ``perplexity`` is per code point, also where one takes two symbols; a text
    exactly at the threshold is kept.  Very long texts are read whole, in steps.
    Null and empty texts have no perplexity and are rejected.  A null id is never
    trusted; rows stay apart whatever their id.  An empty table gives an empty
    result, and other columns are not read.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
    trusted = marks.agg(F.min("quality").alias("quality")).where("quality = 1").select("id")
    held = F.crc32(F.col("id").cast("string")) % 5 == 0
    rows = perplexities(docs, trusted.where(~held), id_col, text_col, lang_col, order, chunk_chars)
    known = rows.join(trusted.where(held), "id", "left_semi").where("perplexity is not null")
    level = F.percentile_approx("perplexity", quantile, 10_000) * slack
    lang = F.coalesce(F.col("lang"), F.lit(""))
    by_lang = known.groupBy(lang.alias("key")).agg(level.alias("own"))
    overall = known.agg(level.alias("overall")).first()["overall"]
    judged = rows.withColumn("key", lang).join(by_lang, "key", "left").drop("key")
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    kept = F.col("perplexity").isNotNull() & (threshold.isNull() | (F.col("perplexity") <= threshold))
    return judged.select("id", "lang", "n_chars", "perplexity", threshold.alias("threshold"), kept.alias("kept"), *ROW)
