"""Quality rules as a short-circuit cascade.

The base figures of a text are always computed, for they are results.  What a
further rule costs is what it adds to them.  The rules run in the order of
rejections per second, both measured on the rows of a sample that the rules
before let pass; a text leaves the cascade at the first rule that rejects it,
and the rules behind are not evaluated.  The order changes how much work is
done and which rule is named, never which texts are kept.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import ROW, filled, text_of

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LETTERS = UPPER + UPPER.lower()
NOT_UPPER = bytes(b for b in range(256) if b not in UPPER)
NOT_LETTER = bytes(b for b in range(256) if b not in LETTERS)
#: A letter for the rules: A-Z, a-z, or any character beyond ASCII.
WITHOUT_LETTER = re.compile(rb"(?<![^ \t\n\x0b\x0c\r])[\x21-\x40\x5b-\x60\x7b-\x7f\x00-\x08\x0e-\x1f]+(?![^ \t\n\x0b\x0c\r])")
BULLETS = tuple(x.encode() for x in ("-", "*", "•"))
ELLIPSES = tuple(x.encode() for x in ("...", "…"))


class Text:
    """A whole text and its figures, each computed when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.data = text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.data.count(c) for c in SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        """The lines that have a word."""
        return [x for x in self.data.split(b"\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by 3-word windows that occur at least twice."""
        windows = list(zip(self.words, self.words[1:], self.words[2:], strict=False))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        covered, upto = 0, 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                covered += at + 3 - max(at, upto)
                upto = at + 3
        return covered

    @cached_property
    def capitals(self) -> int:
        return len(self.data.translate(None, NOT_UPPER))

    @cached_property
    def letters(self) -> int:
        return len(self.data.translate(None, NOT_LETTER))

    @cached_property
    def n_without_letter(self) -> int:
        """Words without a letter."""
        return sum(1 for _ in WITHOUT_LETTER.finditer(self.data))

    @cached_property
    def n_bullets(self) -> int:
        return sum(x.lstrip(SPACES).startswith(BULLETS) for x in self.lines)

    @cached_property
    def n_ellipses(self) -> int:
        return sum(x.rstrip(SPACES).endswith(ELLIPSES) for x in self.lines)

    @cached_property
    def top_word(self) -> int:
        """How often the most frequent word occurs."""
        return max(Counter(self.words).values(), default=0)

    def base_figures(self) -> tuple[int, int, int, int, int]:
        return self.n_words, self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


#: name -> does it reject?  In whole numbers, so every engine agrees on the border.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "dup_lines": lambda t: 10 * t.n_dup_lines > 3 * len(t.lines),
    "short_words": lambda t: t.word_chars < 2 * t.n_words,
    "long_words": lambda t: t.word_chars > 20 * t.n_words,
    "capitals": lambda t: 2 * t.capitals > t.letters,
    "without_letter": lambda t: 10 * t.n_without_letter > 3 * t.n_words,
    "bullets": lambda t: 10 * t.n_bullets > 9 * len(t.lines),
    "ellipses": lambda t: 10 * t.n_ellipses > 3 * len(t.lines),
    "top_word": lambda t: 10 * t.top_word > 3 * t.n_words,
}


def rejecting(t: Text, order: list[str], rules: dict[str, Callable[[Text], bool]]) -> str | None:
    """The first rule in ``order`` that rejects; those behind it are not evaluated."""
    return next((name for name in order if rules[name](t)), None)


def measure(
    docs: DataFrame, text_col: str, rules: dict[str, Callable[[Text], bool]]
) -> list[tuple[frozenset[str], int, dict[str, float]]]:
    """``rules that reject, rows, seconds of every rule`` over the rows that pass the base rules.

    One entry for each set of rules that rejects some row, so at most as many as rows.
    Seconds are those a rule takes when the base figures are there.
    """
    names = list(rules)

    def timed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filled(batches):
            found: dict[str, list[float]] = {}
            for value in batch["text"]:
                base = Text(value)
                if base.base_failed:
                    continue
                base.base_figures()
                known = dict(base.__dict__)
                hits, spent = [], []
                for name in names:
                    t = Text.__new__(Text)
                    t.__dict__.update(known)
                    start = time.perf_counter()
                    if rules[name](t):
                        hits.append(name)
                    spent.append(time.perf_counter() - start)
                held = found.setdefault("\n".join(hits), [0.0] * (len(names) + 1))
                for i, x in enumerate((1.0, *spent)):
                    held[i] += x
            if found:
                yield pd.DataFrame({"hits": list(found), "sums": list(found.values())})

    parts = docs.select(text_of(text_col).alias("text")).mapInPandas(timed, "hits string, sums array<double>")
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(len(names) + 1)]
    return [
        (frozenset(filter(None, r["hits"].split("\n"))), int(r["s0"]), {name: r[f"s{i + 1}"] for i, name in enumerate(names)})
        for r in parts.groupBy("hits").agg(*sums).collect()
    ]


def rule_order(measured: list[tuple[frozenset[str], int, dict[str, float]]], rules: dict) -> list[str]:
    """The rule with most rejections per second next, both over the rows that the rules before let pass.

    Rules that reject none of these follow by their seconds, the cheapest first;
    ties, and rules of which nothing was measured, keep their own order.
    """
    order: list[str] = []
    left, waiting = measured, list(rules)
    while waiting:

        def worth(name: str, left=left) -> tuple[float, float]:
            seconds = sum(spent[name] for _, _, spent in left)
            return sum(n for hits, n, _ in left if name in hits) / max(seconds, 1e-9), -seconds

        best = max(waiting, key=worth)
        order.append(best)
        waiting.remove(best)
        left = [group for group in left if best not in group[0]]
    return order


def quality_cascade(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = 2000,
    rules: dict[str, Callable[[Text], bool]] | None = None,
) -> DataFrame:
    """Base figures and verdict of every row: ``id``, the figures, ``base_failed, kept, rejected_by`` (and a row id).

    ``sample_rows`` bounds the expected size of the sample that costs and
    selectivities come from; nothing else is sampled.  Null and empty texts have
    no words and fail the base rules.  Very long texts are judged whole, one at a
    time.  Rows stay apart whatever their id, nulls and repeats included; an
    empty table gives an empty result.
    """
    rules = RULES if rules is None else rules
    share = min(1.0, sample_rows / max(1, docs.count()))
    order = rule_order(measure(docs.sample(share, seed=7), text_col, rules), rules)
    row = [c for c in ROW if c in docs.columns]

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filled(batches):
            out = []
            for value in batch["text"]:
                t = Text(value)
                failed = t.base_failed
                by = "base" if failed else rejecting(t, order, rules)
                out.append((*t.base_figures(), failed, by is None, by))
            figures = pd.DataFrame(
                out,
                columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
            )
            yield pd.concat([batch[["id", *row]].reset_index(drop=True), figures], axis=1)

    schema = (
        "id long, "
        + "".join(f"`{c}` long, " for c in row)
        + "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        + "base_failed boolean, kept boolean, rejected_by string"
    )
    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"), *row).mapInPandas(judged, schema)
