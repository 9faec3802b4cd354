"""Small column helpers shared by every job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.fixed_values import SPACE_CLASS, SPACES


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, inside one expression.

    Lambda arguments are bound by value, so the optimizer cannot copy the
    expression into every place ``body`` mentions it.
    """
    return F.transform(F.array(value), body)[0]


def one_of(value: Column, *options: str) -> Column:
    """Whether a value is one of a few, for conditions inside lambdas.

    Spark evaluates a short ``isin`` there by walking its expression tree for every row; equalities, and the hash
    set that a list of more than ten becomes, cost a comparison.
    """
    return value.isin(*options) if len(options) > 10 else reduce(Column.__or__, [value == o for o in options])


def trim_wide(text: Column) -> Column:
    """Trim ASCII and Unicode spaces on both sides."""
    return F.btrim(text, F.lit(SPACES))


def squeeze_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE_CLASS}]+", " ")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters above U+FFFF count twice."""
    above = F.regexp_replace(text, r"[^\x{10000}-\x{10ffff}]", "")
    return F.length(text) + F.when(
        text.rlike(r"[\x{10000}-\x{10ffff}]"), F.length(above)
    ).otherwise(0)


def escape_regex(text: str) -> str:
    """``text`` as a literal inside a Java regular expression."""
    return "".join("\\" + c if c in r".*+?^${}()|[]\/-" else c for c in text)


def distinct_by_first(items: Column, key: str, fields: list[str]) -> Column:
    """Rows of an array of structs, the first of each ``key``, order kept.

    Sorting inside the row costs n log n and no shuffle; only rows with a repeated key are sorted.
    """

    def kept(x: Column) -> Column:
        return F.struct(*[x[f].alias(f) for f in fields])

    def first_places(items: Column) -> Column:
        places = F.sort_array(F.transform(items, lambda x, i: F.struct(x[key].alias("k"), i.alias("i"))))
        firsts = let(places, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"])))
        return F.sort_array(F.transform(firsts, lambda x: x["i"]))

    def distinct(items: Column) -> Column:
        keys = F.transform(items, lambda x: x[key])
        return F.when(F.size(F.array_distinct(keys)) == F.size(items), F.transform(items, kept)).otherwise(
            F.transform(first_places(items), lambda i: kept(F.get(items, i)))
        )

    return let(items, distinct)


def explode_items(df: DataFrame, keep: list[str], items: str, pos: str = "ord", item: str = "item") -> DataFrame:
    """One row per array item with its position.

    The outer form is used on purpose: for the plain one the optimizer infers
    ``size(items) > 0`` and pushes it below the projections, which computes the
    whole array a second time.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(pos, item)).where(F.col(pos).isNotNull())


def keep_if(df: DataFrame, condition: Column) -> DataFrame:
    """Rows where a condition on an expensive computed column holds.

    A plain filter would be pushed below the projection and compute the column
    twice; a test on a generated column stays where it is written.
    """
    marked = df.select("*", F.explode_outer(F.when(condition, F.array(F.lit(True)))).alias("keep_row"))
    return marked.where("keep_row").drop("keep_row")
