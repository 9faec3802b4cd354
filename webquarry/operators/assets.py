"""Asset plans, download outcomes and the layout of stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.functions import files as FL
from webquarry.functions.urls import is_tracker
from webquarry.functions.expr import let


def first_writer(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; partial aggregation keeps copies from piling up."""
    others = [c for c in rows.columns if c != key]
    return (
        rows.groupBy(key)
        .agg(F.min_by(F.struct(*others), F.struct(*order)).alias("first"))
        .select(key, "first.*")
    )


def asset_plan(
    assets: DataFrame, categories: tuple[str, ...], block_trackers: bool = True
) -> DataFrame:
    """Assets to fetch: wanted categories, no trackers, each URL once.

    ``assets`` has ``page_id, page_url, ord, url, type``.  The first wanted
    mention of a URL in crawl order decides its type and source page.
    """
    wanted = assets.where(F.col("type").isin(*categories))
    if block_trackers:
        wanted = wanted.where(~is_tracker(F.col("url")))
    return first_writer(
        wanted.select("page_id", "page_url", "ord", "url", "type"), "url", ["page_id", "ord"]
    )


def measured(payloads: DataFrame) -> DataFrame:
    """Payloads with ``sniffed`` and ``size`` in place of their bytes, which need not travel on."""
    facts = {"sniffed": FL.sniff_type(F.col("content")), "size": F.octet_length("content")}
    return payloads.withColumns(facts).drop("content")


def asset_outcomes(plan: DataFrame, payloads: DataFrame, max_bytes: int = 0) -> DataFrame:
    """What becomes of each planned asset: ``status, reason, bytes`` added.

    ``payloads`` has ``url, http_status, content_type, declared_bytes``, ``content`` or the
    columns of :func:`measured`, and may have the ``error`` a failed fetch named, one row
    per URL; a planned asset without a payload is an error.
    """
    got = measured(payloads) if "content" in payloads.columns else payloads
    stated = F.nullif(F.col("error"), F.lit("")) if "error" in got.columns else F.lit(None).cast("string")
    joined = plan.join(got, "url", "left")
    declared = F.coalesce(F.col("declared_bytes"), F.lit(0))
    ok_status = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    no_limit = F.lit(max_bytes == 0)
    outcome = (
        F.when(ok_status & ~no_limit & (declared > max_bytes), F.struct(F.lit("skipped"), F.lit("too-large"), declared))
        .when(
            ~ok_status | F.col("size").isNull(),
            F.struct(
                F.lit("error"),
                F.coalesce(
                    stated, F.concat(F.lit("http-"), F.coalesce(F.col("http_status"), F.lit(0)).cast("string"))
                ),
                F.lit(None).cast("long"),
            ),
        )
        .when(
            ~no_limit & (F.col("size") > max_bytes),
            F.struct(F.lit("skipped"), F.lit("too-large"), F.col("size").cast("long")),
        )
        .when(
            FL.is_html_as_file(F.col("type"), F.col("sniffed"), F.col("content_type")),
            F.struct(
                F.lit("skipped"), F.lit("not-a-file (server returned HTML)"), F.lit(None).cast("long")
            ),
        )
        .otherwise(
            F.struct(F.lit("ok"), F.lit(None).cast("string"), F.col("size").cast("long"))
        )
    )
    return (
        joined.withColumn("o", outcome.cast("struct<status:string,reason:string,bytes:long>"))
        .select(*plan.columns, "content_type", "sniffed", "o.*")
    )


def mirror_paths(stored: DataFrame) -> DataFrame:
    """Add ``path`` in the mirror layout, ``assets/<type>/<host>/<path>``."""
    index = F.concat(F.lit("asset_"), FL.fnv1a_hex(F.col("url")), F.lit(".bin"))
    relative = let(
        FL.mirror_path(F.col("url"), index),
        lambda p: FL.with_missing_extension(p, F.col("sniffed"), F.col("content_type"), F.col("url")),
    )
    return stored.withColumn("path", F.concat(F.lit("assets/"), F.col("type"), F.lit("/"), relative))


def extension_paths(stored: DataFrame, order: str) -> DataFrame:
    """Add ``path`` in the by-type layout, ``assets/<ext>/<name>``, free of clashes.

    The first file of a case-insensitive path keeps the plain name, later ones
    carry their URL's hash after two underscores; plain names never contain two
    in a row, so the two kinds cannot meet.  Firsts are found by partial
    aggregation and joined back on (path, order): that key is unique, so a name
    shared by a third of all files does not pile up in one task.
    """
    named = stored.withColumn(
        "folder", FL.type_folder(F.col("url"), F.col("content_type"), F.col("sniffed"))
    ).withColumn("name", FL.file_name(F.col("url"), F.col("folder")))
    keyed = named.withColumn("taken_key", F.lower(F.concat("folder", F.lit("/"), "name")))
    firsts = (
        keyed.groupBy("taken_key")
        .agg(F.min(order).alias(order))
        .withColumn("is_first", F.lit(True))
    )
    final = F.when(F.col("is_first"), F.col("name")).otherwise(
        FL.disambiguated_name(F.col("name"), F.col("url"))
    )
    return (
        keyed.join(firsts, ["taken_key", order], "left")
        .withColumn("path", F.concat(F.lit("assets/"), F.col("folder"), F.lit("/"), final))
        .select(*stored.columns, "path")
    )


def downloads_by_type(outcomes: DataFrame) -> DataFrame:
    return (
        outcomes.where(F.col("status") == "ok")
        .groupBy("type")
        .agg(F.count("*").alias("files"))
        .orderBy(F.desc("files"), "type")
    )


def file_list(stored: DataFrame) -> DataFrame:
    """One ``path<TAB>bytes`` line per stored file."""
    return stored.select(F.concat_ws("\t", "path", F.col("bytes").cast("string")).alias("value"))
