"""Page snapshots, asset payloads, seed lists and header blocks as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webquarry.functions.expr import let, trim_wide
from webquarry.functions.urls import canonical_url
from webquarry.schemas import SNAPSHOT
from webquarry.session import task_count


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as it lies.

    ``spark.webquarry.readPartitions`` spreads every table over so many tasks; it is
    off unless set, and meant for single files on one machine.
    """
    table = spark.read.parquet(path)
    spread = int(spark.conf.get("spark.webquarry.readPartitions", "0"))
    return table.repartition(spread) if spread else table


def deal(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows over all tasks of the session, for narrow rows that cost far more to work on than to move.

    A file of a few MB is one task however many cores there are, and may hold a million rows.
    Rows of equal ``keys`` go to one task; that is for rows that are grouped by these keys next.
    """
    return rows.repartition(task_count(rows.sparkSession), *keys)


def as_snapshots(pages: DataFrame) -> DataFrame:
    """Project to the snapshot schema; absent columns become typed nulls, header names lower-case."""
    schema = StructType.fromDDL(SNAPSHOT)
    if "headers" in pages.columns:
        pairs = F.transform(
            F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
        )
        pages = pages.withColumn("headers", last_of_each(pairs))
    return pages.select(
        *[
            (F.col(f.name) if f.name in pages.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return as_snapshots(read_table(spark, path))


def as_of(snapshots: DataFrame, at: str | None = None, time: str = "fetched_at") -> DataFrame:
    """One snapshot per URL: the latest that was taken by ``at``, or the latest of all.

    An unknown time counts as the earliest; of equal times the greatest page id counts, then the
    greatest hash of the page.  Urls and times alone tell whether any URL has several; only then do pages move.
    """
    given = snapshots if at is None else snapshots.where(F.col(time).isNull() | (F.col(time) <= F.lit(at).cast("timestamp")))
    if given.groupBy("url").count().where("count > 1").isEmpty():
        return given
    order = [F.col(time), *[F.col(c) for c in ("page_id",) if c in given.columns], *[F.xxhash64(c) for c in ("html",) if c in given.columns]]
    whole = F.struct(*[F.col(f"`{c}`") for c in given.columns])
    return given.groupBy("url").agg(F.max_by(whole, F.struct(*order)).alias("chosen")).select("chosen.*")


def is_html(content_type: Column) -> Column:
    """Whether a page of this type is parsed: an HTML-like or missing one."""
    ctype = F.coalesce(content_type, F.lit(""))
    return ctype.rlike("(?i)html|xml") | (ctype == "")


def html_only(pages: DataFrame) -> DataFrame:
    """Pages worth parsing: an HTML-like or missing type, and a body."""
    return pages.where(is_html(F.col("content_type")) & (F.coalesce(F.col("html"), F.lit("")) != ""))


def last_of_each(pairs: Column) -> Column:
    """A map of ``key, value`` pairs; of a repeated key the last counts."""

    def keep(p: Column) -> Column:
        keys = F.transform(p, lambda x: x["key"])
        return F.filter(p, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["key"]))

    return F.map_from_entries(let(pairs, keep))


def scan_payloads(spark: SparkSession, path: str, max_bytes: int = 0) -> DataFrame:
    """Downloaded files as ``url, declared_bytes, content``; size limits reach the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes:
        files = files.where(F.col("length") <= max_bytes)
    return files.select(
        F.col("path").alias("url"), F.col("length").alias("declared_bytes"), "content"
    )


def payload_rows(stored: DataFrame, url: str, content: str) -> DataFrame:
    """Downloaded bodies that lie in a table: ``url, declared_bytes, content``."""
    body = F.col(content).cast("binary")
    return stored.select(F.col(url).alias("url"), F.octet_length(body).cast("long").alias("declared_bytes"), body.alias("content"))


def seeds(lists: DataFrame, column: str = "seed_list") -> DataFrame:
    """Canonical seeds of newline- or comma-separated lists, order kept as ``ord``."""
    return (
        lists.select(
            *[c for c in lists.columns if c != column],
            F.posexplode(F.split(column, r"[\n,]+")).alias("ord", "raw"),
        )
        .withColumn("raw", trim_wide(F.col("raw")))
        .where(F.col("raw") != "")
        .withColumn("url", canonical_url(F.col("raw")))
        .where(F.col("url").isNotNull())
    )


def bad_seeds(lists: DataFrame, column: str = "seed_list") -> DataFrame:
    """Seeds that do not start with http:// or https://."""
    return (
        lists.select(
            *[c for c in lists.columns if c != column],
            F.posexplode(F.split(column, r"[\n,]+")).alias("ord", "raw"),
        )
        .withColumn("raw", trim_wide(F.col("raw")))
        .where((F.col("raw") != "") & ~F.col("raw").rlike("(?i)^https?://"))
    )


def header_map(block: Column) -> Column:
    """``Name: value`` lines as a map with lower-case names; the last of a name wins."""
    lines = F.filter(F.split(block, r"\n+"), lambda x: F.instr(x, ":") > 1)
    pairs = F.filter(
        F.transform(
            lines,
            lambda x: F.struct(
                F.lower(trim_wide(F.substring_index(x, ":", 1))).alias("key"),
                trim_wide(F.substr(x, F.instr(x, ":") + 1)).alias("value"),
            ),
        ),
        lambda p: (p["key"] != "") & (p["value"] != ""),
    )
    return last_of_each(pairs)
