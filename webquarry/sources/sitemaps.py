"""Sitemap corpora: index files are followed by joins until none is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.functions.expr import explode_items, keep_if
from webquarry.functions.urls import canonical_url, host_with_port, in_scope, origin, passes_patterns
from webquarry.session import durable

_LOC = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"


def first_per_host(seeds: DataFrame) -> DataFrame:
    """The first seed ``seed_no, url`` of every origin; later ones have the same sitemaps."""
    return (
        seeds.groupBy(origin(F.col("url")).alias("origin"))
        .agg(F.min_by(F.struct("seed_no", "url"), "seed_no").alias("first"))
        .select("first.*")
    )


def sitemap_candidates(seeds: DataFrame, robots_sitemaps: DataFrame) -> DataFrame:
    """Sitemaps to try per seed: those of robots.txt in order, then the default one.

    Input ``seed_no, url``; output ``seed_no, candidate_no, sitemap`` without repeats.
    """
    hosted = seeds.select("seed_no", "url", host_with_port(F.col("url")).alias("host"))
    listed = hosted.join(
        robots_sitemaps.select("host", "line", F.col("url").alias("sitemap")), "host"
    ).select("seed_no", "sitemap", F.col("line").alias("candidate_no"))
    default = hosted.select(
        "seed_no",
        F.concat(origin(F.col("url")), F.lit("/sitemap.xml")).alias("sitemap"),
        F.lit(2**31 - 1).alias("candidate_no"),
    )
    return (
        listed.unionByName(default)
        .groupBy("seed_no", "sitemap")
        .agg(F.min("candidate_no").alias("candidate_no"))
    )


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """``sitemap, is_index, locs`` of a corpus ``url, xml``."""
    return sitemaps.select(
        F.col("url").alias("sitemap"),
        F.col("xml").rlike("(?i)<sitemapindex").alias("is_index"),
        F.regexp_extract_all("xml", F.lit(_LOC), F.lit(1)).alias("locs"),
    )


def sitemap_urls(
    candidates: DataFrame,
    sitemaps: DataFrame,
    first_seed: str | None = None,
    scope: str = "all",
    include: tuple[str, ...] = (),
    exclude: tuple[str, ...] = (),
    seeds: DataFrame | None = None,
) -> DataFrame:
    """URLs the sitemaps add: ``seed_no, candidate_no, place, url, parent``.

    A sitemap is read once however many seeds or index files name it, under the
    earliest ``seed_no, candidate_no, place`` that leads to it; an index is followed
    again only when an earlier way to it turns up.  A URL counts for the first
    place that lists it.
    """
    entries = sitemap_entries(sitemaps)
    indexes = durable(entries.where("is_index").drop("is_index"))
    way = F.struct("seed_no", "candidate_no", F.array().cast("array<int>").alias("place"))
    known = durable(candidates.groupBy("sitemap").agg(F.min(way).alias("way")))
    improved = known
    while True:
        found = explode_items(improved.join(indexes, "sitemap").drop("sitemap"), ["way"], "locs", "n", "sitemap")
        place = F.concat("way.place", F.array("n")).alias("place")
        ways = found.select("sitemap", F.struct("way.seed_no", "way.candidate_no", place).alias("way"))
        best = ways.groupBy("sitemap").agg(F.min("way").alias("way"))
        earlier = known.select("sitemap", F.col("way").alias("before"))
        better = best.join(earlier, "sitemap", "left").where(F.col("before").isNull() | (F.col("way") < F.col("before")))
        improved = durable(better.select("sitemap", "way"))
        if improved.isEmpty():
            break
        known = durable(known.unionByName(improved).groupBy("sitemap").agg(F.min("way").alias("way")))
    # Index files are few; the URL lists are joined once, after all ways are known.
    leaves = explode_items(
        known.join(entries.where(~F.col("is_index")), "sitemap"), ["sitemap", "way"], "locs", "n", "loc"
    ).select(
        "way.seed_no",
        "way.candidate_no",
        F.concat("way.place", F.array("n")).alias("place"),
        "loc",
        F.col("sitemap").alias("parent"),
    )
    url = canonical_url(F.col("loc"))
    wanted = keep_if(leaves.withColumn("url", url), F.col("url").isNotNull())
    if first_seed is not None:
        wanted = wanted.where(in_scope(F.col("url"), F.lit(first_seed), scope))
    wanted = wanted.where(passes_patterns(F.col("loc"), include, exclude))
    if seeds is not None:
        wanted = wanted.join(seeds.select("url").distinct(), "url", "left_anti")
    order = F.struct("seed_no", "candidate_no", "place")
    return (
        wanted.groupBy("url")
        .agg(F.min_by(F.struct("seed_no", "candidate_no", "parent", "place"), order).alias("f"))
        .select("url", "f.*")
    )


def seeds_with_sitemaps(seeds: DataFrame, listed: DataFrame) -> DataFrame:
    """Frontier seeds ``url, parent, place``: the seeds, then what their sitemaps list."""
    own = seeds.select(
        "url", F.col("parent").cast("string").alias("parent"), F.array(F.lit(0), F.col("ord").cast("int")).alias("place")
    )
    found = listed.select(
        "url",
        "parent",
        F.concat(
            F.array(F.lit(1), F.col("seed_no").cast("int"), F.col("candidate_no").cast("int")), "place"
        ).alias("place"),
    )
    return own.unionByName(found)
