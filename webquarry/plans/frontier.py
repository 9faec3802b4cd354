"""Frontier expansion: a breadth-first crawl over a table of page snapshots.

The driver loops over levels, never over rows.  Snapshots are written once,
bucketed by URL, and so is every level; visited levels are appended to one table
with a partition per level.  Joining a level with the snapshots, and removing
what was seen, then shuffles neither: a level costs the shuffles of its own new
URLs, and plans are as long at the last level as at the first.  Written levels
also cut the lineage at shared storage, so a lost executor costs a task, not
the run.  A run with a folder of its own notes every finished level there, so a lost
driver costs a level: called again with that folder, the run goes on behind the last note.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.config import CrawlConfig
from webquarry.functions.expr import explode_items
from webquarry.functions.urls import in_scope, passes_patterns
from webquarry.operators.skew import join_one_per_key
from webquarry.session import UrlTables, delete_path, drop_durable, durable, new_folder, read_notes, write_note
from webquarry.sources.robots import RobotsIndex, robots_allowed, robots_index

VISIT = ["url", "depth", "parent", "place", "disposition"]


def first_seed_of(seeds: DataFrame) -> str:
    """The seed every scope test is relative to."""
    return seeds.orderBy("place" if "place" in seeds.columns else "ord").first()["url"]


SITE = "url string, links array<string>"
VISITED = "url string, parent string, place array<int>, disposition string, depth int"


class RunLog:
    """What a run has finished, as notes below its folder: the snapshots, then one note per level."""

    def __init__(self, spark: SparkSession, folder: str, config: CrawlConfig, buckets: int):
        self.spark, self.folder = spark, folder.rstrip("/")
        notes = read_notes(spark, f"{self.folder}/notes")
        options = json.dumps(asdict(config), sort_keys=True)
        begun = json.loads(notes["begin"]) if "begin" in notes else {"options": options, "buckets": buckets}
        if begun["options"] != options:
            raise ValueError(f"the run in {folder} was begun with other options")
        self.buckets = begun["buckets"]
        self.has_site = "site" in notes
        if "begin" not in notes:
            self.note("begin", begun)
        levels = sorted(int(name[len("level-") :]) for name in notes if name.startswith("level-"))
        self.level = json.loads(notes[f"level-{levels[-1]}"]) if levels else None

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def note(self, name: str, value: dict) -> None:
        write_note(self.spark, f"{self.folder}/notes/{name}", json.dumps(value))

    def done(self, depth: int, crawled: int, finished: bool, end: bool) -> None:
        """Everything of a level is stored."""
        self.level = {"depth": depth, "crawled": crawled, "finished": finished, "end": end}
        self.note(f"level-{depth}", self.level)


def expand_frontier(
    seeds: DataFrame,
    snapshots: DataFrame,
    config: CrawlConfig,
    robots: DataFrame | None = None,
    run: str | None = None,
) -> DataFrame:
    """Visits ``url, depth, parent, place, disposition``.

    ``seeds`` has ``url, parent`` and ``ord``, or ``place`` where sitemaps were
    added; ``snapshots`` has ``url, links``, and of several rows of a URL the latest by ``fetched_at``
    counts, a null time as the earliest and without that column the greatest links; ``robots``
    the groups of :func:`robots_groups`.  A visit is a ``page`` (snapshot present),
    an ``error`` (none), ``robots`` (disallowed) or ``queued`` (left over when the
    page budget ran out).

    ``place`` is the chain of link positions from the seed: within a level its
    order is the crawl order, so no level is ever sorted.

    ``run`` is a folder on shared storage.  A run that was stopped goes on there behind its last finished level
    when it is called again with the same inputs and options; one that had ended gives its visits.  Without a
    folder a run starts anew.  What no later level reads is deleted.
    """
    spark = seeds.sparkSession
    log = RunLog(spark, run or new_folder(spark, "frontier"), config, int(spark.conf.get("spark.sql.shuffle.partitions")))
    visited = log.path("visited")
    if not (log.level and log.level["end"]):
        tables = UrlTables(spark, "url", log.buckets)
        index = robots_index(robots) if robots is not None and config.respect_robots else None
        try:
            _expand(tables, log, seeds, snapshots, config, index)
        finally:
            tables.forget()
            if index is not None:
                index.drop()
    return spark.read.schema(VISITED).parquet(visited).select(*VISIT)


def latest_links(snapshots: DataFrame) -> DataFrame:
    """One row ``url, links`` per URL; see :func:`expand_frontier`."""
    order = [c for c in ("fetched_at", "links") if c in snapshots.columns]
    return snapshots.groupBy("url").agg(F.max_by("links", F.struct(*order)).alias("links"))


def _expand(
    tables: UrlTables, log: RunLog, seeds: DataFrame, snapshots: DataFrame, config: CrawlConfig, index: RobotsIndex | None
) -> None:
    spark = seeds.sparkSession
    first_seed = F.lit(first_seed_of(seeds))
    if log.has_site:
        site = tables.attach(log.path("site"), SITE)
    else:
        # What a stopped run left of them is no table yet.
        delete_path(spark, log.path("site"))
        site = tables.stored(latest_links(tables.spread(snapshots)), log.path("site"))
        log.note("site", {})
    stored = spark.table(site)
    depth = log.level["depth"] + 1 if log.level else 0
    crawled = log.level["crawled"] if log.level else 0
    finished = bool(log.level and log.level["finished"])
    if not depth:
        delete_path(spark, log.path("visited"))
        visited = tables.new(log.path("visited"))
        if "place" not in seeds.columns:
            seeds = seeds.withColumn("place", F.array(F.col("ord").cast("int")))
        found = seeds.groupBy("url").agg(F.min_by("parent", "place").alias("parent"), F.min("place").alias("place"))
    else:
        # The part of a level that was not finished is done again.
        delete_path(spark, f"{log.path('visited')}/depth={depth}")
        visited = tables.attach(log.path("visited"), VISITED, part="depth")
        found = _following(spark.table(visited), depth, stored, first_seed, config)
    end = False
    while not end:
        # The new URLs are stored before anything is joined to them.
        fresh = tables.stored(tables.spread(found))
        passing = [fresh]
        last = None
        if depth and spark.table(fresh).isEmpty():
            end = True
        else:
            if finished:
                level = spark.table(fresh).withColumn("disposition", F.lit("queued"))
            else:
                level = _dispositions(tables, spark.table(fresh), stored, index)
            if config.max_pages and not finished:
                passing.append(tables.stored(level))
                level = spark.table(passing[-1])
                of_pages = level.where(F.col("disposition") == "page").select("place")
                pages = of_pages.count()
                if crawled + pages >= config.max_pages:
                    last = _nth_place(of_pages, config.max_pages - crawled)
                    beyond = F.col("place") > F.array(*[F.lit(n) for n in last])
                    level = level.withColumn("disposition", F.when(beyond, "queued").otherwise(F.col("disposition")))
                crawled += pages
            columns = ["url", "parent", "place", "disposition"]
            tables.append(visited, level.select(*columns, F.lit(depth).alias("depth")), part="depth")
            end = finished or bool(config.max_depth and depth + 1 > config.max_depth)
        finished = finished or last is not None
        for name in passing:
            tables.drop(name)
        log.done(depth, crawled, finished, end)
        if not end:
            depth += 1
            found = _following(spark.table(visited), depth, stored, first_seed, config)
    tables.drop(site)


def _following(seen: DataFrame, depth: int, stored: DataFrame, first_seed: Column, config: CrawlConfig) -> DataFrame:
    """The URLs of a level from the visits before it."""
    return _next_level(seen.where(F.col("depth") == depth - 1), stored, seen.select("url"), first_seed, config)


def _nth_place(pages: DataFrame, n: int) -> list[int]:
    """The n-th place in crawl order: a distributed sort, counts per part, and one part of it."""
    ordered = durable(pages.sort("place").select("place", F.spark_partition_id().alias("part")))
    before = 0
    for row in ordered.groupBy("part").count().orderBy("part").collect():
        if before + row["count"] >= n:
            part = ordered.where(F.col("part") == row["part"]).orderBy("place")
            place = part.limit(n - before).agg(F.max("place")).first()[0]
            drop_durable(ordered)
            return place
        before += row["count"]
    raise ValueError(f"fewer than {n} pages")


def _dispositions(
    tables: UrlTables,
    found: DataFrame,
    stored: DataFrame,
    index: RobotsIndex | None,
) -> DataFrame:
    checked = found.withColumn("allowed", F.lit(True)) if index is None else robots_allowed(found, index)
    present = stored.select("url", F.lit(True).alias("present"))
    return tables.spread(checked).join(present, "url", "left").select(
        "url",
        "parent",
        "place",
        F.when(~F.col("allowed"), "robots")
        .when(F.col("present"), "page")
        .otherwise("error")
        .alias("disposition"),
    )


def _next_level(
    level: DataFrame,
    stored: DataFrame,
    seen: DataFrame,
    first_seed: Column,
    config: CrawlConfig,
) -> DataFrame:
    """Unseen targets of a level's pages with their first parent and place."""
    pages = level.where(F.col("disposition") == "page").select("url", "place")
    links = explode_items(
        pages.join(stored, "url").withColumnsRenamed({"url": "page", "place": "from"}),
        ["page", "from"],
        "links",
        "n",
        "url",
    )
    wanted = links.where(
        in_scope(F.col("url"), first_seed, config.scope)
        & passes_patterns(F.col("url"), config.include_patterns, config.exclude_patterns)
    ).withColumn("place", F.concat("from", F.array("n")))
    # Partial aggregation reduces a target linked from everywhere before it is shuffled.
    new = wanted.groupBy("url").agg(F.min_by("page", "place").alias("parent"), F.min("place").alias("place"))
    return new.join(seen, "url", "left_anti")


def crawl_order(visits: DataFrame) -> DataFrame:
    """Visits in breadth-first order."""
    return visits.orderBy("depth", "place")


def link_counters(
    visits: DataFrame, snapshots: DataFrame, seeds: DataFrame, config: CrawlConfig
) -> DataFrame:
    """One row: links out of scope, and links refused by the patterns.

    A refused link is not marked seen, so it counts on every page that has it.
    """
    first_seed = F.lit(first_seed_of(seeds))
    pages = visits.where(F.col("disposition") == "page").join(
        snapshots.select("url", "links"), "url"
    )
    links = explode_items(pages, ["depth"], "links", "n", "url").select("depth", "url")
    scoped = in_scope(F.col("url"), first_seed, config.scope)
    passes = passes_patterns(F.col("url"), config.include_patterns, config.exclude_patterns)
    within = (F.col("depth") + 1 <= config.max_depth) if config.max_depth else F.lit(True)
    per_url = links.groupBy("url").agg(
        F.sum(F.when(scoped, 0).otherwise(1)).alias("outside"),
        F.sum(F.when(scoped & within & ~passes, 1).otherwise(0)).alias("refused"),
    )
    marked = per_url.join(
        seeds.select("url", F.lit(True).alias("is_seed")).distinct(), "url", "left"
    )
    return marked.agg(
        F.coalesce(F.sum("outside"), F.lit(0)).alias("out_of_scope"),
        F.coalesce(F.sum(F.when(F.col("is_seed"), 0).otherwise(F.col("refused"))), F.lit(0)).alias("filtered"),
    )


def known_links(links: DataFrame, seen: DataFrame) -> DataFrame:
    """Links whose target is already in the frontier.

    A semi join in effect: seen URLs are unique, and a target linked from
    everywhere is split when the join runs.
    """
    known = seen.select(F.col("url").alias("dst_url")).distinct().withColumn("known", F.lit(True))
    return join_one_per_key(links, known, "dst_url", how="inner").drop("known")
