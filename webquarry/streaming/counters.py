"""All run counters, kept up to date while pages, fetches, files, findings and visits arrive.

Every input becomes rows ``counter, value, n``; their union runs through one stateful
aggregate, whose state is a row per counter and one per different email.  Each trigger adds
only what arrived, and the counters of the run so far are read from the latest rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.config import CrawlConfig
from webquarry.functions.expr import explode_items
from webquarry.functions.urls import in_scope, passes_patterns
from webquarry.plans.frontier import first_seed_of

COUNTERS = (
    "crawled", "queued", "errors", "downloaded", "downloadedBytes", "pageBytes", "escalated", "blockedByRobots",
    "outOfScope", "filtered", "forms", "secrets", "emails",
)


def _rows(arriving: DataFrame, value: Column | None = None, **counters: Column) -> DataFrame:
    """A row ``counter, value, n`` per arriving row and counter."""
    items = [F.struct(F.lit(name).alias("counter"), F.coalesce(n.cast("long"), F.lit(0).cast("long")).alias("n")) for name, n in counters.items()]
    of = F.lit("") if value is None else value
    return arriving.select(of.alias("value"), F.explode(F.array(*items)).alias("item")).select("item.counter", "value", "item.n")


def arriving_link_flags(visits: DataFrame, snapshots: DataFrame, seeds: DataFrame, config: CrawlConfig) -> DataFrame:
    """Links of arriving page visits as ``outside, refused`` (0 or 1): out of scope, or kept out by the patterns.

    ``snapshots`` and ``seeds`` are tables at rest, so nothing of the stream is held.
    """
    first_seed = F.lit(first_seed_of(seeds))
    pages = visits.where(F.col("disposition") == "page").select("url", "depth").join(snapshots.select("url", "links"), "url")
    links = explode_items(pages, ["depth"], "links", "n", "url").select("depth", "url")
    started = seeds.select("url", F.lit(True).alias("is_seed")).distinct()
    scoped = in_scope(F.col("url"), first_seed, config.scope)
    passes = passes_patterns(F.col("url"), config.include_patterns, config.exclude_patterns)
    within = (F.col("depth") + 1 <= config.max_depth) if config.max_depth else F.lit(True)
    return links.join(started, "url", "left").select(
        F.when(scoped, 0).otherwise(1).alias("outside"),
        F.when(scoped & within & ~passes & F.col("is_seed").isNull(), 1).otherwise(0).alias("refused"),
    )


def live_counters(
    records: DataFrame, errors: DataFrame, outcomes: DataFrame, findings: DataFrame, visits: DataFrame, links: DataFrame, fetches: DataFrame
) -> DataFrame:
    """``counter, value, n`` of streams shaped like the tables of ``crawl_stats``; ``links`` has :func:`arriving_link_flags`.

    Run it in update mode, keyed by ``counter, value``.  Emails count once each, so each
    is a key of the state, which lies on disk.
    """
    ok = F.col("status") == "ok"
    disposition = F.col("disposition")
    found = findings.where(F.col("kind").isin("email", "secret"))
    of_email = F.when(F.col("kind") == "email", F.col("value")).otherwise(F.lit(""))
    named = found.select(
        F.when(F.col("kind") == "email", "emails").otherwise("secrets").alias("counter"), of_email.alias("value"), F.lit(1).cast("long").alias("n")
    )
    parts = [
        _rows(records, crawled=F.lit(1), pageBytes=F.col("bytes"), forms=F.size("forms")),
        _rows(errors, errors=F.lit(1)),
        _rows(
            outcomes,
            downloaded=ok.cast("int"),
            downloadedBytes=F.when(ok, F.col("bytes")),
            errors=(F.col("status") == "error").cast("int"),
        ),
        named,
        _rows(visits, blockedByRobots=(disposition == "robots").cast("int"), queued=(disposition == "queued").cast("int")),
        _rows(links, outOfScope=F.col("outside"), filtered=F.col("refused")),
        _rows(fetches, escalated=F.col("escalated").cast("int")),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.union(part)
    return stacked.groupBy("counter", "value").agg(F.sum("n").alias("n"))


def counters_row(latest: DataFrame) -> DataFrame:
    """One row with every counter from the latest rows of :func:`live_counters`."""
    zero = F.lit(0).cast("long")
    total = {c: F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), zero) for c in COUNTERS}
    total["emails"] = F.count_if(F.col("counter") == "emails")
    return latest.agg(*[total[c].alias(c) for c in COUNTERS])
