"""A whole run over stored snapshots: frontier, records, recon, files, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.config import CrawlConfig
from webquarry.functions.expr import explode_items
from webquarry.operators import assets as A
from webquarry.operators import pages as P
from webquarry.operators import recon as R
from webquarry.plans import frontier as FR
from webquarry.plans import records as RC
from webquarry.session import durable
from webquarry.sinks.exports import page_mirror, write_json, write_mirror, write_results
from webquarry.sources import robots as RB
from webquarry.sources import sitemaps as SM
from webquarry.sources.snapshots import as_of


@dataclass(frozen=True)
class CrawlResult:
    visits: DataFrame
    records: DataFrame
    errors: DataFrame
    findings: DataFrame
    audits: DataFrame
    assets: DataFrame
    stats: DataFrame
    summary: DataFrame
    seeds: DataFrame
    hosts: DataFrame
    mirror: DataFrame | None

    def write(self, folder: str) -> None:
        """All artifacts below one folder; the mirror only if it was asked for."""
        write_results(
            folder, self.records, self.summary, self.assets.where(F.col("status") == "ok"),
            self.errors, self.findings, self.audits,
        )
        write_json(self.stats, f"{folder}/data/stats")
        write_json(self.seeds, f"{folder}/data/seeds")
        write_json(self.hosts, f"{folder}/data/hosts")
        if self.mirror is not None:
            write_mirror(self.mirror, f"{folder}/pages")


def analysed(snapshots: DataFrame, config: CrawlConfig) -> DataFrame:
    """Everything a run needs from each snapshot, read in one pass over the HTML."""
    parsed = P.parse_pages(RC.fetched(snapshots))
    text = F.col("html")
    found = (
        R.findings_column(text, F.col("links"), config.extra_secret_patterns)
        if config.extract_intel
        else F.array()
    )
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    security = F.struct(
        F.col("page_url").rlike("(?i)^https:").alias("https"),
        R.missing_headers_column(headers).alias("missing"),
        R.present_headers_column(headers).alias("present"),
        R.cookie_issues_column(headers).alias("cookie_issues"),
        R.tech_column(
            headers, F.col("meta.generator"), text, config.extra_tech_signatures
        ).alias("tech"),
    )
    audited = F.when(F.lit(config.audit_security) & (F.col("html") != ""), security)
    return parsed.select(
        "page_id", "url", "page_url", "status", "content_type", "bytes", "took_ms", "rendered_with",
        "escalated", "error", "fetched_at", "failed", "meta", "links", "assets", "forms",
        found.cast("array<struct<kind:string,subtype:string,value:string>>").alias("findings"),
        audited.alias("security"),
    )


def run_crawl(
    config: CrawlConfig,
    seeds: DataFrame,
    snapshots: DataFrame,
    robots: DataFrame | None = None,
    sitemaps: DataFrame | None = None,
    payloads: DataFrame | None = None,
    folder: str | None = None,
) -> CrawlResult:
    """Crawl a corpus of snapshots the way a live crawl would have walked it.

    ``seeds`` has canonical ``url, ord``; ``snapshots`` the snapshot schema with canonical ``url``,
    of which the latest by ``config.as_of`` counts; ``robots`` is ``host, text``,
    ``sitemaps`` is ``url, xml``, ``payloads`` one row per asset URL.  The HTML is
    read once; what follows works on the stored analysis.  With a ``folder`` a stopped run finds its frontier again.
    """
    snapshots = as_of(snapshots, config.as_of or None)
    pages = durable(analysed(snapshots, config))
    nofollow = RC.is_nofollow(F.col("meta.robots_meta"), config.respect_robots)
    none = F.array().cast("array<string>")
    site = pages.where(~F.col("failed")).select(
        "url", F.when(nofollow, none).otherwise(F.col("links")).alias("links")
    )
    groups = lines = None
    if robots is not None:
        lines = RB.robots_lines(robots)
        groups = RB.robots_groups(lines, config.robots_agent)
    start = seeds.select("url", "ord", F.lit(None).cast("string").alias("parent"))
    first_seed = FR.first_seed_of(start)
    if config.follow_sitemaps and sitemaps is not None and lines is not None:
        numbered = start.select(F.col("ord").alias("seed_no"), "url")
        listed = SM.sitemap_urls(
            SM.sitemap_candidates(SM.first_per_host(numbered), RB.robots_sitemaps(lines)), sitemaps, first_seed,
            config.scope, config.include_patterns, config.exclude_patterns, seeds=start,
        )
        start = durable(SM.seeds_with_sitemaps(start, listed))
    visits = FR.expand_frontier(start, site, config, groups, f"{folder.rstrip('/')}/frontier" if folder else None)

    fetched = visits.where(F.col("disposition") == "page").join(pages, "url")
    crawled = durable(fetched)
    records = _records(crawled, config, first_seed)
    errors = _page_errors(visits, pages)
    rows = explode_items(
        crawled, ["page_url", "depth", "place"], "findings"
    ).select("page_url", "depth", "place", "ord", "item.*")
    kept = R.run_findings(rows, order=("depth", "place", "ord"))
    findings = kept.withColumn(
        "value", F.when(F.col("kind") == "secret", R.mask_secret(F.col("value"))).otherwise(F.col("value"))
    ).drop("first_seen")
    audits = crawled.where(F.col("security").isNotNull()).select(F.col("page_url").alias("url"), "security.*")
    outcomes = _asset_outcomes(crawled, config, payloads)
    counters = FR.link_counters(visits, site, start, config)
    asset_errors = outcomes.where(F.col("status") == "error").select(
        "url",
        F.concat(F.lit("asset: "), "reason").alias("message"),
        F.lit(-1).alias("depth"),
        F.lit(None).cast("timestamp").alias("ts"),
    )
    tried = visits.where(F.col("disposition").isin("page", "error")).select("url")
    fetches = pages.select("url", "escalated").join(tried, "url", "left_semi")
    stats = RC.crawl_stats(records, errors, outcomes, kept, visits, counters, fetches)
    return CrawlResult(
        visits=visits,
        records=records,
        errors=errors.unionByName(asset_errors),
        findings=findings,
        audits=audits,
        assets=outcomes,
        stats=stats,
        summary=RC.run_summary(records, kept, outcomes, stats),
        seeds=seeds.select("url", "ord"),
        hosts=RC.hosts_seen(records),
        mirror=_mirror(snapshots, crawled) if config.save_pages else None,
    )


def _mirror(snapshots: DataFrame, crawled: DataFrame) -> DataFrame:
    return page_mirror(snapshots.join(crawled.select("url"), "url", "left_semi"))


def _records(crawled: DataFrame, config: CrawlConfig, first_seed: str) -> DataFrame:
    def found(kind: str):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind))

    extras = []
    if config.extract_intel:
        extras.append(
            F.struct(
                found("email").alias("emails"), found("secret").alias("secrets"), found("endpoint").alias("endpoints")
            ).alias("intel")
        )
    if config.audit_security:
        extras.append(
            F.struct("security.missing", "security.tech", F.col("security.cookie_issues").alias("cookieIssues")).alias(
                "security"
            )
        )
    escalated = F.when(F.coalesce(F.col("escalated"), F.lit(False)), "+esc").otherwise("")
    return crawled.select(
        "page_id",
        "url",
        F.col("page_url").alias("finalUrl"),
        "status",
        "depth",
        F.col("content_type").alias("contentType"),
        "bytes",
        F.col("took_ms").alias("tookMs"),
        F.concat(F.coalesce(F.col("rendered_with"), F.lit("http")), escalated).alias("renderedWith"),
        "meta",
        RC.followed_links(F.col("links"), F.col("meta.robots_meta"), F.lit(first_seed), config).alias("links"),
        F.transform("assets", lambda a: F.struct(a["url"].alias("url"), a["type"].alias("type"))).alias("assets"),
        "forms",
        *extras,
        F.col("fetched_at").alias("crawledAt"),
    )


def _page_errors(visits: DataFrame, pages: DataFrame) -> DataFrame:
    """Visited URLs whose fetch failed, or that were never fetched."""
    failures = pages.where("failed").select("url", "status", "error", "fetched_at")
    stated = F.nullif(F.col("error"), F.lit(""))
    coded = F.concat(F.lit("HTTP "), F.coalesce(F.col("status"), F.lit(0)).cast("string"))
    return (
        visits.where(F.col("disposition") == "error")
        .join(failures, "url", "left")
        .select("url", F.coalesce(stated, coded).alias("message"), "depth", F.col("fetched_at").alias("ts"))
    )


def _asset_outcomes(crawled: DataFrame, config: CrawlConfig, payloads: DataFrame | None) -> DataFrame:
    mentions = explode_items(crawled, ["url", "depth", "place"], "assets").select(
        F.struct("depth", "place").alias("page_id"), F.col("url").alias("page_url"), "ord", "item.url", "item.type"
    )
    plan = A.asset_plan(mentions, config.categories if payloads is not None else (), config.block_trackers)
    if payloads is None:
        payloads = plan.sparkSession.createDataFrame(
            [], "url string, http_status int, content_type string, declared_bytes long, content binary, error string"
        )
    rank = F.struct("page_id", "ord").alias("rank")
    outcomes = durable(A.asset_outcomes(plan, payloads, config.max_file_size).select("*", rank))
    kept = outcomes.where(F.col("status") == "ok")
    laid_out = A.extension_paths(kept, "rank") if config.organize_by_extension else A.mirror_paths(kept)
    others = outcomes.where(F.col("status") != "ok").withColumn("path", F.lit(None).cast("string"))
    return laid_out.unionByName(others).select(
        "url", "type", "bytes", F.col("page_url").alias("fromPage"), "path", "status", "reason"
    )
