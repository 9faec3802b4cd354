"""Page records, run counters and reports built from the page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.config import CrawlConfig
from webquarry.functions.expr import keep_if, let
from webquarry.functions.urls import hostname, in_scope, registrable_domain
from webquarry.operators import pages as P
from webquarry.operators import recon as R
from webquarry.operators.fetchlog import is_hard_failure
from webquarry.sources.snapshots import is_html


def is_nofollow(robots_meta: Column, respect: bool = True) -> Column:
    if not respect:
        return F.lit(False)
    return F.coalesce(robots_meta, F.lit("")).rlike("(?i)nofollow")


def nofollow_pages(pages: DataFrame) -> DataFrame:
    """Pages whose robots meta tag tells crawlers to keep no links."""
    meta = P.parse_pages(pages, ("robots",)).select("page_id", "page_url", "robots_meta")
    return keep_if(meta, is_nofollow(F.col("robots_meta")))


def followed_links(links: Column, robots_meta: Column, seed: Column, config: CrawlConfig) -> Column:
    """In-scope links of a page; a nofollow page keeps none."""
    kept = let(seed, lambda s: F.filter(links, lambda u: in_scope(u, s, config.scope)))
    return F.when(
        is_nofollow(robots_meta, config.respect_robots), F.array().cast("array<string>")
    ).otherwise(kept)


def fetched(pages: DataFrame) -> DataFrame:
    """Snapshots with ``failed`` and ``bytes``; the body of a page that is not HTML is not parsed."""
    body = F.coalesce(F.col("html"), F.lit(""))
    status = F.coalesce(F.col("status"), F.lit(200)) if "status" in pages.columns else F.lit(200)
    parsed = is_html(F.col("content_type")) if "content_type" in pages.columns else F.lit(True)
    return pages.withColumns(
        {
            "failed": is_hard_failure(status, F.col("html")),
            "bytes": F.octet_length(body).cast("long"),
            "html": F.when(parsed, body).otherwise(""),
        }
    )


def crawlable(pages: DataFrame, config: CrawlConfig) -> DataFrame:
    """Snapshots as the frontier reads them: ``url, links`` per requested URL."""
    parsed = P.parse_pages(fetched(pages), ("robots", "links"))
    return parsed.select(
        "url",
        F.when(
            is_nofollow(F.col("robots_meta"), config.respect_robots),
            F.array().cast("array<string>"),
        ).otherwise(F.col("links")).alias("links"),
    )


def page_records(pages: DataFrame, config: CrawlConfig, seed: str | Column | None = None) -> DataFrame:
    """Nested page records of snapshots with ``depth``; html does not travel on.

    ``seed`` is what scope is relative to; left out, each page's own URL.
    """
    anchor = F.col("page_url") if seed is None else (F.lit(seed) if isinstance(seed, str) else seed)
    parsed = P.parse_pages(fetched(pages), ("meta", "robots", "links", "assets", "forms"))
    rendered = F.concat(
        F.coalesce(F.col("rendered_with"), F.lit("http")),
        F.when(F.coalesce(F.col("escalated"), F.lit(False)), "+esc").otherwise(""),
    )
    records = parsed.where(~F.col("failed")).select(
        "page_id",
        "url",
        F.col("page_url").alias("finalUrl"),
        "status",
        "depth",
        F.col("content_type").alias("contentType"),
        "bytes",
        F.col("took_ms").alias("tookMs"),
        rendered.alias("renderedWith"),
        "meta",
        followed_links(F.col("links"), F.col("robots_meta"), anchor, config).alias("links"),
        F.transform(
            "assets", lambda a: F.struct(a["url"].alias("url"), a["type"].alias("type"))
        ).alias("assets"),
        "forms",
        *([_intel(F.col("html"))] if config.extract_intel else []),
        *([_security()] if config.audit_security else []),
        F.col("fetched_at").alias("crawledAt"),
    )
    return records


def _intel(html: Column) -> Column:
    return F.struct(
        F.size(R.emails_column(html)).alias("emails"),
        F.size(R.secrets_column(html)).alias("secrets"),
        F.size(R.endpoints_column(html)).alias("endpoints"),
    ).alias("intel")


def _security() -> Column:
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    return F.struct(
        R.missing_headers_column(headers).alias("missing"),
        R.tech_column(
            headers, F.col("meta.generator"), F.coalesce(F.col("html"), F.lit(""))
        ).alias("tech"),
        R.cookie_issues_column(headers).alias("cookieIssues"),
    ).alias("security")


def link_graph(records: DataFrame) -> DataFrame:
    """Adjacency list per requested URL, link order kept; nothing is shuffled."""
    return records.select("url", "links")


def forms_by_page(records: DataFrame) -> DataFrame:
    return keep_if(records, F.size("forms") > 0).select(
        F.coalesce("finalUrl", "url").alias("page"), "forms"
    )


def csv_rows(records: DataFrame) -> DataFrame:
    """The nine columns of the CSV export."""
    return records.select(
        "url",
        "status",
        "depth",
        F.col("meta.title").alias("title"),
        "contentType",
        "bytes",
        F.size("links").alias("linkCount"),
        F.size("assets").alias("assetCount"),
        "renderedWith",
    )


def page_counts(records: DataFrame) -> DataFrame:
    return records.select(
        "page_id", F.size("links").alias("links"), F.size("assets").alias("assets")
    )


def _requested_host() -> Column:
    return F.lower(F.regexp_extract("url", r"(?i)\Ahttps?://(?:[^/?#@]*@)?([^/?#]*)", 1))


def hosts_seen(records: DataFrame) -> DataFrame:
    return records.select(_requested_host().alias("host")).distinct()


def crawl_stats(
    records: DataFrame,
    errors: DataFrame,
    outcomes: DataFrame,
    findings: DataFrame,
    visits: DataFrame,
    link_counts: DataFrame,
    fetches: DataFrame,
) -> DataFrame:
    """One row with the run counters.

    ``fetches`` has ``escalated`` of every fetch, failed ones too.
    Each input is reduced to one row by partial aggregation; only those rows meet.
    """
    pages = records.agg(
        F.count("*").alias("crawled"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("pageBytes"),
        F.coalesce(F.sum(F.size("forms")), F.lit(0)).alias("forms"),
    )
    ok = F.col("status") == "ok"
    files = outcomes.agg(
        F.count_if(ok).alias("downloaded"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("downloadedBytes"),
        F.count_if(F.col("status") == "error").alias("asset_errors"),
    )
    failed = errors.agg(F.count("*").alias("page_errors"))
    # Distinct emails without a single-task distinct: reduce per value first.
    intel = (
        findings.where(F.col("kind").isin("email", "secret"))
        .groupBy("kind", "value")
        .agg(F.count("*").alias("n"))
        .agg(
            F.count_if(F.col("kind") == "email").alias("emails"),
            F.coalesce(F.sum(F.when(F.col("kind") == "secret", F.col("n"))), F.lit(0)).alias("secrets"),
        )
    )
    blocked = visits.agg(
        F.count_if(F.col("disposition") == "robots").alias("blockedByRobots"),
        F.count_if(F.col("disposition") == "queued").alias("queued"),
    )
    raised = fetches.agg(F.count_if(F.coalesce("escalated", F.lit(False))).alias("escalated"))
    row = _sum_rows([pages, files, failed, intel, blocked, link_counts, raised])
    return row.select(
        "crawled",
        "queued",
        (F.col("page_errors") + F.col("asset_errors")).alias("errors"),
        "downloaded",
        "downloadedBytes",
        "pageBytes",
        "escalated",
        "blockedByRobots",
        F.col("out_of_scope").alias("outOfScope"),
        "filtered",
        "forms",
        "secrets",
        "emails",
    )


def _sum_rows(parts: list[DataFrame]) -> DataFrame:
    """One row with every counter of several one-row tables of different columns."""
    names = list(dict.fromkeys(c for part in parts for c in part.columns))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def run_summary(
    records: DataFrame, kept_findings: DataFrame, outcomes: DataFrame | None = None, stats: DataFrame | None = None
) -> DataFrame:
    """Hosts, bytes with downloads, finding counts and the run counters, one row.

    The names of hosts and the seeds have no bound, so they are tables of their
    own: :func:`hosts_seen` and the seeds of the run.
    """
    by_host = records.groupBy(_requested_host().alias("host")).agg(
        F.count("*").alias("pages"), F.sum("bytes").alias("bytes")
    )
    totals = by_host.agg(
        F.coalesce(F.sum("pages"), F.lit(0)).alias("crawled"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("totalBytes"),
        F.count("*").alias("hosts"),
    )
    files = []
    if outcomes is not None:
        stored = outcomes.where(F.col("status") == "ok")
        files = [stored.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("totalBytes"))]
    kinds = ("email", "phone", "social", "endpoint", "secret", "comment")
    counts = kept_findings.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds])
    if stats is not None:
        counters = [c for c in stats.columns if c not in ("crawled", "emails", "secrets")]
        files.append(stats.select(*counters))
    return _sum_rows([totals, counts, *files])


def host_overview(pages: DataFrame) -> DataFrame:
    """Per registrable domain: pages, links inside and outside the page's host, targets.

    The flagship query.  Links are counted per page first, so the aggregation
    shuffles one small row per task and domain; distinct targets are reduced per
    (domain, target) before they are counted.
    """
    parsed = P.parse_pages(pages, ("links",)).select(
        registrable_domain(hostname(F.col("page_url"))).alias("domain"), "page_id", "page_url", "links"
    )
    rows = parsed.select("domain", "page_url", F.posexplode_outer("links").alias("ord", "dst_url"))
    inside = hostname(F.col("dst_url")) == hostname(F.col("page_url"))
    per_target = rows.groupBy("domain", "dst_url").agg(
        F.count_if(F.coalesce(F.col("ord"), F.lit(0)) == 0).alias("pages"),
        F.count_if(inside).alias("inside"),
        F.count_if(~inside).alias("outside"),
    )
    return per_target.groupBy("domain").agg(
        F.sum("pages").alias("pages"),
        F.sum("inside").alias("links_inside"),
        F.sum("outside").alias("links_outside"),
        F.count("dst_url").alias("distinct_targets"),
    )


