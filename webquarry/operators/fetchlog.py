"""Jobs over fetch logs: page quality, attempts, errors and request rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquarry.fixed_values import (
    BLOCKED_STATUSES,
    CHALLENGE_MARKERS,
    RETRYABLE_STATUSES,
    SHELL_PAGE_CHARS,
)
from webquarry.functions.expr import escape_regex, utf16_length


def is_ok(status: Column) -> Column:
    return status.between(200, 299)


def status_class(status: Column) -> Column:
    return (
        F.when(is_ok(status), "ok").when(status.between(300, 399), "warn").otherwise("err")
    )


def looks_blocked(status: Column, html: Column) -> Column:
    """Bot walls, network failures, and successful pages that are empty shells."""
    body = F.lower(F.coalesce(html, F.lit("")))
    markers = "|".join(escape_regex(m) for m in CHALLENGE_MARKERS)
    refused = ~is_ok(status) & status.isin(0, *BLOCKED_STATUSES)
    shell = (body != "") & ((utf16_length(body) < SHELL_PAGE_CHARS) | body.rlike(markers))
    return F.coalesce(refused | (is_ok(status) & shell), F.lit(False))


def is_hard_failure(status: Column, html: Column) -> Column:
    """Not ok and without a body; a failed page with a body still counts as crawled."""
    return ~is_ok(status) & (F.coalesce(html, F.lit("")) == "")


def crawl_errors(log: DataFrame) -> DataFrame:
    """Error rows ``url, message, depth, ts`` of a log with ``url, status, html, ts``."""
    failed = log.where(is_hard_failure(F.col("status"), F.col("html")))
    stated = F.col("error") if "error" in log.columns else F.lit(None).cast("string")
    depth = F.col("depth") if "depth" in log.columns else F.lit(0)
    return failed.select(
        "url",
        F.coalesce(
            F.nullif(stated, F.lit("")), F.concat(F.lit("HTTP "), F.col("status").cast("string"))
        ).alias("message"),
        depth.alias("depth"),
        "ts",
    )


def is_final_attempt(status: Column, html: Column) -> Column:
    """An attempt after which no retry follows."""
    retryable = ~is_ok(status) & status.isin(*RETRYABLE_STATUSES)
    return ~retryable | (F.coalesce(html, F.lit("")) != "")


def request_attempts(log: DataFrame) -> DataFrame:
    """Per request of a log ``request, attempt, status, html``: attempts, the last status, waste.

    ``late`` counts attempts made after one that needed no other.  One partial
    aggregation, no window: a URL asked for a million times stays balanced.
    """
    done = is_final_attempt(F.col("status"), F.col("html"))
    firsts = log.groupBy("request").agg(
        F.count("*").alias("attempts"),
        F.max_by("status", "attempt").alias("status"),
        F.min(F.when(done, F.col("attempt"))).alias("settled"),
        F.max("attempt").alias("last"),
    )
    late = F.coalesce(F.col("last") - F.col("settled"), F.lit(0))
    return firsts.select("request", "attempts", "status", late.cast("long").alias("late"))


def host_gaps(requests: DataFrame, close_ms: int = 1000, bucket_ms: int = 3_600_000) -> DataFrame:
    """Per host of ``host, at_ms``: requests, the smallest gap, and gaps under ``close_ms``.

    Gaps are taken inside time buckets and then between the buckets of a host, so
    a host with a third of all requests is spread over its busy buckets.
    """
    bucketed = requests.withColumn("bucket", F.floor(F.col("at_ms") / bucket_ms))
    gap = F.col("at_ms") - F.lag("at_ms").over(Window.partitionBy("host", "bucket").orderBy("at_ms"))
    inside = (
        bucketed.withColumn("gap", gap)
        .groupBy("host", "bucket")
        .agg(
            F.count("*").alias("requests"),
            F.min("gap").alias("gap"),
            F.count_if(F.col("gap") < close_ms).alias("close"),
            F.min("at_ms").alias("first"),
            F.max("at_ms").alias("last"),
        )
    )
    before = F.lag("last").over(Window.partitionBy("host").orderBy("bucket"))
    return (
        inside.withColumn("jump", F.col("first") - before)
        .groupBy("host")
        .agg(
            F.sum("requests").alias("requests"),
            F.least(F.min("gap"), F.min("jump")).alias("min_gap_ms"),
            (F.sum("close") + F.count_if(F.col("jump") < close_ms)).alias("close_gaps"),
        )
    )


def latest_rows(rows: DataFrame, kind: str, order: list[Column], n: int) -> DataFrame:
    """The latest ``n`` rows of each kind.

    The rank filter is applied before the shuffle, so a task sends at most ``n``
    rows of a kind.
    """
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return rows.withColumn("n", rank).where(F.col("n") <= n).drop("n")
