"""Export writers: each artifact of a run is one distributed DataFrame write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.functions.files import mirror_path
from webquarry.functions.urls import canonical_url, hostname
from webquarry.operators.assets import file_list
from webquarry.plans.records import csv_rows, forms_by_page, link_graph


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(records: DataFrame, path: str) -> None:
    """Nine columns; only values with a comma, quote or newline are quoted."""
    csv_rows(records).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def page_mirror(pages: DataFrame) -> DataFrame:
    """``host, path, html`` of every page with a body, paths mirroring the URL."""
    final = F.coalesce(canonical_url(F.col("final_url")), canonical_url(F.col("url")))
    return (
        pages.where(F.coalesce(F.col("html"), F.lit("")) != "")
        .withColumn("page_url", final)
        .select(
            "page_id",
            hostname(F.col("page_url")).alias("host"),
            F.concat(F.lit("pages/"), mirror_path(F.col("page_url"))).alias("path"),
            "html",
        )
    )


def write_mirror(mirror: DataFrame, path: str) -> None:
    """Rows of :func:`page_mirror` as one table in the order of host and path.

    The files are ranges of that order: as many as the data fills partitions of the size Spark is set to, however many
    hosts there are.  A huge host spans several files, small ones share one, and the ranges in
    the file footers lead a reader of a host to its files.  A file counts once the write is committed; failed tasks leave none.
    """
    mirror.repartitionByRange("host", "path").sortWithinPartitions("host", "path").write.mode("overwrite").parquet(path)


def read_mirror(spark: SparkSession, path: str, host: str | None = None, page: str | None = None) -> DataFrame:
    """The mirrored pages, of one host or one path if given; other files are skipped by their ranges."""
    rows = spark.read.parquet(path)
    if host is not None:
        rows = rows.where(F.col("host") == host)
    return rows if page is None else rows.where(F.col("path") == page)


def write_intel(findings: DataFrame, path: str) -> bool:
    """Findings partitioned by kind; nothing is written when there are none."""
    if findings.isEmpty():
        return False
    findings.write.mode("overwrite").partitionBy("kind").json(path)
    return True


def write_security(audits: DataFrame, path: str) -> bool:
    if audits.isEmpty():
        return False
    write_json(audits, path)
    return True


def write_file_list(stored: DataFrame, path: str) -> None:
    file_list(stored).write.mode("overwrite").text(path)


def write_results(
    folder: str,
    records: DataFrame,
    summary: DataFrame,
    assets: DataFrame,
    errors: DataFrame,
    findings: DataFrame | None = None,
    audits: DataFrame | None = None,
) -> None:
    """All artifacts of a run below one folder."""
    write_json(summary, f"{folder}/data/summary")
    write_json(records, f"{folder}/data/crawl-data")
    write_json(assets, f"{folder}/data/assets")
    write_json(errors, f"{folder}/data/errors")
    write_json(link_graph(records), f"{folder}/data/links")
    write_json(forms_by_page(records), f"{folder}/data/forms")
    if findings is not None:
        write_intel(findings, f"{folder}/data/intel")
    if audits is not None:
        write_security(audits, f"{folder}/data/security")
    if "path" in assets.columns:
        write_file_list(assets, f"{folder}/downloaded-files")


def export(records: DataFrame, path: str, fmt: str, others: dict[str, DataFrame] | None = None) -> None:
    """A run as ``json``, its pages as ``ndjson`` (one per line) or ``csv``.

    The full export holds the pages and every table of ``others``, such as the
    summary, errors, findings and assets, each below its name.
    """
    if fmt == "json":
        for name, table in {"pages": records, **(others or {})}.items():
            write_json(table, f"{path}/{name}")
    elif fmt == "ndjson":
        write_json(records, path)
    elif fmt == "csv":
        write_csv(records, path)
    else:
        raise ValueError(f"unknown export format: {fmt}")
