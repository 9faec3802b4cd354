"""Fetch logs, skew-safe joins, sources, sinks and streams."""

import csv
import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from catalog import derived as D
from catalog import queries as C
from webquarry.config import CrawlConfig
from webquarry.operators import fetchlog as L
from webquarry.operators import pages as P
from webquarry.operators import skew
from webquarry.plans import records as RC
from webquarry.sinks import exports as X
from webquarry.sources import snapshots as S
from webquarry.streaming import jobs as ST


def test_host_gaps_match_a_sorted_log(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.randrange(0, 900_000)) for _ in range(600)] + [("c", 5)]
    got = L.host_gaps(spark.createDataFrame(rows, "host string, at_ms long"), close_ms=700, bucket_ms=10_000).collect()
    want = {}
    for host in "abc":
        times = sorted(at for h, at in rows if h == host)
        gaps = [b - a for a, b in zip(times, times[1:])]
        want[host] = (len(times), min(gaps, default=None), sum(g < 700 for g in gaps))
    assert {r.host: (r.requests, r.min_gap_ms, r.close_gaps) for r in got} == want


def test_request_attempts(spark):
    log = [(1, 0, 503, ""), (1, 1, 200, "x"), (1, 2, 500, ""), (2, 0, 404, ""), (3, 0, 0, ""), (3, 1, 0, ""), (3, 2, 0, ""),
           (4, 0, 500, "body"), (5, 0, 429, "")]
    got = L.request_attempts(spark.createDataFrame(log, "request int, attempt int, status int, html string"))
    assert {r.request: (r.attempts, r.status, r.late) for r in got.collect()} == {
        1: (3, 500, 1), 2: (1, 404, 0), 3: (3, 0, 0), 4: (1, 500, 0), 5: (1, 429, 0),
    }


def test_blocked_pages(spark):
    long = "x" * 600
    cases = [(503, "", True), (404, "", False), (0, "", True), (200, "short", True), (200, "", False), (200, long, False),
             (200, long + "Just A Moment", True), (404, "short", False), (200, "\U0001f600" * 300, False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, status int, html string, want boolean")
    assert rows.where(L.looks_blocked(F.col("status"), F.col("html")) != F.col("want")).count() == 0


def test_skewed_join_equals_the_plain_one(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("k"), F.col("id").alias("v")
    )
    lookup = spark.createDataFrame([("hot", 1), ("3", 2), ("4", 3)], "k string, w int")
    for how in ("left", "inner"):
        for salts in (1, 8):
            safe = skew.join_one_per_key(rows, lookup, "k", how, salts)
            plain = rows.join(lookup, "k", how)
            assert safe.count() == plain.count()
            assert safe.select("k", "v", "w").exceptAll(plain.select("k", "v", "w")).count() == 0


def test_header_map(spark):
    block = "Server: a\n: none\nplain\nX-A:  b:c \n\nx-a: last\nempty:"
    got = spark.createDataFrame([(block,)], "b string").select(S.header_map(F.col("b")).alias("h")).first()["h"]
    assert got == {"server": "a", "x-a": "last"}


def test_scan_lowers_header_names_and_gates_bodies(spark):
    page = '<a href="/x">x</a> me@port.example'
    rows = [(1, "https://port.example/", page, "text/html", {"Content-Security-Policy": "self", "SERVER": "b"}),
            (2, "https://port.example/t", page, "text/plain", None), (3, "https://port.example/n", page, None, None)]
    pages = S.as_snapshots(
        spark.createDataFrame(rows, "page_id long, url string, html string, content_type string, headers map<string,string>")
    ).withColumn("depth", F.lit(0)).withColumn("status", F.lit(200))
    config = CrawlConfig(scope="all", extract_intel=True, audit_security=True)
    records = {r.page_id: r for r in RC.page_records(pages, config).collect()}
    assert "content-security-policy" not in records[1].security.missing and records[1].security.tech == ["Server: b"]
    assert [len(records[i].links) for i in (1, 2, 3)] == [1, 0, 1]
    assert [records[i].intel.emails for i in (1, 2, 3)] == [1, 0, 1]
    assert all(r.bytes == len(page) for r in records.values())
    assert {r.url: len(r.links) for r in RC.crawlable(pages, config).collect()}["https://port.example/t"] == 0


def test_snapshots_get_every_column(spark, sf):
    snaps = S.scan_pages(spark, f"{sf}/pages.parquet")
    assert snaps.columns[0] == "page_id" and snaps.schema["headers"].dataType.simpleString() == "map<string,string>"
    assert snaps.where("status is not null").count() == 0
    assert S.scan_payloads(spark, f"{sf}/region.parquet").count() == 1
    assert S.scan_payloads(spark, f"{sf}/region.parquet", max_bytes=10).count() == 0


def read_json(folder):
    return [json.loads(x) for f in sorted(Path(folder).glob("part-*.json")) for x in f.read_text().splitlines()]


def test_results_are_written(spark, sf, tmp_path):
    pages = S.as_snapshots(
        spark.createDataFrame(
            [(1, "https://h.com/a", '<title>x, "y"</title><a href="/b"><form action="/f"></form><img src="i.png">'),
             (2, "https://h.com/b", "<title>\n</title>a@b.org")], "page_id long, url string, html string",
        )
    ).withColumn("depth", F.lit(0)).withColumn("status", F.lit(200))
    records = RC.page_records(pages, CrawlConfig(extract_intel=True, audit_security=True))
    findings = C.R.findings(pages.withColumn("page_url", F.col("url")))
    audits = C.R.security_audit(pages.select("page_id", F.col("url").alias("page_url"), "headers", F.lit("").alias("generator"), "html"))
    assets = spark.createDataFrame([("u", "images", 3, "assets/i.png")], "url string, type string, bytes long, path string")
    errors = spark.createDataFrame([], "url string, message string, depth int, ts timestamp")
    out = str(tmp_path / "run")
    X.write_results(out, records, RC.run_summary(records, C.R.run_findings(findings)), assets, errors, findings, audits)
    data = read_json(f"{out}/data/crawl-data")
    assert {d["url"]: d["links"] for d in data} == {"https://h.com/a": ["https://h.com/b"], "https://h.com/b": []}
    assert data[0]["meta"]["title"] == 'x, "y"'
    assert [d["page"] for d in read_json(f"{out}/data/forms")] == ["https://h.com/a"]
    assert {d["url"]: d["links"] for d in read_json(f"{out}/data/links")}["https://h.com/a"] == ["https://h.com/b"]
    assert (Path(out) / "data/intel/kind=email").exists() and len(read_json(f"{out}/data/security")) == 2
    lines = [x for f in Path(f"{out}/downloaded-files").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == ["assets/i.png\t3"]
    for fmt in ("json", "ndjson", "csv"):
        X.export(records, str(tmp_path / fmt), fmt, {"errors": errors, "findings": findings})
    assert len(read_json(tmp_path / "json/pages")) == 2 and len(read_json(tmp_path / "json/findings")) == findings.count() > 0
    assert len(read_json(tmp_path / "ndjson")) == 2
    rows = [r for f in sorted((tmp_path / "csv").glob("part-*.csv")) for r in csv.DictReader(f.open())]
    assert {r["title"] for r in rows} == {'x, "y"', ""} and rows[0]["linkCount"] in "01"
    text = "".join(f.read_text() for f in (tmp_path / "csv").glob("part-*.csv"))
    assert '"x, ""y"""' in text and "url,status,depth,title,contentType,bytes,linkCount,assetCount,renderedWith" in text
    X.write_mirror(X.page_mirror(pages), str(tmp_path / "mirror"))
    assert spark.read.parquet(str(tmp_path / "mirror")).where("host = 'h.com'").count() == 2


def test_a_mirror_has_files_by_size_not_by_host(spark, tmp_path):
    pages = spark.range(3000).selectExpr(
        "id AS page_id", "CASE WHEN id % 3 = 0 THEN 'hot.com' ELSE concat('h', id, '.com') END AS host", "concat('pages/', id) AS path", "repeat('x', 50) AS html"
    )
    path = str(tmp_path / "mirror")
    X.write_mirror(pages, path)
    files = list(Path(path).rglob("*.parquet"))
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert X.read_mirror(spark, path).exceptAll(pages).count() == 0 and X.read_mirror(spark, path).count() == 3000
    assert X.read_mirror(spark, path, "hot.com").count() == 1000
    one = X.read_mirror(spark, path, "h7.com", "pages/7")
    assert one.first()["html"] == "x" * 50
    # The ranges of hosts in the files do not overlap but at their ends.
    spans = sorted((r.low, r.high) for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("host").alias("low"), F.max("host").alias("high")).collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_a_failed_mirror_leaves_no_files(spark, tmp_path):
    pages = spark.range(100).selectExpr("id AS page_id", "'h.com' AS host", "concat('p', id) AS path", "CAST(raise_error(concat('lost ', id)) AS string) AS html")
    try:
        X.write_mirror(pages, str(tmp_path / "mirror"))
    except Exception as error:
        assert "lost" in str(error)
    assert not list((tmp_path / "mirror").rglob("*.parquet"))


def test_nothing_found_writes_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "kind string, value string")
    assert not X.write_intel(empty, str(tmp_path / "i")) and not (tmp_path / "i").exists()
    assert not X.write_security(empty, str(tmp_path / "s"))


def test_streamed_links_equal_the_batch(spark, sf):
    streamed = C.QUERIES["stream_links"](spark, sf)
    batch = P.page_links(spark.read.parquet(f"{sf}/pages.parquet")).select(*streamed.columns)
    assert streamed.count() == batch.count() and streamed.exceptAll(batch).count() == 0


def test_stream_drops_repeats(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    want = spark.sql(D.FETCHES, events=events).select("url").distinct().count()
    assert C.QUERIES["stream_dedup"](spark, sf).count() == want


def test_stream_state_is_bounded(spark, sf):
    log = ST.read_stream(spark, sf, C._EVENT_SCHEMA, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    urls = log.withColumn("url", F.lit("https://h.com/"))
    plan = ST.first_seen_urls(urls, "ts")._jdf.queryExecution().analyzed().toString()
    assert "EventTimeWatermark" in plan and "DeduplicateWithinWatermark" in plan
