"""Streams over several triggers: restarts, replays, state that outlives any watermark."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from webquarry.config import CrawlConfig
from webquarry.operators import fetchlog as L
from webquarry.operators import recon as R
from webquarry.plans import frontier as FR
from webquarry.plans import records as RC
from webquarry.sources import snapshots as S
from webquarry.streaming import counters as CT
from webquarry.streaming import jobs as ST

URLS = "url string, ts timestamp"


def arrive(spark, folder, rows, schema=URLS):
    """One more file of a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, schema=URLS, per_trigger=1):
    return ST.read_stream(spark, str(folder), schema, files_per_trigger=per_trigger)


def forget_last_commit(folder):
    """What a driver leaves behind that dies between a trigger's output and its commit."""
    commits = Path(folder) / "progress/commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if (commits / name).exists():
            os.remove(commits / name)
    return last


def at(day):
    import datetime

    return datetime.datetime(2020, 1, 1) + datetime.timedelta(days=day)


def test_a_url_comes_once_however_late_it_returns(spark, tmp_path):
    given, folder = tmp_path / "in", str(tmp_path / "run")
    seen = lambda: sorted(r.canonical for r in ST.drain(ST.first_seen_ever(stream(spark, given)).select("canonical"), folder=folder).collect())
    arrive(spark, given, [("https://a.com/1", at(0)), ("HTTPS://A.com/1#x", at(0)), ("mailto:x", at(0))])
    arrive(spark, given, [("https://a.com/2", at(400))])
    assert seen() == ["https://a.com/1", "https://a.com/2"]
    # Years later, after a restart, and older than anything seen.
    arrive(spark, given, [("https://a.com/1", at(4000)), ("https://a.com/3", at(4000))])
    arrive(spark, given, [("https://a.com/2", at(-900)), ("https://a.com/3", at(9000))])
    assert seen() == ["https://a.com/1", "https://a.com/2", "https://a.com/3"]
    # Nothing new has arrived.
    assert len(seen()) == 3
    state = [p for p in (Path(folder) / "progress/state").rglob("*.zip")] + [p for p in (Path(folder) / "progress/state").rglob("*.changelog")]
    assert state


def test_a_replayed_trigger_adds_nothing(spark, tmp_path):
    given, folder = tmp_path / "in", str(tmp_path / "run")
    for day in range(3):
        arrive(spark, given, [(f"https://a.com/{(day + i) % 4}", at(day)) for i in range(3)])
    urls = lambda: ST.drain(ST.first_seen_ever(stream(spark, given)).select("canonical"), folder=folder)
    assert urls().count() == 4
    assert forget_last_commit(folder) == 2
    assert sorted(r.canonical for r in urls().collect()) == [f"https://a.com/{i}" for i in range(4)]


def test_findings_are_announced_once(spark, tmp_path):
    given, folder, schema = tmp_path / "in", str(tmp_path / "run"), "page_id long, url string, html string, ts timestamp"
    arrive(spark, given, [(1, "https://a.com/", "me@port.example", at(0))], schema)
    arrive(spark, given, [(2, "https://a.com/b", "me@port.example you@port.example", at(700))], schema)
    found = lambda: sorted(r.value for r in ST.drain(ST.arriving_findings(stream(spark, given, schema), "ts", None).select("value"), folder=folder).collect())
    assert found() == ["me@port.example", "you@port.example"]
    arrive(spark, given, [(3, "https://a.com/c", "you@port.example", at(9000))], schema)
    assert found() == ["me@port.example", "you@port.example"]


LOG = "url string, status int, html string, ts timestamp, host string"


def test_counts_go_on_after_a_restart_and_a_replay(spark, tmp_path):
    given, folder, pick = tmp_path / "in", str(tmp_path / "run"), random.Random(3)
    rows = [(f"https://h{pick.randrange(3)}.com/", 200, "x", at(pick.randrange(2))) for _ in range(60)]
    rates = lambda: {(r.host, str(r.window_start)): r.requests for r in ST.drain(ST.host_rate(stream(spark, given, "url string, status int, html string, ts timestamp"), "ts", delay="100 days"), ("window_start", "host"), folder).collect()}
    for part in (rows[:20], rows[20:30]):
        arrive(spark, given, part, "url string, status int, html string, ts timestamp")
    rates()
    forget_last_commit(folder)
    arrive(spark, given, rows[30:], "url string, status int, html string, ts timestamp")
    want = {}
    for url, _, _, ts in rows:
        key = (url[8:-1], str(ts))
        want[key] = want.get(key, 0) + 1
    assert rates() == want == rates()


def test_all_counters_equal_the_batch(spark, tmp_path):
    pick = random.Random(9)
    names = [f"https://h{i % 2}.com/{i}" for i in range(30)] + ["https://other.org/"]
    html = [f'<a href="/x">x</a><form action="/f"></form> m{i % 5}@port.example AKIA{"ABCDEFGHIJKLMNOP"} ' * (i % 3) for i in range(30)]
    pages = S.as_snapshots(
        spark.createDataFrame(
            [(i, u, html[i], 500 if i % 7 == 0 else 200, i % 4 == 0) for i, u in enumerate(names[:30])],
            "page_id long, url string, html string, status int, escalated boolean",
        )
    ).withColumn("depth", F.lit(0))
    log = spark.createDataFrame([(u, pick.choice((200, 404, 0)), "", at(0)) for u in names], "url string, status int, html string, ts timestamp")
    outcomes = spark.createDataFrame([(pick.choice(("ok", "error", "skipped")), pick.randrange(99)) for _ in names], "status string, bytes long")
    site = spark.createDataFrame([(u, [pick.choice(names) for _ in range(4)]) for u in names[:20]], "url string, links array<string>")
    seeds = spark.createDataFrame([(names[0], 0, None), (names[7], 1, None)], "url string, ord int, parent string")
    visits = spark.createDataFrame(
        [(u, i % 3, pick.choice(("page", "robots", "queued", "error"))) for i, u in enumerate(names)], "url string, depth int, disposition string"
    )
    config = CrawlConfig(scope="domain", max_depth=2, exclude_patterns=("(?i)7$",))
    found = lambda p: R.findings(p.select("page_id", F.col("url").alias("page_url"), "html"), masked=False)
    want = RC.crawl_stats(
        RC.page_records(pages, config), L.crawl_errors(log), outcomes, found(pages), visits, FR.link_counters(visits, site, seeds, config), pages
    ).first()
    live = {k: ST.arrived(t, files=3) for k, t in {"pages": pages, "log": log, "outcomes": outcomes, "visits": visits}.items()}
    changed = CT.live_counters(
        ST.arriving_records(live["pages"], config),
        L.crawl_errors(live["log"]),
        live["outcomes"],
        found(live["pages"]),
        live["visits"],
        CT.arriving_link_flags(live["visits"], site, seeds, config),
        live["pages"],
    )
    folder = str(tmp_path / "run")
    got = CT.counters_row(ST.drain(changed, ("counter", "value"), folder)).first()
    assert got == want and tuple(got.__fields__) == CT.COUNTERS
    assert len(list((tmp_path / "run/out").glob("trigger=*"))) == 3
    forget_last_commit(folder)
    assert CT.counters_row(ST.drain(changed, ("counter", "value"), folder)).first() == want


def test_no_rows_are_all_zero(spark):
    empty = spark.createDataFrame([], "counter string, value string, n long")
    assert set(CT.counters_row(empty).first()) == {0}


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_arrives_file_by_file(spark, files):
    rows = spark.range(100).withColumn("k", F.col("id") % 3)
    got = ST.drain(ST.arrived(rows, files))
    assert got.count() == 100 and got.exceptAll(rows).count() == 0


def test_a_part_that_arrives_is_written_by_many_tasks(spark, tmp_path):
    stream = ST.arrived(spark.range(3000), 3)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    newest = max(folder.glob("arrived-*"), key=lambda f: f.stat().st_mtime)
    rows = [spark.read.parquet(str(f)).count() for f in newest.glob("*.parquet")]
    assert sum(rows) == 3000 and max(rows) < 3000 / 6
    run = tmp_path / "run"
    assert ST.drain(stream, folder=str(run)).count() == 3000
    assert len(list((run / "progress/commits").glob("[0-9]*"))) == 3
