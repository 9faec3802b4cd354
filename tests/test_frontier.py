import random

import pytest
from pyspark.sql import functions as F

from webquarry.config import CrawlConfig
from webquarry.plans import frontier as FR


def site(n, seed):
    rng = random.Random(seed)
    graph = {}
    for i in range(n):
        if rng.random() < 0.85:
            targets = [rng.randrange(n) for _ in range(rng.randint(0, 5))]
            graph[f"https://h{i % 3}.example.com/p/{i}"] = list(
                dict.fromkeys(f"https://h{t % 3}.example.com/p/{t}" for t in targets)
            )
    return graph


def sequential(graph, seeds, inside, max_depth, max_pages, refused, blocked):
    """One queue, one worker, one URL at a time."""
    queue = [(u, 0, None) for u in dict.fromkeys(seeds)]
    seen, out, crawled, outside, filtered = set(seeds), {}, 0, 0, 0
    while queue:
        if max_pages and crawled >= max_pages:
            break
        url, depth, parent = queue.pop(0)
        if blocked(url):
            out[url] = (depth, parent, "robots")
        elif url not in graph:
            out[url] = (depth, parent, "error")
        else:
            crawled += 1
            out[url] = (depth, parent, "page")
            for link in graph[url]:
                if not inside(link):
                    outside += 1
                elif (max_depth and depth + 1 > max_depth) or link in seen:
                    continue
                elif refused(link):
                    filtered += 1
                else:
                    seen.add(link)
                    queue.append((link, depth + 1, url))
    for url, depth, parent in queue:
        out[url] = (depth, parent, "queued")
    return out, outside, filtered


@pytest.mark.parametrize(
    "scope,max_depth,max_pages", [("subdomain", 0, 0), ("domain", 3, 0), ("subdomain", 4, 25), ("all", 2, 7)]
)
def test_frontier_matches_a_queue(spark, scope, max_depth, max_pages):
    graph = site(90, 11)
    start = ["https://h1.example.com/p/1", "https://h2.example.com/p/8", "https://h1.example.com/p/1"]
    snapshots = spark.createDataFrame(list(graph.items()), "url string, links array<string>")
    seeds = spark.createDataFrame([(u, i, None) for i, u in enumerate(start)], "url string, ord int, parent string")
    groups = spark.createDataFrame(
        [("h0.example.com", [(1, False, "/p/3*")])], "host string, rules array<struct<line:int,allow:boolean,path:string>>"
    )
    config = CrawlConfig(scope=scope, max_depth=max_depth, max_pages=max_pages, exclude_patterns=("(?i)7$",))
    visits = FR.expand_frontier(seeds, snapshots, config, groups)
    want, outside, filtered = sequential(
        graph, start, (lambda u: "//h1." in u) if scope == "domain" else (lambda u: True), max_depth, max_pages,
        lambda u: u.endswith("7"), lambda u: u.startswith("https://h0.example.com/p/3"),
    )
    rows = visits.collect()
    assert {r.url: (r.depth, r.parent, r.disposition) for r in rows} == want
    assert len(rows) == len(want)
    order = [r.url for r in FR.crawl_order(visits).collect()]
    assert order == sorted(order, key=list(want).index)
    counters = FR.link_counters(visits, snapshots, seeds, config).first()
    assert (counters.out_of_scope, counters.filtered) == (outside, filtered)


def test_levels_do_not_shuffle_snapshots_or_seen_urls(spark):
    from webquarry.session import UrlTables

    tables = UrlTables(spark, "url")
    numbers = spark.range(1000).select(F.col("id").cast("string").alias("url"))
    site_table = numbers.withColumn("links", F.array((F.col("url").cast("int") + 1).cast("string")))
    stored = tables.write(tables.spread(site_table))
    level = tables.write(
        tables.spread(numbers.where("id < 10")).select(
            "url", F.array(F.lit(0)).alias("place"), F.lit("page").alias("disposition")
        )
    )
    seen = level.select("url").hint("merge")
    new = FR._next_level(level.hint("merge"), stored, seen, F.lit("x"), CrawlConfig(scope="all"))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(r.url for r in new.collect()) == ["10"]
    tables.forget()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("webquarry_")]


def test_a_long_chain(spark):
    n = 40
    snapshots = spark.createDataFrame([(f"https://h.com/{i}", [f"https://h.com/{i + 1}"]) for i in range(n)], "url string, links array<string>")
    seeds = spark.createDataFrame([("https://h.com/0", 0, None)], "url string, ord int, parent string")
    visits = FR.expand_frontier(seeds, snapshots, CrawlConfig())
    assert sorted((r.depth, r.disposition) for r in visits.collect()) == [(i, "page") for i in range(n)] + [(n, "error")]
    # However deep the crawl, its result is one scan.
    assert visits._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_the_budget_is_cut_without_a_single_sort(spark):
    pages = spark.range(5000).select(F.array((F.col("id") * 7919 % 5000).cast("int"), F.lit(1)).alias("place")).repartition(7)
    for n in (1, 2, 777, 4999, 5000):
        assert FR._nth_place(pages, n) == [n - 1, 1]


def test_known_links(spark):
    links = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x")], "ord int, src_url string, dst_url string")
    seen = spark.createDataFrame([("x",), ("x",), ("z",)], "url string")
    assert sorted(r.ord for r in FR.known_links(links, seen).collect()) == [1, 3]


class Stop(Exception):
    """The driver is gone."""


def levels(visits):
    return {r.url: (r.depth, r.parent, r.disposition, tuple(r.place)) for r in visits.collect()}


@pytest.mark.parametrize("point, max_pages", [("next", 0), ("note", 30), ("append", 0)])
def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch, point, max_pages):
    graph = site(90, 11)
    snapshots = spark.createDataFrame(list(graph.items()), "url string, links array<string>")
    seeds = spark.createDataFrame([("https://h1.example.com/p/1", 0, None)], "url string, ord int, parent string")
    groups = spark.createDataFrame([("h0.example.com", [(1, False, "/p/3*")])], "host string, rules array<struct<line:int,allow:boolean,path:string>>")
    config = CrawlConfig(scope="subdomain", max_pages=max_pages)
    want = levels(FR.expand_frontier(seeds, snapshots, config, groups))
    run, calls, after = str(tmp_path / "run"), [], 3

    def stopping(real, counts):
        def call(*args, **kwargs):
            if counts(*args):
                calls.append(point)
                if len(calls) == after:
                    if point == "append":
                        real(*args, **kwargs)
                    raise Stop
            return real(*args, **kwargs)

        return call

    with monkeypatch.context() as patch:
        if point == "next":
            patch.setattr(FR, "_next_level", stopping(FR._next_level, lambda *a: True))
        elif point == "note":
            patch.setattr(FR.RunLog, "done", stopping(FR.RunLog.done, lambda *a: True))
        else:
            # The visits of a level are written, its note is not.
            patch.setattr(FR.UrlTables, "append", stopping(FR.UrlTables.append, lambda self, name, *a: self.paths[name].endswith("visited")))
        with pytest.raises(Stop):
            FR.expand_frontier(seeds, snapshots, config, groups, run)
    noted = len(list((tmp_path / "run/notes").glob("level-*")))
    assert noted == (3 if point == "next" else 2)
    counted = []
    real = FR._following
    monkeypatch.setattr(FR, "_following", lambda *a: counted.append(a[1]) or real(*a))
    # Only what the first run had not finished is read again: the snapshots lie in the folder.
    gone = spark.createDataFrame([], "url string, links array<string>")
    assert levels(FR.expand_frontier(seeds, gone, config, groups, run)) == want
    assert counted[0] == noted
    counted.clear()
    assert levels(FR.expand_frontier(seeds, gone, config, groups, run)) == want and not counted
    with pytest.raises(ValueError):
        FR.expand_frontier(seeds, snapshots, CrawlConfig(scope="all"), groups, run)


def test_a_run_leaves_its_visits_only(spark, tmp_path):
    graph = site(40, 3)
    snapshots = spark.createDataFrame(list(graph.items()), "url string, links array<string>")
    seeds = spark.createDataFrame([("https://h1.example.com/p/1", 0, None)], "url string, ord int, parent string")
    before = set(tmp_path.parent.glob("**/table-*"))
    FR.expand_frontier(seeds, snapshots, CrawlConfig(scope="all", max_pages=5), None, str(tmp_path / "run"))
    assert {p.name for p in (tmp_path / "run").iterdir()} == {"notes", "visited"}
    assert set(tmp_path.parent.glob("**/table-*")) == before


def test_several_snapshots_of_a_url_are_one_visit(spark):
    rng = random.Random(5)
    graph = site(60, 4)
    rows = []
    for url, links in graph.items():
        stale = [(url, rng.sample(sorted(graph), 3), "2020-01-0%d" % rng.randrange(1, 5)) for _ in range(rng.randrange(3))]
        rows += [*stale, (url, links, "2020-02-01"), *([(url, ["https://h0.example.com/stale"], None)] if rng.random() < 0.5 else [])]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "url string, links array<string>, t string").withColumn("fetched_at", F.col("t").cast("timestamp"))
    seeds = spark.createDataFrame([("https://h1.example.com/p/1", 0, None)], "url string, ord int, parent string")
    once = spark.createDataFrame(list(graph.items()), "url string, links array<string>")
    config = CrawlConfig(scope="all")
    assert levels(FR.expand_frontier(seeds, table.drop("t"), config)) == levels(FR.expand_frontier(seeds, once, config))


def test_snapshots_as_of_a_date(spark):
    from webquarry.sources.snapshots import as_of

    rng = random.Random(2)
    rows = [(i, f"u{rng.randrange(40)}", rng.choice([None, *range(1, 9)]), f"<p>{rng.randrange(5)}") for i in range(300)] + [(7, "u1", 3, "x")] * 2
    days = {n: f"2021-03-0{n}" for n in range(1, 9)}
    table = spark.createDataFrame([(i, u, days.get(d), h) for i, u, d, h in rows], "page_id long, url string, t string, html string").select(
        "page_id", "url", F.col("t").cast("timestamp").alias("fetched_at"), "html", F.create_map(F.lit("a"), "url").alias("headers")
    )
    for cut in (None, 1, 4, 8):
        want = {}
        for i, u, d, h in rows:
            if cut is None or d is None or d <= cut:
                want[u] = max(want.get(u, (-1, -1)), (d or 0, i))
        got = as_of(table, days.get(cut)).collect()
        assert {r.url: (r.fetched_at.day if r.fetched_at else 0, r.page_id) for r in got} == want and len(got) == len(want)
    single = table.dropDuplicates(["url"])
    assert as_of(single).count() == 40 and "max_by" not in as_of(single)._jdf.queryExecution().optimizedPlan().toString()
