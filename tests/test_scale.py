"""Work that must not pile up in one task, however small the files it comes from."""

from pyspark.sql import functions as F

from catalog import derived as D
from catalog.queries import _site, derived
from webquarry.functions import markup as M
from webquarry.functions import urls as U
from webquarry.operators import pages as P
from webquarry.plans import records as RC


def test_pages_made_of_narrow_rows_are_dealt_over_the_tasks(spark, tmp_path):
    parts = spark.range(400).selectExpr("id AS p_partkey", "'n' AS p_name", "'t' AS p_type")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pages = derived(spark, str(tmp_path), D.MARKET_PAGES)
    per_task = pages.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(per_task) == 400 and max(per_task) <= 50


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_robots_tag_is_read_without_the_other_fields(spark):
    pages = spark.createDataFrame([(1, "https://a.com/", '<meta name=robots content="NoFollow">')], "page_id long, url string, html string")
    found = RC.nofollow_pages(pages)
    assert "og:title" not in plan_of(found) and found.first()["robots_meta"] == "NoFollow"


def test_only_the_attributes_a_part_looks_up_are_decoded(spark):
    html = '<link rel="stylesheet" href="s.css"><a href="x" style="url(y)">'
    tags = P.page_tags(spark.createDataFrame([("https://a.com/", html)], "url string, html string"), (), ("a",))
    assert [(t["name"], len(t["attrs"])) for t in tags.first()["tags"]] == [("link", 0), ("a", 2)]


def test_names_are_looked_up_by_their_first_letter(spark):
    texts = ["&zwj;&Zopf;&zopf;", "&eacute&amp;&lt;", "&NotEqualTilde;", "&nothing;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(M.decode_references(F.col("t")))
    assert [r[0] for r in rows.collect()] == ["\u200d\u2124\U0001d56b", "\u00e9&<", "\u2242\u0338", "&nothing;"]
    # One table per letter in place of a text of all names.
    assert len(M._NAMED.split(M._NEXT)) == 58


def test_references_below_the_folder_resolve_like_written_out_ones(spark):
    base = "https://a.com/d/e.html?q=1"
    cases = {
        "x.png": "https://a.com/d/x.png", "x/y:z?a:b": "https://a.com/d/x/y:z?a:b", "?p=2": "https://a.com/d/e.html?p=2", "?": "https://a.com/d/e.html?",
        "x:y": None, "./x": "https://a.com/d/x", "x/../y": "https://a.com/d/y", "x y\u00e9": "https://a.com/d/x%20y%C3%A9", "": None, "//": None, "/": "https://a.com/",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", U.canonical_url(F.col("raw"), F.lit(base)).alias("url"))
    assert {r.raw: r.url for r in rows.collect()} == cases


def test_attributes_that_nothing_looks_up_are_not_read(spark):
    html = "<a id=1 title='a > b href=no' HREF = \"x&amp;y\" class=c href=z>t</a><a x href='><a href>"
    tags = P.page_tags(spark.createDataFrame([("https://a.com/", html)], "url string, html string"), (), ("a",))
    assert [list(t["attrs"]) for t in tags.first()["tags"]] == [["", "x&y"], ["", ""], []]


def test_links_and_assets_share_the_targets_of_anchors(spark):
    html = '<a href="b.pdf"><a href="c"><iframe src="d.pdf"></iframe><img src="b.pdf">'
    pages = spark.createDataFrame([(1, "https://a.com/", html)], "page_id long, url string, html string")
    row = P.parse_pages(pages, ("links", "assets")).first()
    assert row["targets"] == [f"https://a.com/{x}" for x in ("b.pdf", "c", "d.pdf")] == row["links"]
    assert [(a.url, a.type, a.via) for a in row["assets"]] == [("https://a.com/b.pdf", "documents", "a")]


def test_short_lists_are_compared_by_equality_inside_lambdas(spark):
    rows = spark.createDataFrame([("HTTP://A.com/x/../Y.PNG", '<a href="x"><img src=y><title>t</title>')], "raw string, html string")
    url = U.canonical_url(F.col("raw"), F.lit("https://a.com/"))
    tags = M.tags_of(M.tokens(F.col("html")), ("a", "video", "audio"))
    found = rows.select(url.alias("url"), U.category(url).alias("type"), F.transform(tags, lambda t: t["name"]).alias("names"))
    assert " IN (" not in plan_of(found)
    assert tuple(found.first()) == ("http://a.com/Y.PNG", "images", ["a", "img", "title"])


def test_forms_alone_cut_no_attributes_out_of_other_tags(spark):
    html = '<base href="/b/"><img srcset="s.png 2x"><form action="a?x=1"><input name=u></form><form><button name=b></form>'
    rows = spark.createDataFrame([("https://a.com/", html)], "url string, html string")
    parsed = P.parse_pages(rows, ("meta", "robots", "links", "assets", "forms"))
    alone = parsed.select(F.transform("forms", lambda f: f["action"]).alias("actions"))
    assert alone.first()["actions"] == ["https://a.com/b/a?x=1", "https://a.com/b/"]
    # What the attributes of an image are called stands in the plan of the assets only.
    assert "data-lazy-src" in plan_of(parsed.select("assets")) and "data-lazy-src" not in plan_of(alone)


def test_the_first_base_that_has_a_target_counts(spark):
    pages = ["<base target=x><base href='/b/'><base href='/c/'><a href=x>", "<base target=x><a href=x>", "<base href=''><a href=x>", "<BASE HREF=&#47;d/><a href=x>", "<a href=x>"]
    rows = spark.createDataFrame([(i, "https://a.com/p/", h) for i, h in enumerate(pages)], "page_id int, url string, html string")
    got = P.page_tags(rows, (), ("a",)).orderBy("page_id").select("base").collect()
    assert [r.base for r in got] == ["https://a.com/b/", "https://a.com/p/", "https://a.com/p/", "https://a.com/d/", "https://a.com/p/"]


def test_texts_and_payloads_of_one_file_are_dealt_over_the_tasks(spark, tmp_path):
    spark.range(400).selectExpr("id AS doc_id", "'t' AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(400).selectExpr("id AS p_partkey", "5 AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for text in (D.INTEL_PAGES, D.PAYLOADS):
        rows = derived(spark, str(tmp_path), text)
        per_task = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        assert sum(per_task) == 400 and max(per_task) <= 50


def test_orders_of_one_file_are_dealt_before_they_become_links(spark, tmp_path):
    orders = [(7, 1), (3, 1), (3, 1), (5, 2), (None, 2), (9, None), (4, 0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(3).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(2).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    site = _site(spark, str(tmp_path))
    # Each page's orders meet by the narrow key, not in the one task that reads the file.
    assert "RepartitionByExpression [o_custkey" in plan_of(site)

    def url(n):
        return f"https://h{n % 2}.example.com/{'p' if n % 10 else 'private'}/{n}"

    want = {}
    for order, customer in sorted(o for o in orders if None not in o):
        links = want.setdefault(f"https://h{customer % 2}.example.com/p/{customer}", [])
        target = url((order * 7 + customer) % 4)
        if target not in links:
            links.append(target)
    got = {r.url: [u for u in r.links if u is not None] for r in site.collect() if r.url is not None}
    assert got == want
