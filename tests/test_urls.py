import pytest
from pyspark.sql import functions as F

from webquarry.config import SCOPES, split_list
from webquarry.functions import urls as U

CANONICAL = [
    ("HTTP://Example.com:80/a#frag", None, "http://example.com/a"),
    ("/wiki/X", "https://site.com/a/b", "https://site.com/wiki/X"),
    ("mailto:x@y.com", None, None),
    ("javascript:void(0)", "http://h.com/", None),
    ("../../../x", "https://h.com/a/b/c", "https://h.com/x"),
    ("a/./b/../c/..", "https://h.com/d/e", "https://h.com/d/a/"),
    ("..", "https://h.com/a/b/c", "https://h.com/a/"),
    ("/..", "https://h.com/a", "https://h.com/"),
    ("/a/%2E%2e/b", "https://h.com/", "https://h.com/b"),
    ("/a//b/../c", "http://h.com/", "http://h.com/a//c"),
    ("//cdn.org/x", "http://h.com/", "http://cdn.org/x"),
    ("?q=1", "https://h.com/a/b?z", "https://h.com/a/b?q=1"),
    ("?", "http://h.com/a?b", "http://h.com/a?"),
    ("#top", "https://h.com/", None),
    ("", "https://h.com/", None),
    (None, "https://h.com/", None),
    ("x", None, None),
    ("https://h.com:443", None, "https://h.com/"),
    ("http://h.com:443/", None, "http://h.com:443/"),
    ("http://h.com:0080/", None, "http://h.com/"),
    ("http://h.com:/x", None, "http://h.com/x"),
    ("http://h.com:99999/", None, None),
    ("http://bad host/", None, None),
    ("http://", None, None),
    ("https://u:p@H.com/x", None, "https://u:p@h.com/x"),
    ("https://a_b.com/é x?é='", None, "https://a_b.com/%C3%A9%20x?%C3%A9=%27"),
    ("https://h.com?x", None, "https://h.com/?x"),
    (" \t/t ﻿", "https://h.com/q", "https://h.com/t"),
    ("/a\tb\nc", "https://h.com/", "https://h.com/abc"),
    ("http:foo", "http://h.com/a/b", "http://h.com/a/foo"),
    ("https:foo", "http://h.com/a/b", "https://foo/"),
    ("\\a\\b", "http://h.com/", "http://h.com/a/b"),
    ("http://[::1]:8080/x", None, "http://[::1]:8080/x"),
    ("/the,", "http://h.com/x", "http://h.com/the,"),
]


def test_canonical_urls(spark):
    rows = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(CANONICAL)], "i int, raw string, base string, want string"
    )
    got = rows.withColumn("got", U.canonical_url(F.col("raw"), F.col("base")))
    assert [(r.raw, r.got) for r in got.orderBy("i").collect()] == [(c[0], c[2]) for c in CANONICAL]
    again = got.where("got is not null").select("got", U.canonical_url(F.col("got")).alias("twice"))
    assert again.where("got <> twice").count() == 0


def test_base_free_form_agrees_with_null_base(spark):
    rows = spark.createDataFrame([(c[0],) for c in CANONICAL], "raw string")
    null_base = F.lit(None).cast("string")
    differing = rows.where(
        ~U.canonical_url(F.col("raw")).eqNullSafe(U.canonical_url(F.col("raw"), null_base))
    )
    assert differing.count() == 0


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scopes_match_the_literals(spark):
    lit = F.lit
    seed = lit("https://a.fandom.com/wiki/Home")
    assert one(spark, U.in_scope(lit("https://a.fandom.com/wiki/X"), seed, "domain"))
    assert not one(spark, U.in_scope(lit("https://other.com/x"), seed, "domain"))
    assert one(spark, U.in_scope(lit("https://sub.fandom.com/x"), seed, "subdomain"))
    assert one(spark, U.in_scope(lit("https://a.fandom.com/wiki/a/b"), seed, "path"))
    assert not one(spark, U.in_scope(lit("https://a.fandom.com/x"), seed, "path"))
    assert not one(spark, U.in_scope(lit("https://a.fandom.com/wiki/X"), seed, "page"))


def test_scopes_nest(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(U.canonical_url(F.col("url")).alias("url"))
    seed = F.lit(pages.orderBy("url").first()["url"])
    counts = [pages.where(U.in_scope(F.col("url"), seed, s)).count() for s in SCOPES]
    assert counts == sorted(counts) and counts[0] == 1 and counts[-1] == pages.count()


@pytest.mark.parametrize(
    "host,want",
    [("a.b.co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("x.y.example.com", "example.com"), ("localhost", "localhost")],
)
def test_registrable_domain(spark, host, want):
    assert one(spark, U.registrable_domain(F.lit(host))) == want


@pytest.mark.parametrize(
    "url,ext,category",
    [
        ("https://x.com/pic.PNG", "png", "images"),
        ("https://x.com/a.pdf", "pdf", "documents"),
        ("https://x.com/.hidden", "", None),
        ("https://x.com/a.tar.gz", "gz", "archives"),
        ("https://x.com/a.b/", "b", None),
        ("https://x.com/a.", "", None),
        ("https://x.com/a?x.png", "", None),
        ("https://x.com/..a", "a", None),
    ],
)
def test_extensions(spark, url, ext, category):
    row = spark.range(1).select(U.extension(F.lit(url)).alias("e"), U.category(F.lit(url)).alias("c")).first()
    assert (row.e, row.c) == (ext, category)


def test_trackers_and_patterns(spark):
    for url, want in [
        ("https://www.googletagmanager.com/gtm.js", True),
        ("https://sb.scorecardresearch.com/beacon.js", True),
        ("https://static.wikia.nocookie.net/img/x.png", False),
        ("https://example.com/doubleclick", False),
    ]:
        assert one(spark, U.is_tracker(F.lit(url))) is want
    assert len(split_list("/wiki/\nSpecial:")) == 2
    include = U.compile_patterns("/WIKI/")
    exclude = U.compile_patterns("special:, [broken")
    # Java decides what a pattern is: its own forms count, those of other languages are text.
    assert U.compile_patterns("(?<n>x)[0-9]\n(?P<n>x)\n[[]") == ("(?i)(?<n>x)[0-9]", "(?i)\\(\\?P<n>x\\)", "(?i)\\[\\[\\]")
    for url, want in [("https://h.com/wiki/A", True), ("https://h.com/wiki/Special:B", False),
                      ("https://h.com/x", False), ("https://h.com/wiki/[broken", False)]:
        assert one(spark, U.passes_patterns(F.lit(url), include, exclude)) is want


def test_international_hosts(spark):
    for raw, want in [
        ("stra\u00dfe.de", "xn--strae-oqa.de"),
        ("fa\u00df.de", "xn--fa-hia.de"),
        ("STRA\u00dfE.de", "xn--strae-oqa.de"),
        ("\uff25\uff58\uff41\uff4d\uff50\uff4c\uff45\uff0e\uff43\uff4f\uff4d", "example.com"),
        ("\uff11\uff12\uff17.0.0.1", "127.0.0.1"),
        ("\u65e5\u672c\u8a9e\u3002jp", "xn--wgv71a119e.jp"),
        ("\U0001f600.com", "xn--e28h.com"),
        ("\u03b2\u03cc\u03bb\u03bf\u03c2.com", "xn--nxasmm1c.com"),
        ("\u0dc1\u0dca\u200d\u0dbb\u0dd3.com", "xn--10cl1a0b660p.com"),
        ("\u0646\u0627\u0645\u0647\u200c\u0627\u06cc.com", "xn--mgba3gch31f060k.com"),
        ("ex\u00adample.com", "example.com"),
        ("\ufb01sh.com", "fish.com"),
        ("u\u0308ber.de", "xn--ber-goa.de"),
        ("a\u200db.com", None),
        ("a\u200cb.com", None),
        ("\ue000.com", None),
    ]:
        assert one(spark, U.canonical_url(F.lit(f"http://{raw}/a"))) == (want and f"http://{want}/a"), raw


def test_punycode_against_the_standard_codec(spark):
    import random

    from webquarry.functions.idn import punycode

    rng = random.Random(1)
    signs = "abc-9\u00fc\u00df\u00e9\u00f1\u65e5\u672c\u8a9e\ud55c\uae00\u0414\u0416\U0001f600\U0001f4a9\u0627\u0628\u03c2\U0010fffd\u0080"
    labels = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in labels], "label string").select("label", punycode(F.col("label")).alias("code")).collect()
    assert all(r.code == r.label.encode("punycode").decode() for r in rows)


def test_one_spelling_per_host(spark):
    for raw, want in [
        ("http://M\u00fcnchen.example/a", "http://xn--mnchen-3ya.example/a"),
        ("http://xn--mnchen-3ya.example/a", "http://xn--mnchen-3ya.example/a"),
        ("http://0x7f.1/", "http://127.0.0.1/"),
        ("http://2130706433/x", "http://127.0.0.1/x"),
        ("http://0177.0.0.01/", "http://127.0.0.1/"),
        ("http://10.1.2.3:80/", "http://10.1.2.3/"),
        ("http://1.2.3.256/", None),
        ("http://1.256.3.4/", None),
        ("http://09.1.1.1/", None),
        ("http://4294967296/", None),
        ("http://1.2.3.4.example/", "http://1.2.3.4.example/"),
    ]:
        assert one(spark, U.canonical_url(F.lit(raw))) == want, raw
