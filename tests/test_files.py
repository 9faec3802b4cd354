import re

import pytest
from pyspark.sql import functions as F

from webquarry.functions import files as FL
from webquarry.operators import assets as A


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "content,want",
    [
        (bytes([0x89, 0x50, 0x4E, 0x47, 0, 0, 0, 0]), "png"),
        (bytes([0xFF, 0xD8, 0xFF, 0xE0]), "jpg"),
        (b"GIF8", "gif"),
        (b"RIFF1234WEBP", "webp"),
        (b"RIFF1234WAVE", ""),
        (b"BM12", "bmp"),
        (bytes([0, 0, 1, 0]), "ico"),
        (b"%PDF-1.4 ", "pdf"),
        (b"PK\x05\x06", "zip"),
        (b"PK\x04\x06", ""),
        (b"\x1f\x8b\x08\x00", "gzip"),
        (b"\x00\x00\x00\x18ftypmp42", "mp4"),
        (b"\x00\x00\x00\x18ftyp", ""),
        (b"<!DOCTYPE html><html><body>x", "html"),
        (b'<svg xmlns="http://www.w3.org/2000/svg">', "svg"),
        (b' \n<?xml version="1.0"?><SVG/>', "svg"),
        (b'<?xml version="1.0"?><rss/>', "xml"),
        (b"\xef\xbb\xbf<svg>", ""),
        (b"<sv", ""),
        (b"", ""),
    ],
)
def test_sniffing(spark, content, want):
    row = spark.createDataFrame([(bytearray(content),)], "c binary").select(FL.sniff_type(F.col("c")).alias("v"))
    assert row.first()["v"] == want


def test_content_types(spark):
    for header, want in [("image/png; charset=binary", "png"), (" Application/PDF ", "pdf"), ("", ""), (None, "")]:
        assert one(spark, FL.extension_of_content_type(F.lit(header).cast("string"))) == want


def fnv(text):
    h = 0x811C9DC5
    units = text.encode("utf-16-le")
    for lo, hi in zip(units[::2], units[1::2]):
        h = ((h ^ (lo | hi << 8)) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


def test_hash(spark):
    for text in ("", "?page=2", "https://x.com/é", "\U0001f600?"):
        assert one(spark, FL.fnv1a_hex(F.lit(text))) == fnv(text)


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://x.com/a/b/", "x.com/a/b/index.html"),
        ("https://x.com/", "x.com/index.html"),
        ("https://x.com/a/b.c.html?page=2", f"x.com/a/b.c__{fnv('?page=2')}.html"),
        ("https://x.com/a?x", f"x.com/a__{fnv('?x')}"),
        ("https://x.com/a?", "x.com/a"),
        ("https://x.com/a%zz", f"misc/{fnv('https://x.com/a%zz')}.bin"),
        ("https://x.com/%E9", f"misc/{fnv('https://x.com/%E9')}.bin"),
        ("https://x.com/%C3%A9/a%20b+c", "x.com/é/a_b+c"),
        ("https://x.com/.../a%3Ab", "x.com/seg/a_b"),
    ],
)
def test_mirror_paths(spark, url, want):
    assert one(spark, FL.mirror_path(F.lit(url))) == want


def test_names_are_cut(spark):
    long = one(spark, FL.safe_name(F.lit("a" * 300), "x"))
    assert long == "a" * 171 + "~" + fnv("a" * 300)
    assert long != one(spark, FL.safe_name(F.lit("a" * 299 + "b"), "x"))
    assert one(spark, FL.safe_name(F.lit("a" * 180), "x")) == "a" * 180
    assert one(spark, FL.safe_name(F.lit("._."), "x")) == "x"


def ext_paths(spark, urls):
    rows = spark.createDataFrame([(i, *u) for i, u in enumerate(urls)], "id int, url string, content_type string, sniffed string")
    return [r.path for r in A.extension_paths(rows, "id").orderBy("id").collect()]


def test_paths_by_extension(spark):
    got = ext_paths(
        spark,
        [("https://x.com/a/b/Photo.PNG", "image/png", ""), ("https://x.com/c/Photo.PNG", "image/png", ""),
         ("https://x.com/icon", "image/svg+xml", ""), ("https://x.com/d/photo.png", "", "jpg"),
         ("https://x.com/e/PHOTO.png", "", ""), ("https://x.com/", "", "html"), ("https://x.com/x", "", "")],
    )
    assert got[0] == "assets/png/Photo.PNG" and got[2] == "assets/svg/icon.svg"
    assert re.fullmatch(r"assets/png/Photo__[0-9a-f]{8}\.PNG", got[1])
    assert got[3] == "assets/jpg/photo.png"
    assert re.fullmatch(r"assets/png/PHOTO__[0-9a-f]{8}\.png", got[4])
    assert re.fullmatch(r"assets/other/file_[0-9a-f]{8}\.other", got[5])
    assert got[6] == "assets/other/x.other"


def test_a_plain_name_never_looks_hashed(spark):
    clash = "https://x.com/c/p.png"
    got = ext_paths(spark, [("https://x.com/a/p.png", "", ""), (clash, "", ""), (f"https://x.com/d/p__{fnv(clash)}.png", "", "")])
    assert got[1:] == [f"assets/png/p__{fnv(clash)}.png", f"assets/png/p_{fnv(clash)}.png"]


def test_outcomes(spark):
    plan = spark.createDataFrame([(u, t) for u, t in [
        ("html", "images"), ("svg", "images"), ("page", "scripts"), ("big", "media"), ("grown", "media"), ("gone", "media"),
        ("never", "media"), ("fine", "documents")]], "url string, type string")
    page = bytearray(b"<!DOCTYPE html><html><body>File description page</body></html>")
    payloads = spark.createDataFrame(
        [("html", 200, "text/html; charset=utf-8", None, page), ("svg", 200, "text/html", None, bytearray(b"<svg >")),
         ("page", 200, "text/html", None, page), ("big", 200, "", 1000, bytearray(b"1")), ("grown", 200, "", None, bytearray(101)),
         ("gone", 404, "", 1000, None), ("fine", 200, "", 4, bytearray(b"%PDF"))],
        "url string, http_status int, content_type string, declared_bytes long, content binary",
    )
    named = payloads.withColumn("error", F.when(F.col("url") == "gone", "ETIMEDOUT").otherwise(""))
    assert {r.url: r.reason for r in A.asset_outcomes(plan, named, 100).collect()}["gone"] == "ETIMEDOUT"
    assert A.asset_outcomes(plan, A.measured(payloads), 100).exceptAll(A.asset_outcomes(plan, payloads, 100)).count() == 0
    got = {r.url: (r.status, r.reason, r.bytes) for r in A.asset_outcomes(plan, payloads, 100).collect()}
    assert got == {
        "html": ("skipped", "not-a-file (server returned HTML)", None), "svg": ("ok", None, 6), "page": ("ok", None, len(page)),
        "big": ("skipped", "too-large", 1000), "grown": ("skipped", "too-large", 101), "gone": ("error", "http-404", None),
        "never": ("error", "http-0", None), "fine": ("ok", None, 4),
    }


def test_plan_keeps_the_first_wanted_mention(spark):
    rows = spark.createDataFrame(
        [(2, "p2", 0, "u", "images"), (1, "p1", 5, "u", "media"), (1, "p1", 0, "u", "styles"),
         (1, "p1", 1, "https://ads.doubleclick.net/x.png", "images")],
        "page_id long, page_url string, ord int, url string, type string",
    )
    assert [(r.url, r.type, r.page_url) for r in A.asset_plan(rows, ("images", "media")).collect()] == [("u", "media", "p1")]
