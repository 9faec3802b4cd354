"""File rules as column expressions: content typing, safe names, mirror paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webquarry.fixed_values import BINARY_CATEGORIES, CONTENT_TYPE_EXTENSIONS, SPACE_CLASS, SPACES
from webquarry.functions.expr import let
from webquarry.functions.urls import extension, hostname, pathname, search


def extension_of_content_type(content_type: Column) -> Column:
    """Extension for a Content-Type header, '' when unknown."""
    table = F.create_map(*[F.lit(x) for pair in CONTENT_TYPE_EXTENSIONS.items() for x in pair])
    base = F.lower(F.btrim(F.substring_index(content_type, ";", 1), F.lit(SPACES)))
    return F.coalesce(F.try_element_at(table, base), F.lit(""))


def sniff_type(content: Column) -> Column:
    """Type of a payload from its first bytes, '' when unknown or under 4 bytes."""
    head = F.struct(
        F.hex(F.substring(content, 1, 12)).alias("magic"),
        F.ltrim(
            F.lower(F.decode(F.substring(content, 1, 256), "ISO-8859-1")), F.lit(SPACES)
        ).alias("text"),
    )

    def typed(h: Column) -> Column:
        def magic(*prefixes: str) -> Column:
            return h["magic"].rlike(r"\A(?:" + "|".join(prefixes) + ")")

        def text(*prefixes: str) -> Column:
            return h["text"].rlike(r"\A(?:" + "|".join(prefixes) + ")")

        return (
            F.when(magic("89504E47"), "png")
            .when(magic("FFD8FF"), "jpg")
            .when(magic("474946"), "gif")
            .when(magic("52494646.{8}57454250"), "webp")
            .when(magic("424D"), "bmp")
            .when(magic("00000100"), "ico")
            .when(magic("25504446"), "pdf")
            .when(magic("504B0[357]"), "zip")
            .when(magic("1F8B"), "gzip")
            .when(magic(".{8}66747970.{8}"), "mp4")
            .when(text("<svg") | (text(r"<\?xml") & h["text"].contains("<svg")), "svg")
            .when(text(r"<\?xml"), "xml")
            .when(text("<!doctype html", "<html", "<head", "<body"), "html")
            .otherwise("")
        )

    return F.when(F.octet_length(content) >= 4, let(head, typed)).otherwise("")


def is_html_as_file(category: Column, sniffed: Column, content_type: Column) -> Column:
    """An HTML page served where a binary file was expected; SVG is fine."""
    ctype = F.coalesce(content_type, F.lit(""))
    html = (sniffed == "html") | ctype.rlike("(?i)text/html")
    svg = (sniffed == "svg") | ctype.rlike("(?i)image/svg")
    return category.isin(*BINARY_CATEGORIES) & html & ~svg


def fnv1a_hex(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, as 8 hex digits."""
    units = F.flatten(
        F.transform(
            F.transform(F.split(text, ""), lambda c: F.ascii(c)),
            lambda p: F.when(
                p > 0xFFFF,
                F.array(
                    F.lit(0xD800) + F.shiftright(p - 0x10000, 10),
                    F.lit(0xDC00) + (p - 0x10000).bitwiseAND(F.lit(0x3FF)),
                ),
            ).otherwise(F.array(p)),
        )
    )
    hashed = F.aggregate(
        F.when(text == "", F.array().cast("array<int>")).otherwise(units),
        F.lit(0x811C9DC5).cast("bigint"),
        lambda h, u: (h.bitwiseXOR(u.cast("bigint")) * F.lit(0x01000193).cast("bigint")).bitwiseAND(
            F.lit(0xFFFFFFFF).cast("bigint")
        ),
    )
    return F.lpad(F.lower(F.hex(hashed)), 8, "0")


MAX_NAME = 180


def safe_name(text: Column, fallback: str) -> Column:
    """A file name without unsafe characters.

    File systems limit the length of a name; a longer one is cut and ends in the
    hash of all of it, so two names stay two.
    """
    cleaned = F.regexp_replace(text, r'[\\/:*?"<>|]+', "_")
    cleaned = F.regexp_replace(cleaned, f"[{SPACE_CLASS}]+", "_")
    cleaned = F.regexp_replace(cleaned, "_+", "_")
    cleaned = F.regexp_replace(cleaned, r"\A[._]+|[._]+\z", "")
    return let(
        cleaned,
        lambda c: F.when(c == "", F.lit(fallback))
        .when(F.length(c) > MAX_NAME, F.concat(F.substring(c, 1, MAX_NAME - 9), F.lit("~"), fnv1a_hex(c)))
        .otherwise(c),
    )


def percent_decode(path: Column) -> Column:
    """Decoded path, null when an escape is malformed or not UTF-8."""
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(~path.rlike("%(?![0-9A-Fa-f]{2})"), let(
        decoded,
        lambda d: F.when(
            ~d.contains("�") | path.rlike("(?i)�|%EF%BF%BD"), d
        ),
    ))


def mirror_path(url: Column, index_name: Column | str = "index.html") -> Column:
    """Relative path that mirrors a canonical URL; ``misc/<hash>.bin`` when undecodable."""
    index = F.lit(index_name) if isinstance(index_name, str) else index_name

    def place(path: Column) -> Column:
        full = F.when(path.endswith("/") | (path == ""), F.concat(path, index)).otherwise(path)
        names = F.transform(
            F.filter(F.split(full, "/"), lambda s: s != ""), lambda s: safe_name(s, "seg")
        )

        def assemble(n: Column) -> Column:
            last = F.coalesce(F.get(n, F.size(n) - 1), index)
            tag = F.concat(F.lit("__"), fnv1a_hex(search(url)))
            named = F.when(search(url) == "", last).otherwise(
                let(
                    F.regexp_extract(last, r"(?s)\A.+(\.[^.]*)\z", 1),
                    lambda dot: F.concat(
                        F.substr(last, F.lit(1), F.length(last) - F.length(dot)), tag, dot
                    ),
                )
            )
            folders = F.slice(n, 1, F.greatest(F.size(n) - 1, F.lit(0)))
            return F.array_join(
                F.concat(F.array(safe_name(hostname(url), "host")), folders, F.array(named)), "/"
            )

        return let(names, assemble)

    return F.coalesce(
        let(percent_decode(pathname(url)), lambda p: F.when(p.isNotNull(), place(p))),
        F.concat(F.lit("misc/"), fnv1a_hex(url), F.lit(".bin")),
    )


def real_extension(sniffed: Column) -> Column:
    """The sniffed type where it names a file type, else null."""
    return F.when(~sniffed.isin("", "html", "xml"), sniffed)


def with_missing_extension(path: Column, sniffed: Column, content_type: Column, url: Column) -> Column:
    """Append an extension to a path that has none: sniffed, then header, then URL."""
    found = F.coalesce(
        real_extension(sniffed),
        F.nullif(extension_of_content_type(content_type), F.lit("")),
        F.nullif(extension(url), F.lit("")),
    )
    bare = ~path.rlike(r"[^/]\.[^./]*/*\z")
    return F.when(bare & found.isNotNull(), F.concat(path, F.lit("."), found)).otherwise(path)


def type_folder(url: Column, content_type: Column, sniffed: Column) -> Column:
    """Folder of the by-type layout: sniffed, then URL, then header, else 'other'."""
    return F.lower(
        F.coalesce(
            real_extension(sniffed),
            F.nullif(extension(url), F.lit("")),
            F.nullif(extension_of_content_type(content_type), F.lit("")),
            F.lit("other"),
        )
    )


def file_name(url: Column, folder: Column) -> Column:
    """Readable file name of the by-type layout."""
    last = let(
        F.filter(F.split(pathname(url), "/"), lambda s: s != ""),
        lambda s: F.coalesce(F.get(s, F.size(s) - 1), F.lit("")),
    )
    readable = F.nullif(safe_name(F.coalesce(percent_decode(last), F.lit("")), ""), F.lit(""))
    base = F.coalesce(readable, F.concat(F.lit("file_"), fnv1a_hex(url)))
    return let(
        base,
        lambda b: F.when(
            b.rlike(r"[^/]\.[^./]*\z"), b
        ).otherwise(F.concat(b, F.lit("."), folder)),
    )


def disambiguated_name(name: Column, url: Column) -> Column:
    """Name with the URL's hash before its extension, for a path already taken."""
    dot = F.regexp_extract(name, r"[^/](\.[^./]*)\z", 1)
    return let(
        dot,
        lambda d: F.concat(
            F.substr(name, F.lit(1), F.length(name) - F.length(d)),
            F.lit("__"), fnv1a_hex(url), d,
        ),
    )
