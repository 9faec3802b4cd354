"""Page parsing: metadata, links, assets and forms of HTML snapshots.

Every job here is narrow.  A page's tags, links and assets live in arrays inside
the page's own row, and first-writer-wins rules are applied there, so reading
100 TB of HTML shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.fixed_values import CSS_URL, SPACE_CLASS
from webquarry.functions import markup as M
from webquarry.functions.expr import distinct_by_first, explode_items, let, one_of, trim_wide
from webquarry.functions.urls import base_parts, canonical_against, canonical_url, category

_CONTROL = r"(?is)<(?:input|select|textarea|button)(?=[\s/>])" + M._ATTRS + ">"
_FORM_TAG = r"(?is)\A<form(?=[\s/>])" + M._ATTRS + ">"
_FORM = (
    r"(?is)<form(?=[\s/>])" + M._ATTRS + r">.*?(?:</form(?=[\s/>])[^>]*+>|\z)"
)


def _named(tags: Column, *names: str) -> Column:
    return F.filter(tags, lambda t: one_of(t["name"], *names))


# Start tags whose attributes each part of a page looks up; forms read theirs from the cut-out text.
_READ = {
    "links": ("a", "iframe", "frame"),
    "assets": ("a", "img", "source", "video", "audio", "link", "script"),
    "meta": ("meta", "link", "html"),
    "robots": ("meta",),
    "forms": (),
}
# Start tags each part of a page needs; an asset can sit in any tag's style attribute.
_NEEDED = {
    "links": ("a", "frame"),
    "meta": ("meta", "link", "html"),
    "robots": ("meta",),
    "forms": ("form", "input", "select", "button"),
}


def page_tags(
    pages: DataFrame, names: tuple[str, ...] = (), decoded: tuple[str, ...] = (), styled: bool = False
) -> DataFrame:
    """Add ``page_url, tokens, named, tags, base`` to snapshots with ``url, html``.

    ``tokens`` is the page's one pass over its HTML, shared by whatever needs it; ``named`` has the tags without
    attributes, so what reads names and texts alone, and ``base``, leave those of ``tags`` uncut;
    ``names`` limits the start tags, ``decoded`` and ``styled`` say whose looked-up attributes are.
    ``base`` is the first ``base[href]`` resolved against the page, else the page.
    """
    page_url = canonical_url(F.col("url"))
    if "final_url" in pages.columns:
        page_url = F.coalesce(canonical_url(F.col("final_url")), page_url)
    if names:
        names = (*names, "base")
    read = pages.withColumns({"page_url": page_url, "tokens": M.tokens(F.col("html"), names)})
    read = read.withColumn("named", M.names_of(F.col("tokens")))
    of_base = F.filter(F.col("named"), lambda t: t["name"] == "base")
    bases = F.col("bases")
    first_base = F.get(F.filter(bases, lambda t: M.has_attribute(t, "href")), F.lit(0))
    return (
        read.withColumns(
            {
                "tags": M.read_attributes(F.col("named"), ("base", *decoded), styled),
                "bases": M.read_attributes(of_base, ("base",), False),
            }
        )
        .withColumn(
            "base",
            F.coalesce(
                F.when(F.size(bases) > 0, canonical_url(M.value_of(first_base, "href", "base"), F.col("page_url"))),
                F.col("page_url"),
            ),
        )
        .drop("bases")
    )


def _canonical_all(values: Column, base: Column) -> Column:
    """Canonical forms of an array of raw references, unresolvable ones dropped."""
    return let(
        base_parts(base),
        lambda b: F.filter(
            F.transform(values, lambda v: canonical_against(v, b)), lambda u: u.isNotNull()
        ),
    )


def targets_column(tags: Column, base: Column, frames: bool = True) -> Column:
    """Canonical targets of a page's anchors, then of its frames, in document order; null where there is none."""
    raws = F.transform(_named(tags, "a"), lambda t: M.value_of(t, "href", "a"))
    if frames:
        raws = F.concat(raws, F.transform(_named(tags, "iframe", "frame"), lambda t: M.value_of(t, "src", "frame")))
    return let(base_parts(base), lambda b: F.transform(raws, lambda v: canonical_against(v, b)))


def links_column(targets: Column) -> Column:
    """Distinct link targets: anchors first, then frames, each in document order."""
    return F.array_distinct(F.filter(targets, lambda u: u.isNotNull()))


def srcset_candidates(value: Column) -> Column:
    """First token of every comma-separated part."""
    return F.filter(
        F.transform(
            F.split(value, ","),
            lambda part: F.regexp_extract(trim_wide(part), rf"\A([^{SPACE_CLASS}]+)", 1),
        ),
        lambda c: c != "",
    )


def css_urls_column(css: Column) -> Column:
    return F.regexp_extract_all(css, F.lit(CSS_URL), F.lit(1))


def _candidate(raw: Column, via: str, fixed: str | None, fallback: str | None) -> Column:
    """A raw asset reference: ``fixed`` type, else by extension, else ``fallback``."""
    return F.struct(
        raw.alias("raw"),
        F.lit(via).alias("via"),
        F.lit(fixed).cast("string").alias("fixed"),
        F.lit(fallback).cast("string").alias("fallback"),
    )


def _candidates(raws: Column, via: str, fixed: str | None, fallback: str | None) -> Column:
    return F.transform(raws, lambda r: _candidate(r, via, fixed, fallback))


def asset_candidates(tags: Column, tokens: Column) -> Column:
    """Raw asset references of a page, without those of its anchors, in rule order, then document order."""

    def image(t: Column) -> Column:
        single = [
            _candidate(M.value_of(t, a, "img"), a, "images", None)
            for a in ("src", "data-src", "data-original", "data-lazy-src")
        ]
        sets = [
            _candidates(srcset_candidates(M.value_of(t, a, "img")), "srcset", "images", None)
            for a in ("srcset", "data-srcset")
        ]
        return F.concat(F.array(*single), *sets)

    def source(t: Column) -> Column:
        return F.concat(
            _candidates(srcset_candidates(M.value_of(t, "srcset", "source")), "srcset", "images", None),
            F.array(_candidate(M.value_of(t, "src", "source"), "source", None, "media")),
        )

    def player(t: Column) -> Column:
        return F.array(
            _candidate(M.value_of(t, "src", "video"), "src", "media", None),
            _candidate(M.value_of(t, "poster", "video"), "poster", "images", None),
        )

    def linked(t: Column) -> Column:
        def typed(rel: Column) -> Column:
            early = rel.contains("preload") | rel.contains("prefetch")
            return F.struct(
                M.value_of(t, "href", "link").alias("raw"),
                F.lit("link").alias("via"),
                F.when(rel.contains("stylesheet"), "styles")
                .when(rel.contains("icon"), "images")
                .alias("fixed"),
                F.when(early, "other").alias("fallback"),
            )

        return let(F.lower(M.value_of(t, "rel", "link")), typed)

    scripts = F.transform(
        _named(tags, "script"),
        lambda t: _candidate(M.value_of(t, "src", "script"), "script", "scripts", None),
    )
    sheets = F.flatten(F.transform(M.texts_of(tokens, tags, "style"), css_urls_column))
    inline = F.flatten(F.transform(_styled(tags), lambda t: css_urls_column(M.value_of(t, "style"))))
    return F.concat(
        F.flatten(F.transform(_named(tags, "img"), image)),
        F.flatten(F.transform(_named(tags, "source"), source)),
        F.flatten(F.transform(_named(tags, "video", "audio"), player)),
        F.transform(_named(tags, "link"), linked),
        scripts,
        _candidates(sheets, "css", None, "images"),
        _candidates(inline, "css", None, "images"),
    )


def _styled(tags: Column) -> Column:
    return F.filter(tags, lambda t: M.value_of(t, "style") != "")


def assets_column(tags: Column, tokens: Column, base: Column, targets: Column) -> Column:
    """Assets of a page, ``array<struct<url,type,via>>``, first writer of a URL wins.

    ``targets`` begins with those of the anchors, which come before all other candidates.
    """

    def resolved(url: Column, via: Column, fixed: Column, fallback: Column) -> Column:
        return F.struct(url.alias("url"), via.alias("via"), fixed.alias("fixed"), fallback.alias("fallback"))

    none = F.lit(None).cast("string")
    anchors = F.transform(
        F.slice(targets, F.lit(1), F.size(_named(tags, "a"))), lambda u: resolved(u, F.lit("a"), none, none)
    )
    others = let(
        base_parts(base),
        lambda parts: F.transform(
            F.filter(asset_candidates(tags, tokens), lambda c: c["raw"] != ""),
            lambda c: resolved(canonical_against(c["raw"], parts), c["via"], c["fixed"], c["fallback"]),
        ),
    )
    typed = F.transform(
        F.filter(F.concat(anchors, others), lambda a: a["url"].isNotNull()),
        lambda a: F.struct(
            a["url"].alias("url"), F.coalesce(a["fixed"], category(a["url"]), a["fallback"]).alias("type"), a["via"].alias("via")
        ),
    )
    return distinct_by_first(
        F.filter(typed, lambda a: a["type"].isNotNull()), "url", ["url", "type", "via"]
    )


def metas_column(tags: Column) -> Column:
    """What the meta tags of a page say, in document order."""
    return F.transform(
        _named(tags, "meta"),
        lambda t: F.struct(
            M.value_of(t, "name", "meta").alias("name"),
            M.value_of(t, "property", "meta").alias("property"),
            M.value_of(t, "content", "meta").alias("content"),
            M.value_of(t, "charset", "meta").alias("charset"),
        ),
    )


def _first_text(items: Column, test, field: str) -> Column:
    found = F.get(F.filter(items, test), F.lit(0))[field]
    return trim_wide(F.coalesce(found, F.lit("")))


def named_meta(metas: Column, name: str) -> Column:
    """The content of the first meta tag of that name."""
    return _first_text(metas, lambda x: x["name"] == name, "content")


def meta_column(tags: Column, tokens: Column, base: Column) -> Column:
    """The ten metadata fields; missing text is '', a missing canonical is null."""

    def build(m: Column) -> Column:
        def named(name: str) -> Column:
            return named_meta(m, name)

        def prop(name: str) -> Column:
            return _first_text(m, lambda x: x["property"] == name, "content")

        title = let(
            F.coalesce(F.get(M.texts_of(tokens, tags, "title"), F.lit(0)), F.lit("")),
            lambda text: trim_wide(M.decode_references(text, False)),
        )
        canonical = F.get(
            F.filter(
                tags, lambda t: (t["name"] == "link") & (F.lower(M.value_of(t, "rel", "link")) == "canonical")
            ),
            F.lit(0),
        )
        root = F.get(_named(tags, "html"), F.lit(0))
        return F.struct(
            title.alias("title"),
            F.coalesce(
                F.nullif(named("description"), F.lit("")), prop("og:description")
            ).alias("description"),
            canonical_url(M.value_of(canonical, "href", "link"), base).alias("canonical"),
            trim_wide(M.value_of(root, "lang", "html")).alias("lang"),
            prop("og:title").alias("og_title"),
            prop("og:type").alias("og_type"),
            prop("og:image").alias("og_image"),
            named("robots").alias("robots_meta"),
            named("generator").alias("generator"),
            _first_text(m, lambda x: x["charset"] != "", "charset").alias("charset"),
        )

    return let(metas_column(tags), build)


def forms_column(tags: Column, base: Column) -> Column:
    """Forms with their named controls; of the tags only names and texts are read."""

    def control(tag: Column) -> Column:
        def read(attrs: Column) -> Column:
            kind = F.coalesce(F.nullif(M.listed_value(attrs, "type"), F.lit("")), M.tag_name(tag))
            return F.struct(M.listed_value(attrs, "name").alias("name"), F.lower(kind).alias("type"))

        return let(M.attribute_list(tag), read)

    def form(block: Column, parts: Column) -> Column:
        controls = F.transform(F.regexp_extract_all(block, F.lit(_CONTROL), F.lit(0)), control)

        def read(attrs: Column) -> Column:
            def build(action: Column) -> Column:
                return F.struct(
                    F.when(action == "", base).otherwise(F.coalesce(canonical_against(action, parts), action)).alias("action"),
                    F.lower(F.coalesce(F.nullif(M.listed_value(attrs, "method"), F.lit("")), F.lit("get"))).alias("method"),
                    F.filter(controls, lambda c: c["name"] != "").alias("inputs"),
                )

            return let(M.listed_value(attrs, "action"), build)

        return let(M.attribute_list(F.regexp_extract(block, _FORM_TAG, 0)), read)

    # Form tags and controls alone, in document order, are a small text to cut up.
    related = _named(tags, "form", "/form", "input", "select", "textarea", "button")
    skeleton = F.array_join(F.transform(related, lambda t: t["text"]), "")
    blocks = F.regexp_extract_all(skeleton, F.lit(_FORM), F.lit(0))
    return let(base_parts(base), lambda parts: F.transform(blocks, lambda b: form(b, parts)))


def parse_pages(pages: DataFrame, parts: tuple[str, ...] = ("meta", "links", "assets", "forms")) -> DataFrame:
    """Add ``page_url, base`` and the asked parts of each page as nested columns.

    With the part ``robots`` comes ``robots_meta`` alone, which needs no other field of ``meta``.
    """
    names = () if "assets" in parts else tuple(n for part in parts for n in _NEEDED[part])
    read = tuple(dict.fromkeys(n for part in parts for n in _READ[part]))
    tagged = page_tags(pages, names, read, styled="assets" in parts)
    tags, tokens, base, targets = F.col("tags"), F.col("tokens"), F.col("base"), F.col("targets")
    if "links" in parts or "assets" in parts:
        # Links and assets share the targets of the anchors.
        tagged = tagged.withColumn("targets", targets_column(tags, base, "links" in parts))
    builders = {
        "meta": lambda: meta_column(tags, tokens, base),
        "links": lambda: links_column(targets),
        "assets": lambda: assets_column(tags, tokens, base, targets),
        "forms": lambda: forms_column(F.col("named"), base),
        "robots": lambda: named_meta(metas_column(tags), "robots"),
    }
    return tagged.withColumns({"robots_meta" if part == "robots" else part: builders[part]() for part in parts})


def html_tags(pages: DataFrame) -> DataFrame:
    """One row per start tag: ``page_id, ord, tag, attrs``."""
    tags = F.filter(M.tags_of(M.tokens(F.col("html"))), lambda t: t["name"] != "/form")
    rows = explode_items(pages.select("page_id", tags.alias("tags")), ["page_id"], "tags")
    return rows.select(
        "page_id",
        "ord",
        F.col("item.name").alias("tag"),
        M.attributes(F.col("item.text")).alias("attrs"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edge table ``page_id, src_url, ord, dst_url``."""
    rows = explode_items(
        parse_pages(pages, ("links",)), ["page_id", "page_url"], "links", item="dst_url"
    )
    return rows.withColumnRenamed("page_url", "src_url")


def page_assets(pages: DataFrame) -> DataFrame:
    """Asset table ``page_id, page_url, ord, url, type, via``."""
    rows = explode_items(parse_pages(pages, ("assets",)), ["page_id", "page_url"], "assets")
    return rows.select("page_id", "page_url", "ord", "item.*")


def page_forms(pages: DataFrame) -> DataFrame:
    """Form table ``page_id, page_url, form_no, action, method, inputs``."""
    rows = explode_items(
        parse_pages(pages, ("forms",)), ["page_id", "page_url"], "forms", pos="form_no"
    )
    return rows.select("page_id", "page_url", "form_no", "item.*")


def page_meta(pages: DataFrame) -> DataFrame:
    return parse_pages(pages, ("meta",)).select("page_id", "page_url", "meta.*")


def srcset_urls(pages: DataFrame) -> DataFrame:
    """Resolved srcset candidates: ``page_id, ord, url``."""
    raws = F.flatten(
        F.transform(
            _named(F.col("tags"), "img", "source"),
            lambda t: F.concat(
                srcset_candidates(M.value_of(t, "srcset", "source")),
                srcset_candidates(M.value_of(t, "data-srcset", "source")),
            ),
        )
    )
    found = page_tags(pages, ("img", "source"), ("img", "source")).withColumn(
        "urls", _canonical_all(raws, F.col("base"))
    )
    return explode_items(found, ["page_id"], "urls", item="url")


def css_urls(pages: DataFrame) -> DataFrame:
    """Resolved CSS ``url()`` references: style blocks, then style attributes."""
    tags = F.col("tags")
    blocks = F.flatten(F.transform(M.texts_of(F.col("tokens"), tags, "style"), css_urls_column))
    inline = F.flatten(F.transform(_styled(tags), lambda t: css_urls_column(M.value_of(t, "style"))))
    found = page_tags(pages, styled=True).withColumn(
        "urls", _canonical_all(F.concat(blocks, inline), F.col("base"))
    )
    return explode_items(found, ["page_id"], "urls", item="url")
