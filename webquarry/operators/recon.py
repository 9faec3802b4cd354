"""Passive recon over page text: contacts, secrets, endpoints, comments, headers.

Per-page findings are arrays built inside the page's row, whole and without
caps; only run-wide distinct values shuffle, and those pre-aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.fixed_values import (
    COMMENT_KEYWORDS,
    EMAIL_HOST,
    EMAIL_LOCAL,
    EMAIL_REJECTED_ENDINGS,
    ENDPOINT_PATTERN,
    SECRET_PATTERNS,
    SECURITY_HEADERS,
    SOCIAL_HOSTS,
    SPACE_CLASS,
    TECH_SIGNATURES,
    WORD_EDGE,
    WORD_OPEN,
)
from webquarry.functions.expr import explode_items, let, squeeze_spaces, trim_wide
from webquarry.functions.urls import hostname

# A run of local characters is read once, from its first word character: it starts
# after another character or where the last match ended, and gives nothing back.
_EMAIL = (
    rf"(?:\G|(?<![{EMAIL_LOCAL}]))[.%+-]*+([0-9A-Za-z_][{EMAIL_LOCAL}]*+@{EMAIL_HOST}{WORD_EDGE})"
)
_PHONE = rf"(?:tel:)?\+[0-9][0-9{SPACE_CLASS}().-]{{6,16}}[0-9]"
_COMMENT = r"(?s)<!--(.*?)-->"
_ENDPOINT = "(?i)" + ENDPOINT_PATTERN.format(s=SPACE_CLASS)
_NONE = "array<string>"
_SECRETS = "array<struct<type:string,value:string>>"


def _mentions(text: Column, literals: tuple[str, ...]) -> Column:
    found = text.contains(literals[0])
    for literal in literals[1:]:
        found = found | text.contains(literal)
    return found


def _all_matches(
    text: Column, pattern: str, group: int = 0, needs: tuple[str, ...] = (), lowered: Column | None = None
) -> Column:
    """Matches of a pattern; every match contains one of the literals ``needs``.

    Looking for the literals first is a byte search and skips the pattern on the
    pages that cannot match, which is nearly all of them for most patterns.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if not needs:
        return found
    searched = text if lowered is None else lowered
    return F.when(_mentions(searched, needs), found).otherwise(F.array().cast(_NONE))


def emails_column(text: Column) -> Column:
    lowered = F.transform(_all_matches(text, _EMAIL, 1, needs=("@",)), F.lower)
    return F.array_distinct(
        F.filter(
            lowered,
            lambda e: ~e.rlike(rf"(?:{EMAIL_REJECTED_ENDINGS})\z") & ~e.rlike("@[0-9]"),
        )
    )


def phones_column(text: Column) -> Column:
    return F.array_distinct(
        F.transform(
            _all_matches(text, _PHONE, needs=("+",)),
            lambda m: trim_wide(F.regexp_replace(m, r"\Atel:", "")),
        )
    )


def secrets_column(text: Column, extra: tuple[tuple[str, str], ...] = ()) -> Column:
    """Secrets of a page, ``array<struct<type,value>>``, patterns in order."""
    patterns = [
        (
            label,
            ("(?i)" if flags else "") + pattern.format(b=WORD_OPEN, e=WORD_EDGE, s=SPACE_CLASS),
            1 if "([" in pattern else 0,
            needs,
            bool(flags),
        )
        for label, flags, pattern, needs in SECRET_PATTERNS
    ] + [(label, pattern, 0, (), False) for label, pattern in extra]

    def labelled(label: str):
        return lambda v: F.struct(F.lit(label).alias("type"), v.alias("value"))

    def per_pattern(lowered: Column) -> Column:
        return F.array(
            *[
                F.transform(
                    _all_matches(text, pattern, group, needs, lowered if any_case else None),
                    labelled(label),
                )
                for label, pattern, group, needs, any_case in patterns
            ]
        ).cast(f"array<{_SECRETS}>")

    return let(F.lower(text), lambda lowered: F.flatten(per_pattern(lowered)))


def endpoints_column(text: Column) -> Column:
    return F.array_distinct(_all_matches(text, _ENDPOINT, 1))


def comments_column(text: Column) -> Column:
    tidy = F.transform(
        _all_matches(text, _COMMENT, 1, needs=("<!--",)), lambda c: squeeze_spaces(trim_wide(c))
    )
    return F.filter(tidy, lambda c: (c != "") & c.rlike(f"(?i)(?:{COMMENT_KEYWORDS})"))


def socials_column(links: Column) -> Column:
    return F.array_distinct(
        F.filter(
            links,
            lambda u: F.regexp_replace(hostname(u), r"\Awww\.", "").isin(*SOCIAL_HOSTS),
        )
    )


def mask_secret(value: Column) -> Column:
    """First four and last three characters of a long value, else only stars."""
    return F.when(
        F.length(value) > 10,
        F.concat(F.substring(value, 1, 4), F.lit("…"), F.substr(value, F.length(value) - 2)),
    ).otherwise("***")


def _kind(values: Column, kind: str) -> Column:
    return F.transform(
        values,
        lambda v: F.struct(
            F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("subtype"), v.alias("value")
        ),
    )


def findings_column(
    text: Column, links: Column | None = None, extra: tuple[tuple[str, str], ...] = ()
) -> Column:
    """All findings of a page in reporting order, ``array<struct<kind,subtype,value>>``."""
    groups = [_kind(emails_column(text), "email"), _kind(phones_column(text), "phone")]
    if links is not None:
        groups.append(_kind(socials_column(links), "social"))
    groups.append(_kind(endpoints_column(text), "endpoint"))
    groups.append(
        F.transform(
            secrets_column(text, extra),
            lambda s: F.struct(
                F.lit("secret").alias("kind"), s["type"].alias("subtype"), s["value"].alias("value")
            ),
        )
    )
    groups.append(_kind(comments_column(text), "comment"))
    found = F.concat(*groups)
    return F.when(text.isNotNull(), found).otherwise(
        F.array().cast("array<struct<kind:string,subtype:string,value:string>>")
    )


def findings(
    pages: DataFrame,
    links: str | None = None,
    extra_secrets: tuple[tuple[str, str], ...] = (),
    masked: bool = True,
) -> DataFrame:
    """Findings table ``page_id, page_url, ord, kind, subtype, value``.

    ``pages`` has ``page_id, page_url, html`` in crawl order of ``page_id`` and,
    for social links, an array column named by ``links``.  Secret values are
    masked unless raw ones are asked for.
    """
    found = pages.withColumn(
        "findings", findings_column(F.col("html"), F.col(links) if links else None, extra_secrets)
    )
    rows = explode_items(found, ["page_id", "page_url"], "findings").select(
        "page_id", "page_url", "ord", "item.*"
    )
    if masked:
        rows = rows.withColumn(
            "value", F.when(F.col("kind") == "secret", mask_secret(F.col("value"))).otherwise(F.col("value"))
        )
    return rows


def list_findings(pages: DataFrame, build, item: str) -> DataFrame:
    """One kind of finding: ``page_id, ord, <item>``."""
    found = pages.withColumn("items", build(F.col("html")))
    return explode_items(found, ["page_id"], "items", item=item)


def social_links(pages: DataFrame) -> DataFrame:
    """Social-network links per page; ``pages`` carries ``links`` arrays."""
    found = pages.withColumn("items", socials_column(F.col("links")))
    return explode_items(found, ["page_id"], "items", item="url")


def distinct_findings(rows: DataFrame, order: tuple[str, ...] = ("page_id", "ord")) -> DataFrame:
    """Emails, phones, socials and endpoints once per run, with the first page.

    ``order`` names the columns that give the crawl order.  Partial aggregation
    keeps a value found on every page from piling up in one task.
    """
    return (
        rows.where(F.col("kind").isin("email", "phone", "social", "endpoint"))
        .groupBy("kind", "value")
        .agg(
            F.min_by("page_url", F.struct(*order)).alias("page_url"),
            F.min(F.struct(*order)).alias("first_seen"),
        )
    )


def run_findings(rows: DataFrame, order: tuple[str, ...] = ("page_id", "ord")) -> DataFrame:
    """All findings of a run: emails, phones, socials and endpoints once, the others each time.

    One partial aggregation does both: a finding that counts every time is grouped
    with its own place in the crawl order.
    """
    place = F.struct(*order)
    own = F.when(F.col("kind").isin("secret", "comment"), place)
    return (
        rows.groupBy("kind", "subtype", "value", own.alias("own"))
        .agg(F.min_by("page_url", place).alias("page_url"), F.min(place).alias("first_seen"))
        .drop("own")
    )


def live_rows(kept: DataFrame) -> DataFrame:
    """Rows of :func:`run_findings` shown live: everything but comments."""
    return kept.where(F.col("kind") != "comment")


def intel_counts(rows: DataFrame) -> DataFrame:
    """Findings per kind; secrets and comments are not deduplicated.

    Distinct values are counted after a two-step aggregation on (kind, value).
    """
    distinct_kinds = ("email", "phone", "social", "endpoint")
    per_value = (
        rows.groupBy("kind", "value").agg(F.count("*").alias("n"))
    )
    return per_value.groupBy("kind").agg(
        F.sum(F.when(F.col("kind").isin(*distinct_kinds), F.lit(1)).otherwise(F.col("n"))).alias("n")
    )


def page_intel_counts(pages: DataFrame) -> DataFrame:
    """Emails, secrets and endpoints per page, counted inside the row."""
    t = F.col("html")

    def count(items: Column) -> Column:
        return F.when(items.isNotNull(), F.size(items)).otherwise(0)

    return pages.select(
        "page_id",
        count(emails_column(t)).alias("emails"),
        count(secrets_column(t)).alias("secrets"),
        count(endpoints_column(t)).alias("endpoints"),
    )


# --- headers ------------------------------------------------------------------------


def header(headers: Column, name: str) -> Column:
    """A header's value, null when missing or empty."""
    return F.nullif(F.try_element_at(headers, F.lit(name)), F.lit(""))


def missing_headers_column(headers: Column) -> Column:
    return F.filter(
        F.array(*[F.lit(h) for h in SECURITY_HEADERS]),
        lambda h: F.coalesce(F.try_element_at(headers, h), F.lit("")) == "",
    )


def present_headers_column(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: k.isin(*SECURITY_HEADERS) & (v != ""))


def cookie_issues_column(headers: Column) -> Column:
    def check(cookie: Column) -> Column:
        rules = (
            ("HttpOnly", "(?i)httponly"),
            ("Secure", f"(?i);[{SPACE_CLASS}]*secure"),
            ("SameSite", "(?i)samesite"),
        )
        return F.array_compact(
            F.array(
                *[
                    F.when(~cookie.rlike(pattern), F.lit(f"Set-Cookie missing {flag}"))
                    for flag, pattern in rules
                ]
            )
        )

    return F.when(
        header(headers, "set-cookie").isNotNull(), let(header(headers, "set-cookie"), check)
    ).otherwise(F.array().cast(_NONE))


def tech_column(
    headers: Column, generator: Column, html: Column, extra: tuple[tuple[str, str], ...] = ()
) -> Column:
    """Technologies named by headers, the generator tag and page signatures."""
    named = [
        F.concat(F.lit("Server: "), header(headers, "server")),
        F.concat(F.lit("X-Powered-By: "), header(headers, "x-powered-by")),
        F.concat(F.lit("ASP.NET "), header(headers, "x-aspnet-version")),
        header(headers, "x-generator"),
        F.when(header(headers, "cf-ray").isNotNull(), "Cloudflare"),
        F.nullif(generator, F.lit("")),
    ]

    def signed(lowered: Column) -> Column:
        known = [
            F.when(_mentions(lowered, needs) & html.rlike(f"(?i){pattern}"), F.lit(name))
            for pattern, name, needs in TECH_SIGNATURES
        ]
        own = [F.when(html.rlike(f"(?i){pattern}"), F.lit(name)) for pattern, name in extra]
        return F.array(*named, *known, *own)

    return F.array_distinct(F.array_compact(let(F.lower(html), signed)))


def security_audit(pages: DataFrame, extra: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Audit record per page from ``page_id, page_url, headers, generator, html``."""
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    return pages.select(
        "page_id",
        F.col("page_url").alias("url"),
        F.col("page_url").rlike("(?i)^https:").alias("https"),
        missing_headers_column(headers).alias("missing"),
        present_headers_column(headers).alias("present"),
        cookie_issues_column(headers).alias("cookie_issues"),
        tech_column(
            headers, F.col("generator"), F.coalesce(F.col("html"), F.lit("")), extra
        ).alias("tech"),
    )


def missing_header_counts(audits: DataFrame) -> DataFrame:
    """How many pages lack each header."""
    return (
        audits.select(F.explode_outer("missing").alias("header"))
        .where(F.col("header").isNotNull())
        .groupBy("header")
        .agg(F.count("*").alias("pages"))
    )


