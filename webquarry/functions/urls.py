"""URL rules as column expressions: canonical form, parts, scope, category.

Parsing follows the URL Standard for http and https.  Hosts are lower-cased, names
outside ASCII go to punycode, and number forms of IPv4 hosts to four decimals.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from webquarry.config import split_list
from webquarry.fixed_values import (
    CATEGORY_EXTENSIONS,
    TRACKER_TOKENS,
    TWO_LABEL_SUFFIXES,
)
from webquarry.functions.expr import escape_regex, let, one_of, trim_wide
from webquarry.functions.idn import ascii_name

_SEGMENTS = r"(?:/(?:[0-9A-Za-z_~!$&()*+,;=:@-][0-9A-Za-z_.~!$&()*+,;=:@-]*+)?+)"
_QUERY = r"(?:\?[0-9A-Za-z_.~!$&()*+,;=:@%/?-]*+)?+"
# Already canonical: lower-case named host without port, no dot segments, nothing to encode.
_PLAIN_ABSOLUTE = rf"\Ahttps?://[a-z][a-z0-9-]*+(?:\.[a-z][a-z0-9-]*+)++{_SEGMENTS}++{_QUERY}\z"
#: A rooted path, a path below the base's folder without a colon before its first slash, or a query alone.
_FIRST_SEGMENT = r"[0-9A-Za-z_~!$&()*+,;=@-][0-9A-Za-z_.~!$&()*+,;=@-]*+"
_PLAIN_REFERENCE = rf"\A(?:(?!//){_SEGMENTS}++{_QUERY}|{_FIRST_SEGMENT}{_SEGMENTS}*+{_QUERY}|(?=\?){_QUERY})\z"

_PATH_UNSAFE = r"[^\x21\x24-\x3b\x3d\x40-\x5d\x5f\x61-\x7a\x7c\x7e]"
_QUERY_UNSAFE = r"[^\x21\x24-\x26\x28-\x3b\x3d\x3f-\x7e]"
_DOT_SEGMENT = r"(?i)/(?:\.|%2e){1,2}(?:/|\z)"
_HOST_PORT = r"\A(\[[0-9A-Fa-f:.]+\]|[^\x00-\x20#%/:<>?@\[\\\]^|\x7f]+)(?::([0-9]*))?\z"


def _percent_encode(text: Column, unsafe: str) -> Column:
    safe = "[" + unsafe.removeprefix("[^")
    encoded = F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(f"{safe}++|{unsafe}++"), F.lit(0)),
            lambda run: F.when(
                run.rlike(unsafe), F.replace(F.url_encode(run), F.lit("+"), F.lit("%20"))
            ).otherwise(run),
        ),
        "",
    )
    return F.when(text.rlike(unsafe), encoded).otherwise(text)


def _remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` (also written ``%2e``) in an absolute path."""

    def step(kept: Column, seg: Column) -> Column:
        plain = F.replace(F.lower(seg), F.lit("%2e"), F.lit("."))
        return (
            F.when(plain == ".", kept)
            .when(plain == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(seg)))
        )

    def resolve(segments: Column) -> Column:
        # The last segment decides whether the result ends with a slash.
        last = F.replace(F.lower(F.element_at(segments, -1)), F.lit("%2e"), F.lit("."))
        kept = F.aggregate(
            F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"), step
        )
        joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
        return F.when(
            one_of(last, ".", "..") & (joined != "/"), F.concat(joined, F.lit("/"))
        ).otherwise(joined)

    return F.when(path.rlike(_DOT_SEGMENT), let(F.split(path, "/"), resolve)).otherwise(path)


def base_parts(base: Column) -> Column:
    """What resolving needs from a canonical base URL; all null for a null one."""
    path = F.regexp_extract(base, r"\Ahttps?://[^/?#]*([^?#]*)", 1)
    return F.struct(
        F.substring_index(base, ":", 1).alias("scheme"),
        F.regexp_extract(base, r"\Ahttps?://([^/?#]*)", 1).alias("authority"),
        path.alias("path"),
        F.regexp_extract(path, r"\A.*/", 0).alias("dir"),
        F.regexp_extract(base, r"\?[^#]*", 0).alias("query"),
    )


def _split_reference(text: Column) -> Column:
    """Cut the fragment and query off; backslashes before them act as slashes."""
    cleaned = F.translate(F.substring_index(text, "#", 1), "\t\n\r", "")
    return let(
        cleaned,
        lambda t: let(
            F.struct(F.substring_index(t, "?", 1).alias("head"), t.alias("all")),
            lambda p: F.struct(
                F.translate(p["head"], "\\", "/").alias("head"),
                F.substr(p["all"], F.length(p["head"]) + 1).alias("query"),
            ),
        ),
    )


def _absolute(parts: Column, base: Column | None) -> Column:
    """Scheme, authority, path and query of a split reference, against a base if any."""
    scheme = F.lower(F.regexp_extract(parts["head"], r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))

    def hosted(scheme: Column, rest: Column, query: Column) -> Column:
        bare = F.ltrim(rest, F.lit("/"))
        authority = F.substring_index(bare, "/", 1)
        return let(
            F.struct(bare.alias("bare"), authority.alias("authority")),
            lambda a: F.struct(
                scheme.alias("scheme"),
                a["authority"].alias("authority"),
                F.substr(a["bare"], F.length(a["authority"]) + 1).alias("path"),
                query.alias("query"),
                F.lit(False).alias("of_base"),
            ),
        )

    def resolve(p: Column) -> Column:
        rest, query = p["rest"], p["query"]
        if base is None:
            return F.when(one_of(p["scheme"], "http", "https"), hosted(p["scheme"], rest, query))
        own_host = rest.startswith("//") | (
            (p["scheme"] != "") & (base["scheme"].isNull() | (p["scheme"] != base["scheme"]))
        )
        relative = F.struct(
            base["scheme"].alias("scheme"),
            base["authority"].alias("authority"),
            F.when(rest == "", base["path"])
            .when(rest.startswith("/"), rest)
            .otherwise(F.concat(base["dir"], rest))
            .alias("path"),
            F.when((rest == "") & (query == ""), base["query"]).otherwise(query).alias("query"),
            F.lit(True).alias("of_base"),
        )
        usable = one_of(p["scheme"], "", "http", "https") & (
            (p["scheme"] != "") | base["scheme"].isNotNull()
        )
        known = F.when(p["scheme"] == "", base["scheme"]).otherwise(p["scheme"])
        return F.when(usable & own_host, hosted(known, rest, query)).when(usable, relative)

    return let(
        scheme,
        lambda s: let(
            F.struct(
                s.alias("scheme"),
                F.when(s == "", parts["head"])
                .otherwise(F.substr(parts["head"], F.length(s) + 2))
                .alias("rest"),
                parts["query"].alias("query"),
            ),
            resolve,
        ),
    )


_NUMBER = "(?:0x[0-9a-f]*|[0-9]+)"
_IPV4 = rf"\A{_NUMBER}(?:\.{_NUMBER}){{0,3}}\.?\z"


def _ipv4(host: Column) -> Column:
    """One to four numbers, decimal, octal or hexadecimal, as four decimals; null out of range."""

    def number(part: Column) -> Column:
        digits = F.regexp_extract(part, r"\A(?:0x|0)?0*([0-9a-f]*)\z", 1)
        known = F.concat(F.lit("0"), digits)
        value = (
            F.when(part.startswith("0x"), F.conv(known, 16, 10))
            .when(part.rlike(r"\A0[0-7]+\z"), F.conv(known, 8, 10))
            .when(~part.rlike(r"\A0[0-9]"), F.conv(known, 10, 10))
        )
        return F.when(F.length(digits) <= 12, value.cast("long"))

    def joined(n: Column) -> Column:
        last = F.element_at(n, -1)
        high = F.aggregate(
            F.slice(n, 1, F.size(n) - 1), F.lit(0).cast("long"), lambda a, x: F.when(x <= 255, a * 256 + x)
        )
        room = F.element_at(F.array(*[F.lit(256 ** (5 - k)).cast("long") for k in (1, 2, 3, 4)]), F.size(n))
        address = F.when(last < room, high * room + last)
        return let(
            address,
            lambda a: F.when(
                a.isNotNull(),
                F.concat_ws(".", *[F.shiftright(a, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)]),
            ),
        )

    return let(F.transform(F.split(F.rtrim(host, F.lit(".")), r"\."), number), joined)


def _canonical_host(host: Column) -> Column:
    """The one spelling of a lower-case host; empty for a host that is not valid."""
    name = F.when(host.rlike(r"[^\x00-\x7f]"), F.coalesce(ascii_name(host), F.lit(""))).otherwise(host)
    return let(name, lambda n: F.when(n.rlike(_IPV4), F.coalesce(_ipv4(n), F.lit(""))).otherwise(n))


def _serialize_host(u: Column) -> Column:
    """User, host and port as written canonically, null when the host or port is invalid."""
    host_port = F.substring_index(u["authority"], "@", -1)

    def build(a: Column) -> Column:
        host = let(F.lower(F.regexp_extract(a["host_port"], _HOST_PORT, 1)), _canonical_host)
        port = F.try_to_number(
            F.nullif(F.regexp_extract(a["host_port"], _HOST_PORT, 2), F.lit("")), F.lit("99999999")
        )
        return let(
            F.struct(host.alias("host"), port.cast("int").alias("port")),
            lambda h: F.when(
                (h["host"] != "")
                & (F.coalesce(h["port"], F.lit(0)) <= 65535)
                & ~a["host_port"].rlike(r":[0-9]{9,}\z"),
                F.concat(
                    F.when(one_of(a["user"], "", "@", ":@"), F.lit("")).otherwise(a["user"]),
                    h["host"],
                    F.when(
                        h["port"].isNull()
                        | ((u["scheme"] == "http") & (h["port"] == 80))
                        | ((u["scheme"] == "https") & (h["port"] == 443)),
                        F.lit(""),
                    ).otherwise(F.concat(F.lit(":"), h["port"].cast("string"))),
                ),
            ),
        )

    return let(
        F.struct(
            host_port.alias("host_port"),
            F.substr(
                u["authority"], F.lit(1), F.length(u["authority"]) - F.length(host_port)
            ).alias("user"),
        ),
        build,
    )


def _serialize(u: Column) -> Column:
    """Canonical text of resolved parts, null when the host or port is invalid; the authority of a base is canonical already."""
    path = F.when(u["path"] == "", F.lit("/")).otherwise(
        let(_remove_dot_segments(u["path"]), lambda path: _percent_encode(path, _PATH_UNSAFE))
    )
    return F.concat(
        u["scheme"],
        F.lit("://"),
        F.when(u["of_base"], u["authority"]).otherwise(_serialize_host(u)),
        path,
        _percent_encode(u["query"], _QUERY_UNSAFE),
    )


def canonical_against(raw: Column, base: Column | None) -> Column:
    """Canonical form of ``raw`` against a :func:`base_parts` struct, or null."""

    def full(text: Column) -> Column:
        resolved = let(_split_reference(text), lambda parts: _absolute(parts, base))
        return F.when(
            (text != "") & ~text.startswith("#"), let(resolved, _serialize)
        )

    def shortest(text: Column) -> Column:
        plain = F.when(text == "", F.lit(None).cast("string")).when(
            text.startswith("http") & text.rlike(_PLAIN_ABSOLUTE), text
        )
        if base is not None:
            before = F.when(text.startswith("/"), "").when(text.startswith("?"), base["path"]).otherwise(base["dir"])
            plain = plain.when(
                base["scheme"].isNotNull() & text.rlike(_PLAIN_REFERENCE),
                F.concat(base["scheme"], F.lit("://"), base["authority"], before, text),
            )
        # What is plain has no space to trim.
        return plain.otherwise(let(trim_wide(text), full))

    return let(raw, shortest)


def canonical_url(raw: Column, base: Column | None = None) -> Column:
    """Absolute http(s) URL without fragment, or null.

    ``base`` must itself be canonical.  Only http and https survive, the host is
    lower-cased, default ports go, dot segments are resolved, unsafe characters
    are percent-encoded.
    """
    if base is None:
        return canonical_against(raw, None)
    return let(base_parts(base), lambda b: canonical_against(raw, b))


def hostname(url: Column) -> Column:
    """Host of a canonical URL, without port."""
    return F.regexp_extract(url, r"\Ahttps?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)", 1)


def host_with_port(url: Column) -> Column:
    return F.regexp_extract(url, r"\Ahttps?://(?:[^/?#@]*@)?([^/?#@]*)", 1)


def origin(url: Column) -> Column:
    return F.concat(F.substring_index(url, ":", 1), F.lit("://"), host_with_port(url))


def pathname(url: Column) -> Column:
    return F.regexp_extract(url, r"\Ahttps?://[^/?#]*([^?#]*)", 1)


def search(url: Column) -> Column:
    """The query with its question mark; a lone question mark counts as none."""
    return F.regexp_extract(url, r"\A[^?#]*(\?[^#]+)", 1)


def registrable_domain(host: Column) -> Column:
    """Last two labels, or three under a listed two-label suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def in_scope(url: Column, seed: Column, scope: str) -> Column:
    """Whether a canonical URL belongs to the scope of a canonical seed."""
    if scope == "all":
        return F.lit(True)
    known = url.isNotNull() & seed.isNotNull()
    if scope == "page":
        test = url == seed
    elif scope == "subdomain":
        test = registrable_domain(hostname(url)) == registrable_domain(hostname(seed))
    elif scope == "path":
        folder = F.regexp_extract(pathname(seed), r"\A.*/", 0)
        test = (hostname(url) == hostname(seed)) & F.startswith(pathname(url), folder)
    else:
        test = hostname(url) == hostname(seed)
    return F.coalesce(known & test, F.lit(False))


def extension_of_name(name: Column) -> Column:
    """Extension of a file name or path without its dot, case kept."""
    return F.regexp_extract(name, r"[^/]\.([^./]*)/*\z", 1)


def extension(url: Column) -> Column:
    """Lower-cased extension of a canonical URL's path, '' when there is none."""
    return F.lower(F.regexp_extract(url, r"\Ahttps?://[^/?#]*+[^?#]*[^/?#]\.([^./?#]*)/*(?:[?#]|\z)", 1))


def category_of_extension(ext: Column) -> Column:
    chosen = None
    for category, extensions in CATEGORY_EXTENSIONS.items():
        hit = one_of(ext, *extensions)
        chosen = F.when(hit, category) if chosen is None else chosen.when(hit, category)
    return chosen


def category(url: Column) -> Column:
    """Asset category of a canonical URL by its extension, or null."""
    return let(extension(url), category_of_extension)


def is_tracker(url: Column) -> Column:
    """Whether the host of a canonical URL names an ad or tracking service."""
    tokens = "|".join(escape_regex(t) for t in TRACKER_TOKENS)
    return F.coalesce(hostname(url).rlike(f"(?i){tokens}"), F.lit(False))


def compile_patterns(raw: str | None) -> tuple[str, ...]:
    """Case-insensitive regular expressions of a list; what the JVM cannot compile matches literally."""
    patterns = SparkContext.getOrCreate()._jvm.java.util.regex.Pattern
    compiled = []
    for pattern in split_list(raw):
        try:
            patterns.compile("(?i)" + pattern)
            compiled.append("(?i)" + pattern)
        except (Py4JJavaError, IllegalArgumentException):
            compiled.append("(?i)" + escape_regex(pattern))
    return tuple(compiled)


def passes_patterns(url: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """No exclude matches, and some include matches if there are any."""
    keep = F.lit(True)
    for pattern in exclude:
        keep = keep & ~url.rlike(pattern)
    if include:
        wanted = F.lit(False)
        for pattern in include:
            wanted = wanted | url.rlike(pattern)
        keep = keep & wanted
    return keep

