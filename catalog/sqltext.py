"""Building blocks of the check SQL: plain DuckDB expressions and CTE chains.

They follow the rules set by set, with RE2 patterns and window functions, not
the array expressions the Spark jobs use, so that agreement means something.
"""

from __future__ import annotations

from html.entities import html5

from catalog.derived import for_oracle
from webquarry.fixed_values import (
    CATEGORY_EXTENSIONS,
    CONTENT_TYPE_EXTENSIONS,
    CSS_URL,
    SPACE_CLASS,
    TRACKER_TOKENS,
    TWO_LABEL_SUFFIXES,
)

ATTR = r"""[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?"""
ATTRS = rf"(?:[\s/]+|{ATTR})*"
_RAW = ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")
RAW_REGION = r"<!--(?:-?>|.*?(?:-->|--!>|\z))" + "".join(
    rf"|(<{n}(?:[\s/]{ATTRS})?>).*?(?:</{n}(?:[\s/][^>]*)?>|\z)" for n in _RAW
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def inlist(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$', '', 'g')"


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def source(name: str, text: str) -> str:
    return f"{name} AS MATERIALIZED ({for_oracle(text)})"


# --- URLs --------------------------------------------------------------------------------


def encode(x: str, safe: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, ''), lambda c: "
        f"CASE WHEN regexp_matches(c, '^[{safe}]$') THEN c ELSE url_encode(c) END), '')"
    )


_PATH_SAFE = r"\x21\x24-\x3b\x3d\x40-\x5d\x5f\x61-\x7a\x7c\x7e"
_QUERY_SAFE = r"\x21\x24-\x26\x28-\x3b\x3d\x3f-\x7e"


def canonical(p: str, src: str, raw: str = "raw", base: str = "base", out: str = "canon") -> list[str]:
    """CTEs ending in ``{p}`` = ``src`` plus the canonical form of ``raw``."""
    schemes = "^(?i:mailto:|tel:|javascript:|data:|blob:|ftp:|about:|#)"
    return [
        f"{p}_1 AS (SELECT *, {trim(raw)} AS _t FROM {src})",
        f"""{p}_2 AS (SELECT *, CASE WHEN _t IS NULL OR _t = '' OR regexp_matches(_t, '{schemes}') THEN NULL
            ELSE split_part(regexp_replace(_t, '[\\t\\n\\r]', '', 'g'), '#', 1) END AS _r FROM {p}_1)""",
        f"""{p}_3 AS (SELECT *, lower(regexp_extract(_r, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS _sch,
            regexp_replace(_r, '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS _rest,
            regexp_extract({base}, '^(https?)://', 1) AS _bs, regexp_extract({base}, '^https?://([^/?]*)', 1) AS _ba,
            regexp_extract({base}, '^https?://[^/?]*([^?]*)', 1) AS _bp, regexp_extract({base}, '\\?.*$') AS _bq,
            {base} IS NOT NULL AS _hasbase FROM {p}_2)""",
        f"""{p}_4 AS (SELECT *, CASE WHEN _sch <> '' THEN _sch ELSE _bs END AS _s,
            _r IS NOT NULL AND (_sch IN ('http', 'https') OR (_sch = '' AND _hasbase)) AS _good,
            (_sch <> '' OR starts_with(_rest, '//')) AS _own FROM {p}_3)""",
        f"""{p}_5 AS (SELECT *, CASE WHEN _own THEN regexp_extract(_rest, '^/*([^/?]*)', 1) ELSE _ba END AS _auth,
            CASE WHEN _own THEN regexp_extract(_rest, '^/*[^/?]*([^?]*)', 1)
              WHEN split_part(_rest, '?', 1) = '' THEN _bp
              WHEN starts_with(_rest, '/') THEN split_part(_rest, '?', 1)
              ELSE regexp_replace(_bp, '[^/]*$', '') || split_part(_rest, '?', 1) END AS _p,
            CASE WHEN contains(_rest, '?') THEN regexp_extract(_rest, '\\?.*$')
              WHEN _sch = '' AND _rest = '' THEN _bq ELSE '' END AS _q FROM {p}_4)""",
        f"""{p}_6 AS (SELECT *, string_split(CASE WHEN _p = '' THEN '/' ELSE _p END, '/')[2:] AS _seg FROM {p}_5)""",
        f"""{p}_7 AS (SELECT *, list_reduce(_seg, lambda a, x: CASE x WHEN '.' THEN a WHEN '..' THEN regexp_replace(a, '/[^/]*$', '')
              ELSE a || '/' || x END, '') AS _np, _seg[len(_seg)] IN ('.', '..') AS _dir FROM {p}_6)""",
        f"""{p} AS (SELECT * EXCLUDE (_t, _r, _sch, _rest, _bs, _ba, _bp, _bq, _hasbase, _s, _good, _own, _auth, _p, _q, _seg, _np, _dir),
            CASE WHEN _good THEN _s || '://' || CASE _s WHEN 'http' THEN regexp_replace(lower(_auth), ':(80)?$', '')
              ELSE regexp_replace(lower(_auth), ':(443)?$', '') END
            || {encode("CASE WHEN _np = '' THEN '/' WHEN _dir THEN _np || '/' ELSE _np END", _PATH_SAFE)}
            || {encode("_q", _QUERY_SAFE)} END AS {out} FROM {p}_7)""",
    ]


def host(u: str) -> str:
    return f"regexp_extract({u}, '^https?://([^/?:]*)', 1)"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^https?://[^/?]*([^?]*)', 1)"


def query(u: str) -> str:
    return f"regexp_extract({u}, '\\?.+$')"


def domain(h: str) -> str:
    labels = f"string_split({h}, '.')"
    two = f"array_to_string({labels}[-2:], '.')"
    return (
        f"CASE WHEN len({labels}) <= 2 THEN {h} WHEN {two} IN {inlist(TWO_LABEL_SUFFIXES)} "
        f"THEN array_to_string({labels}[-3:], '.') ELSE {two} END"
    )


def ext(u: str) -> str:
    last = f"regexp_extract({path(u)}, '([^/]*)/*$', 1)"
    return f"lower(regexp_extract({last}, '^.+\\.([^.]*)$', 1))"


def category(u: str) -> str:
    whens = " ".join(f"WHEN {ext(u)} IN {inlist(e)} THEN {lit(c)}" for c, e in CATEGORY_EXTENSIONS.items())
    return f"CASE {whens} END"


def tracker(u: str) -> str:
    return f"regexp_matches({host(u)}, '(?i)({'|'.join(TRACKER_TOKENS)})')"


def ctype_ext(ct: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in CONTENT_TYPE_EXTENSIONS.items())
    return f"CASE lower(trim(split_part({ct}, ';', 1))) {whens} ELSE '' END"


def fnv(x: str) -> str:
    return (
        f"printf('%08x', list_reduce(list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT), "
        f"lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT))"
    )


def safe(x: str) -> str:
    s = rf"""regexp_replace({x}, '[\\/:*?"<>|]+', '_', 'g')"""
    s = f"regexp_replace({s}, '[{SPACE_CLASS}]+', '_', 'g')"
    s = f"regexp_replace({s}, '_+', '_', 'g')"
    s = f"regexp_replace({s}, '^[._]+|[._]+$', '', 'g')"
    return f"CASE WHEN len({s}) > 180 THEN left({s}, 171) || '~' || {fnv(s)} ELSE {s} END"


def sniff(hex_: str) -> str:
    text = f"lower(CAST(unhex({hex_}) AS VARCHAR))"
    return f"""CASE WHEN len({hex_}) < 8 THEN '' WHEN starts_with({hex_}, '89504E47') THEN 'png' WHEN starts_with({hex_}, 'FFD8FF') THEN 'jpg'
      WHEN starts_with({hex_}, '474946') THEN 'gif' WHEN starts_with({hex_}, '52494646') AND substr({hex_}, 17, 8) = '57454250' THEN 'webp'
      WHEN starts_with({hex_}, '25504446') THEN 'pdf' WHEN starts_with({hex_}, '504B03') THEN 'zip' WHEN starts_with({hex_}, '1F8B') THEN 'gzip'
      WHEN starts_with({text}, '<svg') THEN 'svg' WHEN starts_with({text}, '<!doctype html') THEN 'html' ELSE '' END"""


# --- HTML ---------------------------------------------------------------------------------------


#: The references by name that the data have.
REFERENCES = ("amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "middot", "eacute")


def decode(x: str) -> str:
    parts = f"regexp_extract_all({x}, '&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][0-9A-Za-z]*;|[^&]+|&')"
    digits = "string_split(lower(regexp_extract(p, '([0-9A-Fa-f]+);?$', 1)), '')"
    base_16 = f"list_reduce(list_transform({digits}, lambda d: instr('0123456789abcdef', d) - 1), lambda a, b: a * 16 + b)"
    named = " ".join(f"WHEN {lit('&' + n + ';')} THEN {lit(html5[n + ';'])}" for n in REFERENCES)
    one = (
        f"CASE WHEN regexp_matches(p, '^&#[xX]') THEN chr(({base_16})::INTEGER) WHEN regexp_matches(p, '^&#[0-9]') "
        f"THEN chr(regexp_extract(p, '[0-9]+')::INTEGER) ELSE CASE p {named} ELSE p END END"
    )
    return f"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform({parts}, lambda p: {one}), '') ELSE {x} END"


def value_of(token: str) -> str:
    v = f"regexp_extract({token}, '(?s)^[^\\s/>][^\\s/>=]*\\s*=\\s*(.*)$', 1)"
    return decode(f"""regexp_replace({v}, '(?s)^"(.*)"$|^''(.*)''$', '\\1\\2')""")


def attr(name: str, tokens: str = "tok") -> str:
    found = f"list_filter({tokens}, lambda x: lower(regexp_extract(x, '^[^\\s/>][^\\s/>=]*')) = {lit(name)})[1]"
    return f"coalesce({value_of(found)}, '')"


def tokens_of(tag: str) -> str:
    return f"regexp_extract_all(regexp_extract({tag}, '(?s)^<[A-Za-z][^\\s/>]*(.*)>$', 1), {lit(ATTR)})"


def html_chain(src: str) -> list[str]:
    """CTEs ``clean``, ``tags`` and ``bs`` (page_id, page_url, base) over ``src``."""
    return [
        *canonical("pg", f"(SELECT *, NULL::VARCHAR AS nobase FROM {src})", raw="url", base="nobase", out="page_url"),
        f"clean AS MATERIALIZED (SELECT *, regexp_replace(html, {lit(RAW_REGION)}, '\\1\\2\\3\\4\\5\\6\\7\\8', 'gis') AS txt FROM pg)",
        f"""tags0 AS (SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) - 1 AS ord FROM
            (SELECT page_id, regexp_extract_all(txt, {lit("<[A-Za-z][^\\s/>]*" + ATTRS + ">")}) AS l FROM clean))""",
        f"""tags AS MATERIALIZED (SELECT page_id, ord, tag, lower(regexp_extract(tag, '^<([A-Za-z][^\\s/>]*)', 1)) AS name,
            {tokens_of('tag')} AS tok FROM tags0)""",
        f"""bs0 AS (SELECT pg.page_id, page_url, b.href FROM pg LEFT JOIN (SELECT page_id, arg_min({attr('href')}, ord) AS href FROM tags
            WHERE name = 'base' AND len(list_filter(tok, lambda x: lower(regexp_extract(x, '^[^\\s/>=]+')) = 'href')) > 0
            GROUP BY page_id) b USING (page_id))""",
        *canonical("bs1", "bs0", raw="href", base="page_url", out="resolved"),
        "bs AS MATERIALIZED (SELECT page_id, page_url, coalesce(resolved, page_url) AS base FROM bs1)",
    ]


def links_chain() -> list[str]:
    """CTE ``links`` (page_id, page_url, ord, dst_url) after :func:`html_chain`."""
    return [
        f"""lk0 AS (SELECT page_id, 0 AS grp, ord, {attr('href')} AS raw FROM tags WHERE name = 'a'
            UNION ALL SELECT page_id, 1, ord, {attr('src')} FROM tags WHERE name IN ('iframe', 'frame'))""",
        "lk1 AS (SELECT lk0.*, bs.base, bs.page_url FROM lk0 JOIN bs USING (page_id))",
        *canonical("lk2", "lk1"),
        """links AS MATERIALIZED (SELECT page_id, page_url, canon AS dst_url,
            row_number() OVER (PARTITION BY page_id ORDER BY min((grp, ord))) - 1 AS ord
            FROM lk2 WHERE canon IS NOT NULL GROUP BY page_id, page_url, canon)""",
    ]


def exploded(select: str, items: str, name: str, pos: str) -> str:
    return f"SELECT {select}, unnest({items}) AS {name}, generate_subscripts({items}, 1) AS {pos}"


def raw_bodies(element: str) -> str:
    """Content of one kind of raw-text element, in order, as a list."""
    regions = f"regexp_extract_all(html, {lit(RAW_REGION)}, 0, 'is')"
    return (
        f"list_transform(list_filter({regions}, lambda r: regexp_matches(r, '(?i)^<{element}[\\s/>]')), "
        f"lambda r: regexp_extract(r, {lit(rf'^<{element}{ATTRS}>(.*?)(?:</{element}(?:[\s/][^>]*)?>)?$')}, 1, 'is'))"
    )


def css_chain() -> list[str]:
    """CTE ``css`` (page_id, grp, ord, n, k, raw): style blocks, then attributes."""
    return [
        f"css_a AS ({exploded('page_id', raw_bodies('style'), 'body', 'n')} FROM clean)",
        f"css_b AS (SELECT page_id, ord, {attr('style')} AS body FROM tags WHERE contains(lower(tag), 'style'))",
        f"""css AS (SELECT page_id, 0 AS grp, n AS ord, unnest(regexp_extract_all(body, {lit(CSS_URL)}, 1)) AS raw,
              generate_subscripts(regexp_extract_all(body, {lit(CSS_URL)}, 1), 1) AS k FROM css_a
            UNION ALL SELECT page_id, 1, ord, unnest(regexp_extract_all(body, {lit(CSS_URL)}, 1)),
              generate_subscripts(regexp_extract_all(body, {lit(CSS_URL)}, 1), 1) FROM css_b)""",
    ]


def srcset_rows(attr_name: str, tags: str, grp: int, slot: int) -> str:
    parts = f"string_split({attr(attr_name)}, ',')"
    return f"""SELECT page_id, {grp} AS grp, ord, {slot} AS slot, k,
        regexp_extract({trim('part')}, '^([^{SPACE_CLASS}]*)', 1) AS raw, 'srcset' AS via, 'images' AS fixed, NULL AS fallback
      FROM (SELECT page_id, ord, unnest({parts}) AS part, generate_subscripts({parts}, 1) AS k FROM tags WHERE name IN {tags})"""


def assets_chain() -> list[str]:
    """CTE ``assets`` (page_id, page_url, ord, url, type, via)."""

    def single(name: str, tags: str, grp: int, slot: int, via: str, fixed: str, fallback: str) -> str:
        return f"SELECT page_id, {grp}, ord, {slot}, 0, {attr(name)}, {lit(via)}, {fixed}, {fallback} FROM tags WHERE name IN {tags}"

    rel = f"lower({attr('rel')})"
    rows = [
        f"SELECT page_id, 0 AS grp, ord, 0 AS slot, 0 AS k, {attr('href')} AS raw, 'a' AS via, NULL AS fixed, NULL AS fallback FROM tags WHERE name = 'a'",
        *[single(a, "('img')", 1, i, a, "'images'", "NULL") for i, a in enumerate(("src", "data-src", "data-original", "data-lazy-src"))],
        srcset_rows("srcset", "('img')", 1, 5),
        srcset_rows("data-srcset", "('img')", 1, 6),
        srcset_rows("srcset", "('source')", 2, 0),
        single("src", "('source')", 2, 1, "source", "NULL", "'media'"),
        single("src", "('video', 'audio')", 3, 0, "src", "'media'", "NULL"),
        single("poster", "('video', 'audio')", 3, 1, "poster", "'images'", "NULL"),
        f"""SELECT page_id, 4, ord, 0, 0, {attr('href')}, 'link', CASE WHEN contains({rel}, 'stylesheet') THEN 'styles' WHEN contains({rel}, 'icon') THEN 'images' END,
            CASE WHEN contains({rel}, 'preload') OR contains({rel}, 'prefetch') THEN 'other' END FROM tags WHERE name = 'link'""",
        single("src", "('script')", 5, 0, "script", "'scripts'", "NULL"),
        "SELECT page_id, 6 + grp, ord, 0, k, raw, 'css', NULL, 'images' FROM css",
    ]
    return [
        *css_chain(),
        "as0 AS (" + "\nUNION ALL ".join(rows) + ")",
        "as1 AS (SELECT as0.*, bs.base, bs.page_url FROM as0 JOIN bs USING (page_id))",
        *canonical("as2", "as1"),
        f"""as3 AS (SELECT page_id, page_url, canon AS url, coalesce(fixed, {category('canon')}, fallback) AS type, via, (grp, ord, slot, k) AS o
            FROM as2 WHERE canon IS NOT NULL)""",
        """as4 AS (SELECT page_id, page_url, url, arg_min(type, o) AS type, arg_min(via, o) AS via, min(o) AS o
            FROM as3 WHERE type IS NOT NULL GROUP BY page_id, page_url, url)""",
        """assets AS MATERIALIZED (SELECT page_id, page_url, url, type, via, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS ord FROM as4)""",
    ]


def meta_chain() -> list[str]:
    """CTE ``meta`` with the ten fields per page."""

    def first(value: str, cond: str) -> str:
        return trim(f"coalesce(arg_min({value}, ord) FILTER ({cond}), '')")

    def named(n: str) -> str:
        return first(attr("content"), f"name = 'meta' AND {attr('name')} = {lit(n)}")

    def prop(n: str) -> str:
        return first(attr("content"), f"name = 'meta' AND {attr('property')} = {lit(n)}")

    return [
        f"""mt0 AS (SELECT page_id, {named('description')} AS d1, {prop('og:description')} AS d2,
            arg_min({attr('href')}, ord) FILTER (name = 'link' AND lower({attr('rel')}) = 'canonical') AS chref,
            {first(attr('lang'), "name = 'html'")} AS lang, {prop('og:title')} AS og_title, {prop('og:type')} AS og_type,
            {prop('og:image')} AS og_image, {named('robots')} AS robots_meta, {named('generator')} AS generator,
            {first(attr('charset'), "name = 'meta' AND " + attr('charset') + " <> ''")} AS charset FROM tags GROUP BY page_id)""",
        "mt1 AS (SELECT bs.page_id, bs.page_url, bs.base, mt0.* EXCLUDE (page_id) FROM bs LEFT JOIN mt0 USING (page_id))",
        *canonical("mt2", "mt1", raw="chref", base="base", out="canonical"),
        f"""meta AS MATERIALIZED (SELECT mt2.page_id, mt2.page_url, {trim("coalesce(" + decode(raw_bodies('title') + '[1]') + ", '')")} AS title,
            CASE WHEN d1 <> '' THEN d1 ELSE d2 END AS description, canonical, lang, og_title, og_type, og_image, robots_meta, generator, charset
            FROM mt2 JOIN clean USING (page_id))""",
    ]


def forms_chain() -> list[str]:
    """CTE ``forms`` (page_id, page_url, form_no, action, method, inputs)."""
    form = rf"<form(?:[\s/]{ATTRS})?>.*?(?:</form(?:[\s/][^>]*)?>|\z)"
    control = rf"<(?:input|select|textarea|button)(?:[\s/]{ATTRS})?>"
    return [
        f"fm0 AS (SELECT page_id, unnest(l) AS block, generate_subscripts(l, 1) - 1 AS form_no FROM (SELECT page_id, regexp_extract_all(txt, {lit(form)}, 0, 'is') AS l FROM clean))",
        f"""fm1 AS (SELECT *, {tokens_of(f"regexp_extract(block, {lit('^<form' + ATTRS + '>')}, 0, 'is')")} AS tok,
            list_transform(regexp_extract_all(block, {lit(control)}, 0, 'is'), lambda c: {{'t': c, 'tok': {tokens_of('c')}}}) AS cs FROM fm0)""",
        f"""fm2 AS (SELECT page_id, form_no, {attr('action')} AS raw, lower(CASE WHEN {attr('method')} = '' THEN 'get' ELSE {attr('method')} END) AS method,
            list_filter(list_transform(cs, lambda c: {{'name': {attr('name', 'c.tok')}, 'type': lower(CASE WHEN {attr('type', 'c.tok')} = ''
              THEN regexp_extract(c.t, '^<([A-Za-z]+)', 1) ELSE {attr('type', 'c.tok')} END)}}), lambda c: c.name <> '') AS cs FROM fm1)""",
        "fm3 AS (SELECT fm2.*, bs.base, bs.page_url FROM fm2 JOIN bs USING (page_id))",
        *canonical("fm4", "fm3"),
        """forms AS MATERIALIZED (SELECT page_id, page_url, form_no, CASE WHEN raw = '' THEN base ELSE coalesce(canon, raw) END AS action, method,
            array_to_string(list_transform(cs, lambda c: c.name || ':' || c.type), '|') AS inputs FROM fm4)""",
    ]
