"""For each registered query, plain SQL with the same columns for DuckDB."""

from __future__ import annotations

from catalog import derived as D
from catalog import sqltext as Q
from webquarry.fixed_values import (
    BINARY_CATEGORIES,
    BLOCKED_STATUSES,
    CHALLENGE_MARKERS,
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
)

ORACLE: dict[str, str] = {}

lit, trim, inlist = Q.lit, Q.trim, Q.inlist

# --- sources ---------------------------------------------------------------------------

ORACLE["scan_pages"] = (
    "SELECT page_id, url, NULL::INTEGER AS status, NULL::VARCHAR AS content_type, "
    "strlen(html)::INTEGER AS html_bytes, NULL::VARCHAR AS error FROM pages"
)

_seed_items = [
    Q.source("src", D.SEED_LISTS),
    "parts AS (SELECT list_no, regexp_split_to_array(seed_list, '[\\n,]+') AS l FROM src)",
    "items AS (SELECT list_no, unnest(l) AS item, generate_subscripts(l, 1) - 1 AS ord FROM parts)",
    f"tidy AS (SELECT list_no, ord, {trim('item')} AS raw, NULL::VARCHAR AS base FROM items)",
]
ORACLE["seeds"] = Q.with_ctes(
    [*_seed_items, *Q.canonical("c", "tidy")],
    "SELECT list_no, ord, canon AS url FROM c WHERE canon IS NOT NULL",
)
ORACLE["bad_seeds"] = Q.with_ctes(
    _seed_items, "SELECT list_no, ord, raw FROM tidy WHERE raw <> '' AND NOT regexp_matches(raw, '^(?i:https?://)')"
)

ROBOTS_LINES = [
    Q.source("robots", D.ROBOTS),
    "rl0 AS (SELECT host, regexp_split_to_array(text, '\\r?\\n') AS l FROM robots)",
    "rl1 AS (SELECT host, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS line FROM rl0)",
    f"rl2 AS (SELECT host, line, {trim('''regexp_replace(raw, '#.*$', '')''')} AS t FROM rl1)",
    f"""rl3 AS (SELECT host, line, lower({trim("split_part(t, ':', 1)")}) AS field, {trim("substr(t, instr(t, ':') + 1)")} AS value
        FROM rl2 WHERE contains(t, ':'))""",
    """rl4 AS (SELECT *, (field = 'user-agent') AS ag, lag(field = 'user-agent', 1, false) OVER (PARTITION BY host ORDER BY line) AS was FROM rl3)""",
    "rl AS MATERIALIZED (SELECT host, line, field, value, sum(CASE WHEN ag AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY line)::INTEGER AS group_no FROM rl4)",
    "rules AS (SELECT host, group_no, line, field = 'allow' AS allow, value AS path FROM rl WHERE field = 'disallow' OR (field = 'allow' AND value <> ''))",
    """grp0 AS (SELECT host, group_no, CASE WHEN lower(value) = '*' THEN -1 ELSE len(value) END AS w, line FROM rl
        WHERE field = 'user-agent' AND (value = '*' OR contains('corpusbot/1.0', lower(value)))
        UNION ALL SELECT host, 0, -1, -1 FROM rl WHERE group_no = 0 AND field IN ('allow', 'disallow', 'crawl-delay'))""",
    "grp AS MATERIALIZED (SELECT host, arg_min(group_no, (-w, line)) AS group_no FROM grp0 GROUP BY host)",
    """delay AS (SELECT host, group_no, arg_max(d, line) AS crawl_delay FROM (SELECT host, group_no, line,
        try_cast(regexp_extract(value, '^[+-]?[0-9]+\\.?[0-9]*|^[+-]?\\.[0-9]+') AS DOUBLE) AS d FROM rl WHERE field = 'crawl-delay')
        WHERE d IS NOT NULL GROUP BY host, group_no)""",
]
ORACLE["robots_rules"] = Q.with_ctes(ROBOTS_LINES, "SELECT * FROM rules")
ORACLE["robots_group"] = Q.with_ctes(
    ROBOTS_LINES,
    """SELECT g.host, g.group_no, d.crawl_delay, count(r.line)::INTEGER AS rules FROM grp g LEFT JOIN delay d USING (host, group_no)
    LEFT JOIN rules r USING (host, group_no) GROUP BY ALL""",
)

_CANDIDATES = [
    *ROBOTS_LINES,
    Q.source("seeds", D.SEEDS),
    """cand0 AS (SELECT seed_no, value AS sitemap, line AS c FROM seeds JOIN rl ON rl.host = regexp_extract(seeds.url, '^https?://([^/]*)', 1) AND field = 'sitemap'
        UNION ALL SELECT seed_no, regexp_extract(url, '^https?://[^/]*') || '/sitemap.xml', 2147483647 FROM seeds)""",
    "cand AS MATERIALIZED (SELECT seed_no, sitemap, min(c) AS c FROM cand0 GROUP BY ALL)",
]
ORACLE["sitemap_candidates"] = Q.with_ctes(_CANDIDATES, "SELECT seed_no, sitemap FROM cand")
_LOC = "(?i)<loc>\\s*([^<\\s]+)\\s*</loc>"

_DEEPEST = 8  # longer than any chain of index files in the data


def sitemap_chain(without_seeds: bool = False) -> list[str]:
    """CTE ``added`` (seed_no, c, place, url, parent), with or without the seeds themselves."""
    queued = "AND canon NOT IN (SELECT url FROM seeds)" if without_seeds else ""
    return [
        *_CANDIDATES,
        Q.source("sm", D.SITEMAPS),
        f"ent AS (SELECT url AS sitemap, regexp_matches(xml, '(?i)<sitemapindex') AS idx, unnest(regexp_extract_all(xml, {lit(_LOC)}, 1)) AS loc, generate_subscripts(regexp_extract_all(xml, {lit(_LOC)}, 1), 1) - 1 AS n FROM sm)",
        "l0 AS (SELECT seed_no, c, sitemap, []::INTEGER[] AS place FROM cand)",
        *[
            f"l{k + 1} AS (SELECT seed_no, c, loc AS sitemap, list_append(place, n::INTEGER) AS place FROM l{k} JOIN ent USING (sitemap) WHERE idx)"
            for k in range(_DEEPEST)
        ],
        "reached AS (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(_DEEPEST + 1)) + ")",
        "leaf AS (SELECT seed_no, c, sitemap AS parent, loc AS raw, NULL::VARCHAR AS base, list_append(place, n::INTEGER) AS place FROM reached JOIN ent USING (sitemap) WHERE NOT idx)",
        *Q.canonical("lc", "leaf"),
        f"want AS (SELECT * FROM lc WHERE canon IS NOT NULL AND {Q.domain(Q.host('canon'))} = 'example.com' {queued})",
        "fst AS (SELECT canon AS url, arg_min({'s': seed_no, 'c': c, 'p': parent, 'l': place}, (seed_no, c, place)) AS f FROM want GROUP BY canon)",
        "added AS (SELECT f.s AS seed_no, f.c AS c, f.l AS place, url, f.p AS parent FROM fst)",
    ]


ORACLE["sitemap_urls"] = Q.with_ctes(sitemap_chain(), "SELECT seed_no, url, parent FROM added")
ORACLE["header_map"] = Q.with_ctes(
    [
        Q.source("src", D.HEADER_BLOCKS),
        "a AS (SELECT page_id, unnest(string_split(block, chr(10))) AS ln, generate_subscripts(string_split(block, chr(10)), 1) AS n FROM src)",
        "b AS (SELECT page_id, n, lower(trim(substr(ln, 1, instr(ln, ':') - 1))) AS name, trim(substr(ln, instr(ln, ':') + 1)) AS value FROM a WHERE instr(ln, ':') > 1)",
    ],
    "SELECT page_id, name, arg_max(value, n) AS value FROM b WHERE name <> '' AND value <> '' GROUP BY ALL",
)

# --- URLs ------------------------------------------------------------------------------

REFS = [
    Q.source("src0", D.URL_REFS),
    "src1 AS (SELECT *, NULL::VARCHAR AS nobase FROM src0)",
    *Q.canonical("src2", "src1", raw="base", base="nobase", out="page"),
    *Q.canonical("refs", "src2", raw="raw", base="page", out="url"),
    "ok AS MATERIALIZED (SELECT * FROM refs WHERE url IS NOT NULL)",
]
ORACLE["canonical_urls"] = Q.with_ctes(REFS, "SELECT page_id, page, url FROM refs")
ORACLE["domain_rollup"] = Q.with_ctes(
    REFS, f"SELECT {Q.domain(Q.host('url'))} AS domain, count(*) AS urls FROM ok GROUP BY 1"
)
ORACLE["url_categories"] = Q.with_ctes(
    REFS, f"SELECT page_id, {Q.ext('url')} AS ext, {Q.category('url')} AS category FROM ok"
)
ORACLE["dedup_urls"] = Q.with_ctes(REFS, "SELECT url, min(page_id) AS page_id FROM ok GROUP BY url")
ORACLE["url_filters"] = Q.with_ctes(
    REFS,
    "SELECT page_id, NOT regexp_matches(url, '(?i)page=[13]') AND NOT contains(lower(url), '[bad') "
    "AND (regexp_matches(url, '(?i)example\\.com') OR contains(lower(url), '/gtm')) AS passes FROM ok",
)
ORACLE["tracker_assets"] = Q.with_ctes(REFS, f"SELECT page_id, {Q.tracker('url')} AS tracker FROM ok")
for _scope, _test in {
    "page": "url = page",
    "path": f"{Q.host('url')} = {Q.host('page')} AND starts_with({Q.path('url')}, regexp_replace({Q.path('page')}, '[^/]*$', ''))",
    "domain": f"{Q.host('url')} = {Q.host('page')}",
    "subdomain": f"{Q.domain(Q.host('url'))} = {Q.domain(Q.host('page'))}",
    "all": "true",
}.items():
    ORACLE[f"scope_{_scope}"] = Q.with_ctes(REFS, f"SELECT page_id, {_test} AS inside FROM ok")

# --- pages -----------------------------------------------------------------------------

GIVEN = ["src AS (SELECT page_id, url, html FROM pages)", *Q.html_chain("src")]
MARKET = [Q.source("src", D.MARKET_PAGES), *Q.html_chain("src")]

ORACLE["host_overview"] = Q.with_ctes(
    [*GIVEN, *Q.links_chain()],
    f"""SELECT p.domain, p.n AS pages, coalesce(l.i, 0) AS links_inside, coalesce(l.o, 0) AS links_outside, coalesce(l.d, 0) AS distinct_targets
    FROM (SELECT {Q.domain(Q.host('page_url'))} AS domain, count(*) AS n FROM pg GROUP BY 1) p LEFT JOIN
    (SELECT {Q.domain(Q.host('page_url'))} AS domain, count(*) FILTER ({Q.host('dst_url')} = {Q.host('page_url')}) AS i,
     count(*) FILTER ({Q.host('dst_url')} <> {Q.host('page_url')}) AS o, count(DISTINCT dst_url) AS d FROM links GROUP BY 1) l USING (domain)""",
)
_pairs = (
    "list_filter(list_transform(tok, lambda t: {'n': lower(regexp_extract(t, '^[^\\s/>][^\\s/>=]*')), 'v': "
    + Q.value_of("t")
    + "}), lambda x: true)"
)
ORACLE["html_tags"] = Q.with_ctes(
    [
        *MARKET,
        f"p0 AS (SELECT page_id, ord, name, {_pairs} AS ps FROM tags)",
        "p1 AS (SELECT *, list_filter(ps, lambda x, i: list_position(list_transform(ps, lambda y: y.n), x.n) = i) AS fs FROM p0)",
    ],
    "SELECT page_id, ord, name AS tag, array_to_string(list_transform(fs, lambda x: x.n || '=' || x.v), '|') AS attrs FROM p1",
)
ORACLE["page_meta"] = Q.with_ctes([*MARKET, *Q.meta_chain()], "SELECT * FROM meta")
ORACLE["page_titles"] = Q.with_ctes(
    [*GIVEN, *Q.meta_chain()], "SELECT page_id, page_url, title, lang, charset FROM meta"
)
_links = "SELECT page_id, page_url AS src_url, ord, dst_url FROM links"
ORACLE["page_links"] = Q.with_ctes([*GIVEN, *Q.links_chain()], _links)
ORACLE["market_links"] = Q.with_ctes([*MARKET, *Q.links_chain()], _links)
ORACLE["stream_links"] = ORACLE["page_links"]
ORACLE["page_assets"] = Q.with_ctes([*MARKET, *Q.assets_chain()], "SELECT page_id, page_url, ord, url, type, via FROM assets")
ORACLE["srcset_urls"] = Q.with_ctes(
    [
        *MARKET,
        f"s0 AS ({Q.srcset_rows('srcset', '''('img', 'source')''', 0, 0)} UNION ALL {Q.srcset_rows('data-srcset', '''('img', 'source')''', 0, 1)})",
        "s1 AS (SELECT s0.*, bs.base FROM s0 JOIN bs USING (page_id))",
        *Q.canonical("s2", "s1"),
    ],
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord, slot, k) - 1 AS ord, canon AS url FROM s2 WHERE canon IS NOT NULL",
)
ORACLE["css_urls"] = Q.with_ctes(
    [*MARKET, *Q.css_chain(), "c1 AS (SELECT css.*, bs.base FROM css JOIN bs USING (page_id))", *Q.canonical("c2", "c1")],
    "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY grp, ord, k) - 1 AS ord, canon AS url FROM c2 WHERE canon IS NOT NULL",
)
ORACLE["page_forms"] = Q.with_ctes([*MARKET, *Q.forms_chain()], "SELECT page_id, form_no, action, method, inputs FROM forms")
ORACLE["nofollow_pages"] = Q.with_ctes(
    [*MARKET, *Q.meta_chain()], "SELECT page_id, robots_meta FROM meta WHERE contains(lower(robots_meta), 'nofollow')"
)
ORACLE["html_only"] = (
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/HTML; charset=utf-8' WHEN 1 THEN 'application/xml' ELSE '' END AS content_type "
    "FROM pages WHERE page_id % 4 <> 3 AND html <> ''"
)

# Stored market pages: failures dropped, html blanked as in the snapshot fixture.
_BLANKED = f"""SELECT page_id, url, CASE WHEN page_id % 38 = 0 THEN '' ELSE html END AS html FROM ({D.for_oracle(D.MARKET_PAGES)})
  WHERE NOT (page_id % 19 = 0 AND page_id % 38 = 0)"""
_endpoint = "(?i)" + ENDPOINT_PATTERN.format(s=SPACE_CLASS)
_tech = " UNION ALL ".join(
    f"SELECT page_id, {10 + i} AS o, {lit(name)} AS t FROM clean WHERE regexp_matches(html, {lit('(?i)' + p)})"
    for i, (p, name, _) in enumerate(TECH_SIGNATURES)
)


def _distinct_tech(rows: str) -> str:
    return (
        f"SELECT page_id, array_to_string(list(t ORDER BY o), '|') AS tech FROM "
        f"(SELECT page_id, t, min(o) AS o FROM ({rows}) WHERE t IS NOT NULL AND t <> '' GROUP BY page_id, t) GROUP BY page_id"
    )


RECORDS = [
    f"src AS MATERIALIZED ({_BLANKED})",
    *Q.html_chain("src"),
    *Q.links_chain(),
    *Q.assets_chain(),
    *Q.meta_chain(),
    *Q.forms_chain(),
    f"""kept AS (SELECT page_id, array_to_string(list(dst_url ORDER BY ord), '|') AS links, count(*)::INTEGER AS n FROM links JOIN meta USING (page_id, page_url)
        WHERE {Q.host('dst_url')} = {Q.host('page_url')} AND NOT contains(lower(robots_meta), 'nofollow') GROUP BY page_id)""",
    "files AS (SELECT page_id, array_to_string(list(type || ' ' || url ORDER BY ord), '|') AS assets, count(*)::INTEGER AS n FROM assets GROUP BY page_id)",
    "fms AS (SELECT page_id, count(*)::INTEGER AS n, array_to_string(list(action ORDER BY form_no), '|') AS actions FROM forms GROUP BY page_id)",
    f"eps AS (SELECT page_id, len(list_distinct(regexp_extract_all(html, {lit(_endpoint)}, 1)))::INTEGER AS n FROM clean)",
    f"tec AS ({_distinct_tech('SELECT page_id, 5 AS o, generator AS t FROM meta UNION ALL ' + _tech)})",
    """records AS MATERIALIZED (SELECT m.page_id, c.url, m.page_url AS finalUrl, CASE WHEN m.page_id % 19 = 0 THEN 500 ELSE 200 END AS status,
        (m.page_id % 4)::INTEGER AS depth, strlen(c.html)::BIGINT AS bytes,
        CASE WHEN m.page_id % 4 = 0 THEN 'browser' ELSE 'http' END || CASE WHEN m.page_id % 8 = 0 THEN '+esc' ELSE '' END AS renderedWith,
        title, coalesce(kept.links, '') AS links, coalesce(files.assets, '') AS assets, coalesce(fms.n, 0) AS forms, eps.n AS endpoints,
        6 AS missing, coalesce(tec.tech, '') AS tech, coalesce(kept.n, 0) AS nlinks, coalesce(files.n, 0) AS nassets, coalesce(fms.actions, '') AS actions
        FROM meta m JOIN clean c USING (page_id) JOIN eps USING (page_id) LEFT JOIN kept USING (page_id) LEFT JOIN files USING (page_id)
        LEFT JOIN fms USING (page_id) LEFT JOIN tec USING (page_id))""",
]
ORACLE["page_records"] = Q.with_ctes(RECORDS, "SELECT * EXCLUDE (nlinks, nassets, actions) FROM records")
ORACLE["link_graph"] = Q.with_ctes(RECORDS, "SELECT url, links FROM records")
ORACLE["forms_by_page"] = Q.with_ctes(RECORDS, "SELECT finalUrl AS page, forms, actions FROM records WHERE forms > 0")
ORACLE["csv_rows"] = Q.with_ctes(
    RECORDS,
    'SELECT url, status, depth, title, \'text/html\' AS "contentType", bytes, nlinks AS "linkCount", nassets AS "assetCount", "renderedWith" FROM records',
)
ORACLE["page_counts"] = Q.with_ctes(RECORDS, "SELECT page_id, nlinks AS links, nassets AS assets FROM records")
ORACLE["hosts_seen"] = Q.with_ctes(RECORDS, f"SELECT DISTINCT {Q.host('url')} AS host FROM records")


def _decoded(u: str) -> str:
    return f"url_decode(replace({Q.path(u)}, '+', '%2B'))"


def _mirror(u: str, index: str) -> str:
    full = f"CASE WHEN ends_with({_decoded(u)}, '/') THEN {_decoded(u)} || {index} ELSE {_decoded(u)} END"
    segs = (
        f"list_transform(list_filter(string_split({full}, '/'), lambda s: s <> ''), "
        f"lambda s: CASE WHEN {Q.safe('s')} = '' THEN 'seg' ELSE {Q.safe('s')} END)"
    )
    last = f"({segs})[-1]"
    tag = f"'__' || {Q.fnv(Q.query(u))}"
    named = (
        f"CASE WHEN {Q.query(u)} = '' THEN {last} WHEN regexp_matches({last}, '^.+\\.[^.]*$') "
        f"THEN regexp_replace({last}, '\\.[^.]*$', '') || {tag} || regexp_extract({last}, '\\.[^.]*$') ELSE {last} || {tag} END"
    )
    return f"array_to_string(list_concat([{Q.safe(Q.host(u))}], ({segs})[:-2], [{named}]), '/')"


ORACLE["page_mirror"] = Q.with_ctes(
    GIVEN[:1] + Q.canonical("pg", "(SELECT *, NULL::VARCHAR AS nobase FROM src)", raw="url", base="nobase", out="u"),
    f"SELECT page_id, {Q.host('u')} AS host, 'pages/' || {_mirror('u', lit('index.html'))} AS path, strlen(html)::INTEGER AS bytes FROM pg WHERE html <> ''",
)
ORACLE["mirror_paths"] = Q.with_ctes(REFS, f"SELECT page_id, {_mirror('url', lit('index.html'))} AS path FROM ok")

# --- recon -----------------------------------------------------------------------------


def _matches(pattern: str, group: int) -> str:
    return f"regexp_extract_all(html, {lit(pattern)}, {group})"


_EMAIL = rf"\b[{EMAIL_LOCAL}]+@{EMAIL_HOST}\b"
_PHONE = rf"(?:tel:)?\+[0-9][0-9{SPACE_CLASS}().-]{{6,16}}[0-9]"


def recon_chain(src: str) -> list[str]:
    """CTEs ``em, ph, ep, cm, se``: (page_id, page_url, ord, subtype, value) per kind."""

    def ranked(name: str, items: str, value: str, keep: str) -> str:
        return f"""{name} AS (SELECT page_id, page_url, row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS ord, value FROM
            (SELECT page_id, page_url, i, {value} AS value FROM (SELECT page_id, page_url, unnest({items}) AS m, generate_subscripts({items}, 1) AS i FROM {src}))
            WHERE {keep} GROUP BY page_id, page_url, value)"""

    tidy = trim(f"regexp_replace(m, '[{SPACE_CLASS}]+', ' ', 'g')")
    secret_rows = " UNION ALL ".join(
        "SELECT page_id, page_url, {i} AS p, {t} AS subtype, unnest({l}) AS value, generate_subscripts({l}, 1) AS k FROM {s}".format(
            i=i,
            t=lit(label),
            l=_matches(
                ("(?i)" if flags else "") + pattern.format(b=r"\b", e=r"\b", s=SPACE_CLASS), 1 if "([" in pattern else 0
            ),
            s=src,
        )
        for i, (label, flags, pattern, _) in enumerate(SECRET_PATTERNS)
    )
    return [
        ranked(
            "em", _matches(_EMAIL, 0), "lower(m)",
            f"NOT regexp_matches(value, '{EMAIL_REJECTED_ENDINGS}$') AND NOT regexp_matches(value, '@[0-9]')",
        ),
        ranked("ph", _matches(_PHONE, 0), trim("regexp_replace(m, '^tel:', '')"), "true"),
        ranked("ep", _matches(_endpoint, 1), "m", "true"),
        f"""cm AS (SELECT page_id, page_url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ord, value FROM
            (SELECT page_id, page_url, i, {tidy} AS value FROM (SELECT page_id, page_url, unnest({_matches('(?s)<!--(.*?)-->', 1)}) AS m,
            generate_subscripts({_matches('(?s)<!--(.*?)-->', 1)}, 1) AS i FROM {src})) WHERE value <> ''
            AND regexp_matches(value, {lit('(?i)(' + COMMENT_KEYWORDS + ')')}))""",
        f"se AS (SELECT page_id, page_url, subtype, value, row_number() OVER (PARTITION BY page_id ORDER BY p, k) - 1 AS ord FROM ({secret_rows}))",
    ]


def _mask(v: str) -> str:
    return f"CASE WHEN len({v}) > 10 THEN left({v}, 4) || '…' || right({v}, 3) ELSE '***' END"


INTEL = [Q.source("it", D.INTEL_PAGES), *recon_chain("it")]
ALL_FINDINGS = [
    *INTEL,
    """fi0 AS (SELECT page_id, page_url, 1 AS g, ord, 'email' AS kind, NULL::VARCHAR AS subtype, value FROM em
        UNION ALL SELECT page_id, page_url, 2, ord, 'phone', NULL, value FROM ph
        UNION ALL SELECT page_id, page_url, 4, ord, 'endpoint', NULL, value FROM ep
        UNION ALL SELECT page_id, page_url, 5, ord, 'secret', subtype, value FROM se
        UNION ALL SELECT page_id, page_url, 6, ord, 'comment', NULL, value FROM cm)""",
    f"fi AS MATERIALIZED (SELECT * REPLACE (CASE WHEN kind = 'secret' THEN {_mask('value')} ELSE value END AS value), value AS raw FROM fi0)",
    "df AS (SELECT kind, value, arg_min(page_url, (page_id, g, ord)) AS page_url, min((page_id, g, ord)) AS o FROM fi WHERE kind IN ('email', 'phone', 'endpoint') GROUP BY ALL)",
    """kept AS MATERIALIZED (SELECT kind, NULL::VARCHAR AS subtype, value, page_url, o FROM df
        UNION ALL SELECT kind, subtype, value, page_url, (page_id, g, ord) AS o FROM fi WHERE kind IN ('secret', 'comment'))""",
]
ORACLE["emails"] = Q.with_ctes(INTEL, "SELECT page_id, ord, value AS email FROM em")
ORACLE["phones"] = Q.with_ctes(INTEL, "SELECT page_id, ord, value AS phone FROM ph")
ORACLE["document_contacts"] = Q.with_ctes(
    ["it AS (SELECT doc_id AS page_id, '' AS page_url, text AS html FROM documents)", *recon_chain("it")],
    "SELECT page_id, ord, value, 'email' AS kind FROM em UNION ALL SELECT page_id, ord, value, 'phone' FROM ph",
)
ORACLE["secrets"] = Q.with_ctes(INTEL, "SELECT page_id, ord, subtype AS type, sha256(value) AS value_hash FROM se")
ORACLE["masked_secrets"] = Q.with_ctes(INTEL, f"SELECT page_id, subtype, {_mask('value')} AS value FROM se")
ORACLE["endpoints"] = Q.with_ctes(INTEL, "SELECT page_id, ord, value AS endpoint FROM ep")
ORACLE["comments"] = Q.with_ctes(INTEL, "SELECT page_id, ord, value AS comment FROM cm")
ORACLE["social_links"] = Q.with_ctes(
    [*MARKET, *Q.links_chain()],
    f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS ord, dst_url AS url FROM links
    WHERE regexp_replace({Q.host('dst_url')}, '^www\\.', '') IN {inlist(SOCIAL_HOSTS)}""",
)
ORACLE["distinct_findings"] = Q.with_ctes(ALL_FINDINGS, "SELECT kind, value, page_url FROM df")
ORACLE["intel_counts"] = Q.with_ctes(
    ALL_FINDINGS,
    "SELECT kind, CASE WHEN kind IN ('secret', 'comment') THEN count(*) ELSE count(DISTINCT value) END AS n FROM fi GROUP BY kind",
)
ORACLE["page_intel_counts"] = Q.with_ctes(
    INTEL,
    """SELECT it.page_id, (SELECT count(*) FROM em WHERE em.page_id = it.page_id)::INTEGER AS emails,
    (SELECT count(*) FROM se WHERE se.page_id = it.page_id)::INTEGER AS secrets,
    (SELECT count(*) FROM ep WHERE ep.page_id = it.page_id)::INTEGER AS endpoints FROM it""",
)
ORACLE["run_caps"] = Q.with_ctes(ALL_FINDINGS, "SELECT kind, subtype, value, page_url, o[1] AS page_id FROM kept")
ORACLE["capped_findings"] = Q.with_ctes(
    ALL_FINDINGS,
    "SELECT kind, value, o[1] AS page_id FROM kept WHERE kind <> 'comment'",
)

_HEADERS = {
    "content-security-policy": "content_security_policy",
    "strict-transport-security": "strict_transport_security",
}
_missing = " UNION ALL ".join(
    f"SELECT page_id, {i} AS i, {lit(h)} AS header, coalesce({_HEADERS.get(h, 'NULL')}, '') AS v FROM hd"
    for i, h in enumerate(SECURITY_HEADERS)
)
AUDIT = [Q.source("hd", D.HEADERS), f"hh AS (SELECT * FROM ({_missing}))"]
ORACLE["security_audit"] = Q.with_ctes(
    AUDIT,
    """SELECT hd.page_id, starts_with(lower(url), 'https:') AS https,
    (SELECT coalesce(string_agg(header, '|' ORDER BY i), '') FROM hh WHERE hh.page_id = hd.page_id AND v = '') AS missing,
    (SELECT coalesce(string_agg(header || '=' || v, '|' ORDER BY header), '') FROM hh WHERE hh.page_id = hd.page_id AND v <> '') AS present FROM hd""",
)
ORACLE["missing_headers"] = Q.with_ctes(AUDIT, "SELECT header, count(*) AS pages FROM hh WHERE v = '' GROUP BY header")
ORACLE["cookie_issues"] = Q.with_ctes(
    AUDIT,
    """SELECT * FROM (SELECT page_id, array_to_string(list_filter([
      CASE WHEN NOT contains(lower(set_cookie), 'httponly') THEN 'Set-Cookie missing HttpOnly' END,
      CASE WHEN NOT regexp_matches(lower(set_cookie), ';\\s*secure') THEN 'Set-Cookie missing Secure' END,
      CASE WHEN NOT contains(lower(set_cookie), 'samesite') THEN 'Set-Cookie missing SameSite' END], lambda x: x IS NOT NULL), '|') AS issues
    FROM hd WHERE set_cookie <> '') WHERE issues <> ''""",
)
ORACLE["tech_fingerprint"] = Q.with_ctes(
    [
        *MARKET,
        *Q.meta_chain(),
        "tt AS ("
        + _distinct_tech(
            "SELECT page_id, 0 AS o, 'Server: nginx' AS t FROM meta WHERE page_id % 3 = 0 UNION ALL "
            "SELECT page_id, 4, 'Cloudflare' FROM meta WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 5, generator FROM meta UNION ALL "
            + _tech
        )
        + ")",
    ],
    "SELECT page_id, coalesce(tech, '') AS tech FROM meta LEFT JOIN tt USING (page_id)",
)

# --- robots and hosts -------------------------------------------------------------------------


def allowed_chain(urls: str, rules: str = "rules JOIN grp USING (host, group_no)") -> list[str]:
    """CTE ``verdict`` (url, allowed) for a CTE with ``url`` and rules ``host, line, allow, path``."""
    rx = (
        "'^' || replace(regexp_replace(regexp_replace(path, '\\$$', ''), '([.+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*')"
        " || CASE WHEN ends_with(path, '$') THEN '$' ELSE '' END"
    )
    return [
        f"ur AS (SELECT DISTINCT url, regexp_extract(url, '^https?://([^/?]*)', 1) AS host, {Q.path('url')} || {Q.query('url')} AS target FROM {urls})",
        f"mine AS (SELECT host, line, allow, len(path) AS w, {rx} AS rx FROM {rules} WHERE path <> '')",
        """verdict AS MATERIALIZED (SELECT url, coalesce(arg_max(allow, (w, -line)), true) AS allowed FROM
            (SELECT ur.url, m.allow, m.w, m.line FROM ur LEFT JOIN mine m ON m.host = ur.host AND regexp_matches(ur.target, m.rx)) GROUP BY url)""",
    ]


EDGES = [Q.source("edges", D.EDGES)]
ORACLE["robots_allowed"] = Q.with_ctes(
    [*ROBOTS_LINES, *EDGES, "u AS (SELECT dst AS url FROM edges)", *allowed_chain("u")],
    "SELECT ord, dst AS url, allowed FROM edges JOIN verdict ON verdict.url = edges.dst",
)
ORACLE["robots_many_rules"] = Q.with_ctes(
    [Q.source("many", D.RULE_ROWS), *EDGES, "u AS (SELECT dst AS url FROM edges)", *allowed_chain("u", "many")],
    "SELECT ord, dst AS url, allowed FROM edges JOIN verdict ON verdict.url = edges.dst",
)
ORACLE["host_delay"] = Q.with_ctes(
    [*ROBOTS_LINES, Q.source("log", D.FETCHES)],
    """SELECT h.host, greatest(1000.0::DOUBLE, coalesce(crawl_delay * 1000, 0)::DOUBLE) AS delay_ms FROM (SELECT DISTINCT host FROM log) h
    LEFT JOIN grp USING (host) LEFT JOIN delay USING (host, group_no)""",
)

# --- frontier ------------------------------------------------------------------------------------

_LEVELS = 4
_BUDGET = 150


def frontier_chain(sitemaps: bool = False) -> list[str]:
    start = """SELECT url, NULL::VARCHAR AS parent, row_number() OVER (ORDER BY min(seed_no)) AS rank, min(seed_no)::VARCHAR AS place
        FROM seeds GROUP BY url"""
    if sitemaps:
        start += """ UNION ALL SELECT url, parent, (SELECT count(DISTINCT url) FROM seeds) + row_number() OVER (ORDER BY seed_no, c, place), ''
            FROM added"""
    ctes = [
        *(sitemap_chain(True) if sitemaps else [*ROBOTS_LINES, Q.source("seeds", D.SEEDS)]),
        *EDGES,
        "site AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY min(ord)) - 1 AS n FROM edges GROUP BY src, dst)",
        "hasp AS (SELECT DISTINCT src FROM site)",
        "u AS (SELECT dst AS url FROM edges UNION SELECT src FROM edges UNION SELECT url FROM seeds"
        + (" UNION SELECT url FROM added)" if sitemaps else ")"),
        *allowed_chain("u"),
        f"v0 AS MATERIALIZED ({start})",
    ]
    for k in range(_LEVELS + 1):
        ctes.append(
            f"""w{k} AS MATERIALIZED (SELECT v.*, CASE WHEN NOT allowed THEN 'robots' WHEN hasp.src IS NULL THEN 'error' ELSE 'page' END AS disposition
            FROM v{k} v JOIN verdict USING (url) LEFT JOIN hasp ON hasp.src = v.url)"""
        )
        if k == _LEVELS:
            break
        seen = " UNION ALL ".join(f"SELECT url FROM v{i}" for i in range(k + 1))
        ctes.append(
            f"""v{k + 1} AS MATERIALIZED (SELECT url, parent, row_number() OVER (ORDER BY o) AS rank, place FROM
            (SELECT s.dst AS url, arg_min(w.url, (w.rank, s.n)) AS parent, min((w.rank, s.n)) AS o, arg_min(w.place || '.' || s.n, (w.rank, s.n)) AS place
             FROM w{k} w JOIN site s ON s.src = w.url WHERE w.disposition = 'page' AND {Q.domain(Q.host('s.dst'))} = 'example.com'
             AND NOT regexp_matches(s.dst, '(?i)/p/[0-9]*9$') AND s.dst NOT IN (SELECT url FROM ({seen})) GROUP BY s.dst))"""
        )
    union = " UNION ALL ".join(f"SELECT url, {k}::INTEGER AS depth, parent, rank, place, disposition FROM w{k}" for k in range(_LEVELS + 1))
    ctes.append(f"visits AS MATERIALIZED ({union})")
    return ctes


FRONTIER = frontier_chain()
ORACLE["frontier_bfs"] = Q.with_ctes(FRONTIER, "SELECT url, depth, parent, disposition FROM visits")
ORACLE["frontier_from_sitemaps"] = Q.with_ctes(frontier_chain(True), "SELECT url, depth, parent, disposition FROM visits")
ORACLE["crawl_order"] = Q.with_ctes(FRONTIER, "SELECT url, depth, place FROM visits")
ORACLE["page_budget"] = Q.with_ctes(
    [
        *FRONTIER,
        f"cut AS (SELECT max((depth, rank)) AS c FROM (SELECT depth, rank FROM visits WHERE disposition = 'page' ORDER BY depth, rank LIMIT {_BUDGET}))",
        "par AS (SELECT v.*, p.rank AS prank FROM visits v LEFT JOIN visits p ON p.url = v.parent)",
    ],
    """SELECT url, depth, CASE WHEN (depth, rank) > c THEN 'queued' ELSE disposition END AS disposition FROM par, cut
    WHERE depth <= c[1] OR (depth = c[1] + 1 AND prank <= c[2])""",
)
ORACLE["known_links"] = Q.with_ctes(
    FRONTIER, "SELECT ord, src AS src_url, dst AS dst_url FROM edges WHERE dst IN (SELECT url FROM visits)"
)

# --- assets ---------------------------------------------------------------------------------------

PAY = [Q.source("pay0", D.PAYLOADS), f"pay AS MATERIALIZED (SELECT *, {Q.sniff('hex_bytes')} AS sniffed FROM pay0)"]
ORACLE["ctype_ext"] = Q.with_ctes(PAY, f"SELECT asset_id, {Q.ctype_ext('content_type')} AS ext FROM pay")
ORACLE["sniff_types"] = Q.with_ctes(PAY, "SELECT asset_id, sniffed FROM pay")
PLAN = [
    *PAY,
    f"plan AS (SELECT url, arg_min(type, asset_id) AS type, min(asset_id) AS page_id FROM pay WHERE type IN ('images', 'documents', 'media', 'archives') AND NOT {Q.tracker('url')} GROUP BY url)",
    "got AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY asset_id) AS n FROM pay WHERE asset_id IN (SELECT c_custkey FROM customer)) WHERE n = 1)",
]


def _outcomes(limit: int) -> str:
    cap = f"{limit} > 0 AND"
    html = f"p.type IN {inlist(BINARY_CATEGORIES)} AND (g.sniffed = 'html' OR contains(lower(g.content_type), 'text/html')) AND NOT (g.sniffed = 'svg' OR contains(g.content_type, 'image/svg'))"
    size = "len(g.hex_bytes) // 2"
    return f"""outc AS MATERIALIZED (SELECT p.url, p.type, p.page_id, g.content_type, g.sniffed,
      CASE WHEN http_status = 200 AND {cap} declared_bytes > {limit} THEN 'skipped' WHEN http_status IS NULL OR http_status <> 200 THEN 'error'
        WHEN {cap} {size} > {limit} THEN 'skipped' WHEN {html} THEN 'skipped' ELSE 'ok' END AS status,
      CASE WHEN http_status = 200 AND {cap} declared_bytes > {limit} THEN 'too-large' WHEN http_status IS NULL THEN 'http-0' WHEN http_status <> 200 THEN coalesce(nullif(g.error, ''), 'http-' || http_status)
        WHEN {cap} {size} > {limit} THEN 'too-large' WHEN {html} THEN 'not-a-file (server returned HTML)' END AS reason,
      CASE WHEN http_status = 200 AND {cap} declared_bytes > {limit} THEN declared_bytes WHEN http_status IS NULL OR http_status <> 200 THEN NULL
        WHEN {cap} {size} > {limit} THEN {size} WHEN {html} THEN NULL ELSE {size} END AS bytes
      FROM plan p LEFT JOIN got g USING (url))"""


ORACLE["asset_plan"] = Q.with_ctes(PLAN, "SELECT * FROM plan")
ORACLE["asset_outcomes"] = Q.with_ctes([*PLAN, _outcomes(40000)], "SELECT url, type, status, reason, bytes FROM outc")
ORACLE["downloads_by_type"] = Q.with_ctes(
    [*PLAN, _outcomes(0)], "SELECT type, count(*) AS files FROM outc WHERE status = 'ok' GROUP BY type"
)
_real = "CASE WHEN sniffed NOT IN ('', 'html', 'xml') THEN sniffed END"
_repaired = "coalesce({real}, nullif({ct}, ''), nullif({ext}, ''))".format(
    real=_real, ct=Q.ctype_ext("content_type"), ext=Q.ext("url")
)


def _stored_path(index: str) -> str:
    m = _mirror("url", index)
    return f"'assets/' || type || '/' || {m} || CASE WHEN NOT regexp_matches({m}, '[^/]\\.[^./]*$') AND {_repaired} IS NOT NULL THEN '.' || {_repaired} ELSE '' END"


_index = f"'asset_' || {Q.fnv('url')} || '.bin'"
ORACLE["ext_repair"] = Q.with_ctes(PAY, f"SELECT asset_id, {_stored_path(_index)} AS path FROM pay")
ORACLE["file_list"] = Q.with_ctes(
    [*PLAN, _outcomes(0)], f"SELECT {_stored_path(_index)} || chr(9) || bytes AS value FROM outc WHERE status = 'ok'"
)
_last = f"list_filter(string_split({Q.path('url')}, '/'), lambda s: s <> '')[-1]"
ORACLE["ext_paths"] = Q.with_ctes(
    [
        *PAY,
        f"ep0 AS (SELECT asset_id, url, lower(coalesce({_real}, nullif({Q.ext('url')}, ''), nullif({Q.ctype_ext('content_type')}, ''), 'other')) AS folder, {Q.safe('url_decode(' + _last + ')')} AS base FROM pay)",
        "ep1 AS (SELECT asset_id, url, folder, CASE WHEN regexp_matches(base, '.\\.[^.]*$') THEN base ELSE base || '.' || folder END AS name FROM ep0)",
        "ep2 AS (SELECT *, row_number() OVER (PARTITION BY lower(folder || '/' || name) ORDER BY asset_id) AS n FROM ep1)",
    ],
    f"""SELECT asset_id, 'assets/' || folder || '/' || CASE WHEN n = 1 THEN name
    ELSE regexp_replace(name, '\\.[^.]*$', '') || '__' || {Q.fnv('url')} || regexp_extract(name, '\\.[^.]*$') END AS path FROM ep2""",
)

# --- fetch log --------------------------------------------------------------------------------------

LOG = [Q.source("log", D.FETCHES)]
ORACLE["status_class"] = Q.with_ctes(
    LOG,
    "SELECT event_id, CASE status // 100 WHEN 2 THEN 'ok' WHEN 3 THEN 'warn' ELSE 'err' END AS status_class FROM log",
)
_ok = "(status BETWEEN 200 AND 299)"
_blocked = f"""(NOT {_ok} AND status IN {(0, *BLOCKED_STATUSES)}) OR ({_ok} AND html <> '' AND
    (len(html) < 600 OR {' OR '.join(f"contains(lower(html), {lit(m)})" for m in CHALLENGE_MARKERS)}))"""
ORACLE["blocked_pages"] = Q.with_ctes(LOG, f"SELECT event_id, status FROM log WHERE {_blocked}")
ORACLE["crawl_errors"] = Q.with_ctes(
    LOG, f"SELECT url, 'HTTP ' || status AS message, 0 AS depth, ts FROM log WHERE NOT {_ok} AND html = ''"
)
ORACLE["request_attempts"] = Q.with_ctes(
    [*LOG, f"a AS (SELECT *, {_ok} OR html <> '' OR status NOT IN (0, 429, 500, 502, 503, 504) AS fin FROM log)"],
    """SELECT request, count(*) AS attempts, arg_max(status, attempt) AS status,
    coalesce(max(attempt) - min(attempt) FILTER (fin), 0)::BIGINT AS late FROM a GROUP BY request""",
)
ORACLE["host_gaps"] = Q.with_ctes(
    [
        *LOG,
        "a AS (SELECT host, epoch_us(ts) // 1000 AS at_ms FROM log)",
        "b AS (SELECT *, at_ms - lag(at_ms) OVER (PARTITION BY host ORDER BY at_ms) AS gap FROM a)",
    ],
    "SELECT host, count(*) AS requests, min(gap) AS min_gap_ms, count(*) FILTER (gap < 60000) AS close_gaps FROM b GROUP BY host",
)
ORACLE["latest_rows"] = Q.with_ctes(
    LOG,
    "SELECT host, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC) AS n FROM log) WHERE n <= 20",
)

ORACLE["frontier_as_of"] = ORACLE["frontier_bfs"]
ORACLE["pages_as_of"] = Q.with_ctes(
    LOG,
    """SELECT url, event_id AS page_id, status FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) AS n
    FROM log WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') WHERE n = 1""",
)

# --- run accounting -----------------------------------------------------------------------------------


def _sub(name: str, what: str) -> str:
    return f"(SELECT {what} FROM ({ORACLE[name]}))"


_links_seen = Q.with_ctes(
    FRONTIER,
    f"""SELECT count(*) FILTER ({Q.domain(Q.host('s.dst'))} <> 'example.com') AS outside,
    count(*) FILTER ({Q.domain(Q.host('s.dst'))} = 'example.com' AND v.depth < 4 AND regexp_matches(s.dst, '(?i)/p/[0-9]*9$') AND s.dst NOT IN (SELECT url FROM seeds)) AS refused
    FROM visits v JOIN site s ON s.src = v.url WHERE v.disposition = 'page'""",
)
_all_outcomes = Q.with_ctes([*PLAN, _outcomes(0)], "SELECT status, bytes FROM outc")
_secret_rows = Q.with_ctes(ALL_FINDINGS, "SELECT kind, raw FROM fi")
ORACLE["crawl_stats"] = f"""SELECT {_sub('page_records', 'count(*)')} AS crawled, 0::BIGINT AS queued,
  {_sub('crawl_errors', 'count(*)')} + (SELECT count(*) FROM ({_all_outcomes}) WHERE status = 'error') AS errors,
  (SELECT count(*) FROM ({_all_outcomes}) WHERE status = 'ok') AS downloaded,
  (SELECT sum(bytes) FROM ({_all_outcomes}) WHERE status = 'ok')::BIGINT AS "downloadedBytes",
  {_sub('page_records', 'sum(bytes)')}::BIGINT AS "pageBytes",
  (SELECT count(*) FROM part WHERE p_partkey % 8 = 0) AS escalated,
  {_sub('frontier_bfs', '''count(*) FILTER (disposition = 'robots')''')} AS "blockedByRobots",
  (SELECT outside FROM ({_links_seen})) AS "outOfScope", (SELECT refused FROM ({_links_seen})) AS filtered,
  {_sub('page_records', 'sum(forms)')}::BIGINT AS forms,
  (SELECT count(*) FROM ({_secret_rows}) WHERE kind = 'secret') AS secrets,
  (SELECT count(DISTINCT raw) FROM ({_secret_rows}) WHERE kind = 'email') AS emails"""
_kept_kinds = {k: f"(SELECT count(*) FROM ({Q.with_ctes(ALL_FINDINGS, 'SELECT kind FROM kept')}) WHERE kind = '{k}')" for k in ("email", "phone", "social", "endpoint", "secret", "comment")}
ORACLE["run_summary"] = (
    f"SELECT {_sub('page_records', 'count(*)')} AS crawled, ({_sub('page_records', 'sum(bytes)')} + (SELECT sum(bytes) FROM ({_all_outcomes}) WHERE status = 'ok'))::BIGINT AS \"totalBytes\", "
    f"{_sub('hosts_seen', 'count(*)')} AS hosts, " + ", ".join(f"{v} AS {k}s" for k, v in _kept_kinds.items())
)

# --- sinks: what is written is read back -------------------------------------------------------------------

ORACLE["sink_errors"] = "SELECT url, message, depth FROM (" + ORACLE["crawl_errors"] + ")"
ORACLE["sink_assets_index"] = Q.with_ctes([*PLAN, _outcomes(0)], "SELECT url, type, bytes FROM outc WHERE status = 'ok'")
ORACLE["sink_intel"] = Q.with_ctes(ALL_FINDINGS, "SELECT kind, value, page_url FROM fi")
ORACLE["sink_security"] = ORACLE["security_audit"]
ORACLE["sink_ndjson"] = Q.with_ctes(RECORDS, "SELECT page_id, url, title, nlinks AS links FROM records")
def _exported(part: str, rows: str, *columns: str) -> str:
    content = " || '|' || ".join(f"coalesce(({c})::VARCHAR, '')" for c in columns)
    return f"SELECT '{part}' AS part, {content} AS content FROM ({rows})"


ORACLE["sink_full_export"] = " UNION ALL ".join(
    [
        _exported("pages", Q.with_ctes(RECORDS, "SELECT * FROM records"), "page_id", "url", '"finalUrl"', "status", "depth", "bytes", '"renderedWith"', "title", "nlinks", "nassets", "forms"),
        _exported("errors", ORACLE["crawl_errors"], "url", "message", "depth"),
        _exported("findings", ORACLE["run_caps"], "kind", "subtype", "value", "page_url"),
        _exported("assets", Q.with_ctes([*PLAN, _outcomes(0)], "SELECT * FROM outc"), "url", "type", "status", "reason", "bytes"),
    ]
)
ORACLE["sink_crawl_data"] = ORACLE["page_records"]
ORACLE["sink_summary"] = ORACLE["run_summary"]
ORACLE["sink_mirror"] = f"SELECT page_id, host, path, md5(html) AS digest FROM ({ORACLE['page_mirror']}) JOIN (SELECT page_id, html FROM pages) USING (page_id)"
ORACLE["sink_csv"] = ORACLE["csv_rows"]
ORACLE["json_text"] = Q.with_ctes(
    RECORDS, """SELECT page_id, '{"url":"' || url || '","depth":' || depth || ',"bytes":' || bytes || '}' AS text FROM records"""
)
ORACLE["extra_patterns"] = Q.with_ctes(
    INTEL,
    """SELECT page_id, m AS value FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)todo[^<]{1,8}')) AS m FROM it)""",
)
ORACLE["asset_payloads"] = (
    "SELECT url, strlen(html)::BIGINT AS declared_bytes, " + Q.sniff("upper(hex(encode(left(html, 64))))") + " AS sniffed FROM pages"
)

# --- streams ----------------------------------------------------------------------------------------------

ORACLE["stream_dedup"] = Q.with_ctes(LOG, "SELECT DISTINCT url AS canonical FROM log")
ORACLE["stream_assets"] = ORACLE["page_assets"]
ORACLE["given_assets"] = Q.with_ctes([*GIVEN, *Q.assets_chain()], "SELECT page_id, page_url, ord, url, type, via FROM assets")
ORACLE["stream_first_seen"] = ORACLE["stream_dedup"]
ORACLE["stream_first_findings"] = Q.with_ctes(
    INTEL,
    f"""SELECT DISTINCT 'email' AS kind, value FROM em UNION SELECT 'phone', value FROM ph UNION SELECT 'endpoint', value FROM ep
    UNION SELECT 'secret', {_mask('value')} FROM se UNION SELECT 'comment', value FROM cm""",
)
ORACLE["stream_crawl_stats"] = ORACLE["crawl_stats"]
ORACLE["given_meta"] = Q.with_ctes([*GIVEN, *Q.meta_chain()], "SELECT * FROM meta")
ORACLE["given_forms"] = Q.with_ctes([*GIVEN, *Q.forms_chain()], "SELECT page_id, form_no, action, method, inputs FROM forms")
ORACLE["stream_records"] = Q.with_ctes(
    [*GIVEN, *Q.links_chain(), *Q.meta_chain(),
     f"""lk AS (SELECT page_id, count(*)::INTEGER AS n FROM links JOIN meta USING (page_id, page_url) WHERE {Q.host('dst_url')} = {Q.host('page_url')}
         AND NOT contains(lower(robots_meta), 'nofollow') GROUP BY page_id)"""],
    """SELECT m.page_id, c.url, strlen(c.html)::BIGINT AS bytes, m.title, coalesce(lk.n, 0) AS links
    FROM meta m JOIN clean c USING (page_id) LEFT JOIN lk USING (page_id)""",
)
ORACLE["stream_findings"] = Q.with_ctes(
    ["it AS (SELECT page_id, '' AS page_url, html FROM pages)", *recon_chain("it")],
    f"""SELECT DISTINCT 'email' AS kind, value FROM em UNION SELECT 'phone', value FROM ph UNION SELECT 'endpoint', value FROM ep
    UNION SELECT 'secret', {_mask('value')} FROM se UNION SELECT 'comment', value FROM cm""",
)
ORACLE["stream_stats"] = Q.with_ctes(
    LOG,
    f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) FILTER ({_ok} OR html <> '') AS crawled,
    count(*) FILTER (NOT {_ok} AND html = '') AS errors, sum(strlen(html))::BIGINT AS page_bytes, count(*) FILTER ({_blocked}) AS blocked
    FROM log GROUP BY 1""",
)
ORACLE["stream_host_rate"] = Q.with_ctes(
    LOG,
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, host, count(*) AS requests FROM log GROUP BY ALL",
)

# Positions are 32-bit in Spark arrays; give them the same type here.
for _column, _names in {
    "ord": (
        "seeds", "bad_seeds", "html_tags", "page_links", "market_links", "stream_links", "page_assets", "srcset_urls",
        "css_urls", "stream_assets", "given_assets", "emails", "phones", "document_contacts", "secrets", "endpoints", "comments", "social_links",
    ),
    "line": ("robots_rules",),
    "form_no": ("page_forms", "given_forms"),
}.items():
    for _name in _names:
        ORACLE[_name] = f"SELECT * REPLACE (CAST({_column} AS INTEGER) AS {_column}) FROM (\n{ORACLE[_name]}\n)"
