"""Tables derived from the given ones, as SQL both engines read alike.

The given pages have no headers, statuses, robots files, forms or images, so
those inputs are computed from the given tables; they grow with them.  Table
names stand in braces.
"""

URL_REFS = """
SELECT page_id, url AS base, CASE page_id % 8
  WHEN 0 THEN replace(url, 'http', 'HTTP')
  WHEN 1 THEN '/a/' || cast(page_id AS string) || '.PDF#f'
  WHEN 2 THEN '../up/x.png?q=1'
  WHEN 3 THEN '//cdn.example.org/lib.min.js'
  WHEN 4 THEN 'mailto:a@example.com'
  WHEN 5 THEN 'https://WWW.Example.co.uk:443/p q/' || cast(page_id % 7 AS string)
  WHEN 6 THEN '?page=' || cast(page_id % 5 AS string)
  ELSE 'http://www.googletagmanager.com:80/gtm.js?id=' || cast(page_id % 9 AS string) END AS raw
FROM {pages}
"""

EDGES = """
SELECT o_orderkey AS ord,
  'https://h' || cast(o_custkey % (SELECT count(*) FROM {supplier}) AS string) || '.example.com/p/' || cast(o_custkey AS string) AS src,
  'https://h' || cast(d % (SELECT count(*) FROM {supplier}) AS string) || '.example.com/'
    || CASE WHEN d % 10 = 0 THEN 'private/' ELSE 'p/' END || cast(d AS string) AS dst
FROM (SELECT o_orderkey, o_custkey,
        (o_orderkey * 7 + o_custkey) % (SELECT count(*) + 1 FROM {customer}) AS d FROM {orders}) o
"""

MARKET_PAGES = """
SELECT p_partkey AS page_id,
  'https://s' || cast(p_partkey % 10 AS string) || '.example.com/dir/' || cast(p_partkey AS string) || '.html' AS url,
  '<!doctype html><html lang="en"><head><title> ' || p_name || ' Caf&eacute; &#8211; &amp;lt; x&#x2F;y </title><meta name="description" content="' || p_type
  || '"><meta property="og:type" content="product">'
  || CASE WHEN p_partkey % 11 = 0 THEN '<meta name="robots" content="noindex, NOFOLLOW">' ELSE '' END
  || CASE WHEN p_partkey % 9 = 0 THEN '<meta name="generator" content="WordPress 6.1">' ELSE '' END
  || CASE WHEN p_partkey % 6 = 0 THEN '<base href="/base/">' ELSE '' END
  || CASE WHEN p_partkey % 5 = 0 THEN '<link rel="canonical" href="../c/' || cast(p_partkey AS string) || '">' ELSE '' END
  || '<link rel="stylesheet" href="/s.css"><link rel="icon" href="f.ico"><link rel="preload" href="a.woff2"><style>.a{{background:url(bg'
  || cast(p_partkey % 3 AS string) || '.webp)}}</style><script src="/app.js"></script></head><body><a href="/p/'
  || cast(p_partkey % 50 AS string) || '">x</a><a title="a > b href=no" href="d' || cast(p_partkey % 4 AS string)
  || '.pdf?x=1&amp;y=2">d</a><a href=''https://twitter.com/b' || cast(p_partkey % 5 AS string)
  || '''>t</a><A HREF=/up/../q/é%20' || cast(p_partkey % 3 AS string)
  || '>u</A><a href="?a=1&#038;b=2&copy=3&amp;lt;4">r</a><a href="/p&#x2F;q&eacute;">e</a><iframe src="/fr"><a href="/not-a-link"></iframe><img src="i.png" data-src="l.jpg" srcset="s1.png 1x, s2.png 2x"><video src="v.mp4" poster="p.jpg"></video><picture><source srcset="w.webp 2x" src="clip.webm"></picture><div style="background:url(''h.webp'')"></div><form action="/login" method="POST"><input name="u"><input name="pw" type="password"><button name="go">Go</button></form>'
  || CASE WHEN p_partkey % 3 = 0 THEN '<form><select name="s"></select><textarea name="t"><input name="no"></textarea><input></form>' ELSE '' END
  || CASE p_partkey % 7
    WHEN 0 THEN '<!-- TODO: drop the debug token <a href="/c"> -->'
    WHEN 1 THEN '<script>fetch("/api/v1/i' || cast(p_partkey % 13 AS string) || '");var a="<a href=''/s''>";</script><div id="__NEXT_DATA__"></div>'
    WHEN 2 THEN '<!-- plain --><p class="wp-content">w</p>'
    ELSE '' END || '</body></html>' AS html
FROM {part}
"""

INTEL_PAGES = """
SELECT doc_id AS page_id, 'https://d' || cast(doc_id % 37 AS string) || '.example.com/t/' || cast(doc_id AS string) AS page_url,
  text || CASE doc_id % 12
    WHEN 0 THEN ' "AKIA' || upper(substr(md5(cast(doc_id AS string)),1,16)) || '" '
    WHEN 1 THEN ' ghp_' || md5(cast(doc_id AS string)) || substr(md5(cast(doc_id AS string)),1,8) || ' '
    WHEN 2 THEN ' sk_live_' || substr(md5(cast(doc_id AS string)),1,20) || ' '
    WHEN 3 THEN ' api_key = "' || substr(md5(cast(doc_id AS string)),1,24) || '" '
    WHEN 4 THEN ' AC' || md5(cast(doc_id AS string)) || ' '
    WHEN 5 THEN ' key-' || md5(cast(doc_id AS string)) || ' '
    WHEN 6 THEN ' eyJ' || substr(md5(cast(doc_id AS string)),1,10) || '.' || substr(md5(cast(doc_id AS string)),5,12) || '.' || substr(md5(cast(doc_id AS string)),9,16) || ' '
    WHEN 7 THEN ' -----BEGIN RSA PRIVATE KEY----- '
    WHEN 8 THEN ' xoxb-' || substr(md5(cast(doc_id AS string)),1,12) || ' '
    WHEN 9 THEN ' AIza' || md5(cast(doc_id AS string)) || 'abc '
    WHEN 10 THEN ' aws_secret_access_key="' || md5(cast(doc_id AS string)) || substr(md5(cast(doc_id AS string)),1,8) || '" '
    ELSE ' m' || cast(doc_id AS string) || '@Mail.example.com logo@2x.png tel:+1 555 010 ' || cast(1000 + doc_id % 9000 AS string) || ' ' END
  || CASE doc_id % 5
    WHEN 0 THEN ' fetch("/api/v2/d' || cast(doc_id % 40 AS string) || '") ''https://api.example.com/x' || cast(doc_id % 11 AS string) || ''' '
    WHEN 1 THEN ' <!-- TODO: remove   debug' || chr(10) || ' ' || cast(doc_id % 6 AS string) || ' --> <!-- plain --> '
    ELSE '' END AS html
FROM {documents}
"""

HEADERS = """
SELECT page_id, url, html, CASE page_id % 3 WHEN 0 THEN 'nginx' WHEN 1 THEN 'Apache' END AS server,
  CASE WHEN page_id % 4 = 0 THEN 'PHP/8.1' END AS x_powered_by,
  CASE WHEN page_id % 2 = 0 THEN 'default-src self' WHEN page_id % 5 = 0 THEN '' END AS content_security_policy,
  CASE WHEN page_id % 3 = 0 THEN 'max-age=1' END AS strict_transport_security,
  CASE page_id % 5 WHEN 0 THEN 'a=1; Secure; HttpOnly' WHEN 1 THEN 'a=1; SameSite=Lax' WHEN 2 THEN 'a=1' END AS set_cookie
FROM {pages}
"""

HEADER_BLOCKS = """
SELECT page_id, 'Server: ' || CASE page_id % 3 WHEN 0 THEN 'nginx' ELSE '' END || chr(10) || 'X-Trace:  a:' || cast(page_id AS string)
  || ' ' || chr(10) || chr(10) || ': none' || chr(10) || 'no colon' || chr(10) || 'x-trace: last' || cast(page_id % 4 AS string)
  || CASE WHEN page_id % 2 = 0 THEN chr(10) || 'Set-Cookie: a=1' ELSE '' END AS block
FROM {pages}
"""

PAYLOADS = """
SELECT p_partkey AS asset_id, 'https://c.example.com/' || cast(p_partkey % 9 AS string) || '/f' || cast(p_partkey % 40 AS string)
  || CASE p_partkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.pdf' ELSE '' END
  || CASE WHEN p_partkey % 13 = 0 THEN '?v=' || cast(p_partkey AS string) ELSE '' END AS url,
  CASE p_partkey % 5 WHEN 0 THEN 'images' WHEN 1 THEN 'documents' WHEN 2 THEN 'media' WHEN 3 THEN 'scripts' ELSE 'archives' END AS type,
  CASE p_partkey % 3 WHEN 0 THEN 'image/png; x=1' WHEN 1 THEN 'text/html' ELSE 'application/pdf' END AS content_type,
  CASE p_partkey % 10 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '474946383961'
    WHEN 3 THEN '524946460000000057454250' WHEN 4 THEN '255044462D312E34' WHEN 5 THEN '504B0304' WHEN 6 THEN '1F8B0800'
    WHEN 7 THEN '3C21444F43545950452068746D6C3E' WHEN 8 THEN '3C73766720786D6C6E733D2278223E' ELSE '0102' END AS hex_bytes,
  CASE WHEN p_partkey % 17 = 0 THEN 404 ELSE 200 END AS http_status,
  CASE WHEN p_partkey % 34 = 0 THEN 'ECONNRESET' WHEN p_partkey % 51 = 0 THEN '' END AS error,
  cast(p_size AS bigint) * 1000 AS declared_bytes
FROM {part}
"""

ROBOTS = """
SELECT 'h' || cast(s_suppkey AS string) || '.example.com' AS host,
  CASE WHEN s_suppkey % 5 = 3 THEN 'Disallow: /p/*3' || chr(10) ELSE '' END
  || 'User-agent: *' || chr(10) || 'Disallow: /private' || chr(10) || 'Allow: /private/public' || chr(13) || chr(10)
  || 'Crawl-delay: ' || cast(s_suppkey % 4 AS string) || '.5s' || chr(10)
  || 'Sitemap: https://h' || cast(s_suppkey AS string) || '.example.com/sm.xml' || chr(10)
  || CASE WHEN s_suppkey % 2 = 0 THEN 'User-agent: otherbot' || chr(10) || '# comment' || chr(10) || 'User-agent: corpusbot # us' || chr(10)
     || 'Disallow: /p/*1$' || chr(10) || 'Allow: /p/1*1$' || chr(10) || 'Disallow:' || chr(10) || 'Allow:' || chr(10) || 'broken line' ELSE '' END AS text
FROM {supplier}
"""

RULE_ROWS = """
SELECT 'h' || cast(c_custkey % 3 AS string) || '.example.com' AS host, c_custkey AS line, c_custkey % 4 <> 1 AS allow,
  CASE c_custkey % 5 WHEN 0 THEN '/p/' || cast(c_custkey % 97 AS string) || '*' || cast(c_custkey % 7 AS string) || '$'
    WHEN 1 THEN '/private/' || cast(c_custkey % 1000 AS string) WHEN 2 THEN '/p/' || cast(c_custkey * 7 % 1000 AS string) || '$'
    ELSE '/p/' || cast(c_custkey * 3 % 10000 AS string) END AS path
FROM {customer}
"""

SITEMAPS = """
SELECT 'https://h' || cast(s_suppkey AS string) || '.example.com/sm.xml' AS url,
  CASE WHEN s_suppkey % 3 = 0 THEN '<sitemapindex><sitemap><loc>https://h' || cast(s_suppkey + 1 AS string)
    || '.example.com/sm.xml</loc></sitemap><sitemap><LOC> https://h' || cast(s_suppkey + 2 AS string)
    || '.example.com/sm.xml </LOC></sitemap>' || CASE WHEN s_suppkey % 15 <> 12 THEN '<sitemap><loc>https://h'
    || cast(s_suppkey + 3 AS string) || '.example.com/sm.xml</loc></sitemap>' ELSE '' END || '</sitemapindex>'
  ELSE '<urlset><url><loc> https://h' || cast(s_suppkey AS string) || '.example.com/p/1 </loc></url><url><loc>https://H0.example.com/p/'
    || cast(s_suppkey % 7 AS string) || '#x</loc></url><url><loc>mailto:a@b.c</loc></url></urlset>' END AS xml
FROM {supplier}
"""

SEEDS = """
SELECT s_suppkey + 1000000 * k AS seed_no, 'https://h' || cast(s_suppkey % (SELECT count(*) FROM {supplier}) AS string) || '.example.com/'
  || CASE k WHEN 0 THEN 'p/' ELSE 'q/' END || cast(s_suppkey AS string) AS url
FROM {supplier}, (SELECT 0 AS k UNION ALL SELECT 1 AS k) twice
"""

SEED_LISTS = """
SELECT s_suppkey AS list_no, ' https://H' || cast(s_suppkey AS string) || '.Example.com:443/#x ,, ftp://old.example.com' || chr(10) || 'h'
  || cast(s_suppkey AS string) || '.example.com' || chr(10) || chr(10) || 'HTTP://x.example.com/a/../' || cast(s_suppkey % 5 AS string) AS seed_list
FROM {supplier}
"""

FETCHES = """
SELECT event_id, ts, user_id % 20 AS host_no, 'h' || cast(user_id % 20 AS string) || '.example.com' AS host,
  'https://h' || cast(user_id % 20 AS string) || '.example.com/p/' || cast(event_id % 700 AS string) AS url,
  cast(floor(event_id / 3) AS bigint) AS request, event_id % 3 AS attempt,
  CASE event_type WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 403 WHEN 2 THEN 503 ELSE 404 END
    ELSE CASE WHEN event_id % 50 = 7 THEN 301 ELSE 200 END END AS status,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 10 = 0 THEN '<p>gone</p>' ELSE '' END
    WHEN event_id % 9 = 0 THEN 'Just a moment...'
    WHEN event_id % 31 = 0 THEN repeat('body ', 200) || 'DDoS protection by x' ELSE repeat('body ', 200) END AS html
FROM {events}
"""

#: Rows that become whole pages or files, or cost far more to work on than to move, and their table: it is dealt over the tasks first.
GROWN = {MARKET_PAGES: "part", ROBOTS: "supplier", SITEMAPS: "supplier", INTEL_PAGES: "documents", PAYLOADS: "part"}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def for_oracle(text: str) -> str:
    """The derived table's SQL with plain table names."""
    return text.format(**{name: name for name in TABLES})
