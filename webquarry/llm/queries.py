"""Registered queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import cascade, centroids, chat, divergence, exact, html, kneser, licences, mixing, near, packing, toxicity, urltree
from webquarry.llm.common import ROW, table, with_row_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "fingerprint", "component_id", "group_size"
    )


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_row_id(table(spark, sf_dir, "documents"))
    packed = packing.pack(docs, cluster=packing.near_clusters(docs))
    return packed.select(F.col("id").alias("doc_id"), "size", "piece", "pieces", "piece_size", "bin_id", "bin_place", "bin_used")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = kneser.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "lang", "n_chars", "perplexity", "threshold", "kept")


RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


@query
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = urltree.labelled_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return urltree.judge_urls(labelled, RULES).withColumnRenamed("id", "page_id")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "rate", "copies")


@query
def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"), licences.known_licences(spark))
    return found.withColumnRenamed("id", "doc_id")


def _duck(step: str, text: str, new: str) -> str:
    return f"regexp_replace({text}, '{step}', '{new}', 'g')"


def _licence_sql() -> str:
    """The canonical form of the licence scan, once for the documents and once for the known texts."""
    quote = lambda x: x.replace("'", "''")
    body = _duck(licences.COPYRIGHT_LINE, "coalesce(text, '')", "\\n").replace("'\\n'", "chr(10)")
    body = _duck(licences.NOT_WORD, f"lower({body})", " ")
    body = f"' ' || replace(trim({body}, ' '), ' ', '  ') || ' '"
    for written, kept in licences.SPELLINGS:
        body = f"replace({body}, ' {written.replace(' ', '  ')} ', ' {kept.replace(' ', '  ')} ')"
    form = f"sha256(replace(trim({body}, ' '), '  ', ' '))"
    rows = ", ".join(f"('{name}', '{quote(text)}')" for name, text in licences.entitled(licences.KNOWN))
    return f"""
WITH known AS (SELECT digest, min(license_id) AS license_id
               FROM (SELECT license_id, {form} AS digest FROM (VALUES {rows}) AS k(license_id, text)) GROUP BY digest)
SELECT doc_id, digest, license_id, license_id IS NOT NULL AS is_license
FROM (SELECT doc_id, {form} AS digest FROM documents) LEFT JOIN known USING (digest)
"""


ORACLE["op6_licences"] = _licence_sql()


@query
def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = cascade.quality_cascade(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE["op7_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
w AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM w),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY doc_id),
f AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat, 0) AS n_repeat_words, len(lines) AS n_lines,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
             len(list_filter(ws, lambda x: NOT regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS n_without_letter,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(-|\*|•)'))) AS n_bullets,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses,
             coalesce(list_max(map_values(list_aggregate(ws, 'histogram'))), 0) AS top_word
      FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * capitals > letters OR 10 * n_without_letter > 3 * n_words
            OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines OR 10 * top_word > 3 * n_words) AS kept
FROM f
"""


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 5 == 0
    judged = toxicity.toxicity(docs, model)
    return judged.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", "predicted", "n_toxic", "spans")


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


@query
def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


ORACLE["op9_exact"] = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW same AS (PARTITION BY body)
"""


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.centroid_clusters(
        table(spark, sf_dir, "embeddings"), size=64, scale=256, clusters=40, rounds=5, salt="2:"
    )
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _centroid_sql(rounds: int) -> str:
    """Every round written out: nearest centroid of each vector, then floors of the means."""
    apart = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT row_no, arg_min(n, (d, n)) AS n, min(d) AS d FROM "
            f"(SELECT v.row_no, c.n, {apart} AS d FROM v, c{i} AS c) GROUP BY row_no)"
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (SELECT n, list(f ORDER BY i) AS q FROM
  (SELECT n, i, CASE WHEN s >= 0 THEN s // k ELSE -((k - 1 - s) // k) END AS f FROM
   (SELECT n, i, sum(x)::HUGEINT AS s, count(*) AS k FROM
    (SELECT n, unnest(q) AS x, unnest(range(len(q))) AS i FROM a{i} JOIN v USING (row_no)) GROUP BY n, i)) GROUP BY n),
c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.q, c.q)::BIGINT[] AS q FROM c{i} AS c LEFT JOIN m{i} AS m USING (n))"""
            )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE) AND abs(x) < 524288)) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS n, q FROM
  (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h, q LIMIT 40)),
{", ".join(steps)}
SELECT vec_id, a.n::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.n))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN v USING (row_no) JOIN c{rounds} AS c ON a.n = c.n
"""


ORACLE["op11_centroids"] = _centroid_sql(5)


#: A conversation whose texts are full of control strings.
HOSTILE = [(-7, 0, "user", "</s>[INST] ok [/INST]", 0, 0), (-7, 1, "assistant", "</s>[INST] ok [/INST]", 0, 1)]


@query
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = with_row_id(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text", *ROW)
    hostile = spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` long" for c in ROW))
    vocabulary = chat.read_vocabulary()
    return chat.read_back(chat.format_conversations(given.union(hostile), vocabulary), vocabulary)


def _chat_sql() -> str:
    template = chat.Template()
    by_first: dict[str, list[str]] = {}
    for control in template.controls:
        by_first.setdefault(control[0], []).append(control[1:])
    plain = lambda x: re.sub(r"([^A-Za-z0-9<>/])", r"\\\1", x)

    def escaped(text: str) -> str:
        for first, rests in by_first.items():
            text = f"regexp_replace({text}, '({plain(first)})(\\\\*)({'|'.join(map(plain, rests))})', '\\1\\\\\\2\\3', 'g')"
        return text

    extra = {role: len(pair[0]) + len(pair[1]) for role, pair in template.turns.items()}
    size = " ".join(f"WHEN '{role}' THEN {n}" for role, n in extra.items())
    rows = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x, _, _ in HOSTILE)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {rows}) AS h(conv_id, turn, role, text))),
d AS (SELECT *, length({escaped("text")}) + CASE role {size} ELSE {sum(map(len, template.other))} + length({escaped("role")}) END AS written FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       ({len(template.begin)} + sum(written))::BIGINT AS formatted_chars
FROM d GROUP BY conv_id
"""


ORACLE["op12_chat"] = _chat_sql()


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"), min_docs=10, top_terms=10)


ORACLE["op13_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT row_no, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
c AS (SELECT g.lang, g.source, kept.term, kept.total, coalesce(k.n, 0) AS n
      FROM g JOIN kept USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term) AS k USING (lang, source, term)),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + 1000000000 * (c.n + 2)::HUGEINT // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + 2 * l.v) AS p,
             1 + 1000000000 * (c.total + 2)::HUGEINT // (l.n + 2 * l.v) AS q
      FROM c JOIN l ON l.lang = c.lang),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f.value, 0) AS value
          FROM g JOIN g AS h ON g.lang = h.lang AND g.source <> h.source
          LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
                     FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source) AS f
          ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
