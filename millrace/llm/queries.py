"""The ten operators and the pipeline as registered queries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, packing, pii, quality, secrets, simhash, substrings, token_store, urls
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items every document holds, and how many of its words they hit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.add_hits(docs, table(spark, sf_dir, "benchmark"), size=8)
    names = F.array_sort(F.transform("hits.items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        decontaminate.hit_words(F.col("hits.spans")).alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        decontaminate.contaminated("hits", 2).alias("contaminated"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document.

    The test documents name no owner: a source stands for one, and what it has
    in one language for one of its repositories.
    """
    docs = table(spark, sf_dir, "documents").withColumn("repository", F.concat_ws("/", F.coalesce("source", F.lit("\x01")), "lang"))
    return secrets.scan(docs.select("doc_id", "text", "source", "repository"), owner="source", repository="repository")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality figures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels"), without=("text",))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), radius=3, shingle=3)


#: A dated list for the test pages (rule, action, effective): fixed values.
URL_LIST = [
    ("spam-farm.example.org", "block", "2024-02-01"),
    ("spam-farm.example.org", "drop", "2024-10-01"),
    ("cheap-pills.example.com", "block", "2024-01-15"),
    ("example.net", "block", "2024-06-01"),
    ("blog.example.net", "allow", "2024-06-01"),
    ("example.net/en", "allow", "2024-07-01"),
    ("example.net", "drop", "2024-09-01"),
    ("example.com/fr", "block", "2024-03-01"),
    ("example.com/fr", "allow", "2024-05-01"),
    ("example.org", "allow", "2024-01-01"),
]
_LIST = ", ".join(f"('{r}', '{a}', DATE '{d}')" for r, a, d in URL_LIST)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list's verdict on every page; pages carry no fetch time, so the id's day of 2024 stands for it."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", fetched.alias("fetched"))
    entries = spark.sql(f"SELECT * FROM VALUES {_LIST} AS t(rule, action, effective)")
    return urls.judge(captures, entries).withColumnRenamed("capture_id", "page_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("found", pii.pseudonymise(F.col("text"), pii.session_key(spark)))
    counts = [F.expr(f"cast(size(filter(found.finds, x -> x.kind = '{k}')) as bigint) as n_{k}") for k in pii.KINDS]
    return found.select("doc_id", F.col("found.text").alias("text"), *counts)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from a content-addressed store."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = token_store.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return token_store.digest(spark, path)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed into sequences of 4096 ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages that came before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, size=20, texts=False)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_secrets": op2_secrets,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_url_filter": op5_url_filter,
    "op6_pii": op6_pii,
    "op7_token_store": op7_token_store,
    "op8_packing": op8_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language": op10_language,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(8, len(ws)) AS n, array_to_string(ws[i:i + 7], ' ') AS w
  FROM b, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) t(i) WHERE len(ws) > 0
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, s.n AS n, i, array_to_string(ws[i:i + s.n - 1], ' ') AS w
  FROM d, sizes s, unnest(range(1, len(ws) - s.n + 2)) t(i) WHERE len(ws) >= s.n
),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) u(p) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
_OP5_SQL = f"""
WITH entries(rule, action, since) AS (VALUES {_LIST}),
valid AS (SELECT *, lead(since) OVER (PARTITION BY rule ORDER BY since) AS until FROM entries),
c AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) || '/', '/+', '/', 'g') AS path
  FROM pages
),
m AS (
  SELECT c.page_id, v.rule, v.action FROM c JOIN valid v
  ON ('.' || c.host) LIKE ('%.' || split_part(v.rule, '/', 1))
  AND starts_with(c.path, substr(v.rule, length(split_part(v.rule, '/', 1)) + 1) || '/')
  AND v.action <> 'drop' AND c.fetched >= v.since AND (v.until IS NULL OR c.fetched < v.until)
),
best AS (
  SELECT page_id, rule, action, row_number() OVER (PARTITION BY page_id
    ORDER BY length(split_part(rule, '/', 1)) DESC, length(rule) DESC, action = 'block' DESC, rule DESC) AS k FROM m
)
SELECT c.page_id, c.url, c.fetched, b.action, b.rule, coalesce(b.action <> 'block', true) AS kept
FROM c LEFT JOIN best b ON b.page_id = c.page_id AND b.k = 1
"""
_KEYWORD_SQL = secrets.BASE["assign"][0].replace("'", "''")
_PROVIDER_SQL = secrets.MORE["provider"][0]


def _finds(kind: str, pattern: str, group: int, keep: str) -> str:
    """SQL for the finds of one kind: place, value and kind of each match that is kept."""
    return f"""
  SELECT doc_id, source, repository, {secrets.KINDS.index(kind)} AS rank, '{kind}' AS kind, v[i] AS value,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a,
    length(m[i]) AS n
  FROM (SELECT doc_id, source, repository, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS v,
    string_split_regex(t, '{pattern}') AS g FROM d), unnest(range(1, len(m) + 1)) u(i)
  WHERE {keep}"""


_OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS source, concat_ws('/', coalesce(source, chr(1)), lang) AS repository, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join([
    _finds("assign", _KEYWORD_SQL, 2, "length(v[i]) >= 12"),
    _finds("access", secrets.BASE["access"][0], 0, "true"),
    _finds("hex", secrets.BASE["hex"][0], 0, "true"),
    _finds("short", _KEYWORD_SQL, 2, "length(v[i]) BETWEEN 8 AND 11 AND regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Za-z]')"),
    _finds("provider", _PROVIDER_SQL, 0, "true"),
])}),
o AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT repository) AS repositories FROM f GROUP BY value),
j AS (SELECT f.*, owners, repositories, rank < {len(secrets.BASE)} AS base, kind || ':' || a || ':' || (a + n) AS span FROM f JOIN o USING (value)),
s AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY a, rank) FILTER (base) AS bases,
    string_agg(span, ',' ORDER BY a, rank) FILTER (base OR owners <= {secrets.MOST_OWNERS}) AS spans,
    count(*) FILTER (owners <= {secrets.MOST_OWNERS}) AS n_owner_specific, count(*) FILTER (owners > {secrets.MOST_OWNERS}) AS n_copied,
    max(owners) AS most_owners, max(repositories) AS most_repositories FROM j GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(bases, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owner_specific, 0) AS n_owner_specific,
  coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN s USING (doc_id)
"""
_OP9_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k
  FROM w, unnest(range(1, len(ws) - 18)) t(i) WHERE len(ws) >= 20
),
later AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
),
cov AS (SELECT DISTINCT doc_id, p FROM later, unnest(range(i, i + 20)) u(p)),
pos AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) t(p)),
kept AS (
  SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) FILTER (cov.p IS NULL) AS k, count(cov.p) AS n_removed
  FROM pos LEFT JOIN cov ON pos.doc_id = cov.doc_id AND pos.p = cov.p GROUP BY pos.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
ORACLE_SQL = {
    "op1_decontamination": _OP1_SQL,
    "op2_secrets": _OP2_SQL,
    "op5_url_filter": _OP5_SQL,
    "op9_substring_dedup": _OP9_SQL,
}
