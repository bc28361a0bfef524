"""Registered queries of the training-data operators, and their DuckDB oracles.

Each query applies one operator with production parameters to its whole
table and derives the digest columns from the operator's outputs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bpe, exact_dedup, line_dedup, line_quality, packing, pii, prefix_trie, resample, secret_scan,
               sharding, simhash, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op2_packing")
def op2(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False).drop("ids")


@_query("op3_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op3(spark, sf_dir):
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind from the pieces between the matches (the text split at them) and the matches."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, start, start + length(m[i]) AS stop FROM (
    SELECT *, list_sum(list_transform(s[:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
          FROM (SELECT doc_id, string_split_regex(t, {pattern}) AS s, regexp_extract_all(t, {pattern}) AS m,
                       regexp_extract_all(t, {pattern}, {group}) AS g
                FROM texts WHERE regexp_matches(t, {pattern})))
    WHERE length(g[i]) >= {least})"""


_SECRET_SQL = "WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS (" + " UNION ALL ".join(
    _spans_sql(r.kind, i, "'" + r.pattern.replace("'", "''") + "'", r.group, r.least)
    for i, r in enumerate(secret_scan.RULES)) + """),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank)
         AS spans
  FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (doc_id)"""


def _count_kind(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@_query("op6_secret_scan", _SECRET_SQL)
def op6(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*[r.kind for r in secret_scan.RULES]))
    return found.select(
        "doc_id",
        *[_count_kind("secret_spans", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("secret_spans")).alias("spans"))


@_query("op7_sharding")
def op7(spark, sf_dir):
    return (sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.layout())
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"))


_LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
first AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
          GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, f.keeper IS NULL OR f.keeper = k.doc_id AS stays FROM keyed k LEFT JOIN first f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@_query("op10_line_dedup", _LINE_SQL)
def op10(spark, sf_dir):
    return (line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")))


@_query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


@_query("op8_warc", """
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND low <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND low <> page_id THEN low END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low FROM pages)""")
def op8(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    arch = warc.archive(pages)
    return (warc.lookup(spark, arch, pages, keep_payload=False)
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


@_query("op5_byte_bpe")
def op5(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op4_quality_rules")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    field = line_quality.fit(docs, table(spark, sf_dir, "labels"))
    return line_quality.decide(docs, field).select(
        "doc_id", *[F.col(f"__quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                     "n_repeat_words", "base_failed", "content_share", "kept")])


@_query("op9_pii")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = pii.scan(docs, pii.fit(docs))
    return found.select("doc_id", *[_count_kind("base", kind).alias(f"n_{kind}") for kind in pii.KINDS],
                        F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))


#: CRC-32 in DuckDB: a byte at a time over a text's UTF-8 bytes, with a table made by its rule.
_CRC_SQL = """
  crc_table AS (
    SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
                ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),"""


def crc32_sql(text: str) -> str:
    """A DuckDB expression for the unsigned CRC-32 of the UTF-8 bytes of ``text``; ``t`` is the table in scope."""
    octets = (f"list_transform(range(strlen({text})), lambda i: CAST(('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2]) "
              "AS BIGINT))")
    step = "lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, {step}), 4294967295::BIGINT)"


_RESAMPLE_SQL = "WITH " + _CRC_SQL + r"""
  texts AS (
    SELECT 'd' AS side, doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS x FROM documents
    UNION ALL SELECT 'b', NULL, -row_number() OVER (), coalesce(text, '') FROM benchmark),
  words AS (
    SELECT side, row_id, unnest(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
  counted AS (SELECT side, row_id, word, count(*) AS n FROM words GROUP BY ALL),
  hashed AS (SELECT word, """ + crc32_sql("word") + """ % 10000 AS bucket
             FROM (SELECT DISTINCT word FROM counted), crc_table),
  per_bucket AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
    FROM counted JOIN hashed USING (word) GROUP BY bucket),
  gain AS (
    SELECT bucket, CAST(floor(1000.0::DOUBLE * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
                   / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS g FROM per_bucket),
  mean AS (
    SELECT row_id, sum(n) AS n, sum(n * g) AS total
    FROM counted JOIN hashed USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row_id),
  scored AS (
    SELECT doc_id, row_id, coalesce(n, 0) AS n,
           coalesce(CAST((total - ((total % n) + n) % n) // n AS BIGINT), 0) AS weight,
           CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[:8] AS BIGINT) AS h
    FROM texts LEFT JOIN mean USING (row_id) WHERE side = 'd'),
  ranked AS (
    SELECT doc_id, n, weight, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score,
           row_id FROM scored),
  placed AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place FROM ranked)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score,
       CASE WHEN n >= 20 AND place <= 10 * (SELECT count(*) FROM ranked WHERE n >= 20) // 100 THEN place END AS rank
FROM placed"""


@_query("op13_importance_resampling", _RESAMPLE_SQL)
def op13(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TRIE_SQL = "WITH " + _CRC_SQL + r"""
  turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
           length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
  ids AS (SELECT conv_id, """ + crc32_sql("CAST(conv_id AS VARCHAR)") + r""" % 6 AS h
          FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
  mixed AS (
    SELECT i.conv_id, t.pos, 0 AS part, t.k, t.n FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 100 AND t.pos <= h
    UNION ALL SELECT i.conv_id, t.pos, 1, t.k, t.n FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos > h),
  lists AS (SELECT i.conv_id, coalesce(list(k ORDER BY part, pos) FILTER (k IS NOT NULL), []) AS ks,
                   coalesce(list(n ORDER BY part, pos) FILTER (k IS NOT NULL), []) AS ns
            FROM ids i LEFT JOIN mixed USING (conv_id) GROUP BY i.conv_id),
  members AS (SELECT conv_id, d, array_to_string(ks[:d], '') AS path, array_to_string(ks[:d - 1], '') AS up,
                     CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n, len(ks) = d AS ends
              FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM lists)),
  nodes AS (SELECT path, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM members GROUP BY path, d),
  grown AS (SELECT p.path, p.d, count(c.path) AS n_children FROM nodes p LEFT JOIN nodes c ON c.up = p.path AND c.d = p.d + 1
            GROUP BY p.path, p.d),
  full_nodes AS (SELECT * FROM nodes JOIN grown USING (path, d)),
  below AS (
    SELECT path[:64 * a] AS path, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * n) AS saved
    FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_nodes) GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below b USING (path, d) LEFT JOIN nodes p ON f.d > 0 AND p.path = f.up AND p.d = f.d - 1"""


@_query("op11_conversation_trie", _TRIE_SQL)
def op11(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@_query("op12_nearest_neighbours")
def op12(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
