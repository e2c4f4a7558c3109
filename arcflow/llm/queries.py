"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, context_mixing, decontaminate, html_tree, language_id, line_dedup, quality, simhash, url_filter, warc
from .common import small_batches, table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.encode_decode(table(spark, sf_dir, "documents"), word_bpe())


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    bundles = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = docs.withColumn("held_out", language_id.held_out(docs["doc_id"]))
    return language_id.predict(rows, language_id.fit(docs), keep=("doc_id", "held_out"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest("items").alias("items_sha256"), "contaminated")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.references(docs))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op7_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_tree.extract(pages, html_tree.fit(pages))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.LineStore.build(docs).apply(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return context_mixing.score_docs(docs.withColumn("held_out", context_mixing.held_out(docs["doc_id"])))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_quality_rules that do not hang on its model: SQL can tell them."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_url_filter that its rules settle; rule_verdict is null where the model judges."""
    found = op6_url_filter(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def mixing_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_context_mixing that do not hang on its model; the score to three places, for the order of sums."""
    found = op10_context_mixing(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_html_tree": op7_html_tree,
    "op8_line_dedup": op8_line_dedup,
    "op9_bpe": op9_bpe,
    "op10_context_mixing": op10_context_mixing,
    "quality_base": quality_base,
    "url_rules": url_rules,
    "mixing_base": mixing_base,
}

#: Keys are text here, digests in the operator.
OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT l.*, coalesce(l.doc_id <> f.first_doc, FALSE) AS gone FROM lines l LEFT JOIN firsts f USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), q AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest, n >= 100) ELSE page_id END AS first FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM q
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 8) AS n, unnest(generate_series(1, len(w) - least(len(w), 8) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, p.n, item_id FROM places p JOIN windows USING (n, win)
), words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n >= 2
), repeated AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS k FROM twice) GROUP BY r
), lines AS (
  SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line
), copies AS (
  SELECT r, sum(n - 1) AS n FROM lines GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(c.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(p.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN copies c USING (r) LEFT JOIN repeated p USING (r)
"""

URL_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), found AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS rule_verdict FROM found
"""

#: The recursion takes a crc32 bit by bit: DuckDB has none.
MIXING_SQL = r"""
WITH RECURSIVE ids AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL
), steps(doc_id, s, k, crc) AS (
  SELECT doc_id, s, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT doc_id, s, k + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)
  FROM (SELECT doc_id, s, k, CASE WHEN k % 8 = 0 THEN xor(crc, ascii(s[k // 8 + 1])::BIGINT) ELSE crc END AS x FROM steps WHERE k < 8 * length(s))
), held AS (
  SELECT doc_id, xor(crc, 4294967295::BIGINT) % 5 = 1 AS held_out FROM steps WHERE k = 8 * length(s)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(held_out, FALSE) AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+'), '') AS w
  FROM documents LEFT JOIN held USING (doc_id)
), tokens AS (
  SELECT r, held_out, unnest(w) AS word FROM d
), counts AS (
  SELECT word, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY word
), sums AS (
  SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM counts
), scored AS (
  SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base
  FROM tokens LEFT JOIN counts USING (word), sums GROUP BY r
)
SELECT doc_id, held_out, n_tokens::BIGINT AS n_tokens, n_known::BIGINT AS n_known, n::BIGINT AS train_tokens, round(base, 3) AS base_score
FROM d JOIN scored USING (r), sums
"""

ORACLE_SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op3_decontaminate": OP3_SQL,
    "op8_line_dedup": OP8_SQL,
    "quality_base": QUALITY_SQL,
    "url_rules": URL_SQL,
    "mixing_base": MIXING_SQL,
}
