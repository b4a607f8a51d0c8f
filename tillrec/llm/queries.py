"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillrec.llm.alignment import align_tokenizers
from tillrec.llm.ann import nearest_by_codes
from tillrec.llm.common import table
from tillrec.llm.decontaminate import contamination_digest
from tillrec.llm.divergence import source_divergence
from tillrec.llm.langid import identify_languages
from tillrec.llm.linerules import line_rules_digest
from tillrec.llm.mixing import mix_sources
from tillrec.llm.pfp import remove_repeats
from tillrec.llm.pii import pii_digest
from tillrec.llm.quality import score_documents
from tillrec.llm.sharding import shard_by_bytes
from tillrec.llm.simhash import simhash_digest
from tillrec.llm.tokencount import token_digest

#: Vocabulary of the token counts; the file is read where the driver runs.
VOCABULARY = "byte_bpe_50k.json"
SECOND_VOCABULARY = "piece_bpe_32k.model"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a bidirectional gated network over bytes."""
    return identify_languages(table(spark, sf_dir, "documents"))


def op2_nearest_by_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest rows of every twentieth vector, by one-bit codes and reranking."""
    return nearest_by_codes(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted-fair-queueing mix of all documents."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at four differing bits."""
    return simhash_digest(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word benchmark windows in all documents."""
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: exact patterns plus the network's spans."""
    return pii_digest(table(spark, sf_dir, "documents"))


def op7_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes under 50-byte strings that also start in an earlier document."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of all documents by co-trained classifiers."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight byte-balanced shards of all documents."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=8)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents from counts at every prefix."""
    return token_digest(table(spark, sf_dir, "documents"), vocabulary_path(), limit=1024)


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over all documents."""
    return align_tokenizers(table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path(SECOND_VOCABULARY))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every pair of sources of a language, and the words that mark a source."""
    return source_divergence(table(spark, sf_dir, "documents"), min_docs=3, top=200)


def op13_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and cross-document line frequency on all documents."""
    return line_rules_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_nearest_by_codes": op2_nearest_by_codes,
    "op3_mix_sources": op3_mix_sources,
    "op4_simhash_components": op4_simhash_components,
    "op5_decontaminate": op5_decontaminate,
    "op6_personal_data": op6_personal_data,
    "op7_remove_repeats": op7_remove_repeats,
    "op8_quality": op8_quality,
    "op9_shard_documents": op9_shard_documents,
    "op10_token_counts": op10_token_counts,
    "op11_align_tokenizers": op11_align_tokenizers,
    "op12_source_divergence": op12_source_divergence,
    "op13_line_rules": op13_line_rules,
}

#: Every product of a query and a candidate.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, max(list_reduce(list_transform(generate_series(1, len(a.e)), lambda i: a.e[i] * b.e[i]), lambda x, y: x + y)) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) GROUP BY ALL)
SELECT * FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s) r
WHERE rank <= 20"""

#: The weighted-fair-queueing mix with whole-table windows.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS s, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h
  FROM documents),
src AS (
  SELECT s, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY s NULLS LAST) - 1 AS rk FROM d GROUP BY s),
w AS (
  SELECT *, CASE rk % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS wt, source_size * 2.0::DOUBLE AS cap,
         (SELECT sum(source_size) FROM src) * 1.5::DOUBLE AS budget
  FROM src),
f AS (
  SELECT a.*, (SELECT sum(least(b.wt * (a.cap / a.wt), b.cap)) FROM w b) <= a.budget + 1e-6 AS stopped FROM w a),
t AS (
  SELECT *, CASE WHEN stopped THEN cap
                 ELSE wt * (budget - (SELECT coalesce(sum(cap), 0) FROM f WHERE stopped)) / (SELECT sum(wt) FROM f WHERE NOT stopped) END AS target
  FROM f),
q AS (
  SELECT d.*, t.rk, t.wt, t.source_size, t.target, t.budget, row_number() OVER () AS id,
         sum(size) OVER (PARTITION BY t.rk ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.s IS NOT DISTINCT FROM t.s),
c AS (
  SELECT id, size, budget, sum(size) OVER (ORDER BY (e * source_size + cum) / wt, rk, e, h ROWS UNBOUNDED PRECEDING) AS run
  FROM q, (VALUES (0), (1)) x(e) WHERE size > 0),
u AS (SELECT id, CAST(sum(CASE WHEN run <= budget THEN size ELSE 0 END) AS BIGINT) AS taken FROM c GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN u USING (id)"""

#: Every window of every item against every run of as many words.
OP5_SQL = r"""
WITH low AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0) x),
grams AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, (SELECT DISTINCT n FROM win) k WHERE len(w) >= n) x),
hits AS (SELECT DISTINCT r, i, win.n, item FROM grams JOIN win USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) x GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
          FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

#: Running sums over the whole order; the checksum byte by byte from its table.
OP9_SQL = """
WITH steps AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
              lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS i) x),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, '')) AS a, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS b
  FROM documents),
c AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(text)), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))),
                            lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])), 4294967295) AS text_crc32
  FROM (SELECT r, text, hex(encode(text)) AS h FROM d) x, steps),
o AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY a, b, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before,
         row_number() OVER (ORDER BY a, b, size) AS place, CAST(sum(size) OVER () AS BIGINT) AS total
  FROM d),
p AS (SELECT *, least((2 * before + size) * 8 // (2 * total), 7) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
FROM p JOIN c USING (r)"""

#: Every kept word against every source, zeros included.
OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS term FROM d) x GROUP BY ALL),
l AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT t.lang, t.source, t.term, CAST(sum(t.n) AS BIGINT) AS n FROM t JOIN l USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
lt AS (SELECT lang, sum(n) AS total, count(*) AS v FROM l GROUP BY lang),
gt AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT gt.lang, gt.source, l.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gt.total + lt.v) AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (l.n + 1)) // (lt.total + lt.v) AS BIGINT) AS q
  FROM gt JOIN lt USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = l.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, CAST(sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS BIGINT) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
  FROM ranked) z
WHERE part = 'pair' OR rank <= 200"""

#: Lines as text instead of hashes; windows as text.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS raw,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')),
           '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3) x),
twice AS (SELECT r, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM win JOIN twice USING (r, g)) x GROUP BY r),
texts AS (SELECT source, text, any_value(lines) AS lines FROM d GROUP BY ALL),
hosts AS (SELECT source, greatest(10.0::DOUBLE, count(*) * 0.001::DOUBLE) AS lim FROM texts GROUP BY ALL),
freq AS (
  SELECT f.source, f.line FROM (
    SELECT source, line, count(*) AS n FROM (SELECT source, text, unnest(list_distinct(lines)) AS line FROM texts) x GROUP BY ALL) f
  JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source WHERE f.n > hosts.lim),
gone AS (
  SELECT r, CAST(sum(len(string_split(x.line, ' '))) AS BIGINT) AS n
  FROM (SELECT r, source, unnest(lines) AS line FROM d) x
  JOIN freq ON x.line = freq.line AND x.source IS NOT DISTINCT FROM freq.source GROUP BY r),
b AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(raw) - len(list_distinct(raw)) AS BIGINT) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - coalesce(gone.n, 0) AS n_left
      FROM b LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_left >= 50 AND n_left * 100 >= n_words * 50 AS kept
FROM v"""

SQL: dict[str, str] = {
    "op2_nearest_by_codes": OP2_SQL,
    "op3_mix_sources": OP3_SQL,
    "op5_decontaminate": OP5_SQL,
    "op9_shard_documents": OP9_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_line_rules": OP13_SQL,
}
