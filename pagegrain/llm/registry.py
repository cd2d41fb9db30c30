"""The queries of this subpackage: each applies one operator, with the parameters
meant for production, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import round_trip
from .decontaminate import leaks
from .hard_negatives import hard_negatives, quantised
from .html_extract import extract
from .language_id import language_id
from .license_scan import license_scan
from .multi_index import search
from .ngram_join import ngram_join
from .sharding import document_shards
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .token_records import token_records
from .url_filter import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shards(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


SQL_SUBSTRING_DEDUP = r"""
WITH listed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), word AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM listed
), win AS (
  SELECT doc_id, i, n, md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS k FROM word
), whole AS (
  SELECT doc_id, i, k FROM win WHERE i <= n - 50
), copied AS (
  SELECT doc_id, i FROM whole JOIN (SELECT k, min(doc_id) AS first_doc FROM whole GROUP BY k) USING (k) WHERE first_doc < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM copied
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS m FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(m, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM listed l LEFT JOIN kept k ON l.doc_id = k.doc_id
"""


SQL_NGRAM_JOIN = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), word AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM listed
), gram AS (
  SELECT doc_id, i, n, md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS k FROM word
), shingle AS (
  SELECT DISTINCT doc_id, k FROM gram WHERE i <= n - 5 OR (n < 5 AND i = 0)
), size AS (
  SELECT doc_id, count(*) AS m FROM shingle GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingle a JOIN shingle b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
), pair AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * o >= 80 * (x.m + y.m - o)
), link AS (
  SELECT a, b FROM pair UNION SELECT b, a FROM pair
), reach AS (
  SELECT a AS doc_id, a AS r FROM link UNION SELECT reach.doc_id, b FROM reach JOIN link ON a = r
)
SELECT l.doc_id, CAST(coalesce(m, 0) AS BIGINT) AS n_shingles, coalesce(c, l.doc_id) AS component_id
FROM listed l LEFT JOIN size s ON s.doc_id = l.doc_id LEFT JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) r ON r.doc_id = l.doc_id
"""


# the polynomial of CRC-32 is fixed; its table follows from it
SQL_CRC32 = r"""
WITH RECURSIVE step AS (
  SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM step WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY byte) AS t FROM step WHERE k = 8
), """


def _sql_crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 in SQL, where t is the table of SQL_CRC32."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"


SQL_SHARDING = (
    SQL_CRC32
    + f"""doc AS (
  SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, CAST({_sql_crc32("coalesce(text, '')")} AS BIGINT) AS text_crc32 FROM documents, crc
), told AS (
  SELECT *, coalesce('=' || source, '') AS st, md5('shards:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32) AS k FROM doc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY st ORDER BY k) - 1 AS r, count(*) OVER (PARTITION BY st) AS n, (CAST('0x' || left(md5('shards:' || st), 8) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM told
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (CAST(r AS DOUBLE) + CAST(u AS DOUBLE)) / n, st) - 1 AS p, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p * 40 // total AS INTEGER) AS shard, CAST(p - (p * 40 // total * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""
)


SQL_HARD_NEGATIVES = r"""
WITH told AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM told a JOIN told b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 5
"""


# levenshtein counts bytes in DuckDB: the 64 letters from U+00C0 take those of as many ASCII characters that no word holds
SQL_ONE_BYTE = f"""translate(word, '{"".join(map(chr, range(0xC0, 0x100)))}', '{"".join(map(chr, range(32, 96))).replace("'", "''")}')"""
SQL_SPELLING = (
    SQL_CRC32
    + rf"""run AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), many AS (
  SELECT doc_id, run, count(*) AS n FROM run WHERE length(run) >= 6 GROUP BY ALL
), told AS (
  SELECT run, n, {_sql_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM many, crc
), word AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM told GROUP BY 1
), voc AS (
  SELECT word, n, {SQL_ONE_BYTE} AS w FROM word WHERE n >= 5 AND length(word) >= 6
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM voc a JOIN voc b ON abs(length(a.word) - length(b.word)) <= 1 AND a.word <> b.word AND levenshtein(a.w, b.w) = 1
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word
), form AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM voc v LEFT JOIN best b ON v.word = b.word
), chain AS (
  SELECT word, word AS seen, 0 AS d FROM form UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN form f ON f.word = c.seen WHERE f.form IS NOT NULL
)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM form f JOIN (SELECT word, arg_max(seen, d) AS root FROM chain GROUP BY word) r ON r.word = f.word
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_language_id, op2_multi_index, op3_byte_bpe, op4_substring_dedup, op5_html_extract,
        op6_ngram_join, op7_token_records, op8_decontaminate, op9_url_filter, op10_license_scan,
        op11_sharding, op12_hard_negatives, op13_spelling_variants,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": SQL_SUBSTRING_DEDUP, "op6_ngram_join": SQL_NGRAM_JOIN, "op11_sharding": SQL_SHARDING, "op12_hard_negatives": SQL_HARD_NEGATIVES, "op13_spelling_variants": SQL_SPELLING}
