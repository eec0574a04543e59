"""The queries ``opN_<name>`` of this subpackage, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, table
from .embeddings import near_vectors
from .fingerprints import compare_versions
from .html_extraction import extract_main_text
from .language_id import identify
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .packing import pack_documents
from .prefix_trie import prefix_trie
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .token_alignment import align_tokens
from .token_files import read_tokens, write_tokens
from .toxicity import score_toxicity


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The bytes that are left as text; a character cut apart becomes U+FFFD.
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", text)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), scratch_dir(spark, "token-files")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM s),
r AS (
  SELECT *, row_number() OVER o AS rk,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_size,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_w
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / CAST(w AS DOUBLE), source ASC NULLS LAST)),
f AS (SELECT rk, left_size, left_w FROM r WHERE NOT (3 * source_size * left_w < w * left_size) ORDER BY rk LIMIT 1),
t AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.rk < f.rk THEN CAST(3 * r.source_size AS DOUBLE)
              ELSE CAST(r.w AS DOUBLE) * CAST(f.left_size AS DOUBLE) / CAST(f.left_w AS DOUBLE) END AS target
  FROM r, f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""

# The first CTEs spell out crc32 of an id's digits; a node is a conversation's path of turn digests.
OP11_SQL = r"""
WITH RECURSIVE tab(i, k, v) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM tab WHERE k < 8),
ids AS (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc(c, s, k, v) AS (
  SELECT c, s, 0, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL SELECT c, s, crc.k + 1, xor(crc.v // 256, tab.v)
  FROM crc JOIN tab ON tab.k = 8 AND tab.i = xor(crc.v % 256, ascii(substr(s, crc.k + 1, 1))) WHERE crc.k < length(s)),
h AS (SELECT c, xor(v, 4294967295) % 9 AS h FROM crc WHERE k = length(s)),
t AS (
  SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n_bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
b AS (
  SELECT h.c, 0 AS own, t.i, t.x, t.n_bytes FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.i < h.h
  UNION ALL SELECT h.c, 1, t.i, t.x, t.n_bytes FROM h JOIN t ON t.c = h.c AND t.i >= h.h),
s AS (SELECT c, x, n_bytes, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d FROM b),
r AS (
  SELECT c, d, n_bytes, string_agg(x, ',') OVER (PARTITION BY c ORDER BY d) AS path FROM s
  UNION ALL SELECT c, 0, 0, '' FROM ids),
n AS (SELECT c, max(d) AS n FROM r GROUP BY c),
g AS (
  SELECT path, d, min(r.c) AS c, count(*) AS n_convs, max(n_bytes) AS n_bytes, max(n.n) = d AS leaf,
         sha256(coalesce(string_agg(CAST(r.c AS VARCHAR), ',' ORDER BY r.c) FILTER (WHERE n.n = d), '')) AS ends_sha256
  FROM r JOIN n ON n.c = r.c GROUP BY path, d),
up AS (SELECT g.path, g.c, g.d, a.path AS above, a.d AS above_d FROM g JOIN r a ON a.c = g.c AND a.d <= g.d),
sums AS (
  SELECT up.above AS path, up.above_d AS d, count(*) FILTER (WHERE up.d = up.above_d + 1) AS n_children,
         count(*) FILTER (WHERE g.leaf) AS n_leaves, sum((g.n_convs - 1) * g.n_bytes) AS saved_tokens
  FROM up JOIN g ON g.path = up.path AND g.d = up.d GROUP BY up.above, up.above_d)
SELECT g.c AS conv_id, CAST(g.d AS BIGINT) AS depth, p.c AS parent_conv_id, CAST(g.n_convs AS BIGINT) AS n_convs,
       CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN sums ON sums.path = g.path AND sums.d = g.d
LEFT JOIN up ON up.path = g.path AND up.d = g.d AND up.above_d = g.d - 1
LEFT JOIN g p ON p.path = up.above AND p.d = up.above_d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_line_dedup": op1_line_dedup, "op2_suffix_dedup": op2_suffix_dedup, "op3_fingerprints": op3_fingerprints, "op4_token_files": op4_token_files, "op5_html_extraction": op5_html_extraction, "op6_embedding_dedup": op6_embedding_dedup, "op7_language_id": op7_language_id, "op8_simhash": op8_simhash, "op9_mixing": op9_mixing, "op10_packing": op10_packing, "op11_prefix_trie": op11_prefix_trie, "op12_toxicity": op12_toxicity, "op13_token_alignment": op13_token_alignment}


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": OP9_SQL, "op11_prefix_trie": OP11_SQL}
