"""The registered queries of this folder and their SQL for DuckDB.

Each query is its operator over a whole table with production parameters, cut to the columns that
its result has to have.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    exact_dedup,
    hilbert,
    language,
    line_dedup,
    main_text,
    ngram_join,
    packing,
    prefix_trie,
    substring_dedup,
    token_alignment,
    topk,
    warc_zip,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Dimensions that shards can be pruned by.
SHARD_DIMENSIONS = ["size", "lang", "source"]


#: Folder of the public vocabularies, and their files.
TOKENIZERS = os.path.dirname(public_tokenizers.path(""))
BYTE_BPE, WORD_BPE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_table(spark, f"{sf_dir}/documents.parquet")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archive_and_read(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram_join.near_duplicates(docs, words=4, percent=85)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(
        table(spark, sf_dir, "documents"), line_dedup.line_pairs
    ).select(
        "doc_id", "n_lines", "removed_chunks", "removed_lines",
        F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    ranks = bpe.read_ranks(f"{tokenizers}/{BYTE_BPE}")
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents"), ranks, PATTERN)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hilbert.hilbert_shards(docs, SHARD_DIMENSIONS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op9_best_fit_packing(
    spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS
) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"), f"{tokenizers}/{WORD_BPE}", with_ids=False
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", "n_chars"
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op13_token_alignment(
    spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS
) -> DataFrame:
    vocabularies = token_alignment.read_vocabularies(
        f"{tokenizers}/{BYTE_LEVEL}", f"{tokenizers}/{PIECES}"
    )
    return token_alignment.align_corpus(table(spark, sf_dir, "documents"), vocabularies)


def registered() -> dict[str, Query]:
    return {
        "op1_topk_search": op1_topk_search,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_language_id": op3_language_id,
        "op4_warc_zip": op4_warc_zip,
        "op5_ngram_join": op5_ngram_join,
        "op6_line_dedup": op6_line_dedup,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_hilbert_shards": op8_hilbert_shards,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_html_extraction": op10_html_extraction,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_token_alignment": op13_token_alignment,
    }


OP2_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM rows
)
"""


OP1_SQL = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
WHERE rank <= 5
"""


#: The checksum of a decimal id is computed bit by bit; 3988292384 is CRC-32's polynomial.
OP11_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')
         ) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), digits AS (
  SELECT DISTINCT conv_id,
         list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
  FROM turns
), heads AS (
  SELECT conv_id, conv_id - conv_id % 5 AS lead,
         xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), bytes),
           lambda crc, byte: list_reduce(
             [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda a, unused: xor(a >> 1, 3988292384 * (a & 1))
           )
         )) % 9 AS h
  FROM digits
), rebuilt AS (
  SELECT h.conv_id, nth, role, text FROM heads h JOIN turns t ON t.conv_id = h.lead AND nth <= h
  UNION ALL
  SELECT h.conv_id, nth, role, text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND nth > h
), paths AS (
  SELECT h.conv_id, coalesce(path, []) AS path
  FROM heads h LEFT JOIN (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY nth) AS path FROM rebuilt GROUP BY conv_id
  ) USING (conv_id)
), prefixes AS (
  SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM paths
), nodes AS (
  SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                         FILTER (WHERE depth = len(path)), '')) AS ends_sha256
  FROM prefixes GROUP BY ALL
), children AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(n.node[-1].text) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN children USING (node)
), up AS (
  SELECT node[1:level] AS node, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS level FROM counted) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN up USING (node)
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
"""


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, string_split_regex(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                    '[\x20\x09-\x0D]+') AS words
  FROM documents
), docs AS (
  SELECT doc_id, CASE WHEN words = [''] THEN [] ELSE words END AS words FROM words
), windows AS (
  SELECT doc_id, start, sha256(list_aggregate(words[start + 1:start + 20], 'string_agg', ' ')) AS window_sha256
  FROM (SELECT doc_id, words, unnest(range(len(words) - 19)) AS start FROM docs WHERE len(words) >= 20)
), later AS (
  SELECT doc_id, start FROM windows
  QUALIFY row_number() OVER (PARTITION BY window_sha256 ORDER BY doc_id, start) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS word FROM later
), flat AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM docs
), kept AS (
  SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY place) FILTER (WHERE g.word IS NULL) AS text,
         count(g.word) AS n_removed
  FROM flat f LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.word = f.place GROUP BY f.doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
"""


#: All pairs that share a shingle, and their components; for small tables.
OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(
    string_split_regex(lower_ascii, '[\x20\x09-\x0D]+'), lambda w: w <> ''
  ) AS words
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles
  FROM words
), flat AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS shared
    FROM flat x JOIN flat y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2
  ) WHERE 100 * shared >= 85 * (n + m - shared)
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1) c USING (doc_id)
"""


def sql() -> dict[str, str]:
    return {
        "op1_topk_search": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op5_ngram_join": OP5_SQL,
        "op11_prefix_trie": OP11_SQL,
        "op12_substring_dedup": OP12_SQL,
    }
