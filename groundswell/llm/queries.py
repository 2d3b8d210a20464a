"""The registered query of each operator, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundswell.llm.common import table
from groundswell.llm.embedding_dedup import near_duplicate_vectors
from groundswell.llm.html_text import extract_text
from groundswell.llm.line_dedup import line_report
from groundswell.llm.mixing import mixing_rates
from groundswell.llm.near_dup import near_duplicates
from groundswell.llm.neighbours import nearest
from groundswell.llm.packing import pack
from groundswell.llm.phrases import collocations
from groundswell.llm.quality import quality_scores
from groundswell.llm.sentence_pieces import codec_report
from groundswell.llm.substring import substring_report
from groundswell.llm.token_counts import token_counts
from groundswell.llm.whitening import whiten

VOCABULARIES = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file: the installed package's, or in ``TOKENIZERS_DIR``."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return os.path.join(VOCABULARIES, name)
    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), 85)


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing_rates(table(spark, folder, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, folder, "embeddings"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_report(table(spark, folder, "documents"))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


def op13_sentencepiece_codec(spark: SparkSession, folder: str) -> DataFrame:
    return codec_report(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_minhash_near_dedup,
        op2_line_dedup,
        op3_token_counts,
        op4_quality_classifier,
        op5_source_mixing,
        op6_embedding_near_dedup,
        op7_substring_dedup,
        op8_best_fit_packing,
        op9_nearest_neighbours,
        op10_html_extraction,
        op11_embedding_whitening,
        op12_phrase_collocations,
        op13_sentencepiece_codec,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP, "op12_phrase_collocations": COLLOCATIONS}


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH numbered AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         string_split(coalesce(text, ''), chr(10)) AS parts
  FROM documents
), lines AS (
  SELECT doc_id, row_no, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM numbered
), keyed AS (
  SELECT *, translate(trim(line, {_BLANKS}),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed
  WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, row_no
"""

COLLOCATIONS = """
WITH pieces AS (
  SELECT lang, [w FOR w IN string_split_regex(piece, '[ \\t]+') IF w <> ''] AS words
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[.,;:!?\\n\\x0b\\x0c\\r]')) AS piece
        FROM documents)
), placed AS (
  SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i
  FROM pieces, (VALUES (1), (2), (3)) AS size(k)
), grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM placed GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f AS a
  FROM grams WHERE k >= 2 AND f >= 10
), cuts AS (
  SELECT lang, k, phrase, words, a, unnest(range(1, k)) AS cut FROM candidates
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, p.f AS l, r.f AS r,
         CAST((1000000::HUGEINT * c.a * c.a) // (p.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c
  JOIN grams p ON p.lang = c.lang AND p.phrase = array_to_string(c.words[1:c.cut], ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[c.cut + 1:c.k], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.cut) = 1
), longer AS (
  SELECT lang, part, max(a) AS a FROM (
    SELECT lang, a, array_to_string(words[1:2], ' ') AS part FROM candidates WHERE k = 3
    UNION ALL
    SELECT lang, a, array_to_string(words[2:3], ' ') AS part FROM candidates WHERE k = 3)
  GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN longer x ON x.lang = s.lang AND x.part = s.phrase
  WHERE x.a IS NULL OR 100 * x.a < 50 * s.a
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
