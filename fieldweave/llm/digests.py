"""Those columns of the corpus operators' results that SQL can give too: queries beside the opN_ ones, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import mixing, quality_rules
from fieldweave.tables import table

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 before its verdict."""
    rows = quality_rules.base_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.base_failed().alias("base_failed"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8's sizes and targets of sources."""
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10's columns that don't depend on its template."""
    from fieldweave.llm.queries import op10_chat_formatting

    return op10_chat_formatting(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


QUERIES = {f.__name__: f for f in (quality_base_columns, mix_targets, chat_digests)}
ORACLE_SQL = {
    "quality_base_columns": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
  lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
  windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
  again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
  cover AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(3) r(j) GROUP BY doc_id),
  rows_ AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
    FROM d JOIN lines USING (doc_id) LEFT JOIN cover c ON c.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM rows_""",
    "mix_targets": rf"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
  o AS (SELECT *, 3.0 * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS k FROM s),
  v AS (SELECT (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
  t AS (SELECT source, source_size, round(least(CAST(cap AS DOUBLE), weight * (SELECT max(level) FROM v)), 3) AS target FROM o)
SELECT doc_id, size, source_size, target FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source""",
    "chat_digests": """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(k)),
  g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256 FROM g""",
}
