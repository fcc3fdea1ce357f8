"""Queries of the problems 2, 6, 8, 9 and 10, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.llm.bpe import encode_column, round_trip
from terazi.llm.canonical import map_founders
from terazi.llm.leakage import find_leaks
from terazi.llm.quality import CASES, document_quality
from terazi.llm.quantiles import TARGETS, percentiles, value_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(value_counts(table(spark, sf_dir, "universe")))


def p2_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(table(spark, sf_dir, "universe"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_founders(table(spark, sf_dir, "general"), table(spark, sf_dir, "eylul_2026_fon_krizi")).select("fonkodu", "fonunvan", "name")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), paraphrases=True)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_quality(table(spark, sf_dir, "documents"))


def p10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that SQL can count: words, their mean length, share of lines that end in punctuation."""
    return p10_stats(spark, sf_dir).select("doc_id", "words", *(F.round(c, 6).alias(c) for c in ("word_length", "end_punctuation")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_stats(spark, sf_dir).filter(CASES).select("doc_id", "kind")


def llm_queries() -> dict:
    return {f.__name__: f for f in (p2_percentiles, p2_partials, p6_found, p8_ids, p8_round_trip, p9_leaks, p9_found, p10_stats, p10_counts, p10_found)}


COUNTS = """WITH u AS (SELECT DISTINCT fonkodu, start_date, end_date, archetype, start_aum, end_aum, end_participants, flow_pct, market_effect_pct FROM universe),
l AS (SELECT nullif(lower(trim(archetype, ' ' || chr(9) || chr(13) || chr(10) || chr(160))), '') AS archetype, end_date, flow_pct, market_effect_pct FROM u),
v AS (SELECT archetype, end_date, 'flow_pct' AS field, flow_pct AS v FROM l UNION ALL SELECT archetype, end_date, 'market_effect_pct', market_effect_pct FROM l),
c AS (SELECT archetype, end_date, field, round_even(v * 1000000, 0) + 0.0 AS step FROM v WHERE v IS NOT NULL AND NOT isnan(v))"""
PERCENTILES = f"""{COUNTS},
s AS (SELECT *, row_number() OVER (PARTITION BY archetype, field ORDER BY step) AS i, count(*) OVER (PARTITION BY archetype, field) AS n FROM c),
t AS (SELECT unnest([{', '.join(map(str, TARGETS))}]) AS permille)
SELECT archetype, field, permille, step / 1000000 AS value, i AS rank, n FROM s, t WHERE i = greatest(1, (permille * n + 999) // 1000)"""


LETTERS = r"[\p{L}\p{No}\p{Nl}]+"
SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]"
P10_COUNTS = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, regexp_extract_all(t, '{LETTERS}(?:[''’]{LETTERS})?') AS w, list_filter(regexp_extract_all(t, '[^\n\r\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]+'), lambda y: NOT regexp_full_match(y, '{SPACE}*')) AS lines FROM d)
SELECT doc_id, CAST(len(w) AS INTEGER) AS words, round(CASE WHEN len(w) = 0 THEN 0 ELSE list_sum(list_transform(w, lambda y: length(y))) / len(w) END, 6) AS word_length,
  round(CASE WHEN len(lines) = 0 THEN 0 ELSE len(list_filter(lines, lambda y: regexp_matches(y, '[.!?…:;]["''”’»)\]]*{SPACE}*$'))) / len(lines) END, 6) AS end_punctuation FROM x"""


def llm_sql() -> dict:
    return {
        "p2_percentiles": PERCENTILES,
        "p8_round_trip": "SELECT doc_id, true AS same, md5(coalesce(text, '')) AS digest FROM documents",
        "p10_counts": P10_COUNTS,
        "p2_partials": f"{COUNTS} SELECT archetype, end_date, field, step, count(*) AS n FROM c GROUP BY ALL",
    }
