"""Queries of the operators that the corpus pipeline chains, with SQL where it can express them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, line_dedup, packing, quality, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), word_tokenizer())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), keep=["doc_id", "text"])
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op4_simhash": op4_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op9_line_dedup": op9_line_dedup,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id,
         coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)
), hits AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, gram)),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS found FROM hits GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(found), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(found, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""



def _quality_sql(rounds: int = 25) -> str:
    """The rules, their votes and every round of the estimation, as one query."""
    rules = range(len(quality.RULES))

    def vote(name: str, good_from: float, good_to: float, bad_below: float, bad_above: float) -> str:
        good = f"{name} >= {good_from}" + (f" AND {name} <= {good_to}" if good_to != math.inf else "")
        bad = f"{name} < {bad_below}" + (f" OR {name} > {bad_above}" if bad_above != math.inf else "")
        return f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END"

    odds = "ln(good) - ln(1 - good)" + "".join(
        f" + CASE WHEN v{j} > 0 THEN ln(a{j}) - ln(1 - b{j} + 1e-12) WHEN v{j} < 0 THEN ln(1 - a{j} + 1e-12) - ln(b{j}) ELSE 0 END" for j in rules
    )
    start = ", ".join(f"0.95::DOUBLE AS a{j}, 0.5::DOUBLE AS b{j}" for j in rules)
    share = lambda j, right, weight, own, all_: (
        f"({own} + coalesce(sum({weight}) FILTER (v{j} {right} 0), 0)) / ({all_} + coalesce(sum({weight}) FILTER (v{j} <> 0), 0))"
    )
    steps = [f"m0 AS MATERIALIZED (SELECT 0.8::DOUBLE AS good, {start})"]
    for i in range(1, rounds + 1):
        steps.append(f"e{i} AS MATERIALIZED (SELECT p.*, 1 / (1 + exp(-greatest(-500, least(500, {odds})))) AS p FROM patterns p, m{i - 1})")
        each = ", ".join(f"{share(j, '>', 'n * p', 9.5, 10)} AS a{j}, {share(j, '<', 'n * (1 - p)', 5.0, 10)} AS r{j}" for j in rules)
        kept = ", ".join(f"a{j}, greatest(r{j}, 1 - a{j}) AS b{j}" for j in rules)
        total = "(8 + coalesce(sum(n * p), 0)) / (10 + coalesce(sum(n), 0)) AS good"
        steps.append(f"m{i} AS MATERIALIZED (SELECT good, {kept} FROM (SELECT {total}, {each} FROM e{i}))")
    names = ", ".join(f"v{j}" for j in rules)
    votes = ", ".join(f"{vote(*rule)} AS v{j}" for j, rule in enumerate(quality.RULES))
    space, symbol = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), again AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1) GROUP BY r
), f AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '{symbol}', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '{symbol}'))) AS marked,
         len(regexp_extract_all(t, '{symbol}(?:{space}|$)')) AS ends, len(regexp_extract_all(t, '\p{{Lu}}')) AS upper,
         length(t) - length(replace(t, '!', '')) AS exclaims, length(t) - length(regexp_replace(t, '[.?!]', '', 'g')) AS stops
  FROM w LEFT JOIN again USING (r)
), x AS (
  SELECT *, word_chars / greatest(n_words, 1) AS chars_per_word, n_symbols / greatest(n_words, 1) AS symbols_per_word,
         n_symbols / greatest(word_chars, 1) AS symbol_share, ends / greatest(n_words, 1) AS symbol_end_share,
         marked / greatest(n_lines, 1) AS symbol_line_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
         n_repeat_words / greatest(n_words, 1) AS repeat_word_share, upper / greatest(word_chars, 1) AS upper_share,
         exclaims / greatest(n_words, 1) AS exclaims_per_word, stops / greatest(n_words, 1) AS stops_per_word
  FROM f
), v AS MATERIALIZED (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {votes} FROM x),
patterns AS MATERIALIZED (SELECT {names}, count(*) AS n FROM v GROUP BY {names}),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {odds} >= 0 AS kept
FROM v, m{rounds}
"""


ORACLES = {"op1_decontamination": _DECONTAMINATION, "op6_quality_rules": _quality_sql()}
