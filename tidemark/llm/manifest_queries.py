"""Queries of the manifest, divergence and exact deduplication operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import divergence, exact_dedup, merkle


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.col("n_chars").cast("decimal(20,0)")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = {"n_chars": F.when(struck, chars + 1).otherwise(chars)}
    made = merkle.manifest(_documents(spark, sf_dir), tampered=tampered)
    proof = F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256")
    return made.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_documents(spark, sf_dir))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


QUERIES = {
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_divergence": op12_source_divergence,
    "op13_exact_dedup": op13_exact_dedup,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_EXACT = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')) AS h FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(r) OVER w AS keep_row, count(*) OVER (PARTITION BY h) AS n
  FROM d WINDOW w AS (PARTITION BY h ORDER BY doc_id DESC NULLS LAST, r)
)
SELECT doc_id, keep_id, n::BIGINT AS group_size, r = keep_row AS kept, h AS text_sha256 FROM g
"""

#: One bit of the table-free CRC at a time: a step of -1 shifts, any other mixes a byte in.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), "
    "lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"
)


def _value(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(_value(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"


def _tree(leaves: str, name: str) -> str:
    """Every node of the trees over (g, pos, n, h), level by level; a root is the only node of its level."""
    return f"""{name} AS (
  SELECT g, 0 AS level, pos, n, h FROM {leaves}
  UNION ALL
  SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1
  GROUP BY g, level, pos // 2, n
)"""


_MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {_leaf("n_chars")} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars::HUGEINT + 1)")} ELSE {_leaf("n_chars")} END AS other
  FROM documents
), placed AS (
  SELECT *, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n FROM d
), leaves AS (SELECT g, pos, n, leaf AS h FROM placed),
{_tree("leaves", "nodes")},
tops AS (
  SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h, g AS lang FROM nodes WHERE n = 1
),
{_tree("tops", "upper")},
walk AS (
  SELECT r, 0 AS part, 0 AS level, pos, n, g, other AS x, '' AS seen FROM placed
  UNION ALL
  SELECT * FROM (
    SELECT w.r, w.part, w.level + 1, w.pos // 2, (w.n + 1) // 2, w.g,
           sha256(CASE WHEN s.h IS NULL THEN w.x WHEN w.pos % 2 = 0 THEN w.x || s.h ELSE s.h || w.x END), w.seen || coalesce(s.h, '')
    FROM walk w LEFT JOIN (SELECT *, 0 AS part, 0 AS zero FROM nodes UNION ALL SELECT NULL, level, pos, n, h, 1, 1 FROM upper) s
      ON s.part = w.part AND s.level = w.level AND s.pos = xor(w.pos, 1) AND (w.part = 1 OR s.g IS NOT DISTINCT FROM w.g)
    WHERE w.n > 1
    UNION ALL
    SELECT w.r, 1, 0, t.pos, t.n, w.g, w.x, w.seen FROM walk w JOIN tops t ON t.lang IS NOT DISTINCT FROM w.g WHERE w.n = 1 AND w.part = 0
  )
), ended AS (SELECT r, x, seen FROM walk WHERE part = 1 AND n = 1)
SELECT p.doc_id, p.leaf, t.h AS subroot, u.h AS root, sha256(e.seen) AS proof_sha256, e.x AS folded_root, e.x = u.h AS verified
FROM placed p JOIN ended e USING (r) JOIN tops t ON t.lang IS NOT DISTINCT FROM p.g, (SELECT h FROM upper WHERE n = 1) u
"""


def _share(n: str, total: str) -> str:
    return f"(1 + 1000000000 * ({n} + 5)::HUGEINT // ({total} + 5 * terms))::BIGINT"


_DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS MATERIALIZED (SELECT lang, sum(lang_n)::HUGEINT AS lang_total, count(*) AS terms FROM v GROUP BY lang),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(lang_total, 0) AS lang_total, coalesce(terms, 0) AS terms
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM n GROUP BY lang, source) USING (lang, source)
  LEFT JOIN l USING (lang)
), p AS MATERIALIZED (
  SELECT lang, source, term, coalesce(n, 0) AS n, {_share("coalesce(n, 0)", "total")} AS p, {_share("lang_n", "lang_total")} AS q
  FROM g JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= 50
"""

ORACLES = {"op11_merkle_manifest": _MANIFEST, "op12_source_divergence": _DIVERGENCE, "op13_exact_dedup": _EXACT}
