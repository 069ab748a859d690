"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from tidemark.llm import corpus_queries, manifest_queries, text_queries


def queries() -> dict:
    return corpus_queries.QUERIES | text_queries.QUERIES | manifest_queries.QUERIES


def oracle_sql() -> dict:
    return corpus_queries.ORACLES | text_queries.ORACLES | manifest_queries.ORACLES
