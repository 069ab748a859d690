"""Every registered query and its SQL, by name."""

from __future__ import annotations

import importlib

AREAS = (
    "obligation_queries",
    "text_queries",
    "news_queries",
    "monitoring_queries",
    "event_queries",
    "quality_queries",
    "digest_queries",
)


def _collect(attribute: str) -> dict:
    out = {}
    for area in AREAS:
        for name, value in getattr(importlib.import_module(f"tidemark.plans.{area}"), attribute).items():
            if name in out:
                raise ValueError(f"{name} is registered twice")
            out[name] = value
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
