"""The catalogue of queries."""

from __future__ import annotations

from tidemark.plans.registry import ORACLES, QUERIES, Query


def all_queries() -> dict[str, Query]:
    from tidemark.plans import catalogue  # noqa: F401

    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from tidemark.plans import catalogue  # noqa: F401

    return dict(ORACLES)
