"""Queries over the given tables, grouped by stage, each with its check SQL."""

from __future__ import annotations


def _load() -> None:
    from attesta.plans import web, texts, replies, claims, nearest, verify, runs  # noqa: F401


def all_queries() -> dict:
    from attesta.plans.registry import QUERIES
    _load()
    return dict(QUERIES)


def all_checks() -> dict:
    from attesta.plans.registry import CHECKS
    _load()
    return dict(CHECKS)
