"""Registered queries, one or more per operator, each with its DuckDB counterpart where the
operation is expressible in SQL."""

from __future__ import annotations


def _load():
    from . import aggregates, base, builds, joins, models, results, scalars, sources, text, windows  # noqa: F401
    return base


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
