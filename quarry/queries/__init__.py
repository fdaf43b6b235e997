"""Registered queries: each runs an operator over the tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from .registry import QUERIES, SQL
from . import clusters, geo, jobs, names, plans, records, sequences, sources, streams, text, typing  # noqa: E402, F401  (they register)


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
