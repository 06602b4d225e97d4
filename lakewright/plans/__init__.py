"""Named queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import catalogue, feeds, records, texts, work

MODULES = (catalogue, feeds, records, texts, work)


def queries():
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
