"""Every operator as a query over the given tables, with its SQL equivalent.

Each module has ``QUERIES`` (name -> function of session and table folder) and
``ORACLES`` (name -> SQL for the same result). Queries run over whole tables;
timestamps and lists are returned as text so that engines compare equal.
"""

from __future__ import annotations

from lodestone.catalog import documents, pages, status, vectors

MODULES = (pages, documents, status, vectors)


def all_queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_oracles():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
