"""Where the modules of this package enter their queries and the SQL that gives the same rows."""

from __future__ import annotations

from hearthledger.sources.fixtures import with_views

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, *views: str):
    """Enter a function (spark, sf_dir) -> DataFrame as a query, with DuckDB's SQL over the named views."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add
