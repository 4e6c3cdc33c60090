"""Registration of a query with its SQL."""

from __future__ import annotations


def registry():
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(statement: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if statement is not None:
                sql[f.__name__] = statement
            return f

        return add

    return queries, sql, query


def rounded(df, *cols: str, digits: int = 6):
    """The frame with those columns rounded."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(c, digits) for c in cols})
