"""Where the plan modules put their queries."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function, with its SQL twin where one exists."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            # "by" is a block coordinate here and a keyword in SQL.
            SQL[name] = re.sub(r'(?<![\w"])by(?![\w"])', '"by"', sql)
        return fn
    return add
