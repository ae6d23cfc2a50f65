"""What a query is: the projections it needs, the operator over them, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

Frames = dict[str, DataFrame]


@dataclass(frozen=True)
class Query:
    needs: tuple[str, ...]
    run: Callable[[Frames], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, needs: str, sql: str | None):
    def add(f: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        QUERIES[name] = Query(tuple(needs.split()), f, sql)
        return f

    return add
