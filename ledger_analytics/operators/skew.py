"""Joins on keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_analytics.sources.materialize import materialize

#: A key is heavy with more than one in so many rows, so there are at most so many heavy keys.
HEAVY = 1000


def never_broadcast(rows: DataFrame) -> DataFrame:
    """``rows`` for an inner join in which neither side is to pass through the driver.

    A stored ledger of few distinct values is some twenty times as large in memory as its
    files, by whose size Spark decides; so a join of it with what is derived from it would
    broadcast all of its rows.
    """
    return rows.hint("merge")


def join_attributes(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, name: str) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row per ``key`` and in ``count`` the
    number of rows with it, of ``total``.

    Rows with a heavy key get its attributes by broadcast, of a table of at most ``HEAVY``
    rows, and are not shuffled; so no task gets all rows of a heavy key, with or without
    adaptive execution. The others are joined as usual.
    """
    table = materialize(table, name)
    if table.where(F.col(count) * HEAVY > F.lit(total)).isEmpty():
        return rows.join(table, key, "left")
    heavy = F.broadcast(table.where(F.col(count) * HEAVY > F.lit(total)))
    light = table.where(F.col(count) * HEAVY <= F.lit(total))
    joined = rows.join(heavy, key)
    rest = rows.join(heavy.select(key), key, "left_anti").join(light, key, "left")
    return joined.unionByName(rest)
