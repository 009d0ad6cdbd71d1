"""Joins of a large table with a keyed one: by broadcast if the size is proven, else with hot keys split off.

Keys compare NULL-safe throughout: a row whose key is NULL finds the statistics of the NULL key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenspark.session import materialise

#: Rows up to which a table of statistics is fetched and sent to every task.
SMALL_ROWS = 50_000
#: A key with at least this share of all rows is hot. By arithmetic there are at most 1 / share such keys.
HOT_SHARE = 0.001


def null_safe(rows: DataFrame, keyed: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where NULL equals NULL; the columns of ``rows`` and then the others of ``keyed``."""
    if not on:
        raise ValueError("a join needs a key")
    others = [c for c in keyed.columns if c not in on]
    renamed = keyed.select(*[F.col(c).alias(f"_on_{c}") for c in on], *others)
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return rows.join(renamed, condition, how).drop(*[f"_on_{c}" for c in on])


def join_small(rows: DataFrame, statistics: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table of statistics that is expected to be small.

    It is computed at once, reading at most SMALL_ROWS + 1 rows. If that was all, the fetched rows are broadcast: the
    size is known, the large table stays in place, and its statistics are not computed again. A larger table is
    written down, so that it is computed once, and joined by key, where adaptive execution splits hot keys.
    """
    fetched = statistics.limit(SMALL_ROWS + 1).collect()
    if len(fetched) > SMALL_ROWS:
        return null_safe(rows, materialise(statistics), on, how)
    local = rows.sparkSession.createDataFrame(fetched, statistics.schema)
    return null_safe(rows, F.broadcast(local), on, how)


def join_keyed(rows: DataFrame, keyed: DataFrame, on: Sequence[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key, where ``keyed`` also carries the number of rows of each key.

    The hot keys, at most 1 / HOT_SHARE of them, go to every task and their rows stay where they are. The rest is
    shuffled, and no task gets more than HOT_SHARE of the rows for one key.
    """
    is_hot = F.col(size) >= F.lit(max(1.0, HOT_SHARE * total))
    hot = F.broadcast(keyed.where(is_hot))
    near = null_safe(rows, hot, on)
    rest = null_safe(rows, hot.select(*on), on, "left_anti")
    return near.unionByName(null_safe(rest, keyed.where(~is_hot), on))
