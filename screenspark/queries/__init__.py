"""Every operator as a runnable query on the given tables, next to the SQL that gives the same rows."""

from screenspark.queries.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
