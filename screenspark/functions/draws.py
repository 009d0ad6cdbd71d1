"""Repeatable random draws. The same seed and key give the same draw on any cluster and in any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def hash_key(seed: int | str, *keys: Column | str) -> Column:
    """32 hex digits, uniform over rows with distinct keys; used as the shuffle order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_as_column(k).cast("string") for k in keys]))


def draw32(seed: int | str, *keys: Column | str) -> Column:
    """Whole number in [0, 2^32)."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("bigint")


def draw60(seed: int | str, *keys: Column | str) -> Column:
    """Whole number in [0, 2^60): a remainder by a row count is as good as unbiased."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 15), 16, 10).cast("bigint")


def draw_unit(seed: int | str, *keys: Column | str) -> Column:
    """Number in [0, 1)."""
    return draw32(seed, *keys) / F.lit(TWO_32)
