"""Small helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenspark.session import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays (``lower`` would also change accented letters)."""
    return F.translate(text, UPPER, UPPER.lower())


def numbered_columns(df: DataFrame, *wanted: str) -> tuple[DataFrame, tuple[str, ...]]:
    """The rows with columns c0, c1 ... in place of their names, and the new names of the wanted ones.

    So columns may have any names: dots, names that differ in case only, and names that an operator uses itself.
    ``.toDF(*df.columns)`` gives the names back. A wanted name is looked up as it is, then without regard to case.
    """
    columns = df.columns
    lowered = [c.lower() for c in columns]
    found = []
    for name in wanted:
        if name not in columns and name.lower() not in lowered:
            raise ValueError(f"no column {name}")
        found.append(f"c{columns.index(name) if name in columns else lowered.index(name.lower())}")
    return df.toDF(*[f"c{k}" for k in range(len(columns))]), tuple(found)


def id_remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo a small number; NULL ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def unit_draw(*parts: Column) -> Column:
    """A repeatable number in (0, 1) from a hash of the parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def bounded_sample(rows: DataFrame, key: Iterable[Column], limit: int, seed: int = 7) -> DataFrame:
    """About ``limit`` rows by hash of the key (all of them if there are fewer); the same rows in any layout.

    The expected size is the bound; the number is binomial, so it passes 1.1 x limit with a probability below 1e-20
    for limits of 10,000 and more. Rows with equal keys are all in or all out: hash a key that tells rows apart.
    """
    n = rows.count()
    if n <= limit:
        return rows
    return rows.where(unit_draw(F.lit(seed), *key) < F.lit(limit / n))


def sent_if_small(rows: DataFrame, limit: int, entries: Column | None = None) -> DataFrame:
    """The rows, written down so that they are made once, with a broadcast hint if they hold at most ``limit`` entries
    (by default rows); a join with more is left to the optimizer."""
    kept = materialise(rows)
    n = kept.agg(F.sum(F.lit(1) if entries is None else entries)).first()[0] or 0
    return F.broadcast(kept) if n <= limit else kept


def sorted_runs(frames: Iterable[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Cut frames whose rows come sorted by ``key`` so that no key is spread over two frames."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = tuple(frame[key].iloc[-1])
        open_from = int((frame[key] == last).all(axis=1).to_numpy().argmax())
        if open_from:
            yield pd.concat([*held, frame.iloc[:open_from]], ignore_index=True) if held else frame.iloc[:open_from]
            held = [frame.iloc[open_from:]]
        elif held and tuple(held[0][key].iloc[0]) != last:
            yield pd.concat(held, ignore_index=True)
            held = [frame]
        else:
            held.append(frame)
    if held:
        yield pd.concat(held, ignore_index=True)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a table that this run wrote to the shared folder and no longer reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Return freed memory of a Python worker to the system at the end of a task; idle workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
