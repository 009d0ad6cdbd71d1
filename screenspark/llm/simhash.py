"""Near-duplicates by SimHash fingerprints, found with tables of pivot distances.

A text's fingerprint is the bitwise majority over the hashes of its shingles. The 64 bits are cut into five blocks;
each block has reference fingerprints ("pivots"), and the table of a fingerprint holds its Hamming distances to all of
them, each taken over the pivot's own block. A flipped bit moves every distance of its block by exactly one and no
other, so two fingerprints that differ in k bits have distance rows whose largest coordinate differences, added over
the blocks, are at most k.

Candidates: at k <= 2 flips three of the five blocks are untouched, so linked fingerprints share the pivot distances of
at least one of the ten choices of three blocks. Rows are keyed by those distances; in a key's bucket, pairs are
discarded by the maximum coordinate differences and survivors verified on the bits. Equal fingerprints are collapsed
first. Buckets send on a spanning forest of their links, never the pairs. A bucket too large for one task's pass is cut
into parts, every two of which are searched like a bucket of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.llm.common import give_back, numbered_columns, sent_if_small, sorted_runs
from screenspark.llm.graph import components
from screenspark.operators.joins import join_keyed
from screenspark.session import materialise

SHINGLE, MAX_BITS, HASH_SEED = 3, 2, 42
#: The five blocks of bits and the pivots of each.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
PIVOTS_PER_BLOCK = 8
#: Members up to which a bucket is searched in one pass of a task.
PASS_ROWS = 4096
#: Shingles hashed at a time: bounds the memory for long texts.
CHUNK = 1 << 17
#: Keys of dropped rows (two numbers each) up to which they are sent to every task; more are joined by key.
BROADCAST_ROWS = 500_000

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def pivot_masks() -> tuple[np.ndarray, np.ndarray]:
    """Pivots and the masks of their blocks, as unsigned 64-bit numbers; made from a fixed seed."""
    draw = np.random.default_rng(20240501)
    masks = [np.uint64(((1 << (high - low)) - 1) << low) for low, high in BLOCKS for _ in range(PIVOTS_PER_BLOCK)]
    pivots = [np.uint64(int(draw.integers(0, 1 << 63)) * 2 + 1) & mask for mask in masks]
    return np.array(pivots, np.uint64), np.array(masks, np.uint64)


PIVOTS, MASKS = pivot_masks()


def pivot_distances(prints: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot over the pivot's block: (n, pivots) small integers."""
    return np.bitwise_count((prints[:, None] ^ PIVOTS[None, :]) & MASKS[None, :]).astype(np.int8)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit majority fingerprint of a text; NULL and texts without words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < size:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[: len(words) - size] + 1])
        shingles = (joined[a:b] for a, b in zip(starts.tolist(), ends[size - 1 :].tolist()))
    hashed = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), 0
    while True:
        part = np.fromiter((hashed(s, HASH_SEED) for s in itertools.islice(shingles, CHUNK)), np.uint64)
        if not len(part):
            break
        n += len(part)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, mark, fp): a hash of every text and its fingerprint as a signed long. Words are cut at ASCII white space,
    A-Z lowered."""

    def of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prints = np.array([fingerprint(t, size) for t in frame["t"]], np.uint64)
            yield pd.DataFrame({"id": frame["id"], "mark": frame["mark"], "fp": prints.view(np.int64)})
        give_back()

    kept = documents.select(F.col(id_column).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("t"))
    return kept.mapInPandas(of_frames, "id bigint, mark bigint, fp bigint")


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ten rows per fingerprint: the pivot distances of three blocks, folded into one long with the choice."""
    choices = list(itertools.combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS))
    # Distances below 16 are hexadecimal digits; multiply-and-add folds the row. A collision only adds candidates.
    factors = np.random.default_rng(7).integers(1, 1 << 62, len(PIVOTS), dtype=np.int64) | 1
    for frame in frames:
        prints = frame["fp"].to_numpy(np.int64)
        table = pivot_distances(prints.view(np.uint64)).astype(np.int64)
        weighed = (table * factors).reshape(len(prints), len(BLOCKS), PIVOTS_PER_BLOCK).sum(2)
        for k, blocks in enumerate(choices):
            key = weighed[:, list(blocks)].sum(1) * 16 + k
            yield pd.DataFrame({"key": key, "fp": prints})


def _near(prints: np.ndarray, table: np.ndarray, i: int, rest: np.ndarray, bits: int) -> np.ndarray:
    """Members of ``rest`` within ``bits`` of member i: pivots discard, then the bits decide."""
    apart = np.abs(table[rest] - table[i]).reshape(len(rest), len(BLOCKS), PIVOTS_PER_BLOCK).max(2).sum(1)
    rest = rest[apart <= bits]
    return rest[np.bitwise_count(prints[rest] ^ prints[i]) <= bits]


def _bucket_links(bits: int):
    def of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A spanning forest of the links of each bucket."""
        for frame in sorted_runs(frames, ["key", "i", "j"]):
            keys, signed = frame[["key", "i", "j"]].to_numpy(), frame["fp"].to_numpy(np.int64)
            prints = signed.view(np.uint64)
            table = pivot_distances(prints)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            a: list[int] = []
            b: list[int] = []
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                rest = np.arange(low, high)
                while len(rest):
                    root, rest = rest[0], rest[1:]
                    front = [root]
                    while front and len(rest):
                        near = _near(prints, table, front.pop(), rest, bits)
                        if len(near):
                            rest = np.setdiff1d(rest, near, assume_unique=True)
                            front.extend(near.tolist())
                            a.extend([int(root)] * len(near))
                            b.extend(near.tolist())
            yield pd.DataFrame({"a": signed[a], "b": signed[b]})

    return of_frames


def fingerprint_links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints (column fp) which differ in ``bits`` bits or fewer (0 to 2).

    The links need not be direct ones: they span the components of the direct links, within each bucket.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError("the five blocks serve distances up to two bits")
    keyed = materialise(distinct.select("fp").mapInPandas(_keys, "key bigint, fp bigint"))
    sizes = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    sized = join_keyed(keyed, sizes, ["key"], "n", sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    # A bucket of more than PASS_ROWS is cut into parts, and every two of them are searched together: a row of part p is in
    # the pairs (p, p .. last) and (0 .. p - 1, p).
    parts = sized.withColumn("parts", F.ceil(F.col("n") / max(1, PASS_ROWS // 2)).cast("int")).withColumn("parts", F.when(F.col("n") <= PASS_ROWS, 1).otherwise(F.col("parts")))
    placed = parts.withColumn("at", F.pmod(F.xxhash64("fp", "key"), F.col("parts")).cast("int"))
    later = F.transform(F.sequence("at", F.col("parts") - 1), lambda j: F.struct(F.col("at").alias("i"), j.alias("j")))
    sooner = F.filter(F.sequence(F.lit(0), F.col("at")), lambda i: i < F.col("at"))
    sooner = F.transform(sooner, lambda i: F.struct(i.alias("i"), F.col("at").alias("j")))
    spread = placed.select("key", "fp", F.inline(F.concat(later, sooner)))
    spread = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return spread.mapInPandas(_bucket_links(bits), "a bigint, b bigint")


def near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SHINGLE, bits: int = MAX_BITS
) -> DataFrame:
    """(id, mark, fp, root, component): root names the group, component is the smallest id
    that links reach from each document, through equal or near fingerprints; mark is a hash of the text.

    One row per row of ``documents``, copies included. NULL, empty and wordless texts have fingerprint zero and are
    linked like any other. A NULL id is never the smallest; a component without ids has a NULL one. An empty table
    gives an empty result; further columns are ignored.
    """
    prints = materialise(fingerprints(documents, id_column, text, size))
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")))
    n_prints, n_rows = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    roots = materialise(components(fingerprint_links(distinct, bits)))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    member = member.select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    # One group may hold a third of all fingerprints, and one fingerprint a third of all rows.
    first = member.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("size"))
    member = materialise(join_keyed(member, first, ["root"], "size", n_prints).select("fp", "root", "component", "copies"))
    return join_keyed(prints, member, ["fp"], "copies", n_rows).select("id", "mark", "fp", "root", "component")


def one_per_group(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SHINGLE, bits: int = MAX_BITS
) -> DataFrame:
    """One row of every group of near-duplicates, that of the smallest id (of equal ids, the smallest hash of the
    text; of equal rows, any); NULL ids come last. All columns as they were.

    The rows to drop, by id and hash, go back to the scan of the documents; texts are not grouped.
    """
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")
    inner, (i, t) = numbered_columns(documents, id_column, text)
    found = near_duplicates(inner, i, t, size, bits)
    rows = materialise(found.groupBy("root", "id", "mark").agg(F.count(F.lit(1)).alias("n")))
    first = rows.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size"))
    told = materialise(join_keyed(rows, first, ["root"], "size", rows.count()).withColumn("stays", order == F.col("first")))
    again = told.where("stays and n > 1").select("id", "mark")
    gone = sent_if_small(told.where("not stays or n > 1").select("id", "mark"), BROADCAST_ROWS)

    keyed = inner.withColumns({"__id": F.col(i).cast("bigint"), "__mark": F.xxhash64(t)})

    def same(keys: DataFrame) -> Column:
        return keyed["__id"].eqNullSafe(keys["id"]) & (keyed["__mark"] == keys["mark"])

    left = keyed.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        again = sent_if_small(again, BROADCAST_ROWS)
        left = left.unionByName(keyed.join(again, same(again), "left_semi").dropDuplicates(["__id", "__mark"]))
    return left.drop("__id", "__mark").toDF(*documents.columns)


def linked_documents(documents: DataFrame) -> DataFrame:
    """Fingerprint in hexadecimal and component of every document."""
    found = near_duplicates(documents)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
