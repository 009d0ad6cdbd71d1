"""Alignment of two tokenizers' tokens of the same text, and how often their tokens meet across the corpus.

Both tokenizers cut the bytes of a text, so the ends of their tokens are two increasing lists of byte offsets. Galloping
intersection finds where they agree: every end of the shorter list is looked up in the longer one by steps that double
from a place already known, and then by halving. Equal ends cut both token sequences into groups. The rank of an end in
the other list, taken from the same search, tells where the bytes of a token begin and stop there: the differences of
two ranks are the tokens it overlaps.

A cut that neither tokenizer ever crosses (a single space between two visible characters, checked on the vocabulary) is
an end in both lists, so a text is aligned as the parts between such cuts, and a task keeps the alignment of parts that
it has seen. Corpus counts are a join: each document sends an id pair once, and the counts come back to its links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from screenspark.llm.bpe import BYTE_LEVEL, LONG, ByteLevelBpe
from screenspark.llm.common import give_back
from screenspark.operators.joins import join_keyed
from screenspark.session import materialise, scratch_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Parts whose alignment a task keeps, and characters of text that it handles at a time.
KEPT_PARTS, CHARS_AT_ONCE = 300_000, 6_000_000
#: Words that are encoded together.
WORDS_AT_ONCE = 50_000
#: Id pairs up to which their corpus counts are sent to every task (some 60 bytes each); more are joined by key.
BROADCAST_PAIRS = 1_000_000

_WORD = re.compile(r" \S+")


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For every number of ``short`` the first place of ``long`` whose number is not smaller; both increase strictly.

    The places of every second, fourth, eighth ... number bound the search of those between them: the search starts at
    the place of the left neighbour, doubles its step until it has passed the number, and halves what is left. All
    numbers of a level are searched at once, so the work is about a few steps per number of the shorter list.
    """
    n, m = len(short), len(long)
    place = np.full(n + 1, m, np.int64)
    stride = 1 << max(0, n - 1).bit_length()
    at = np.zeros(1, np.int64)[: min(n, 1)]
    while len(at):
        target = short[at]
        left = np.zeros(len(at), np.int64) if stride > n else place[np.maximum(at - stride, 0)] * (at >= stride)
        right = place[np.minimum(at + stride, n)]
        # Doubling: ``left`` is at most the wanted place, ``right`` at least.
        step, open_ = 1, np.flatnonzero(left < right)
        while len(open_):
            reached = left[open_] + step - 1
            inside = reached < right[open_]
            passed = np.zeros(len(open_), bool)
            passed[inside] = long[reached[inside]] >= target[open_[inside]]
            right[open_[passed]] = reached[passed]
            on = inside & ~passed
            left[open_[on]] = reached[on] + 1
            open_ = open_[on]
            step *= 2
        # Halving.
        open_ = np.flatnonzero(left < right)
        while len(open_):
            middle = (left[open_] + right[open_]) >> 1
            low = long[middle] < target[open_]
            left[open_[low]] = middle[low] + 1
            right[open_[~low]] = middle[~low]
            open_ = open_[left[open_] < right[open_]]
        place[at] = left
        if stride <= 1:
            break
        stride >>= 1
        at = np.arange(stride, n, 2 * stride)
    return place[:n]


def meet(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Alignment of two lists of ends over the same bytes (equal last ends): places of the common ends in both, and for
    every token of ``short`` the first and the last overlapping token of ``long``."""
    last = gallop(short, long)
    common = long[last] == short
    first = np.concatenate([[0], (last + common)[:-1]])
    return np.flatnonzero(common), last[common], first, last


class PlainBpe(ByteLevelBpe):
    """Byte-level BPE for which the names of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.library.encode_special_tokens = True


class Aligner:
    """Aligns texts under two tokenizer files; one per process and pair of files."""

    def __init__(self, bytes_path: str, pieces_path: str) -> None:
        import sentencepiece

        self.a = PlainBpe(bytes_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size = np.array([len(p) for p in self.a.pieces], np.int64)
        self.b_size = np.array([len(p) for p in self.b_bytes], np.int64)
        self.b_decimal = [str(k) for k in range(len(pieces))]
        self.forget()

    def forget(self) -> None:
        """Drop the kept parts."""
        self.number: dict[str, int] = {}  # of each known part
        self.text: list[str] = []  # its groups
        self.sums: list[np.ndarray] = [np.zeros((0, 6), np.int64)]  # aligned (0 or 1), tokens a, b, groups, links, first link
        self.codes: list[np.ndarray] = [np.zeros(0, np.int64)]  # links of all parts in a row, as a * len(b) + b
        self.n_codes = 0

    def cut(self, text: str) -> list[str]:
        return self.a.cut(text) if self.cuts else [text]

    def learn(self, parts: list[str]) -> None:
        """Align parts not seen before; each begins with the space that the second tokenizer adds by itself.

        Words with their space are encoded many at a time, as both tokenizers cut there; other parts one by one.
        """
        words, others = [], []
        for p in parts:
            (words if self.cuts and len(p) < 64 and _WORD.fullmatch(p) else others).append(p)
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            lines = ["".join(some[k : k + 500]) for k in range(0, len(some), 500)]
            if not self._add(some, self.a.whole(lines), self.b.encode([x[1:] for x in lines], num_threads=1)):
                others += some
        for at in range(0, len(others), WORDS_AT_ONCE):
            some = others[at : at + WORDS_AT_ONCE]
            of_short = iter(self.a.whole([p for p in some if len(p) <= LONG]))
            a_ids = [next(of_short) if len(p) <= LONG else self.a.tree(p) for p in some]
            b_ids = self.b.encode([p[1:] for p in some], num_threads=1)
            if not self._add(some, a_ids, b_ids):
                good = [self._whole(p, x, y) for p, x, y in zip(some, a_ids, b_ids)]
                kept = [k for k, ok in enumerate(good) if ok]
                self._add([some[k] for k in kept], [a_ids[k] for k in kept], [b_ids[k] for k in kept])
                bad = [p for p, ok in zip(some, good) if not ok]
                self.number.update(zip(bad, range(len(self.text), len(self.text) + len(bad))))
                self.text += [""] * len(bad)
                self.sums.append(np.zeros((len(bad), 6), np.int64))

    def _whole(self, part: str, a_ids: bytes, b_ids: list[int]) -> bool:
        """Whether both tokenizers' tokens give the part back."""
        raw = part.encode()
        a = b"".join([self.a.pieces[x] for x in np.frombuffer(a_ids, "<u4").tolist()])
        return a == raw and b"".join([self.b_bytes[x] for x in b_ids]) == raw

    def _add(self, parts: list[str], a_ids: list[bytes], b_ids: list[list[int]]) -> bool:
        """Align parts laid end to end, so that one search serves them all: the end of a part is common to both lists.
        False, and nothing done, if some tokens do not give the text back."""
        a = np.frombuffer(b"".join(a_ids), "<u4").astype(np.int64)
        b = np.array([x for ids in b_ids for x in ids], np.int64)
        raw = [p.encode() for p in parts]
        together = b"".join(raw)
        a_list, b_list = a.tolist(), b.tolist()
        if b"".join([self.a.pieces[x] for x in a_list]) != together or b"".join([self.b_bytes[x] for x in b_list]) != together:
            return False
        if not parts:
            return True
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.cumsum(np.array([len(x) for x in raw], np.int64))
        a_to, b_to = np.searchsorted(a_ends, ends, "right"), np.searchsorted(b_ends, ends, "right")
        if (a_ends[a_to - 1] != ends).any() or (b_ends[b_to - 1] != ends).any():
            return False
        n_a, n_b = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        sums = np.ones((len(parts), 6), np.int64)
        sums[:, 1], sums[:, 2] = n_a, n_b
        a_text, b_text = [self.a.decimal[x] for x in a_list], [self.b_decimal[x] for x in b_list]
        text = [""] * len(parts)
        for a_drives in (True, False):  # the shorter list of a part drives
            chosen = (n_a <= n_b) == a_drives
            if not chosen.any():
                continue
            of_a, of_b = np.flatnonzero(np.repeat(chosen, n_a)), np.flatnonzero(np.repeat(chosen, n_b))
            short, long = (a_ends[of_a], b_ends[of_b]) if a_drives else (b_ends[of_b], a_ends[of_a])
            at_short, at_long, first, last = meet(short, long)
            at_a, at_b = (at_short, at_long) if a_drives else (at_long, at_short)
            n = last - first + 1
            driver = np.repeat(np.arange(len(short)), n)
            other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            link_a, link_b = (driver, other) if a_drives else (other, driver)
            self.codes.append(a[of_a[link_a]] * len(self.b_bytes) + b[of_b[link_b]])
            part_ends = ends[chosen]
            groups_to = np.searchsorted(a_ends[of_a][at_a], part_ends, "right")
            links_to = np.cumsum(n)[np.searchsorted(short, part_ends, "right") - 1]
            sums[chosen, 3] = np.diff(groups_to, prepend=0)
            sums[chosen, 4] = np.diff(links_to, prepend=0)
            sums[chosen, 5] = self.n_codes + links_to - sums[chosen, 4]
            self.n_codes += len(link_a)
            last_a, last_b = of_a[at_a], of_b[at_b]
            size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
            groups = [
                f"{a_text[i]}|{b_text[j]}" if x == y == 1 else f"{','.join(a_text[i - x + 1 : i + 1])}|{','.join(b_text[j - y + 1 : j + 1])}"
                for i, j, x, y in zip(last_a.tolist(), last_b.tolist(), size_a.tolist(), size_b.tolist())
            ]
            g = 0
            for k, to in zip(np.flatnonzero(chosen).tolist(), groups_to.tolist()):
                text[k] = groups[g] if to == g + 1 else ";".join(groups[g:to])
                g = to
        self.number.update(zip(parts, range(len(self.text), len(self.text) + len(parts))))
        self.text += text
        self.sums.append(sums)
        return True

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.sums) > 1:
            self.sums, self.codes = [np.concatenate(self.sums)], [np.concatenate(self.codes)]
        return self.sums[0], self.codes[0]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For every text: sums (aligned, tokens a and b, groups, links) and groups; and for all texts in a row: how many
        distinct id pairs are linked in each, the pairs, and the links of each pair."""
        if len(self.number) > KEPT_PARTS:
            self.forget()
        cut = [self.cut(" " + t) if t else [] for t in texts]
        self.learn(list({p for parts in cut for p in parts if p not in self.number}))
        number = self.number
        sums, codes = self._tables()
        places = [[number[p] for p in parts] for parts in cut]
        lengths = np.array([len(x) for x in places], np.int64)
        flat = np.array([x for each in places for x in each], np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        total = np.zeros((len(texts), 5), np.int64)
        for k in range(5):
            running = np.concatenate([[0], np.cumsum(sums[flat, k])])
            total[:, k] = running[ends[1:]] - running[ends[:-1]]
        good = (total[:, 0] == lengths) & (lengths > 0)
        total[~good] = 0
        text = self.text
        groups = [";".join([text[x] for x in each]) if ok else "" for each, ok in zip(places, good.tolist())]
        n = sums[flat, 4] * np.repeat(good, lengths)
        link = codes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(sums[flat, 5], n)]
        of_text = np.repeat(np.repeat(np.arange(len(texts)), lengths), n)
        width = len(self.a.pieces) * len(self.b_bytes)
        both, times = np.unique(of_text * width + link, return_counts=True)
        distinct = np.bincount(both // width, minlength=len(texts))
        for p in {p for parts in cut for p in parts if len(p) > LONG}:  # long parts seldom come again
            self.text[number.pop(p)] = ""
        return total, groups, distinct, both % width, times


@lru_cache(maxsize=2)
def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    return Aligner(bytes_path, pieces_path)


def _batches(texts: list[str | None]) -> Iterator[slice]:
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars + len(texts[end] or "") <= CHARS_AT_ONCE):
            chars += len(texts[end] or "")
            end += 1
        yield slice(start, end)
        start = end


def aligned(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", digest: bool = False,
    bytes_path: str = BYTE_LEVEL, pieces_path: str = PIECES,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, times) of every row, without a shuffle.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``, or its sha256 with ``digest``; it is empty for rows without tokens: NULL and empty
    texts, and those whose tokens do not give back a space and the text in both tokenizers. ``pairs`` holds each linked
    id pair once, as ``a * (size of the second vocabulary) + b`` in ascending order, and ``times`` its links. Every row gives
    one, repeated ones and those with NULL ids too; further columns are ignored.
    """
    schema = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<int>"

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(bytes_path, pieces_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _batches(texts):
                total, groups, distinct, pairs, times = own.align(texts[part])
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                ends = pa.array(np.concatenate([[0], np.cumsum(distinct)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, part.stop - part.start),
                        *[pa.array(total[:, k]) for k in range(1, 5)],
                        pa.array(groups, pa.string()),
                        pa.ListArray.from_arrays(ends, pa.array(pairs)),
                        pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                    ],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
                )
        own.forget()
        give_back()

    kept = documents.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("t"))
    return kept.mapInArrow(of_batches, schema)


def pair_counts(rows: DataFrame, second_size: int) -> DataFrame:
    """(pair, n, best): in how many rows of ``aligned`` each id pair is linked, and whether none of its first id's pairs is
    linked in more. At most ``second_size`` pairs share a first id."""
    counted = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    of_first = Window.partitionBy(F.floor(F.col("pair") / F.lit(second_size)))
    return counted.withColumn("best", F.col("n") == F.max("n").over(of_first))


def document_alignments(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", bytes_path: str = BYTE_LEVEL, pieces_path: str = PIECES
) -> DataFrame:
    """Counts and digest of every document's alignment, with the corpus counts of its links.

    Rows as in ``aligned``. They are written to the shared folder once; the pairs in them are counted, and the counts go
    to every task if there are few pairs, else to the rows by a join on the pair that splits off frequent ones. Tables
    without rows or without any token give rows with zeros.
    """
    spark = documents.sparkSession
    second = len(aligner(bytes_path, pieces_path).b_bytes)
    path = scratch_path(spark, "alignments")
    made = aligned(documents, id_column, text, True, bytes_path, pieces_path)
    made.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    counts = materialise(pair_counts(rows, second))
    n_pairs, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    links = rows.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    if n_pairs <= BROADCAST_PAIRS:
        met = links.join(F.broadcast(counts), "pair")
    else:
        met = join_keyed(links, counts.withColumn("size", F.col("n")), ["pair"], "size", total)
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = F.lit(0).cast("bigint")
    return rows.join(sums, "row", "left").select(
        F.col("id").alias("doc_id"),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        F.col("groups").alias("groups_sha256"),
    )
