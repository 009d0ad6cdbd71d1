"""Token ids of a corpus in files: frequency-ranked, byte-aligned codes with separate control bytes.

An id is replaced by its rank in the corpus's id frequencies, so frequent ids are small numbers. A number takes one to
four bytes, low byte first; two bits per number say how many. The control bytes (four numbers each, low bits first)
and the data bytes are two streams, so a reader expands the control bytes by a table and fills all numbers at once,
without a branch per number.

A token file is a folder of Parquet files: ``ids`` has one row per document, in ascending document order over the part
numbers and within each, and ``ranks`` the id of every rank. Spark writes it, so it can lie in any store, and a task
that runs again after a lost executor replaces its own part.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screenspark.llm.common import drop_scratch, give_back
from screenspark.session import scratch_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Pieces of words whose ids a task keeps, and characters of text that it handles at a time.
KEPT_PIECES, CHARS_AT_ONCE = 700_000, 8_000_000

#: For every control byte and each of its four numbers: which of four data bytes are there.
PRESENT = np.array([[[byte <= control >> 2 * k & 3 for byte in range(4)] for k in range(4)] for control in range(256)])


def pack_all(numbers: np.ndarray, lengths: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of sequences of numbers below 2**32 that lie one after the other."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    more = (numbers >= 1 << 8).astype(np.uint8) + (numbers >= 1 << 16) + (numbers >= 1 << 24)
    data = numbers.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]].tobytes()
    ends = np.cumsum(lengths)
    bytes_to = np.concatenate([[0], np.cumsum(more, dtype=np.int64)])[ends] + ends
    # Every sequence begins a control byte of its own.
    fours_to = np.cumsum(-(-lengths // 4))
    place = np.arange(len(numbers)) + np.repeat(4 * (fours_to - -(-lengths // 4)) - (ends - lengths), lengths)
    fours = np.zeros(4 * int(fours_to[-1]) if len(lengths) else 0, np.uint8)
    fours[place] = more
    fours = fours.reshape(-1, 4)
    control = (fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6).tobytes()

    def cut(whole: bytes, to: np.ndarray) -> list[bytes]:
        to = to.tolist()
        return [whole[i:j] for i, j in zip([0, *to[:-1]], to)]

    return cut(control, fours_to), cut(data, bytes_to)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of numbers below 2**32."""
    control, data = pack_all(numbers, np.array([len(numbers)]))
    return control[0], data[0]


def unpack_all(control: list[bytes], data: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The numbers of ``pack_all``, one sequence after the other, by table lookup."""
    fours = -(-lengths // 4)
    present = PRESENT[np.frombuffer(b"".join(control), np.uint8)].reshape(-1, 4)
    ends = np.cumsum(lengths)
    place = np.arange(int(lengths.sum())) + np.repeat(4 * (np.cumsum(fours) - fours) - (ends - lengths), lengths)
    numbers = np.zeros((len(place), 4), np.uint8)
    numbers[present[place]] = np.frombuffer(b"".join(data), np.uint8)
    return numbers.reshape(-1).view("<u4")


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of ``pack``."""
    return unpack_all([control], [data], np.array([n]))


#: What the tokenizer's own first step cuts lower-case text into, and the space between two words.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+| ")
_WORD_END = "</w>"


def _gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class WordBpe:
    """Encodes with a tokenizer file that drops white space and marks the last token of a word.

    A text's ids are those of its words in a row. Words are cut at spaces and counted as distinct ones; those are cut into the
    tokenizer's own pieces, all together, and pieces not seen before are encoded by the library, many at a time: the marked
    tokens tell them apart. Ids are gathered by number, pieces into words and words into texts.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for token, k in self.library.get_vocab().items():
            self.ends[k] = token.endswith(_WORD_END)
        # Two bytes hold an id of a vocabulary this small, which halves what is written and shuffled.
        self.kind = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        """Drop the known pieces; number 0 is the space between two words and has no ids."""
        self.number: dict[str, int] = {" ": 0}
        self.flat, self.size = [np.zeros(0, self.kind)], [np.zeros(1, np.int64)]

    def _learn(self, new: list[str]) -> None:
        """Encode pieces and keep their ids."""
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            size = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
            if len(size) != len(part):  # a piece that the library cuts further
                each = [e.ids for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
                ids, size = np.array([x for e in each for x in e], self.kind), np.array([len(e) for e in each], np.int64)
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part))))
            self.flat.append(ids)
            self.size.append(size)

    def encode(self, texts: list[str]) -> Iterator[list[bytes]]:
        """Ids of every text, in order, as little-endian numbers of ``kind``, in lists of some texts."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= CHARS_AT_ONCE):
                chars += len(texts[end])
                end += 1
            words = pc.split_pattern(pa.array(texts[start:end], pa.large_string()), " ")
            coded = words.flatten().dictionary_encode()
            yield self._joined(coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.diff(words.offsets.to_numpy()))
            start = end

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        if len(self.number) > KEPT_PIECES:
            self.forget()
        text = " ".join(words)
        # Special tokens, and a sigma that Python lower-cases by its neighbours: the library gets the whole word.
        whole = [k for k, w in enumerate(words) if "<|" in w or "\u03a3" in w] if "<|" in text or "\u03a3" in text else []
        if whole:
            taken = set(whole)
            text = " ".join(["" if k in taken else w for k, w in enumerate(words)])
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        pieces = _PIECE.findall(text.lower())
        self._learn(list(set(pieces) - self.number.keys()))
        number = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        if len(self.flat) > 1:
            self.flat, self.size = [np.concatenate(self.flat)], [np.concatenate(self.size)]
        size = self.size[0][number]
        ids = _gathered(self.flat[0], (np.cumsum(self.size[0]) - self.size[0])[number], size)
        of_word = np.bincount(np.cumsum(number == 0), size, len(words)).astype(np.int64)
        if whole:
            each = [e.ids for e in self.library.encode_batch_fast([words[k] for k in whole], add_special_tokens=False)]
            before = (np.cumsum(of_word) - of_word)[whole]
            ids = np.insert(ids, np.repeat(before, [len(e) for e in each]), np.array([x for e in each for x in e], self.kind))
            of_word[whole] += [len(e) for e in each]
        return ids, of_word

    def _joined(self, distinct: list[str], place: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        if not distinct:
            return [b""] * len(lengths)
        flat, size = self._of_words(distinct)
        first = np.cumsum(size) - size
        # All words in a row: the ids of the distinct words, gathered by their places.
        n = size[place]
        ends = np.cumsum(n)
        ids = _gathered(flat, first[place], n)
        raw, width = ids.tobytes(), self.kind.itemsize
        after = np.concatenate([[0], ends])[np.cumsum(lengths)] * width
        return [raw[a:b] for a, b in zip([0, *after[:-1].tolist()], after.tolist())]


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _ids(documents: DataFrame, id_column: str, text: str, path: str, end_id: int) -> DataFrame:
    """(id, crc, ids): raw ids of each whole text and the end id; crc orders rows of equal id."""

    def of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = word_bpe(path)
        end = np.array([end_id], coder.kind).tobytes()
        for frame in frames:
            at = 0
            for part in coder.encode(["" if t is None else t for t in frame["t"]]):
                ids = [x + end for x in part]
                here = frame["id"].iloc[at : at + len(ids)].reset_index(drop=True)
                yield pd.DataFrame({"id": here, "crc": [zlib.crc32(x) for x in ids], "ids": ids})
                at += len(ids)
        give_back()

    kept = documents.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("t"))
    return kept.mapInPandas(of_frames, "id bigint, crc bigint, ids binary")


def _frequencies(frames: Iterator[pd.DataFrame], kind: np.dtype, size: int) -> Iterator[pd.DataFrame]:
    total = np.zeros(size, np.int64)
    for frame in frames:
        total += np.bincount(np.frombuffer(b"".join(frame["ids"]), kind), minlength=size)
    some = np.flatnonzero(total)
    yield pd.DataFrame({"token": some, "n": total[some]})


def write_token_file(
    documents: DataFrame, path: str, id_column: str = "doc_id", text: str = "text",
    tokenizer: str = WORD_BPE, end_id: int = END_ID,
) -> None:
    """Encode every whole text, append the end id, and write the token file ``path`` in ascending document order.

    NULL and empty texts have only the end id. NULL document ids come first; rows of equal id are ordered by their
    ids' checksum. Every row of ``documents`` is written, repeated ones too; further columns are ignored.
    """
    spark = documents.sparkSession
    raw_path = scratch_path(spark, "raw-ids")
    _ids(documents, id_column, text, tokenizer, end_id).write.option("compression", "zstd").parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    coder = word_bpe(tokenizer)
    kind, size = coder.kind, max(len(coder.ends), end_id + 1)
    counted = raw.select("ids").mapInPandas(lambda frames: _frequencies(frames, kind, size), "token bigint, n bigint")
    counted = counted.groupBy("token").agg(F.sum("n").alias("n"))
    ranked = counted.orderBy(F.desc("n"), "token").collect()  # the vocabulary bounds it
    spark.createDataFrame([(k, r["token"]) for k, r in enumerate(ranked)], "rank bigint, token bigint").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(size, np.uint32)
    rank_of[[r["token"] for r in ranked]] = np.arange(len(ranked))

    def of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), 0
        for frame in frames:
            n = frame["ids"].map(len).to_numpy(np.int64) // kind.itemsize
            control, data = pack_all(rank_of[np.frombuffer(b"".join(frame["ids"]), kind)], n)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pd.DataFrame({"part": part, "before": starts, "id": frame["id"].astype("Int64"), "n": n, "control": control, "data": data})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = raw.repartitionByRange(parts, "id", "crc").sortWithinPartitions("id", "crc")
    coded = ordered.mapInPandas(of_frames, "part int, before bigint, id bigint, n bigint, control binary, data binary")
    coded.write.parquet(f"{path}/ids")
    drop_scratch(spark, raw_path)


def token_by_rank(spark: SparkSession, path: str) -> np.ndarray:
    """The id of every rank; as long as the vocabulary at most."""
    return np.array([r["token"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, ids): the ids of every document and the number of ids of all documents before it."""
    return _read(spark, path, lambda ids: ids.astype(np.int64), "array<bigint>")


def _read(spark: SparkSession, path: str, of_ids, kind: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/ids")
    by_rank = token_by_rank(spark, path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n").alias("n"))  # one row per part file
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("parts_before"))

    def of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = frame["n"].to_numpy(np.int64)
            flat = by_rank[unpack_all(frame["control"].to_list(), frame["data"].to_list(), n)]
            ids = np.split(flat, np.cumsum(n)[:-1])
            yield pd.DataFrame({"id": frame["id"].astype("Int64"), "start": frame["start"], "n": frame["n"], "ids": [of_ids(x) for x in ids]})

    placed = rows.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("parts_before"))
    return placed.select("id", "start", "n", "control", "data").mapInPandas(of_frames, f"id bigint, start bigint, n bigint, ids {kind}")


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """Place, count and checksum of every document's ids, read back from a token file."""
    read = _read(spark, path, lambda ids: zlib.crc32(ids.tobytes()), "bigint")
    return read.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("ids").alias("ids_crc32"))


def through_file(documents: DataFrame) -> DataFrame:
    """Write the documents to a token file in the shared folder and read it back."""
    spark = documents.sparkSession
    path = scratch_path(spark, "token-file")
    write_token_file(documents, path)
    return file_digest(spark, path)
