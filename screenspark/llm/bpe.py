"""Exact BPE encoding of whole texts by parts, and decoding.

The encoding of a text is put together from parts, each encoded by the tokenizers library:

* Cuts that the pre-tokenizer itself makes. For byte-level BPE these are single spaces between two visible characters
  (a word takes the one space before it along); where the tokenizer drops white space, every space. The parts repeat a
  lot, so each task keeps the ids of parts it has seen, up to a bound.
* Tree concatenation for long parts without such cuts: the halves are cut again until they are short, the leaves are
  encoded as one batch, and neighbours are joined bottom-up. A join encodes a window around the seam anew and doubles
  it until its first tokens equal the left side's and its last tokens the right side's. Then every two neighbouring
  tokens of the joined sequence stand next to each other in some encoding made by the library, which for BPE makes the
  whole sequence the encoding of the joined text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenspark.llm.common import give_back

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
#: Characters up to which a part goes to the library as one piece, and leaves of the tree.
LONG, LEAF = 8192, 4096
#: Tokens on each side of the first window, and how many must agree.
FIRST_WINDOW, AGREE = 16, 2
#: Parts whose ids a task keeps, and characters of text that it handles at a time.
KEPT_PARTS, CHARS_AT_ONCE = 300_000, 3_000_000

_SPACE_CUT = re.compile(r"(?<=\S)(?= \S)")
_ODD_SPACE = re.compile(r"\s | \s|^ | $")


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevelBpe:
    """Encodes and decodes with a byte-level tokenizer file; one per process and file."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kept: dict[str, bytes] = {}
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        byte_of = _byte_of()
        self.pieces: list[bytes] = [b""] * self.library.get_vocab_size()
        for token, k in self.library.get_vocab().items():
            plain = token in special or not all(c in byte_of for c in token)
            self.pieces[k] = token.encode() if plain else bytes(byte_of[c] for c in token)
        self.decimal = [str(k) for k in range(len(self.pieces))]

    def cut(self, text: str) -> list[str]:
        if _ODD_SPACE.search(text):
            return _SPACE_CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]

    def whole(self, parts: list[str]) -> list[bytes]:
        """Ids of short parts, as little-endian unsigned 32-bit integers."""
        found = self.library.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text, in order."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= CHARS_AT_ONCE):
                chars += len(texts[end])
                end += 1
            cut = [self.cut(t) if t else [] for t in texts[start:end]]
            if len(self.kept) > KEPT_PARTS:
                self.kept.clear()
            kept = self.kept
            new = list({part for parts in cut for part in parts if part not in kept})
            short = [p for p in new if len(p) <= LONG]
            kept.update(zip(short, self.whole(short)))
            long = {p: self.tree(p) for p in new if len(p) > LONG}
            for parts in cut:
                if long:
                    yield b"".join([long[p] if p in long else kept[p] for p in parts])
                else:
                    yield b"".join([kept[p] for p in parts])
            start = end

    def tree(self, text: str) -> bytes:
        """Ids of a long text, by halves."""
        n = max(1, -(-len(text) // LEAF))
        n = 1 << (n - 1).bit_length()  # a full tree
        ends = [len(text) * k // n for k in range(n + 1)]
        level = [np.frombuffer(x, "<u4").tolist() for x in self.whole([text[a:b] for a, b in zip(ends, ends[1:])])]
        while len(level) > 1:
            level = [self.join(level[k], level[k + 1]) for k in range(0, len(level), 2)]
        return np.array(level[0], "<u4").tobytes()

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the joined texts of two encodings."""
        size = FIRST_WINDOW
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            while a > 0 and self._inside(left[a]):
                a -= 1
            while b < len(right) and self._inside(right[b]):
                b += 1
            window = b"".join([self.pieces[k] for k in left[a:] + right[:b]]).decode()
            middle = np.frombuffer(self.whole([window])[0], "<u4").tolist()
            same_left = a == 0 or middle[:AGREE] == left[a : a + AGREE]
            same_right = b == len(right) or middle[-AGREE:] == right[b - AGREE : b]
            if same_left and same_right and (len(middle) >= 2 * AGREE or (a == 0 and b == len(right))):
                return left[:a] + middle + right[b:]
            size *= 2

    def _inside(self, token: int) -> bool:
        """Whether the token begins inside a character."""
        return self.pieces[token][0] & 0xC0 == 0x80

    def forget(self) -> None:
        """Drop the kept ids at the end of a task."""
        self.kept.clear()
        give_back()

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.pieces[k] for k in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevelBpe:
    return ByteLevelBpe(path)


def encoded(documents: DataFrame, id_column: str = "doc_id", text: str = "text", path: str = BYTE_LEVEL) -> DataFrame:
    """(id, ids): the ids of every whole text; NULL and empty texts have none. Row by row, without a shuffle."""

    def of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = byte_level(path)
        for frame in frames:
            ids = coder.encode(["" if t is None else t for t in frame["t"]])
            yield pd.DataFrame({"id": frame["id"], "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]})
        coder.forget()

    kept = documents.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("t"))
    return kept.mapInPandas(of_frames, "id bigint, ids array<int>")


def decoded(rows: DataFrame, path: str = BYTE_LEVEL) -> DataFrame:
    """(id, text) of rows (id, ids); bytes that are no character become U+FFFD, NULL ids the empty text."""

    def of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = byte_level(path)
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "text": [coder.decode([] if x is None else list(x)) for x in frame["ids"]]})

    return rows.select("id", "ids").mapInPandas(of_frames, "id bigint, text string")


def round_trip(documents: DataFrame, id_column: str = "doc_id", text: str = "text", path: str = BYTE_LEVEL) -> DataFrame:
    """Token count, checksum of the ids and checksum of the text that they decode to, for every row.

    Every row of ``documents`` gives one, repeated ones too; further columns are ignored; NULL texts are empty ones.
    """

    def of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = byte_level(path)
        for frame in frames:
            n, sums, texts = [], [], []
            for x in coder.encode(["" if t is None else t for t in frame["t"]]):
                ids = np.frombuffer(x, "<u4").tolist()
                n.append(len(ids))
                sums.append(hashlib.sha256(",".join([coder.decimal[k] for k in ids]).encode()).hexdigest())
                texts.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": frame["id"], "n_tokens": n, "ids_sha256": sums, "decoded_sha256": texts})
        coder.forget()

    kept = documents.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("t"))
    return kept.mapInPandas(of_frames, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
