"""Periodic runs of words: maximal stretches that repeat themselves, and texts without the repetitions.

How far two places of a text agree (their longest common extension, LCE) is asked for on a harmonic grid: a run of
period p and at least L words has L - p places that equal the place p further on, so a grid of every max(p, L - p)-th
place meets it. That is n/1 + n/2 + n/3 + ... questions, and most end at the first word.

The rest are answered by a difference cover. The cover holds some remainders modulo 13 such that any two places reach
covered places by the same small step: the few words up to there are compared one by one, and from there on only the
suffixes that start at covered places are needed. Those are sorted (by their first 13 words, then by doubling), the
agreement of neighbours in that order is kept, and a table of minima over 1, 2, 4 ... neighbours answers the rest at
once. The same on the reversed text extends runs to the left.

All texts of a batch are searched together, one after the other with a separator of its own behind each, so that no run
passes from one text to the next. Work is row by row on the cluster: no shuffle.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenspark.llm.common import give_back

#: Words that a run has at least, besides two periods.
SHORTEST = 12
#: A difference cover: every difference modulo 13 is one of two of its members.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Words searched together (a longer text is searched alone), and questions answered at a time.
WORDS_AT_ONCE, QUESTIONS_AT_ONCE = 1_000_000, 1_000_000

_IN_COVER = np.isin(np.arange(MODULUS), COVER)
#: The step from places of two remainders to covered places.
_STEP = np.array([[next(t for t in range(MODULUS) if _IN_COVER[(i + t) % MODULUS] and _IN_COVER[(j + t) % MODULUS]) for j in range(MODULUS)] for i in range(MODULUS)])


class Extensions:
    """Answers how many words agree from two places of the same text on.

    ``words`` ends with MODULUS numbers that occur nowhere else; every text in it is followed by a number of its own.
    ``home`` tells for each place which text it is in, or which text it follows. Suffixes are sorted for texts that a question reaches.
    """

    def __init__(self, words: np.ndarray, home: np.ndarray, n_texts: int) -> None:
        self.words, self.home = words, home
        self.table_of = np.full(n_texts, -1, np.int64)
        self.tables: list[tuple[np.ndarray, list[np.ndarray]]] = []
        self.bits = max(1, int(words.max()).bit_length())

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        words = self.words
        found = np.zeros(len(i), np.int64)
        step = _STEP[i % MODULUS, j % MODULUS]
        open_ = np.arange(len(i))
        reached = []
        for t in range(MODULUS):
            at_cover = step[open_] == t
            reached.append(open_[at_cover])
            open_ = open_[~at_cover]
            open_ = open_[words[i[open_] + t] == words[j[open_] + t]]
            found[open_] = t + 1
            if not len(open_):
                break
        rest = np.concatenate(reached)
        x, y = i[rest] + step[rest], j[rest] + step[rest]
        # The first words after the step differ for most.
        same = words[x] == words[y]
        rest, x, y = rest[same], x[same], y[same]
        if len(rest):
            found[rest] += self._sampled(x, y)
        return found

    def _sampled(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Agreement from covered places."""
        text = self.home[x]
        new = np.unique(text[self.table_of[text] < 0])
        if len(new):
            self.table_of[new] = len(self.tables)
            self.tables.append(self._sorted(new))
        out = np.zeros(len(x), np.int64)
        in_table = self.table_of[text]
        for k in np.unique(in_table):
            chosen = np.flatnonzero(in_table == k)
            rank, minima = self.tables[k]
            a, b = rank[x[chosen]], rank[y[chosen]]
            low, high = np.minimum(a, b), np.maximum(a, b)  # never equal: two places of one text
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            answer = np.zeros(len(chosen), np.int64)
            for v in np.unique(level):
                at = np.flatnonzero(level == v)
                answer[at] = np.minimum(minima[v][low[at]], minima[v][high[at] - (1 << v)])
            out[chosen] = answer
        return out

    def _sorted(self, texts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(rank of the suffix at every covered place of some texts, minima of the agreement of neighbours in order)."""
        words = self.words
        wanted = np.zeros(len(self.table_of), bool)
        wanted[texts] = True
        inside = np.flatnonzero(wanted[self.home])
        place = inside[_IN_COVER[inside % MODULUS]]
        m = len(place)
        number = np.zeros(len(words), np.int64)
        number[place] = np.arange(m)
        # By the first MODULUS words, some of them packed into one number.
        per = max(1, 63 // self.bits)
        keys = []
        for t in range(0, MODULUS, per):
            key = np.zeros(m, np.int64)
            for s in range(t, min(t + per, MODULUS)):
                key = key << self.bits | words[place + s]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        differs = np.zeros(m, bool)
        for key in keys:
            k = key[order]
            differs[1:] |= k[1:] != k[:-1]
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(differs)
        levels, span = [rank], MODULUS
        while m and levels[-1].max() < m - 1:
            # Places whose first words are not unique: their whole span lies in one text, and so does what follows.
            rank = levels[-1]
            repeated = np.bincount(rank, minlength=m)[rank] > 1
            follows = np.zeros(m, np.int64)
            follows[repeated] = rank[number[place[repeated] + span]] + 1
            key = rank * (m + 1) + follows
            order = np.argsort(key, kind="stable")
            k = key[order]
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]])) if m else 0
            levels.append(rank)
            span *= 2
        # Agreement of neighbours: down the levels, then the last few words.
        x, y = place[order][:-1].copy(), place[order][1:].copy()
        agree = np.zeros(max(0, m - 1), np.int64)
        for rank in reversed(levels):
            same = np.flatnonzero(rank[number[x]] == rank[number[y]])
            agree[same] += span
            x[same] += span
            y[same] += span
            span //= 2
        open_ = np.arange(len(agree))
        for _ in range(MODULUS):
            open_ = open_[words[x[open_]] == words[y[open_]]]
            agree[open_] += 1
            x[open_] += 1
            y[open_] += 1
        minima, width = [agree.astype(np.int32)], 1
        while 2 * width <= len(agree):
            minima.append(np.minimum(minima[-1][:-width], minima[-1][width:]))
            width *= 2
        full = np.zeros(len(words), np.int32)
        full[place] = levels[-1]
        return full, minima


def find_runs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, period) of every run of texts of word numbers from 0; by text, start and period."""
    lengths = np.array([len(x) for x in texts], np.int64)
    # Shortest texts first: period p concerns those of 2p words and more, which are one stretch at the end.
    by_length = np.argsort(lengths, kind="stable")
    ordered = lengths[by_length]
    n_words = max([int(x.max()) + 1 for x in texts if len(x)], default=0)
    size = int(lengths.sum()) + len(texts)
    begins = np.concatenate([[0], np.cumsum(ordered + 1)])[:-1]
    words = np.full(size + MODULUS, -1, np.int64)
    home = np.repeat(np.arange(len(texts)), ordered + 1)
    for at, k in zip(begins.tolist(), by_length.tolist()):
        words[at : at + lengths[k]] = texts[k]
    gaps = np.flatnonzero(words < 0)
    words[gaps] = n_words + np.arange(len(gaps))
    home = np.concatenate([home, np.full(MODULUS, len(texts))])  # padding is no text
    forward = Extensions(words, home, len(texts) + 1)
    turned = np.concatenate([words[:size][::-1], words[size:]])
    # The separator behind a turned text is that of the text before it.
    backward = Extensions(turned, np.concatenate([home[size:][:1], home[:size][::-1], home[size:][1:]]), len(texts) + 1)

    found: list[np.ndarray] = []
    held: list[tuple[int, np.ndarray]] = []
    n_held = 0

    def answer() -> None:
        i = np.concatenate([x for _, x in held])
        p = np.repeat(np.array([q for q, _ in held]), [len(x) for _, x in held])
        held.clear()
        within = home[i] == home[i + p]
        i, p = i[within], p[within]
        after = forward.agree(i, i + p)
        before = np.zeros(len(i), np.int64)
        some = np.flatnonzero(i > begins[home[i]])
        before[some] = backward.agree(size - i[some], size - i[some] - p[some])
        enough = after + before >= np.maximum(p, SHORTEST - p)
        i, p, after, before = i[enough], p[enough], after[enough], before[enough]
        rows = np.stack([i - before, i + p + after, p], axis=1)
        found.append(_least_periods(rows))

    short = words[:size].astype(np.int32) if n_words + len(gaps) < 1 << 31 else words[:size]
    longest = int(ordered[-1]) if len(ordered) else 0
    for p in range(1, longest // 2 + 1):
        first = int(np.searchsorted(ordered, max(2 * p, SHORTEST)))
        if first == len(ordered):
            break
        low, grid = int(begins[first]), max(p, SHORTEST - p)
        hits = np.flatnonzero(short[low : size - p : grid] == short[low + p : size : grid])
        if len(hits):
            held.append((p, low + hits * grid))
            n_held += len(hits)
        if n_held > QUESTIONS_AT_ONCE:
            answer()
            n_held = 0
    if held:
        answer()
    rows = _least_periods(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)
    text = home[rows[:, 0]]
    start, end, period = rows[:, 0] - begins[text], rows[:, 1] - begins[text], rows[:, 2]
    text = by_length[text]
    order = np.lexsort([period, start, text])
    return text[order], start[order], end[order], period[order]


def _least_periods(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period) with equal start and end, the one of the smallest period."""
    rows = rows[np.lexsort([rows[:, 2], rows[:, 1], rows[:, 0]])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def _searched(texts: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """(start, length, period) of the runs of every text, and its words without repetitions."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    coded = [np.array([number[w] for w in words], np.int64) for words in texts]
    text, start, end, period = find_runs(coded)
    parts = np.searchsorted(text, np.arange(len(texts) + 1))
    for k, words in enumerate(texts):
        of = slice(parts[k], parts[k + 1])
        runs = list(zip(start[of].tolist(), (end[of] - start[of]).tolist(), period[of].tolist()))
        if runs:
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, start[of] + period[of], 1)
            np.add.at(edge, end[of], -1)
            words = [words[x] for x in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
        yield runs, words


def _groups(texts: Iterable[list[bytes]]) -> Iterator[list[list[bytes]]]:
    held: list[list[bytes]] = []
    n = 0
    for words in texts:
        if held and n + len(words) > WORDS_AT_ONCE:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield held


def with_repeated_tail(words: list, crc: int) -> list:
    """The words, where those from some place on repeat a few words, if the checksum ends in 0; else as they are."""
    n, g = len(words), crc // 10
    if crc % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def word_runs(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", repeat_tails: bool = False
) -> DataFrame:
    """(id, runs, collapsed) of every row: runs as an array of (start, length, period), in words from 0, by start and then
    period; collapsed the words in no run after its first period, with single spaces between.

    Words are what ASCII white space separates. A run has its smallest period q, max(12, 2q) words or more, and no
    neighbouring word extends it. NULL and empty texts have no words. Every row gives one, repeated ones too; further
    columns are ignored; empty tables give none. With ``repeat_tails``, a tenth of the texts, by the checksum of the id
    (a NULL id counts as empty), get repetitions first.
    """
    schema = "id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

    def of_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = (("" if t is None else t).encode().split() for t in batch.column(1).to_pylist())
            if repeat_tails:
                texts = (with_repeated_tail(w, zlib.crc32(b"" if k is None else str(k).encode())) for k, w in zip(ids, texts))
            done = 0
            for group in _groups(texts):
                runs, kept, ends = [], [], [0]
                for found, words in _searched(group):
                    runs += found
                    ends.append(len(runs))
                    kept.append(b" ".join(words))
                flat = np.array(runs, np.int64).reshape(-1, 3)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                columns = [
                    batch.column(0).slice(done, len(group)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "runs", "collapsed"])
                done += len(group)
        give_back()

    kept = documents.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("t"))
    return kept.mapInArrow(of_batches, schema)


def document_runs(documents: DataFrame) -> DataFrame:
    """Number, longest, and digests of the runs of every document, some with repeated tails; rows as in ``word_runs``.

    Of equally long runs the one that starts first counts, then the one of the smaller period; none gives NULLs.
    """

    def best(name: str) -> Column:
        return F.when(F.size("runs") > 0, F.col("longest")[name])

    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = word_runs(documents, repeat_tails=True).withColumn("longest", F.array_min(ranked))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        best("start").alias("start"),
        best("length").alias("length"),
        best("period").alias("period"),
        F.when(F.size("runs") > 0, F.floor(F.col("longest.length") * 1000 / F.col("longest.period"))).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
