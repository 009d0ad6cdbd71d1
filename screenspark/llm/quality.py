"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

A document is a sparse vector: its words, hashed to BUCKETS coordinates with logarithmic counts scaled to length one,
and one coordinate per statistic and bin. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2),

whose last part is the sum over all pairs <v_i, v_j> x_i x_j, taken in time linear in the words. It is trained by
gradient steps on a bounded sample of labelled rows; scoring reads every whole text, in parallel and without a shuffle.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenspark.llm.common import bounded_sample, give_back, id_remainder, numbered_columns

#: Coordinates for words, and latent factors.
BUCKETS, FACTORS = 1 << 15, 6
#: Labelled rows that are fetched for training: the bound on what is learned from.
TRAINING_ROWS = 8_000
#: Gradient steps: passes over the sample, and steps at least where the sample is small.
PASSES, LEAST_STEPS, BATCH, RATE, DECAY, SEED = 12, 800, 64, 0.1, 1e-4, 5
THRESHOLD = 0.7
#: ``accepted`` rejects only below this: a document of a few words is seldom sure of either class.
REJECTED_BELOW = 0.4
CHARS_AT_ONCE = 2_000_000

#: Each statistic is cut at these bounds, and every bin is a coordinate.
SHARES = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95)
BOUNDS = {
    "log2_chars": tuple(range(1, 24)),
    "log2_words": tuple(range(1, 20)),
    "word_length": tuple(x / 2 for x in range(2, 30)),
    "upper": SHARES,
    "digit": SHARES,
    "mark": SHARES,
    "space": SHARES,
    "distinct_words": SHARES,
    "repeated_next": SHARES,
    "most_frequent": SHARES,
    "wordless": SHARES,
    "repeated_lines": SHARES,
}
_FIRST = dict(zip(BOUNDS, itertools.accumulate([BUCKETS, *[len(b) + 1 for b in BOUNDS.values()]])))
WIDTH = BUCKETS + sum(len(b) + 1 for b in BOUNDS.values())
#: Weight of one statistic's coordinate beside the words, which share a length of one.
STATISTIC = 1.0


def _kinds() -> np.ndarray:
    """Class of every code point below 65536: 1 upper case, 2 digit, 3 white space, 4 other visible non-letter."""
    out = np.zeros(1 << 16, np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        out[k] = 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 0 if c.isalpha() else 4
    return out


_KINDS: list[np.ndarray] = []


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of whole texts: (row, coordinate, value), sorted by row. An empty text has only statistics."""
    if not _KINDS:
        _KINDS.append(_kinds())
    rows, places, values = [], [], []
    n = len(texts)
    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(lengths.sum()), object)
    flat[:] = list(itertools.chain.from_iterable(words))
    code, unique = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), [])
    hashed = np.array([zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % BUCKETS for w in unique], np.int64)
    visible = np.array([any(c.isalpha() for c in w) for w in unique], bool)
    of = np.repeat(np.arange(n), lengths)

    statistics = np.zeros((len(BOUNDS), n))
    kinds = np.zeros((n, 5), np.int64)
    for k, text in enumerate(texts):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds[k] = np.bincount(_KINDS[0][np.minimum(points, 65535)], minlength=5)
    chars = np.maximum(kinds.sum(1), 1)
    some = np.maximum(lengths, 1)
    pair, counts = np.unique(of * max(1, len(unique)) + code, return_counts=True)
    of_pair = pair // max(1, len(unique))
    largest = np.zeros(n, np.int64)
    np.maximum.at(largest, of_pair, counts)
    same_next = np.zeros(n)
    if len(flat) > 1:
        same = (code[1:] == code[:-1]) & (of[1:] == of[:-1])
        same_next = np.bincount(of[1:][same], minlength=n).astype(float)
    lines = [[line for line in t.split("\n") if line.strip()] for t in texts]
    told = {
        "log2_chars": np.log2(chars),
        "log2_words": np.log2(some),
        "word_length": (chars - kinds[:, 3]) / some,
        "upper": kinds[:, 1] / chars,
        "digit": kinds[:, 2] / chars,
        "mark": kinds[:, 4] / chars,
        "space": kinds[:, 3] / chars,
        "distinct_words": np.bincount(of_pair, minlength=n) / some,
        "repeated_next": same_next / some,
        "most_frequent": largest / some,
        "wordless": np.bincount(of, ~visible[code] if len(flat) else None, n) / some,
        "repeated_lines": np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines]),
    }
    for k, (name, bounds) in enumerate(BOUNDS.items()):
        statistics[k] = _FIRST[name] + np.searchsorted(np.array(bounds, float), told[name], "right")
    rows.append(np.tile(np.arange(n), len(BOUNDS)))
    places.append(statistics.reshape(-1).astype(np.int64))
    values.append(np.full(n * len(BOUNDS), STATISTIC))

    if len(flat):
        pair, counts = np.unique(of * BUCKETS + hashed[code], return_counts=True)
        of_pair, weight = pair // BUCKETS, 1 + np.log(counts)
        norm = np.sqrt(np.bincount(of_pair, weight**2, n))
        rows.append(of_pair)
        places.append(pair % BUCKETS)
        values.append(weight / norm[of_pair])
    row, place, value = map(np.concatenate, (rows, places, values))
    order = np.argsort(row, kind="stable")
    return row[order], place[order], value[order]


@dataclass
class Machine:
    """Parameters of a factorisation machine over WIDTH coordinates."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, row: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Score before the logistic, by the sum-of-squares identity."""
        moved = self.factors[place] * value[:, None]
        out = self.bias + np.bincount(row, self.linear[place] * value, n)
        for f in range(self.factors.shape[1]):
            out += 0.5 * np.bincount(row, moved[:, f], n) ** 2
        return out - 0.5 * np.bincount(row, (moved**2).sum(1), n)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = [_logistic(self.raw(*features(part), len(part))) for part in _parts(texts)]
        return np.concatenate(out) if out else np.zeros(0)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _parts(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in lists of bounded length."""
    start = 0
    while start < len(texts):
        part, chars = [], 0
        while start < len(texts) and (not part or chars + len(texts[start] or "") <= CHARS_AT_ONCE):
            part.append(texts[start] or "")
            chars += len(part[-1])
            start += 1
        yield part


def fit(sparse: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> Machine:
    """Train on rows given as (coordinates, values) and their labels, 0.0 or 1.0.

    Gradient steps with per-coordinate rates on the logistic loss. Without rows of both kinds, a constant.
    """
    rate = (good.sum() + 0.5) / (len(good) + 1) if len(good) else 0.5
    machine = Machine(float(np.log(rate / (1 - rate))), np.zeros(WIDTH), np.zeros((WIDTH, FACTORS)))
    if not len(good) or good.min() == good.max():
        return machine
    draw = np.random.default_rng(SEED)
    machine.factors = draw.normal(0, 0.05, (WIDTH, FACTORS))
    place, value = (np.concatenate(x) for x in zip(*sparse))
    first = np.concatenate([[0], np.cumsum([len(p) for p, _ in sparse])])
    seen_linear, seen_factors, seen_bias = np.full(WIDTH, 1e-2), np.full((WIDTH, FACTORS), 1e-2), 1e-2
    batches = max(1, len(good) // BATCH)
    for _ in range(max(PASSES, LEAST_STEPS // batches)):
        for batch in np.array_split(draw.permutation(len(good)), batches):
            size = first[batch + 1] - first[batch]
            at = np.repeat(first[batch] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            r, p, x = np.repeat(np.arange(len(batch)), size), place[at], value[at]
            moved = machine.factors[p] * x[:, None]
            sums = np.stack([np.bincount(r, moved[:, f], len(batch)) for f in range(FACTORS)], 1)
            raw = machine.bias + np.bincount(r, machine.linear[p] * x, len(batch)) + 0.5 * (sums**2).sum(1)
            raw -= 0.5 * np.bincount(r, (moved**2).sum(1), len(batch))
            slope = (_logistic(raw) - good[batch]) / len(batch)
            touched, back = np.unique(p, return_inverse=True)
            gx = slope[r] * x
            step = np.bincount(back, gx, len(touched)) + DECAY * machine.linear[touched]
            seen_linear[touched] += step**2
            machine.linear[touched] -= RATE * step / np.sqrt(seen_linear[touched])
            by_factor = gx[:, None] * (sums[r] - moved)
            step = np.stack([np.bincount(back, by_factor[:, f], len(touched)) for f in range(FACTORS)], 1)
            step += DECAY * machine.factors[touched]
            seen_factors[touched] += step**2
            machine.factors[touched] -= RATE * step / np.sqrt(seen_factors[touched])
            seen_bias += slope.sum() ** 2
            machine.bias -= RATE * slope.sum() / np.sqrt(seen_bias)
    return machine


def learn(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> Machine:
    """Fit on at most about TRAINING_ROWS rows with a label of 0 or 1, three quarters of the ids, chosen by hash.

    Features are made in the tasks; a row brings at most BUCKETS of them to the driver, a few hundred as a rule.
    Rows without an id, or with another or no label, teach nothing; repeated labels count as often as they occur.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("y"))
    known = bounded_sample(known.where(id_remainder("id", 4) != 2), [F.col("id")], TRAINING_ROWS)
    chosen = documents.select(F.col(id_column).alias("id"), F.col(text).alias("t")).join(F.broadcast(known), "id")  # bounded above

    def of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = 0
            for part in _parts(frame["t"].tolist()):
                row, place, value = features(part)
                ends = np.searchsorted(row, np.arange(1, len(part)))
                here = frame.iloc[at : at + len(part)]
                places = [x.astype("<i4").tobytes() for x in np.split(place, ends)]
                values = [x.astype("<f8").tobytes() for x in np.split(value, ends)]
                yield pd.DataFrame({"id": here["id"], "y": here["y"], "places": places, "values": values})
                at += len(part)

    rows = chosen.mapInPandas(of_frames, "id bigint, y int, places binary, values binary")
    rows = rows.orderBy("id", "y", F.crc32("places"), F.crc32("values")).collect()
    sparse = [(np.frombuffer(r["places"], "<i4").astype(np.int64), np.frombuffer(r["values"], "<f8")) for r in rows]
    return fit(sparse, np.array([r["y"] for r in rows], float))


def scored(documents: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``documents`` with score: the estimated chance that the whole text is of label 1. NULL texts are empty ones.

    Every row is kept, repeated ones too; a column named score is replaced.
    """
    return documents.withColumn("score", _judge(documents, machine)(F.col(text)))


def _judge(documents: DataFrame, machine: Machine):
    shared = documents.sparkSession.sparkContext.broadcast(machine)  # WIDTH x (FACTORS + 1) numbers, whatever the data

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()))
        give_back()

    return judge


def document_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and class of every document.

    Every row gives one, repeated ones too; NULL texts are empty ones, and NULL ids teach nothing. Further columns are ignored; an
    empty table gives none.
    """
    found = scored(documents.select("doc_id", "text"), learn(documents, labels))
    return found.select(
        "doc_id",
        (id_remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(documents: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents that are not clearly of label 0; columns as they were, whatever their names.

    NULL texts are empty ones, repeated rows are judged alike, NULL ids teach nothing; an empty table stays empty.
    """
    inner, (t, i) = numbered_columns(documents, text, id_column)
    judge = _judge(documents, learn(inner.select(F.col(i).alias("doc_id"), F.col(t).alias("text")), labels))
    return inner.withColumn("judged", judge(F.col(t))).where(F.col("judged") >= REJECTED_BELOW).drop("judged").toDF(*documents.columns)
