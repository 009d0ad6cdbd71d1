"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton, which recognises exactly the substrings of
the sample. A text is parsed against it into the longest phrases the sample holds: phrase after phrase takes the
longest match and the next one starts at the character that failed. Text of the sample's language needs few phrases.
Phrases times the logarithm of the sample's length (the bits of a pointer into it), over the letters parsed, estimate
the cross entropy; the language with the least wins. A character that the sample does not hold costs the same in every
language, so that a short sample with its short pointers does not win texts it knows nothing of.

Automata are tables of (state, character) steps, so thousands of stretches of text are parsed side by side, one
character of each per numpy step. A whole text is parsed, in stretches of STRETCH characters: a phrase ends at the end
of its stretch.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenspark.llm.common import give_back, id_remainder, numbered_columns, unit_draw

#: Characters of sample text per language (fewer only if all its texts hold fewer), the characters one document gives
#: where there are enough documents, and the documents first fetched per language. These bound what is learned from;
#: every document is judged whole.
SAMPLE_CHARS, CHARS_PER_DOCUMENT, SAMPLE_DOCUMENTS = 16_000, 400, 200
#: Labels beyond this are no languages; more of them is an error.
MAX_LANGUAGES = 200
STRETCH = 512
#: Letters of a language whose steps are a table; those of the others are searched.
FREQUENT_LETTERS = 96
CHARS_AT_ONCE = 2_000_000
UNKNOWN = "und"
#: Documents with a lower score are rejected by ``accepted``: four languages have at least 0.25 for the best.
MIN_SCORE = 0.35

LETTER = r"\p{L}"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str | None) -> str:
    """Lower-case letters, with one space for everything between them; empty if the text has no letter."""
    kept = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    return kept if any(c.isalpha() for c in kept) else ""


def suffix_automaton(sample: str) -> list[dict[str, int]]:
    """Steps of every state; state 0 is the empty string. Paths from it spell exactly the substrings of the sample."""
    steps: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sample:
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return steps


class Steps:
    """The steps of one language's automaton: a table for its most frequent letters, sorted keys for the others."""

    def __init__(self, sample: str, letters: list[str]) -> None:
        automaton = suffix_automaton(sample)
        counts = Counter(sample)
        own = sorted(counts, key=lambda c: (-counts[c], c))
        frequent, rare = own[:FREQUENT_LETTERS], own[FREQUENT_LETTERS:]
        # Own code of every common code. 0: not in the sample; then the frequent letters, past the end, and rare letters.
        place = {c: k for k, c in enumerate([*frequent, None, *rare], 1)}
        self.width = len(frequent) + 2
        self.own = np.array([0, *[place.get(c, 0) for c in letters], self.width - 1], np.int32)
        self.unheld = self.own == 0
        self.table = self._table(automaton, place)
        keys = sorted((state * len(rare) + place[c] - self.width, to) for state, out in enumerate(automaton) for c, to in out.items() if place[c] >= self.width)
        self.n_rare = len(rare)
        self.keys = np.array([k for k, _ in keys], np.int64)
        self.to = np.array([to for _, to in keys], np.int32)

    def step(self, state: np.ndarray, codes: np.ndarray, any_rare: bool) -> np.ndarray:
        """Four times the offset of the next state's row, plus the phrases that ended on the way."""
        if not any_rare:
            return self.table[state + codes]
        rare = np.flatnonzero(codes >= self.width)
        plain_codes = codes.copy()
        plain_codes[rare] = 0
        out = self.table[state + plain_codes]
        letter, at = codes[rare].astype(np.int64) - self.width, state[rare] // self.width
        begin = self.to[np.searchsorted(self.keys, letter)]  # the keys of state 0 come first, one per rare letter
        wanted = at * self.n_rare + letter
        found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        goes_on = self.keys[found] == wanted
        out[rare] = np.where(goes_on, self.to[found], begin) * self.width * 4 + (~goes_on & (at > 0))
        return out

    def _table(self, steps: list[dict[str, int]], place: dict[str, int]) -> np.ndarray:
        n, width = len(steps), self.width
        following = np.full((n, width), -1, np.int64)
        for state, out in enumerate(steps):
            for c, to in out.items():
                if place[c] < width:
                    following[state, place[c]] = to
        # Without a step the open phrase ends and a new one starts with the character; a character that starts none is
        # a phrase of its own and leaves none open.
        starts = following[0] >= 0
        begin = np.where(starts, following[0], 0)
        ended = np.where(starts, 1, 2) - (np.arange(n) == 0)[:, None]
        table = np.where(following >= 0, following * width * 4, begin * width * 4 + ended)
        table[:, width - 1] = np.arange(n) * width * 4
        return table.astype(np.int32).reshape(-1)


class CrossParser:
    """Step tables of all languages; one per process and set of samples."""

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        self.languages = [name for name, _ in samples]
        letters = sorted(set("".join(text for _, text in samples)))
        self.width = len(letters) + 2  # code 0: a character of no sample; the last code: past the end
        self.code = np.zeros(sys.maxunicode + 1, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.bits = np.array([np.log2(max(2, len(text))) for _, text in samples])
        self.steps = [Steps(text, letters) for _, text in samples]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): phrases that each plain text needs."""
        return self._parsed(texts)[0]

    def costs(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): bits of the phrases; a character that is not in the sample has those of the longest."""
        phrases, unheld = self._parsed(texts)
        return phrases * self.bits + unheld * (self.bits.max(initial=0) - self.bits)

    def _parsed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) twice: phrases, and those of them that are a character which is not in the sample (only
        counted for samples that are shorter than the longest, where it matters)."""
        out, unheld = np.zeros((2, len(texts), len(self.languages)), np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        rows = -(-lengths // STRETCH)
        if not rows.sum():
            return out, unheld
        codes = np.full((int(rows.sum()), STRETCH), self.width - 1, np.int32)
        flat, at = codes.reshape(-1), 0
        for text, r in zip(texts, rows.tolist()):
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            flat[at : at + len(points)] = self.code[points]
            at += r * STRETCH
        columns = np.ascontiguousarray(codes.T)
        of_text = np.repeat(np.arange(len(texts)), rows)
        for k, steps in enumerate(self.steps):
            state, ended = np.zeros(len(codes), np.int32), np.zeros(len(codes), np.int32)
            own = steps.own[columns]
            rare = (own >= steps.width).any(axis=1).tolist()
            for column, any_rare in zip(own, rare):
                step = steps.step(state, column, any_rare)
                ended += step & 3
                state = step >> 2
            ended += state > 0  # the phrase that is open at the end
            out[:, k] = np.bincount(of_text, ended, len(texts)).astype(np.int64)
            if self.bits[k] < self.bits.max():
                unheld[:, k] = np.bincount(of_text, steps.unheld[codes].sum(1), len(texts)).astype(np.int64)
        return out, unheld

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. The score is the best language's share of 2 ** (bits saved / 16)."""
        names, scores, start = [], [], 0
        while start < len(texts):
            part, chars = [], 0
            while start < len(texts) and (not part or chars + len(texts[start] or "") <= CHARS_AT_ONCE):
                part.append(plain(texts[start]))
                chars += len(part[-1])
                start += 1
            cost = self.costs(part)
            best = cost.argmin(1)  # ties: the first language in alphabetical order
            share = 1 / np.exp2(-np.minimum((cost - cost.min(1, keepdims=True)) / 16, 1000)).sum(1)
            names += [self.languages[b] if t else UNKNOWN for b, t in zip(best, part)]
            scores += [s if t else 0.0 for s, t in zip(share.tolist(), part)]
        return names, np.array(scores, np.float64)


@lru_cache(maxsize=2)
def cross_parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(samples)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """(language, sample text) of every language of the labelled rows, by name; samples hold SAMPLE_CHARS characters.

    Rows without a language or letters are left out; repeated texts count once. About SAMPLE_DOCUMENTS distinct texts
    per language are fetched, chosen by a hash of the text; while that is too little, more of them, and longer pieces,
    until a language has its sample or all of its text is in it.
    """
    draw = unit_draw(F.lit("language"), F.col("t"))
    known = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"))
    known = known.where(F.col("l").isNotNull() & F.col("t").rlike(LETTER)).withColumn("d", draw)
    texts = known.groupBy("l", "d").agg(F.max(F.length("t")).alias("c"))  # copies fall together before they are dealt
    counts = texts.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different language labels")
    longest = {r["l"]: r["c"] for r in counts}
    # Of each language that lacks text: share of its texts, and characters of each.
    wanted = {r["l"]: (SAMPLE_DOCUMENTS / r["n"], max(CHARS_PER_DOCUMENT, -(-2 * SAMPLE_CHARS // r["n"]))) for r in counts}
    samples: dict[str, str] = {}
    while wanted:
        found = _pieces(known, wanted)
        short = {}
        for name, (share, chars) in wanted.items():
            samples[name] = " ".join(found.get(name, []))[:SAMPLE_CHARS]
            got = len(samples[name])
            if got < SAMPLE_CHARS and share < 1:
                short[name] = (share * max(2.0, 1.5 * SAMPLE_CHARS / max(got, 1)), chars)
            elif got < SAMPLE_CHARS and chars < longest[name]:
                short[name] = (share, 4 * chars)
        wanted = short
    if empty := sorted(name for name, sample in samples.items() if not sample):
        raise ValueError(f"no text could be sampled of the languages {', '.join(empty)}")
    return tuple(sorted(samples.items()))


def _pieces(known: DataFrame, wanted: dict[str, tuple[float, int]]) -> dict[str, list[str]]:
    """Plain pieces of the wanted share of each language's distinct texts, in the order of their draws."""
    share = F.create_map(*[F.lit(x) for name, (part, _) in wanted.items() for x in (name, float(part))])
    chars = F.create_map(*[F.lit(x) for name, (_, most) in wanted.items() for x in (name, most)])
    chosen = known.where(F.col("l").isin(*wanted)).where(F.col("d") < share[F.col("l")]).withColumn("m", chars[F.col("l")])
    # Pieces from the middle of the texts: titles and other openings are less typical. One without a letter begins at
    # the text's first letter instead.
    middle = F.expr("substring(t, greatest(1, cast(length(t) / 2 as int) - cast(m / 2 as int)), m)")
    piece = F.when(middle.rlike(LETTER), middle).otherwise(F.expr(f"substring(t, regexp_instr(t, '{LETTER.replace(chr(92), chr(92) * 2)}'), m)"))
    cleaned = F.pandas_udf(lambda p: p.map(plain), "string")

    found: dict[str, list[str]] = {}
    distinct = chosen.select("l", "d", piece.alias("p")).distinct()
    for r in distinct.select("l", "d", cleaned("p").alias("p")).orderBy("l", "d", "p").collect():
        if r["p"]:
            found.setdefault(r["l"], []).append(r["p"])
    return found


def identified(documents: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """``documents`` with lang_pred and score: the likeliest language of each whole text and its share, 0 to 1.

    Texts that are NULL or have no letter are ``und`` with score 0; so is everything if nothing was learned. Every row
    is kept, repeated ones too; columns named lang_pred or score are replaced.
    """
    inner, (t,) = numbered_columns(documents, text)
    kept = [k for k, c in enumerate(documents.columns) if c.lower() not in ("lang_pred", "score")]
    judged = inner.select(*[f"c{k}" for k in kept], _judge(samples)(F.col(t)).alias("judged"))
    told = judged.select(*[f"c{k}" for k in kept], "judged.lang_pred", "judged.score")
    return told.toDF(*[documents.columns[k] for k in kept], "lang_pred", "score")


def _judge(samples: tuple[tuple[str, str], ...]):
    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            if samples:
                names, scores = cross_parser(samples).predict(texts.tolist())
                yield pd.DataFrame({"lang_pred": names, "score": scores})
            else:
                yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0})
        give_back()

    return judge


def training_rows(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows whose labels may be learned from: two thirds, by checksum of the id."""
    return documents.where(id_remainder(id_column, 3) != 1)


def document_languages(documents: DataFrame) -> DataFrame:
    """Language and score of every document, learned from two thirds of the labels.

    Every row gives one, repeated ones too; NULL texts and those without a letter are ``und`` with score 0. NULL ids are
    in the training part, NULL languages teach nothing. Further columns are ignored; an empty table gives none.
    """
    samples = learn(training_rows(documents))
    found = identified(documents.select("doc_id", "text"), samples)
    return found.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def accepted(documents: DataFrame, text: str = "text", id_column: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The documents whose language can be told; columns as they were, whatever their names.

    NULL texts and those without a letter are rejected, repeated rows are judged alike. A language that is NULL teaches nothing; nothing
    is rejected if nothing was learned, and an empty table stays empty.
    """
    inner, (t, i, known) = numbered_columns(documents, text, id_column, lang)
    samples = learn(training_rows(inner, i), t, known)
    if not samples:
        return documents
    judged = inner.withColumn("judged", _judge(samples)(F.col(t)))
    sure = (F.col("judged.lang_pred") != UNKNOWN) & (F.col("judged.score") >= MIN_SCORE)
    return judged.where(sure).drop("judged").toDF(*documents.columns)
