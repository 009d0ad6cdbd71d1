"""Text to fixed-width bit sets and counts, whole texts.

The portable bit sets are hashed in Arrow batches, which costs a fraction of nested array functions; the rest stays
inside the JVM. A bit set is a sorted ``ARRAY<INT>`` of set places, a few hundred numbers instead of 2048 columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from screenspark.functions.hashing import Pieces, bit_sets
from screenspark.functions.scalars import col_of, guarded_ratio

# Width of the hashed bit sets and the largest gram of the token fingerprint.
N_BITS = 2048
MAX_GRAM = 3


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters a-z and digits; a NULL text has none."""
    words = F.split(F.lower(F.coalesce(col_of(text), F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda w: w != "")


def fold_hash(piece: Column, n_bits: int, portable: bool = True) -> Column:
    """Place of a piece of text in [0, n_bits). The portable form is md5 and can be repeated in other engines."""
    if portable:
        number = F.conv(F.substring(F.md5(piece), 1, 8), 16, 10).cast("bigint")
    else:
        number = F.xxhash64(piece)
    return F.pmod(number, F.lit(n_bits)).cast("int")


def _hashed(words: Column, n_bits: int, glue: str, pieces_of: Callable[..., Iterator[Pieces]]) -> Column:
    """Ascending places of the pieces of a row's tokens, as ``fold_hash`` has them; NULL for NULL."""

    @arrow_udf("array<int>")
    def places(rows: pa.Array) -> pa.Array:
        return bit_sets(rows, n_bits, glue, pieces_of)

    # A filter on the result would otherwise be pushed below it, and hash everything twice.
    return places.asNondeterministic()(words)


def _places(pieces: Column, n_bits: int, portable: bool) -> Column:
    # Distinct pieces first: a long text repeats most of its words, and hashing is the costly step.
    hashed = F.transform(F.array_distinct(pieces), lambda p: fold_hash(p, n_bits, portable))
    return F.sort_array(F.array_distinct(hashed))


def _head(items: Column, less: int) -> Column:
    return F.slice(items, 1, F.greatest(F.size(items) - less, F.lit(0)))


def _tail(items: Column, skip: int) -> Column:
    return F.slice(items, skip + 1, F.greatest(F.size(items) - skip, F.lit(0)))


def _bind(value: Column, body) -> Column:
    """Compute a value once per row and use it several times in an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gram_bits(words: Column | str, n_bits: int = N_BITS, max_gram: int = MAX_GRAM, portable: bool = True) -> Column:
    """Bit set of all runs of 1 to ``max_gram`` neighbouring tokens. No token, no bit.

    Shifted copies of the token array are zipped, so a text of n tokens costs n steps per gram length. Tokens are not NULL.
    """
    if portable:

        def grams_of(starts: np.ndarray, own: np.ndarray, ends: np.ndarray) -> Iterator[Pieces]:
            for n in range(max_gram):
                i = np.flatnonzero(np.arange(len(own)) + n < ends)
                yield starts[i], starts[i + n + 1] - 1, None, None, b"", own[i]

        return _hashed(col_of(words), n_bits, " ", grams_of)

    def longer(single: Column, grams: list[Column]) -> Column:
        if len(grams) == max_gram:
            return _places(F.concat(*grams), n_bits, portable)
        zipped = F.zip_with(_head(grams[-1], 1), _tail(single, len(grams)), lambda a, b: F.concat_ws(" ", a, b))
        return _bind(zipped, lambda found: longer(single, [*grams, found]))

    return _bind(col_of(words), lambda single: longer(single, [single]))


def pair_bits(words: Column | str, n_bits: int = N_BITS, max_distance: int = 4, portable: bool = True) -> Column:
    """Bit set of (token, later token, distance) for distances up to ``max_distance``. Tokens are not NULL."""
    if portable:

        def pairs_of(starts: np.ndarray, own: np.ndarray, ends: np.ndarray) -> Iterator[Pieces]:
            for d in range(1, max_distance + 1):
                i = np.flatnonzero(np.arange(len(own)) + d < ends)
                yield starts[i], starts[i + 1], starts[i + d], starts[i + d + 1], str(d).encode(), own[i]

        return _hashed(col_of(words), n_bits, "|", pairs_of)

    def at(single: Column, distance: int) -> Column:
        return F.zip_with(
            _head(single, distance),
            _tail(single, distance),
            lambda a, b: F.concat_ws("|", a, b, F.lit(str(distance))),
        )

    return _bind(
        col_of(words),
        lambda single: _places(F.concat(*[at(single, d) for d in range(1, max_distance + 1)]), n_bits, portable),
    )


def key_bits(text: Column | str, patterns: Sequence[str]) -> Column:
    """0/1 per pattern of a fixed dictionary, in dictionary order."""
    value = F.coalesce(col_of(text), F.lit(""))
    return F.array(*[value.rlike(p).cast("int") for p in patterns])


def pattern_counts(text: Column | str, patterns: Mapping[str, str]) -> dict[str, Column]:
    """Number of matches per named pattern; 0 for a NULL text."""
    value = F.coalesce(col_of(text), F.lit(""))
    return {name: F.regexp_count(value, F.lit(p)) for name, p in patterns.items()}


def derived_ratios(ratios: Mapping[str, tuple[str, str]], sums: Mapping[str, Sequence[str]] = {}) -> dict[str, Column]:
    """Named quotients guarded by a divisor of at least 1, and named sums of columns."""
    out = {name: guarded_ratio(top, bottom) for name, (top, bottom) in ratios.items()}
    for name, parts in sums.items():
        out[name] = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return out


# The derived ratios of the property table as (numerator, divisor).
STRUCTURE_RATIOS = {
    "flexibility": ("rotatable_bonds", "heavy_atoms"),
    "complexity": ("rings", "heavy_atoms"),
    "aromaticity": ("aromatic_rings", "rings"),
    "saturation": ("saturated_rings", "rings"),
    "heteroatom_ratio": ("heteroatoms", "heavy_atoms"),
    "spiro_density": ("spiro_atoms", "heavy_atoms"),
    "bridgehead_density": ("bridgehead_atoms", "heavy_atoms"),
}
STRUCTURE_SUMS = {"hydrogen_bonding": ("hbd", "hba")}


def tanimoto(left: Column | str, right: Column | str) -> Column:
    """Shared over all set bits; NULL when both sets are empty."""
    shared = F.size(F.array_intersect(col_of(left), col_of(right)))
    union = F.size(col_of(left)) + F.size(col_of(right)) - shared
    return F.try_divide(shared.cast("double"), union.cast("double"))


def dense(bits: Column | str, n_bits: int) -> Column:
    """Bit set to a 0/1 array, for the block concat."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda i: F.array_contains(col_of(bits), i).cast("double")
    )


def concat_blocks(blocks: Sequence[Column | str]) -> Column:
    """Feature blocks side by side, missing numbers as 0."""
    joined = F.concat(*[col_of(b).cast("array<double>") for b in blocks])
    return F.transform(joined, lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))


WORD_BITS = 64


def word_names(n_bits: int) -> list[str]:
    """Fields of a packed set: one long per 64 bits."""
    return [f"w{k}" for k in range(-(-n_bits // WORD_BITS))]


def word_masks(bit: Column, n_bits: int) -> list[Column]:
    """Aggregates that pack the bits of a group, one long per 64 bits; a negative bit sets none."""
    zero = F.lit(0).cast("bigint")
    word = F.call_function("shiftright", bit, F.lit(6))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(WORD_BITS - 1)))
    return [F.coalesce(F.bit_or(F.when(word == k, mask).otherwise(zero)), zero).alias(name) for k, name in enumerate(word_names(n_bits))]


def packed_shared(left: Column | str, right: Column | str, n_bits: int = N_BITS) -> Column:
    """Number of bits set in both of two packed sets."""
    a, b = col_of(left), col_of(right)
    counts = [F.bit_count(a[name].bitwiseAND(b[name])) for name in word_names(n_bits)]
    return sum(counts[1:], counts[0])


def packed_tanimoto(left: Column | str, left_size: Column | str, right: Column | str, right_size: Column | str, n_bits: int = N_BITS) -> Column:
    """Shared over all set bits of two packed sets of known sizes; NULL when both are empty."""
    shared = packed_shared(left, right, n_bits)
    return F.try_divide(shared.cast("double"), (col_of(left_size) + col_of(right_size) - shared).cast("double"))


def packed_alike(left: Column | str, left_size: Column | str, right: Column | str, right_size: Column | str, similar: float, n_bits: int = N_BITS) -> Column:
    """Whether two packed sets have a Tanimoto of at least ``similar``, by counts instead of a quotient; exact for limits of up to
    five decimals, for others to a millionth of a bit."""
    return packed_shared(left, right, n_bits) * (1 + similar) >= (col_of(left_size) + col_of(right_size)) * similar - 1e-6
