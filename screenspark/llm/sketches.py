"""Threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed share of the hash range, so its size grows with the text, and the shared
part of two sketches is the sketch of the shared shingles: what share of a short document lies in a long one can be
estimated, which sketches of a fixed size cannot tell. The sketch of a union of shingles is the union of the sketches.
A text all of whose hashes lie above the threshold keeps its smallest one, so that no text with words goes without.

Only built-in functions are used. To set a document beside the next one by id, the ids are cut into short ranges by a
sample of them, and every range also gets the first row of the next one; texts move once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenspark.llm.decontaminate import gram_hashes, words_of

#: Words of a shingle, and the share of the hash range whose hashes are kept.
SHINGLE, SHARE = 5, 1 / 8
#: Rows of a range of ids (about), ranges at most (beyond, they get longer), and sampled ids per range.
ROWS, RANGES, SAMPLED = 500, 32_768, 8
_BITS = (1 << 63) - 1


def _free(columns: list[str], name: str) -> str:
    """A column name like ``name`` that is not taken."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def _below(share: float) -> Callable[[Column], Column]:
    """Whether a hash is below the threshold."""
    return lambda h: h <= F.lit(int(share * (1 << 63)) - 1)


def with_sketch(df: DataFrame, text: str, out: str, share: float = SHARE, shingle: int = SHINGLE) -> DataFrame:
    """The rows with the sketch of a text column: hashes below ``share`` of the range, in ascending order.

    Shingles are ``shingle`` consecutive words with A-Z lowered, all words if there are fewer; words are runs of letters
    and digits. NULL texts and those without words have an empty sketch.
    """
    words, hashes = _free(df.columns, "_words"), _free(df.columns, "_hashes")
    cut = df.withColumn(words, words_of(F.col(f"`{text}`")))
    size = F.size(words)
    whole = F.when(size > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    hashed = F.when(size >= shingle, gram_hashes(F.col(words), shingle)).otherwise(whole)
    made = cut.withColumn(hashes, F.transform(hashed, lambda h: h.bitwiseAND(F.lit(_BITS)))).drop(words)
    kept = F.sort_array(F.array_distinct(F.filter(hashes, _below(share))))
    made = made.withColumn(out, kept)
    least = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.col(hashes))
    return made.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(least)).drop(hashes)


def merged(a: Column, b: Column, share: float = SHARE) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    kept = F.filter(both, _below(share))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) > 0, shared / F.size(a)).otherwise(1.0)


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger one; of two empty sketches 1, of an empty and another one 0."""
    least = F.least(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b)) / least
    return F.when(least > 0, both).otherwise(F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def as_text(sketch: Column) -> Column:
    """A sketch as one string: 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def group_containment(rows: DataFrame, group: str, sketch: str, share: float = SHARE) -> DataFrame:
    """(group, n_hashes, n_other, n_shared, contained): sketches merged by group, and how much of each lies in the rest.

    The merged sketches are kept as rows (group, hash), never as one value, so groups may be of any size, and a hash that
    many groups have is a count: the number of groups that hold it. A group without hashes below the threshold has no row;
    NULL is a group.
    """
    own = rows.select(F.col(f"`{group}`").alias("group"), F.explode(f"`{sketch}`").alias("hash")).where(_below(share)(F.col("hash"))).distinct()
    held = own.groupBy("hash").agg(F.count(F.lit(1)).alias("n_groups"))
    total = held.agg(F.count(F.lit(1)).alias("n_all"))
    counted = own.join(held, "hash").groupBy("group").agg(
        F.count(F.lit(1)).alias("n_hashes"), F.count_if(F.col("n_groups") > 1).alias("n_shared")
    )
    n_all = total.first()["n_all"]
    return counted.select(
        "group", "n_hashes", (F.lit(n_all) - F.col("n_hashes") + F.col("n_shared")).alias("n_other"), "n_shared",
        (F.col("n_shared") / F.col("n_hashes")).alias("contained"),
    )


def _bounds(rows: DataFrame) -> list[tuple[int, int, bool]]:
    """First key (place, tie) of every range, and whether that key alone fills ranges; from a sample of the keys.

    The driver gets SAMPLED x RANGES keys at most (about), whatever the size of the table. Any bounds give the same result.
    """
    n, first = rows.agg(F.count(F.lit(1)), F.min(F.struct("_place", "_tie"))).first()
    if not n:
        return []
    ranges = min(RANGES, -(-n // ROWS))
    some = rows.where(F.rand(7) < F.lit(SAMPLED * ranges / n)) if n > SAMPLED * ranges else rows
    keys = some.groupBy("_place", "_tie").agg(F.count(F.lit(1)).alias("n")).collect()
    bounds, held = {tuple(first): False}, 0
    for place, tie, count in sorted(map(tuple, keys)):
        hot = count >= 2 * SAMPLED
        if hot or held >= SAMPLED:
            bounds[place, tie] = hot
            held = 0
        held += count
    return [(*key, hot) for key, hot in sorted(bounds.items())]


def _literal(numbers: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def beside_next(documents: DataFrame, id_column: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch): every row with the next one in ascending order of ids; the last row's
    next is the first one.

    NULL ids come first, rows of equal id in the order of a hash of their texts; NULL texts are empty. Rows equal in id and
    text that are so many that they would fill ranges move as one row with a count and are set apart again, each
    beside its copy and the last beside the next row. A single row is its own next; an empty table gives none.
    """
    rows = documents.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = rows.withColumns({"_place": F.coalesce("id", F.lit(-1 << 63)), "_tie": F.xxhash64("text")})
    bounds = _bounds(rows)
    if not bounds:
        bounds = [(0, 0, False)]
    any_hot = any(hot for *_, hot in bounds)
    places, ties, hots = (_literal([int(b[k]) for b in bounds]) for k in range(3))
    n, steps = len(bounds), [1 << k for k in reversed(range(max(1, (len(bounds) - 1).bit_length())))]

    def halve(low: Column, step: Column) -> Column:
        at = low + step
        before = (F.get(places, at) < F.col("_place")) | ((F.get(places, at) == F.col("_place")) & (F.get(ties, at) <= F.col("_tie")))
        return F.when((at < n) & before, at).otherwise(low)

    # The range of a row, by binary search; the first row of a range is also a guest at the end of the one before.
    rows = rows.withColumn("_range", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve))
    is_bound = (F.get(places, "_range") == F.col("_place")) & (F.get(ties, "_range") == F.col("_tie"))
    rows = rows.withColumn("_copies", F.lit(1).cast("bigint"))
    if any_hot:
        rows = rows.withColumn("_hot", is_bound & (F.get(hots, "_range") == 1))
        names = ["id", "text", "_place", "_tie", "_range"]
        one = rows.where("_hot").groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
        rows = rows.where("not _hot").drop("_hot").unionByName(one)
    own = F.struct(F.col("_range").alias("_at"), F.lit(0).alias("_guest"))
    guest = F.struct(F.pmod(F.col("_range") - 1, F.lit(n)).alias("_at"), F.lit(1).alias("_guest"))
    seats = F.when(is_bound, F.array(own, guest)).otherwise(F.array(own))
    placed = with_sketch(rows.select("*", F.inline(seats)), "text", "sketch", share)
    following = Window.partitionBy("_at").orderBy("_guest", "_place", "_tie")
    beside = placed.withColumns({"next_text": F.lead("text").over(following), "next_sketch": F.lead("sketch").over(following)})
    beside = beside.where("_guest = 0").select("id", "text", "sketch", "next_text", "next_sketch", "_copies")
    if any_hot:
        last = F.struct(F.lit(1).cast("bigint").alias("_times"), F.col("next_text").alias("_nt"), F.col("next_sketch").alias("_ns"))
        inner = F.struct((F.col("_copies") - 1).alias("_times"), F.col("text").alias("_nt"), F.col("sketch").alias("_ns"))
        parts = F.when(F.col("_copies") > 1, F.array(last, inner)).otherwise(F.array(last))
        beside = beside.select("id", "text", "sketch", F.inline(parts))
        beside = beside.select("id", "text", "sketch", F.col("_nt").alias("next_text"), F.col("_ns").alias("next_sketch"), F.explode(F.sequence(F.lit(1).cast("bigint"), "_times")))
    return beside.select("id", "text", "sketch", "next_text", "next_sketch")


def edited(text: Column, other: Column) -> Column:
    """The text with its last half (rounded down, in code points) replaced by the first as many of another one."""
    half = F.floor(F.length(text) / 2).cast("int")
    one = F.lit(1)
    return F.concat(F.substr(text, one, F.length(text) - half), F.substr(other, one, half))


def document_fingerprints(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """Sketches of every document and of its edited text, and their likeness; rows as in ``beside_next``.

    The likeness of two sketches is the containment of the smaller one in the other. Equal texts have equal sketches; texts
    without words have empty ones, alike to each other and to no others. Every row gives one, repeated ones too; further columns
    are ignored.
    """
    rows = beside_next(documents, share=share)
    rows = with_sketch(rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))), "edited", "edited_sketch", share)
    return rows.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
