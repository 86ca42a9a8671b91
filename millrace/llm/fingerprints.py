"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer is a run of k units. It is an anchor if the smallest of its inner s-mers (runs of s units, compared by hash) stands
at one of its edges. Whether a k-mer is an anchor depends on its own units alone, so equal passages have equal anchors
wherever they stand; of any k - s + 1 neighbouring k-mers at least one is an anchor.

Every text has anchors of two sizes, by one rule for all lengths. Those of K words (S inner ones) carry their places, for
positional matching. Those of two code points (of which each is closed) tell short texts and changed words apart: they are
made of the distinct words that a hash draws, about LETTERED of a text, at a rate that falls with its length so that what
a longer text draws is drawn in a shorter one too; a text of up to LETTERED words gives all of them. Words are what is left
between ASCII white space, lower-cased; one of over LONGEST code points, as in scripts without white space, counts as its
code points among the words.

The fingerprint of a document is all its distinct anchor hashes, cut off nowhere, so that a short passage shared by long
texts counts. Two fingerprints are as alike as the Dice coefficient of the 32-bit hashes that they have. `aligned` moves one
text's anchors by the shift that most shared anchors have, and then counts those at equal places.

Defined results: a null text is an empty one, whose fingerprint is empty; two empty fingerprints are alike (1), an empty
and another one are not (0); equal texts have equal fingerprints; a very long text is one array of words; an empty table
gives an empty table; ids are read as longs, one that is no number as null; only the two columns named are read, so that others may have
any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, with_partition_position

K, S = 5, 2
#: Code points of the longest word that is a unit.
LONGEST = 16
_SPACE = r"[\x20\x09-\x0D]+"
#: Words of a text whose pairs of code points are anchors, about; all if it has no more.
LETTERED = 24


def _let(value: Column, use) -> Column:
    """use(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), use), 0)


def _run(hashes: Column, at: Column, length: int) -> Column:
    """Hash of `length` neighbouring hashes."""
    return F.xxhash64(*[F.get(hashes, at + j) for j in range(length)])


def _words(lowered: Column) -> Column:
    return F.filter(F.split(lowered, _SPACE), lambda w: w != "")


def _apart(words: Column) -> Column:
    """Words with the long ones taken apart."""
    return F.flatten(F.transform(words, lambda w: F.when(F.length(w) <= LONGEST, F.array(w)).otherwise(F.split(w, ""))))


def _has_long(words: Column) -> Column:
    return F.exists(words, lambda w: F.length(w) > LONGEST)


def _units(text: Column) -> Column:
    return _let(_words(F.lower(text)), lambda words: F.when(_has_long(words), _apart(words)).otherwise(words))


def _hashes(units: Column) -> Column:
    return F.transform(units, lambda u: F.xxhash64(u))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<place, hash>>: place is the number of the anchor's first unit, hash a 64-bit hash of its units."""
    return _let(_hashes(_units(F.coalesce(text, F.lit("")))), lambda hashes: _closed(hashes, k, s))


def letter_anchors(text: Column) -> Column:
    """32-bit hashes of the pairs of code points, edges included, of the words that are drawn."""
    return _let(_words(F.lower(F.coalesce(text, F.lit("")))), _letters)


def _letters(words: Column) -> Column:
    def made(rate: Column) -> Column:
        some = F.filter(words, lambda w: F.shiftrightunsigned(F.xxhash64(w, F.lit(1)), 33) < rate)
        return F.flatten(F.transform(F.array_distinct(some), pairs))

    def pairs(word: Column) -> Column:
        each = lambda letters: F.transform(F.sequence(F.lit(0), F.size(letters) - 2), lambda i: F.concat(F.get(letters, i), F.get(letters, i + 1)))
        cut_up = F.split(F.concat(F.lit("\x02"), word, F.lit("\x03")), "")
        return F.transform(_let(cut_up, each), lambda pair: F.shiftrightunsigned(F.xxhash64(pair), 32))

    n = F.when(_has_long(words), F.size(_apart(words))).otherwise(F.size(words))
    return _let(F.lit(float(1 << 31) * LETTERED) / F.greatest(n, F.lit(1)), made)


def marks(text: Column, k: int = K, s: int = S) -> Column:
    """Both kinds of anchors of a text, its words split once: struct<packed array<long>, letters array<long>>."""

    def both(words: Column) -> Column:
        units = F.when(_has_long(words), _apart(words)).otherwise(words)
        packed = _let(_hashes(units), lambda hashes: _pack(_closed(hashes, k, s)))
        return F.struct(packed.alias("packed"), _letters(words).alias("letters"))

    return _let(_words(F.lower(F.coalesce(text, F.lit("")))), both)


def _closed(hashes: Column, k: int, s: int) -> Column:
    """The closed k-mers."""
    n = F.size(hashes)
    inner = F.transform(F.sequence(F.lit(0), n - s), lambda i: _run(hashes, i, s))
    edge = k - s

    def one(runs: Column, i: Column) -> Column:
        low = F.array_min(F.slice(runs, i + 1, edge + 1))
        closed = (F.get(runs, i) == low) | (F.get(runs, i + edge) == low)
        return F.when(closed, F.struct(i.alias("place"), _run(hashes, i, k).alias("hash")))

    every = _let(inner, lambda runs: F.transform(F.sequence(F.lit(0), n - k), lambda i: one(runs, i)))
    none = F.slice(F.array(F.struct(F.lit(0).alias("place"), F.lit(0).cast("bigint").alias("hash"))), 1, 0)
    return F.when(n >= k, F.filter(every, lambda a: a.isNotNull())).otherwise(none)


def _pack(found: Column, shift: Column | None = None) -> Column:
    """Anchors as longs: the upper 32 bits of the hash, then the place."""
    place = (lambda a: a["place"] + shift) if shift is not None else lambda a: a["place"]
    upper = F.lit(-(1 << 32))
    return F.transform(found, lambda a: a["hash"].bitwiseAND(upper).bitwiseOR(place(a).cast("bigint")))


def packed_anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Anchors of a text as array<long>, one long each, by place."""
    return _pack(anchors(text, k, s))


def edited_marks(own: Column, kept: Column, tail: Column, k: int = K, s: int = S) -> Column:
    """marks of the text kept + tail, where own are packed anchors of a text that begins with kept.

    All k-mers of whole words of kept are those of that text; only what reaches into the tail is computed.
    """
    ended = F.substring(kept, -1, 1).isin(*" \t\n\x0b\x0c\r")

    def after(raw: Column) -> Column:  # the words of kept
        open_ = (F.size(raw) > 0) & ~ended  # the last one may be broken
        broken = F.when(open_, F.element_at(raw, -1)).otherwise(F.lit(""))
        whole = F.transform(raw, lambda w: F.lower(w))
        added = _words(F.lower(F.concat(broken, tail)))
        return _let(F.slice(whole, F.lit(1), F.size(raw) - open_.cast("int")), lambda full: _let(added, lambda more: from_words(full, more)))

    def from_words(full: Column, added: Column) -> Column:
        last = F.slice(full, F.greatest(F.size(full) - (k - 2), F.lit(1)), F.lit(k - 1))
        count = F.when(_has_long(full), F.size(_apart(full))).otherwise(F.size(full))

        def joined(m: Column) -> Column:
            start = F.greatest(m - (k - 1), F.lit(0))
            near = _let(_apart(last), lambda u: F.slice(u, F.greatest(F.size(u) - (m - start) + 1, F.lit(1)), m - start))
            hashes = _hashes(F.concat(near, F.when(_has_long(added), _apart(added)).otherwise(added)))
            new = _let(hashes, lambda h: F.struct(_pack(_closed(h, k, s), start).alias("new")))
            same = F.filter(own, lambda p: p.bitwiseAND(F.lit((1 << 32) - 1)) < start)
            packed = F.concat(same, new["new"])
            return F.struct(packed.alias("packed"), _letters(F.concat(full, added)).alias("letters"))

        return _let(count, joined)

    return _let(_words(kept), after)


def sketch_of(packed: Column, letters: Column) -> Column:
    """All distinct anchor hashes, ascending, each its upper 32 bits."""
    return F.sort_array(F.array_distinct(F.concat(F.transform(packed, lambda p: F.shiftrightunsigned(p, 32)), letters)))


def sketch(text: Column, k: int = K, s: int = S) -> Column:
    """The fingerprint of a text."""
    return sketch_of(packed_anchors(text, k, s), letter_anchors(text))


def _small(found: Column) -> Column:
    """A sketch in half the room: ints, less by 2 ** 31."""
    return F.transform(found, lambda h: (h - F.lit(1 << 31)).cast("int"))


def written_out(found: Column) -> Column:
    """A sketch as text: 8 lower-case hex digits for each hash."""
    return F.array_join(F.transform(found, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """How alike two sketches are, 0 to 1."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def aligned(a: Column, b: Column) -> Column:
    """How alike two arrays of packed anchors (columns of the table, not expressions) are by places, 0 to 1: the Dice
    coefficient as they stand, if half of the fewer stand at equal places, else after a is moved by the main shift."""

    def moved(shift: Column) -> Column:
        there = F.filter(a, lambda p: p.bitwiseAND(F.lit((1 << 32) - 1)) + shift >= 0)
        return F.size(F.array_intersect(F.transform(there, lambda p: p + shift), b))

    total = F.size(a) + F.size(b)
    here = lambda n: F.when(2 * n >= F.least(F.size(a), F.size(b)), n).otherwise(_let(main_shift(a, b), moved))
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * _let(F.size(F.array_intersect(a, b)), here) / total)


def _firsts(packed: Column) -> Column:
    """The first place of each hash, ordered by hash."""
    upper = lambda p: F.shiftrightunsigned(p, 32)
    return _let(F.sort_array(packed), lambda a: F.filter(a, lambda p, i: (i == 0) | (upper(p) != upper(F.get(a, i - 1)))))


def _shifts(a: Column, b: Column) -> Column:
    """Of each shared hash, how much later it stands in b."""
    hash_of, place = (lambda p: F.shiftrightunsigned(p, 32)), (lambda p: p.bitwiseAND(F.lit((1 << 32) - 1)))
    tagged = lambda x, side: F.transform(_firsts(x), lambda p: F.struct(hash_of(p).alias("h"), F.lit(side).alias("s"), place(p).alias("p")))
    both = F.sort_array(F.concat(tagged(a, 0), tagged(b, 1)))
    apart = lambda x: F.transform(x, lambda e, i: F.when((e["s"] == 1) & (i > 0) & (F.get(x, i - 1)["h"] == e["h"]), e["p"] - F.get(x, i - 1)["p"]))
    return F.filter(_let(both, apart), lambda d: d.isNotNull())


def main_shift(a: Column, b: Column) -> Column:
    """By how many places most shared anchors of a stand later in b (first places count; the smallest of equally frequent
    shifts); 0 if none is shared."""
    def runs(shifts: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("most"), F.lit(0).cast("bigint").alias("best"))

        def step(s: Column, x: Column) -> Column:
            n = F.when((s["n"] > 0) & (s["at"] == x), s["n"] + 1).otherwise(F.lit(1).cast("bigint"))
            better = n > s["most"]
            return F.struct(n.alias("n"), x.alias("at"), F.when(better, n).otherwise(s["most"]).alias("most"), F.when(better, x).otherwise(s["best"]).alias("best"))

        return F.aggregate(shifts, start, step, lambda s: s["best"])

    return _let(_shifts(a, b), lambda x: runs(F.sort_array(x)))


def neighbours(ids: DataFrame) -> DataFrame:
    """(id, n) to (id, before, before_n): for each distinct id the next smaller one, and the largest n of that one's rows;
    before the first stands the last. Ids are placed by range partitions; only one row per partition is looked at as a
    table."""
    one = ids.where("id IS NOT NULL").groupBy("id").agg(F.max("n").alias("n"))
    placed = cut(with_partition_position(one, F.col("id")))
    edges = placed.groupBy("pid").agg(F.max(F.struct("id", "n")).alias("last"))
    every = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(
        F.col("pid").alias("_pid"),
        F.coalesce(F.lag("last").over(Window.orderBy("pid")), F.last("last").over(every)).alias("_edge"),
    )
    within = placed.withColumn("_within", F.lag(F.struct("id", "n")).over(Window.partitionBy("pid").orderBy("pos")))
    found = F.coalesce("_within", "_edge")
    return within.join(edges, F.col("pid") == F.col("_pid")).select(
        "id", found.getField("id").alias("before"), found.getField("n").alias("before_n")
    )


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, text, anchors, sketch, edited, edited_marks, next_sketch) of every row.

    edited is the text whose last floor(n_chars / 4) code points are replaced by the first as many of the next document
    by id (after the last comes the first). Of a document as the next one only that beginning and its sketch travel.
    Of rows that share an id the one with the smallest such beginning, then sketch, stands for it as a next document;
    rows with a null id have no next document, and their edited text just loses its end.
    """
    docs = df.select(F.col(f"`{id_col}`").try_cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    before = neighbours(docs.select("id", F.length("text").alias("n")))
    held = docs.where("id IS NOT NULL").join(before, "id")
    own = marks(F.col("text"))  # twice, after the shuffle of the texts: anchors are as large as these
    part = F.substring(F.col("text"), F.lit(1), (F.col("before_n") / 4).cast("int"))
    marked = _let(own, lambda m: _small(sketch_of(m["packed"], m["letters"])))
    sent = held.groupBy(F.col("before").alias("_of")).agg(F.min(F.struct(part, marked)).alias("_sent"))
    n = F.length("text")
    kept = F.expr("substring(text, 1, length(text) - length(text) div 4)").alias("_kept")
    tail = F.substring(F.col("_sent.col1"), F.lit(1), (n / 4).cast("int")).alias("_tail")
    found = held.join(sent, F.col("id") == F.col("_of")).select("id", "text", own.alias("own"), kept, tail, F.col("_sent.col2").alias("_next"))
    alone = docs.where("id IS NULL").select("id", "text", own.alias("own"), kept, F.lit("").alias("_tail"), F.lit(None).cast("array<int>").alias("_next"))
    return found.union(alone).select(
        "id",
        n.alias("n_chars"),
        "text",
        F.col("own.packed").alias("anchors"),
        sketch_of(F.col("own.packed"), F.col("own.letters")).alias("sketch"),
        F.concat("_kept", "_tail").alias("edited"),
        edited_marks(F.col("own.packed"), F.col("_kept"), F.col("_tail")).alias("edited_marks"),
        F.transform("_next", lambda h: h.cast("bigint") + F.lit(1 << 31)).alias("next_sketch"),
    )
