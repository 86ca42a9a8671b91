"""Line dedup: exact repeats and lines within one or two edits, by a deletion-neighbourhood join.

Each line emits the line itself and every variant with one character deleted as hashed keys. Two lines are within one
edit exactly where they share a variant with the same place deleted (a substitution) or one is a variant of the other
(an insertion). Lines that share (variant, place) are all within one edit of each other, so each needs comparing with
the earliest of them only, and a line that equals a variant is compared with the lines that emit it: no group of lines
is expanded into its pairs. The edit distance is verified on the texts, and a line goes if an earlier one is near.

Within two edits lines emit the variants with two deletions as well. Two lines are that near exactly where one variant is
(a) that of one deletion in both, (b) one of two deletions and the other whole line, (c) one of two deletions in one and
of one in the other, with a deletion at the same gap of the variant, or (d) one of two deletions in both at the same
gaps, or where they are within one edit. Each of these keys again has only lines that are all near each other.

Two steps come before, since a line of 300 characters has 300 variants. Exact repeats are one entry, under a 128-bit
digest. And variants are only made for lines that share a half (for two edits a third) with another: of two lines within
one edit, either the first half of the shorter begins both or its second half ends both. That is a necessary condition,
so it loses nothing; for one edit it also tells in which half the edit is, and only that half's deletions are emitted.

Rules: lines are split at line feeds and compared as they are, in the order of (id, place in the document). Lines of
only white space always stay. Two lines are near if they are within max_edits edits and the shorter has min_chars
characters for each edit, that is, with the default of 20 if at least 95 in 100 of their characters agree: a similarity,
below which short lines like "Chapter 1" and "Chapter 2" would go. There is no upper limit; within two edits a line of n
characters has n * n / 2 variants, made in blocks, so that long lines take time but no memory.

Defined results: a null text stays null and has 0 lines; rows with a null id stay as they are and take no part; rows
that share an id are one document: a line of theirs stays if the line at that place stays in one of them. An empty
table gives an empty table. Extra columns are kept, whatever their names; where n_lines or n_kept is taken, underscores
go before the new name until it is free. Ids are read as longs; a row whose id is no number is one with a null id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, row_slices, small_side, stored

#: Variants that are made at a time.
ROWS = 50_000


def _parts(line: Column, max_edits: int) -> Column:
    """Keys of the parts that near lines must share one of, for each length that the shorter one may have.

    One edit: two parts, the first at the beginning, the other at the end. Two edits: three, and where the middle one is
    left alone and neither other is, it stands at most one place farther.
    """
    n = F.length(line)
    keys = []
    for less in range(max_edits + 1):
        length = n - less
        first = F.floor(length / (max_edits + 1)).cast("int")
        last = length - max_edits * first
        keys.append(F.xxhash64(F.lit(0), length, F.substring(line, F.lit(1), first)))
        keys.append(F.xxhash64(F.lit(1), length, F.substring(line, n - last + 1, last)))
        if max_edits > 1:
            keys += [F.xxhash64(F.lit(2), length, F.substring(line, first + 1 + k, first)) for k in (-1, 0, 1)]
    return F.array(*keys)


def _weights(count: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**64, count, dtype=np.uint64) | np.uint64(1)


def variants(line: str, first: bool, second: bool, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the line without each character of the halves asked for, and the place of it; -1 is the line itself.

    The hash sums code points times a random weight of their place, so that all deletions come from two prefix sums.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    n = len(codes)
    stay = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * weights[:n])])
    moved = np.zeros(n + 1, dtype=np.uint64)
    moved[2:] = np.cumsum(codes[1:] * weights[: max(n - 1, 0)])
    half = n // 2
    places = np.arange(0 if first else max(half - 1, 0), n if second else min(half + 1, n))
    of_length = [np.uint64(m * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for m in (max(n - 1, 0), n)]
    gone = stay[places] + (moved[n:] - moved[places + 1]) + of_length[0]
    own = stay[n:] + of_length[1]
    return np.concatenate([own, gone]).view(np.int64), np.concatenate([[-1], places]).astype(np.int32)


def variant_blocks(line: str, first: bool, second: bool, weights: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What variants() gives, about `rows` places at a time; of a long line only its characters are in memory."""
    if len(line) <= rows:
        yield variants(line, first, second, weights)
        return
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(codes)

    def sums(s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        part = codes[s:e].astype(np.uint64) + np.uint64(1)
        back = part * weights[np.arange(s, e) - 1]
        if s == 0:
            back[0] = 0
        return np.cumsum(part * weights[s:e]), np.cumsum(back)

    of_length = [np.uint64(m * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for m in (n - 1, n)]
    stay, moved = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
    for s in range(0, n, rows):
        a, b = sums(s, min(s + rows, n))
        stay, moved = stay + a[-1], moved + b[-1]
    yield (stay + of_length[1]).view(np.int64), np.array([-1], dtype=np.int32)
    half, every = n // 2, moved
    low, high = 0 if first else max(half - 1, 0), n if second else min(half + 1, n)
    stay, moved = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
    for s in range(0, high, rows):
        e = min(s + rows, n)
        a, b = sums(s, e)
        places = np.arange(max(s, low), min(e, high))
        if len(places):
            before = np.concatenate([stay, stay + a[:-1]])
            gone = before[places - s] + (every - (moved + b[places - s])) + of_length[0]
            yield gone.view(np.int64), places.astype(np.int32)
        stay, moved = stay + a[-1], moved + b[-1]


def _emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = _weights(1000)
    for batch in it:
        doc, no, first, second = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
        for k in range(len(doc)):
            line = batch.column(2)[k].as_py()
            if len(line) > len(weights):
                weights = _weights(max(len(line), 2 * len(weights)))  # begins with the same weights
            for keys, places in variant_blocks(line, first[k], second[k], weights, ROWS):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys),
                        pa.array(places),
                        pa.array(np.full(len(keys), doc[k], dtype=np.int64)),
                        pa.array(np.full(len(keys), no[k], dtype=np.int32)),
                    ],
                    names=["v", "place", "doc", "no"],
                )


def _mixed(h: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """Hashes of hashes and numbers."""
    x = (h ^ (np.asarray(number, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


#: Kinds of keys: the variant alone, with one gap, with two gaps.
_ALONE, _GAP, _GAPS = 1, 2, 3


def two_edit_keys(line: str, doubles: bool, rows: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(keys, kind, deletions) of the line for matches within two edits, about `rows` keys at a time; without doubles
    only variants of one deletion are made. A gap is the place in the variant where a character is missing."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    n = len(codes)
    weights = _weights(n + 1)
    sums = [np.append(np.uint64(0), np.cumsum(codes * np.append(np.zeros(k, np.uint64), weights)[:n])) for k in range(3)]
    of = [np.uint64(max(n - k, 0) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in range(3)]
    yield _mixed(sums[0][n:] + of[0], _ALONE), _ALONE, 0
    for s in range(0, n, rows):
        at = np.arange(s, min(n, s + rows))
        single = sums[0][at] + (sums[1][n] - sums[1][at + 1]) + of[1]
        yield _mixed(single, _ALONE), _ALONE, 1
        yield _mixed(_mixed(single, _GAP), at), _GAP, 1
    for i in range(n - 1 if doubles else 0):
        for s in range(i + 1, n, rows):
            j = np.arange(s, min(n, s + rows))
            double = sums[0][i] + (sums[1][j] - sums[1][i + 1]) + (sums[2][n] - sums[2][j + 1]) + of[2]
            yield _mixed(double, _ALONE), _ALONE, 2
            gap = _mixed(double, _GAP)
            yield _mixed(gap, i), _GAP, 2
            yield _mixed(gap, j - 1)[j - 1 > i], _GAP, 2
            yield _mixed(_mixed(_mixed(double, _GAPS), i), j), _GAPS, 2


def _emit_two(min_chars: int):
    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            doc, no = (batch.column(k).to_pylist() for k in (0, 1))
            for k in range(len(doc)):
                line = batch.column(2)[k].as_py()
                for keys, kind, gone in two_edit_keys(line, len(line) >= 2 * min_chars, ROWS):
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys.view(np.int64)),
                            pa.array(np.full(n, kind, dtype=np.int32)),
                            pa.array(np.full(n, gone, dtype=np.int32)),
                            pa.array(np.full(n, doc[k], dtype=np.int64)),
                            pa.array(np.full(n, no[k], dtype=np.int32)),
                        ],
                        names=["v", "kind", "gone", "doc", "no"],
                    )

    return emit


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _within(x: np.ndarray, y: np.ndarray, edits: int) -> bool:
    m = min(len(x), len(y))
    other = np.flatnonzero(x[:m] != y[:m])
    k = int(other[0]) if len(other) else m
    x, y = x[k:], y[k:]
    if not len(x) or not len(y) or not edits:
        return max(len(x), len(y)) <= edits
    if abs(len(x) - len(y)) > edits:
        return False
    return _within(x[1:], y[1:], edits - 1) or _within(x[1:], y, edits - 1) or _within(x, y[1:], edits - 1)


def within(a: str, b: str, edits: int) -> bool:
    """Whether two texts are within so many edits, in time linear in their length."""
    return _within(_codes(a), _codes(b), edits)


def within_one(a: str, b: str) -> bool:
    return within(a, b, 1)


def _close(max_edits: int, min_chars: int):
    def close(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            near = []
            for k in range(batch.num_rows):
                a, b = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                near.append(within(a, b, min(max_edits, min(len(a), len(b)) // max(1, min_chars))))
            yield batch.select(["doc", "no"]).filter(pa.array(near, pa.bool_()))

    return close


def _packed(it: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Small batches joined to larger ones."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in it:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _candidates_one(lines: DataFrame) -> DataFrame:
    """(a, b): lines and an earlier one that may be within one edit, the earliest for each key."""
    emitted = cut(
        lines.select("doc", "no", "line", "first", "second").mapInArrow(
            lambda it: _packed(_emit(it)), "v long, place int, doc long, no int"
        )
    )
    at = F.struct("doc", "no")
    gone = emitted.where("place >= 0")
    earliest = gone.groupBy("v", "place").agg(F.min(at).alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same_place = gone.join(earliest.drop("n"), ["v", "place"]).select(at.alias("a"), "b")
    whole = emitted.where("place < 0").select(F.col("v").alias("_v"), at.alias("b"))
    inserted = gone.join(whole, F.col("v") == F.col("_v")).select(F.greatest(at, "b").alias("a"), F.least(at, "b").alias("b"))
    return same_place.union(inserted)


def _candidates_two(lines: DataFrame, min_chars: int) -> DataFrame:
    """As _candidates_one, within two edits: of each key the earliest line by the number of deletions."""
    emitted = cut(
        lines.select("doc", "no", "line").mapInArrow(
            lambda it: _packed(_emit_two(min_chars)(it)), "v long, kind int, gone int, doc long, no int"
        )
    )
    at = F.struct("doc", "no")
    first = [F.min(F.when(F.col("gone") == k, at)).alias(f"b{k}") for k in range(3)]
    earliest = emitted.groupBy("v", "kind").agg(*first, F.min(at).alias("low"), F.max(at).alias("high")).where("low < high").drop("low", "high")
    met = emitted.join(earliest, ["v", "kind"])
    alone, gap, gaps = (F.col("kind") == k for k in (_ALONE, _GAP, _GAPS))
    gone = [F.col("gone") == k for k in range(3)]
    partners = (
        F.when(alone & gone[0], F.array("b1", "b2"))
        .when(alone & gone[1], F.array("b0", "b1"))
        .when(alone & gone[2], F.array("b0"))
        .when(gap & gone[1], F.array("b1", "b2"))
        .when(gap & gone[2], F.array("b1"))
        .when(gaps, F.array("b2"))
    )
    found = met.select(at.alias("a"), F.explode(partners).alias("b")).where("b IS NOT NULL AND a <> b")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _asked_lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the lines asked for (number, digest, halves) to these lines, where the digest agrees."""
    for batch in row_slices(it):
        rows = []
        for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            every = (text.as_py() or "").split("\n")
            for a in asked.as_py():
                line = every[a["no"]] if a["no"] < len(every) else ""
                if hashlib.md5(line.encode("utf-8", "surrogatepass")).digest() == a["k"]:
                    rows.append((doc, a["no"], line, a["first"], a["second"]))
        names, kinds = ("doc", "no", "line", "first", "second"), (pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def near_lines(docs: DataFrame, heads: DataFrame, max_edits: int = 1, min_chars: int = 20) -> DataFrame:
    """Of the distinct lines in heads, those with an earlier one near: (doc, no)."""
    keyed = heads.where("parts IS NOT NULL").select("doc", "no", "k", F.posexplode("parts").alias("which", "part"))
    shared = cut(keyed.groupBy("part").count().where("count > 1").select(F.col("part").alias("_part")))
    marked = (
        keyed.join(small_side(shared, shared.count()), F.col("part") == F.col("_part"))
        .groupBy("doc", "no", "k")
        .agg(F.max(F.col("which") % 2 == 1).alias("first"), F.max(F.col("which") % 2 == 0).alias("second"))
    )
    asked = cut(marked.groupBy("doc").agg(F.collect_list(F.struct("no", "k", "first", "second")).alias("asked")))
    entries = asked.agg(F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()[0]  # 40 bytes each
    found = docs.join(small_side(asked, entries), F.col("_id") == F.col("doc"))
    lines = found.select("doc", "_text", "asked").mapInArrow(_asked_lines, "doc long, no int, line string, first boolean, second boolean")
    lines = cut(lines.dropDuplicates(["doc", "no"]))
    pairs = _candidates_one(lines) if max_edits == 1 else _candidates_two(lines, min_chars)
    text_a = lines.select(F.struct("doc", "no").alias("a"), F.col("line").alias("line_a"))
    text_b = lines.select(F.struct("doc", "no").alias("b"), F.col("line").alias("line_b"))
    both = pairs.where("a > b").distinct().join(text_a, "a").join(text_b, "b").select("a.doc", "a.no", "line_a", "line_b")
    return both.mapInArrow(_close(max_edits, min_chars), "doc long, no int").distinct()


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = 20
) -> DataFrame:
    """df with its texts reduced to the lines that stay, and n_lines and n_kept, the lines before and after.

    max_edits is 0 (exact repeats only), 1 or 2.
    """
    if max_edits not in (0, 1, 2):
        raise ValueError("max_edits is 0, 1 or 2")
    names = df.columns
    rows = df.toDF(*[f"c{k}" for k in range(len(names))])  # names of their own, so that none clashes
    own_id, own_text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    own_id = own_id.try_cast("bigint")
    docs = rows.where(own_id.isNotNull()).select(own_id.alias("_id"), own_text.alias("_text"))
    line = F.col("line")
    parts = F.when(F.length(line) >= min_chars, _parts(line, max_edits)) if max_edits else F.lit(None)
    lines = (
        docs.select("_id", F.posexplode(F.split("_text", "\n")).alias("no", "line"))
        .where(line.rlike(r"\S"))
        .select(
            F.unhex(F.md5(line)).alias("k"),
            F.struct(F.col("_id").alias("doc"), "no").alias("at"),
            parts.cast("array<bigint>").alias("parts"),
        )
    )
    heads = lines.groupBy("k").agg(F.min("at").alias("at"), F.any_value("parts").alias("parts"))
    heads = stored(heads.select("k", "at.doc", "at.no", "parts"), "lines")
    stay = heads.select("doc", "no")
    if max_edits:
        gone = near_lines(docs, heads, max_edits, min_chars)
        stay = stay.join(gone, ["doc", "no"], "left_anti")
    stay = stay.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("no").alias("_stay"))
    joined = rows.join(stay, own_id == F.col("_doc"), "left").withColumn("_lines", F.split(own_text, "\n"))
    blank = F.filter(
        F.transform("_lines", lambda x, i: F.when(~x.rlike(r"\S"), i).cast("int")), lambda i: i.isNotNull()
    )
    every = F.array_sort(F.array_union(F.coalesce("_stay", F.array().cast("array<int>")), blank))
    inside = F.filter(every, lambda i: i < F.size("_lines"))
    joined = joined.withColumn("_every", F.when(own_id.isNotNull(), inside))
    text = F.when(
        F.col("_every").isNotNull(), F.array_join(F.transform("_every", lambda i: F.get("_lines", i)), "\n")
    ).otherwise(own_text)
    total = F.when(own_text.isNull(), 0).otherwise(F.size("_lines"))
    kept = F.when(own_id.isNull() | own_text.isNull(), total).otherwise(F.size("_every"))
    n_lines, n_kept = (free_name(n, names) for n in ("n_lines", "n_kept"))
    return joined.select(
        *[(text if c == text_col else F.col(f"c{k}")).alias(c) for k, c in enumerate(names)],
        total.alias(n_lines),
        kept.alias(n_kept),
    )
