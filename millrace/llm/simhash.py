"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are sorted by their rank in the reflected Gray code, which puts fingerprints with few differing bits near
each other. Over the sorted list stands a tree: a node keeps the bits on which all fingerprints below it agree (a mask
and a pattern) without those that a node above holds already. A search goes down from the top, adds up the differing
bits of the patterns it passes and leaves a whole group once the sum exceeds the bound.

The tree is spread over the cluster: ranges of Gray ranks are its groups of leaves, each searched in one task, and the
upper nodes over the ranges form a directory of at most MAX_GROUPS entries, which every task gets. A fingerprint goes to
the groups that the directory cannot rule out, about 1 + b + b(b-1)/2 of them for groups that share b bits.

Exact copies are one entry of the index; links inside a group leave a task as a spanning forest, so no group of near
copies is expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, row_slices
from .components import connected_components, spanning_edges

#: Leaves of one group of the distributed index, the fewest groups (so that all cores search), and the most; the
#: directory has 16 bytes a group.
GROUP_SIZE, MIN_GROUPS, MAX_GROUPS = 4096, 64, 65536
FAN_OUT = 8
#: Text is taken in pieces of about so many bytes, so that one very long text needs little memory.
PIECE = 1 << 20

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_AT = np.arange(8) * 256


def _pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of data in order, in lists of bounded size."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            while end < len(data) and data[end] not in b" \t\n\v\f\r":
                end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the word shingles of text, as a signed integer.

    A-Z are lower-cased; words are runs without ASCII white space; shingles are `width` words joined by a space and count
    as often as they occur. Fewer words than that are one shingle; no words (null too) give 0.
    """
    counts, total, carry = np.zeros((8, 256), dtype=np.int64), 0, []
    for words in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carry + words
        if len(words) >= width:
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ends = np.cumsum(lengths + 1) - 1
            starts = (ends - lengths).tolist()
            digest = xxhash.xxh64_intdigest
            hashes = np.array(
                [digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist())], dtype="<u8"
            )
            cells = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_AT
            counts += np.bincount(cells.ravel(), minlength=2048).reshape(8, 256)
            total += len(hashes)
        carry = words[-(width - 1) :] if width > 1 else []
    if not total:
        if not carry:
            return 0
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(carry), seed)).astype(np.int64))
    bits = (counts @ _BYTE_BITS).ravel() * 2 > total
    return int(np.packbits(bits, bitorder="little").view("<u8")[0].astype(np.int64))


def with_fingerprint(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp) of every row of df."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(it, 4096):
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "fp"])

    return df.select(F.col(f"`{id_col}`").try_cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(batches, "id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Rank of a 64-bit code in the reflected Gray order, as a signed long that sorts like the unsigned rank."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


class GrayTree:
    """The hierarchical index over leaves in Gray order; a leaf is a fingerprint, or a group known by its AND and OR."""

    def __init__(self, every: np.ndarray, some: np.ndarray) -> None:
        """every, some: AND and OR of the fingerprints of each leaf (uint64), in Gray order."""
        levels = [(every, some)]
        while len(levels[-1][0]) > FAN_OUT:
            low, high = levels[-1]
            starts = np.arange(0, len(low), FAN_OUT)
            levels.append((np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)))
        self.levels = []
        above = None
        for low, high in reversed(levels):
            agreed = ~(low ^ high)
            own = agreed if above is None else agreed & ~np.repeat(above, FAN_OUT)[: len(low)]
            self.levels.append((low, own))
            above = agreed

    def search(self, queries: np.ndarray, radius: int, chunk: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, leaf) of places whose difference on the leaf's agreed bits is at most radius, chunk by chunk."""
        if not len(self.levels[0][0]):
            return
        for first in range(0, len(queries), chunk):
            some = queries[first : first + chunk]
            count = len(self.levels[0][0])
            query, node = np.repeat(np.arange(len(some)), count), np.tile(np.arange(count), len(some))
            apart = np.zeros(len(query), dtype=np.uint8)
            for depth, (pattern, own) in enumerate(self.levels):
                if depth:
                    query, apart = np.repeat(query, FAN_OUT), np.repeat(apart, FAN_OUT)
                    node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                    if len(node) and node.max() >= len(pattern):
                        inside = node < len(pattern)
                        query, apart, node = query[inside], apart[inside], node[inside]
                apart = apart + np.bitwise_count((some[query] ^ pattern[node]) & own[node])
                near = apart <= radius
                query, node, apart = query[near], node[near], apart[near]
            yield query + first, node


class _Group:
    """The members of one group and the links found so far."""

    def __init__(self, radius: int) -> None:
        self.radius, self.parts, self.tree = radius, [], None
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def index(self) -> None:
        if self.tree is None:
            prints = np.concatenate([p for p, _, _ in self.parts]) if self.parts else np.empty(0, np.uint64)
            reps = np.concatenate([r for _, r, _ in self.parts]) if self.parts else np.empty(0, np.int64)
            ranks = np.concatenate([k for _, _, k in self.parts]) if self.parts else np.empty(0, np.int64)
            order = np.argsort(ranks, kind="stable")
            self.prints, self.reps = prints[order], reps[order]
            self.tree = GrayTree(self.prints, self.prints)

    def found(self, a: np.ndarray, b: np.ndarray) -> None:
        self.links.append((a, b))
        if sum(len(x) for x, _ in self.links) > 1_000_000:
            self.links = [spanning_edges(*map(np.concatenate, zip(*self.links)))]

    def ask(self, prints: np.ndarray, reps: np.ndarray) -> None:
        self.index()
        for query, leaf in self.tree.search(prints, self.radius):
            self.found(reps[query], self.reps[leaf])

    def close(self) -> pa.RecordBatch:
        self.index()
        for query, leaf in self.tree.search(self.prints, self.radius):
            own = query < leaf
            self.found(self.reps[query[own]], self.reps[leaf[own]])
        a, b = spanning_edges(*map(np.concatenate, zip(*self.links))) if self.links else (self.reps[:0], self.reps[:0])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def link_fingerprints(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct (fp, rep) to links (a, b) between reps whose fingerprints differ in at most radius bits.

    The links are those of a spanning forest in each group: their components are those of all links.
    """
    spark = prints.sparkSession
    groups = min(MAX_GROUPS, max(MIN_GROUPS, -(-prints.count() // GROUP_SIZE)))
    ranked = prints.withColumn("rank", gray_rank(F.col("fp")))
    placed = cut(ranked.repartitionByRange(groups, "rank").withColumn("gid", F.spark_partition_id()))
    rows = sorted(
        placed.groupBy("gid").agg(F.min("rank"), F.bit_and("fp"), F.bit_or("fp")).collect(), key=lambda r: r[1]
    )  # at most MAX_GROUPS rows
    gids = np.array([r[0] for r in rows], dtype=np.int32)
    every, some = (np.array([r[k] for r in rows], dtype=np.int64).view(np.uint64) for k in (2, 3))
    directory = spark.sparkContext.broadcast((gids, every, some))

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gids, every, some = directory.value
        upper, place = GrayTree(every, some), np.zeros(int(gids.max(initial=0)) + 1, dtype=np.int64)
        place[gids] = np.arange(len(gids))
        for batch in it:
            fp, rep, rank, gid = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            own = place[gid]
            member = pa.array(np.ones(len(fp), dtype=bool))
            names = ["fp", "rep", "rank", "gid", "member"]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (fp, rep, rank, gid)), member], names=names)
            for query, leaf in upper.search(fp.view(np.uint64), radius):
                later = leaf > own[query]
                query, leaf = query[later], leaf[later]
                sent = [pa.array(x[query]) for x in (fp, rep, rank)]
                asks = pa.array(np.zeros(len(query), dtype=bool))
                yield pa.RecordBatch.from_arrays([*sent, pa.array(gids[leaf]), asks], names=names)

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, None
        for batch in it:
            fp, rep, rank, gid, member = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            key = gid.astype(np.int64) * 2 + ~member
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if gid[s] != at:
                    if group:
                        yield group.close()
                    at, group = gid[s], _Group(radius)
                if member[s]:
                    group.parts.append((fp[s:e].view(np.uint64).copy(), rep[s:e].copy(), rank[s:e].copy()))
                else:
                    group.ask(fp[s:e].view(np.uint64), rep[s:e])
        if group:
            yield group.close()

    routed = placed.select("fp", "rep", "rank", "gid").mapInArrow(
        route, "fp long, rep long, rank long, gid int, member boolean"
    )
    together = routed.repartition("gid").sortWithinPartitions("gid", F.col("member").desc())
    return together.mapInArrow(search, "a long, b long")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One row (id, fp, component) per row of df.

    fp is the fingerprint, component the smallest id reachable over fingerprints that differ in at most radius bits.
    Defined results: a null or blank text has fingerprint 0, which links like any other; rows with a null id get their
    fingerprint and a null component and link nothing; repeated rows each get their row; an empty table gives an empty
    table. Only the two columns named are read; ids are read as longs, one that is no number as null. A very long text is
    taken in pieces.
    """
    prints = cut(with_fingerprint(df, id_col, text_col))
    distinct = cut(prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")))
    classes = connected_components(link_fingerprints(distinct, radius))
    of = distinct.join(classes, distinct.rep == classes.node, "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("_component")
    )
    return prints.join(of, F.col("fp") == F.col("_fp"), "left").select(
        "id", "fp", F.when(F.col("id").isNotNull(), F.col("_component")).alias("component")
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """The rows of df that stand for their class, the smallest id each; rows with a null id stay. Columns may have any
    names."""
    classes = near_dedup(df, id_col, text_col, radius)
    name = free_name("gone", df.columns)
    gone = classes.where(F.col("component") != F.col("id")).select(F.col("id").alias(name)).distinct()
    return df.join(gone, F.col(f"`{id_col}`").try_cast("bigint") == F.col(name), "left_anti")
