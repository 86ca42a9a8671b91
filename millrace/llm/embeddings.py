"""Embedding near-dedup with spherical-cap filters from structured random product codes.

The filters are caps around directions of a product code: the space is cut into blocks, each block has a codebook of
random unit vectors, and a direction is one codeword of each block. Of the many directions the list decoder finds those
that exceed a vector's threshold without going through all of them: sorted by score, the best sums of two lists are among
the pairs of places (i, j) with i * j <= t, and blocks are joined one after another. The threshold is the vector's own,
the score of its t-th best direction, so that every vector has t filters wherever the code is thin. There are several
such tables, each with a random rotation and codebooks of its own.

Vectors meet over filters. To compare each pair once, the vectors are dealt into cells by their best filter, and the join
on filters is one of cells: two cells are compared if their vectors share at least `shared` filters. Comparing is blocked:
a cell is split into blocks of about BLOCK vectors, the smaller of two cells travels to the blocks of the larger one, and
a task multiplies what arrives with its block in double precision. What leaves a task are link counts per vector and a
spanning forest of its links, never pairs; exact copies are one entry with a weight.

Recall: under a random rotation every pair of some cosine is as likely to share filters as any other, whatever the data, and
tables are independent. So what one table shares of random pairs at the bound gives the chance that a pair shares fewer
than `shared` over all tables. `plan` simulates it for the dimension and codebook at hand and takes as many tables as
bring it to MISS; where more than TABLES were needed, codebooks are halved, so that cells grow instead. The codebook of
one word compares all pairs, so that there is always such a plan. The chance is an estimate from PAIRS pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do
vectors of different lengths and rows with a null id (whose component is null and which are kept); rows that share an id
are of one document, and each carries the links of all their different vectors; an empty table gives an empty table. Ids
are read as longs, one that is no number as null; only the two columns named are read, so that others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components, spanning_edges

FILTERS, SHARED, BLOCK = 48, 3, 1024
#: Filters of a table, and the most tables; FILTERS is the least number over all tables.
OF_TABLE, TABLES = 8, 16
#: The chance at most that a pair at the bound is not compared, and the pairs that it is estimated from.
MISS, PAIRS = 1e-6, 2000
#: Vectors per filter that the size of the codebooks aims at, and its bounds.
OCCUPANCY, CODEBOOK = 2, (64, 65536)


def codebooks(dims: int, size: int, blocks: int = 2, seed: int = 5) -> list[np.ndarray]:
    """Random unit vectors of each block, one row each."""
    rng = np.random.default_rng([seed, dims, size])
    parts = np.array_split(np.arange(dims), min(blocks, dims))
    books = [rng.normal(size=(size, len(p))) for p in parts]
    return [b / np.linalg.norm(b, axis=1, keepdims=True) for b in books]


def _best(scores: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """The t largest of each row, descending, and their places."""
    t = min(t, scores.shape[1])
    at = np.argpartition(-scores, t - 1, axis=1)[:, :t]
    held = np.take_along_axis(scores, at, axis=1)
    order = np.argsort(-held, axis=1, kind="stable")
    return np.take_along_axis(held, order, axis=1), np.take_along_axis(at, order, axis=1)


def list_decode(x: np.ndarray, books: list[np.ndarray], t: int) -> np.ndarray:
    """Numbers of the t best product directions of each unit vector, best first."""
    ends = np.cumsum([b.shape[1] for b in books])
    parts = np.split(x, ends[:-1], axis=1)
    score, code = _best(parts[0] @ books[0].T, t)
    for part, book in zip(parts[1:], books[1:]):
        new, at = _best(part @ book.T, t)
        i, j = np.nonzero((np.arange(1, score.shape[1] + 1)[:, None] * np.arange(1, new.shape[1] + 1)) <= t)
        score, chosen = _best(score[:, i] + new[:, j], t)
        code = np.take_along_axis(code[:, i] * len(book) + at[:, j], chosen, axis=1)
    return code


def rotation(dims: int, table: int) -> np.ndarray:
    """A random orthogonal matrix, the table's own."""
    q, upper = np.linalg.qr(np.random.default_rng([7, dims, table]).normal(size=(dims, dims)))
    return q * np.where(np.diag(upper) < 0, -1.0, 1.0)


def tables(dims: int, codebook: int, count: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    return [(rotation(dims, k), codebooks(dims, codebook, seed=5 + k)) for k in range(count)]


def filters_of(x: np.ndarray, own: list[tuple[np.ndarray, list[np.ndarray]]]) -> np.ndarray:
    """Filters of each unit vector over all tables, told apart by the table, best of the first table first."""
    return np.concatenate([list_decode(x @ turn, books, OF_TABLE) | (k << 40) for k, (turn, books) in enumerate(own)], axis=1)


def pairs_at(least: float, dims: int, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors at cosine `least`."""
    x, z = np.random.default_rng([seed, dims]).normal(size=(2, count, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dims == 1:
        return x, x
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, least * x + np.sqrt(max(0.0, 1 - least * least)) * z


def shared_filters(x: np.ndarray, y: np.ndarray, own: list[tuple[np.ndarray, list[np.ndarray]]]) -> np.ndarray:
    """How many filters each pair shares."""
    step = max(1, 4_000_000 // max(len(b) for _, books in own for b in books))
    found = []
    for first in range(0, len(x), step):
        a, b = (filters_of(v[first : first + step], own) for v in (x, y))
        found += [len(np.intersect1d(p, q)) for p, q in zip(a, b)]
    return np.array(found)


def plan(dims: int, count: int, least: float, filters: int = FILTERS, shared: int = SHARED) -> tuple[int, int]:
    """Codebook size and number of tables for `count` vectors of a length, such that a pair at cosine `least` shares
    `shared` filters but for a chance of MISS."""
    codebook = int(np.clip(np.sqrt(OF_TABLE * count / OCCUPANCY), *CODEBOOK))
    fewest, most = -(-filters // OF_TABLE), max(TABLES, shared)
    x, y = pairs_at(min(1.0, max(-1.0, least)), dims, PAIRS)
    while codebook > 1:
        got = shared_filters(x, y, tables(dims, codebook, 1))
        one = np.bincount(np.minimum(got, shared), minlength=shared + 1)[:shared] / PAIRS
        low = np.ones(1)
        for n in range(1, most + 1):
            low = np.convolve(low, one)[:shared]
            if n >= fewest and low.sum() <= MISS:
                return codebook, n
        codebook //= 2
    return 1, max(fewest, shared)


def unit_rows(raw: list[bytes]) -> np.ndarray:
    """Vectors packed as doubles, scaled to length 1."""
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(raw: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.array([len(r) for r in raw])
    for size in np.unique(sizes).tolist():
        yield size // 8, np.flatnonzero(sizes == size)


def with_filters(vectors: DataFrame, plans: dict[int, tuple[int, int]]) -> DataFrame:
    """(rep, weight, raw) with filters, array of longs, best of the first table first; plans has codebook and tables by
    length."""

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, list[tuple[np.ndarray, list[np.ndarray]]]] = {}
        for batch in it:
            raw = batch.column(2).to_pylist()
            for dims, rows in _by_length(raw):
                if dims not in made:
                    made[dims] = tables(dims, *plans[dims])
                step = max(1, 4_000_000 // plans[dims][0])
                for first in range(0, len(rows), step):
                    some = rows[first : first + step]
                    codes = filters_of(unit_rows([raw[k] for k in some]), made[dims]) | (dims << 48)
                    offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32())
                    filters = pa.ListArray.from_arrays(offsets, pa.array(codes.ravel(), pa.int64()))
                    kept = batch.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([*kept.columns, filters], names=["rep", "weight", "raw", "filters"])

    return vectors.select("rep", "weight", "raw").mapInArrow(decode, "rep long, weight long, raw binary, filters array<long>")


class _Block:
    """The vectors of one block, link counts and links found so far."""

    def __init__(self, least: float) -> None:
        self.least, self.parts, self.x = least, [], None
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def ready(self) -> None:
        if self.x is None:
            self.rep, self.weight = (np.concatenate([p[k] for p in self.parts]) if self.parts else np.empty(0, np.int64) for k in (0, 1))
            raw = [r for p in self.parts for r in p[2]]
            self.x = unit_rows(raw) if raw else np.empty((0, 0))
            self.count = np.zeros(len(self.rep), dtype=np.int64)

    def found(self, a: np.ndarray, b: np.ndarray) -> None:
        self.links.append(spanning_edges(a, b))
        if sum(len(x) for x, _ in self.links) > 500_000:
            self.links = [spanning_edges(*map(np.concatenate, zip(*self.links)))]

    def guests(self, rep: np.ndarray, weight: np.ndarray, raw: list[bytes]) -> pa.RecordBatch | None:
        self.ready()
        if not len(self.rep):
            return None
        near = unit_rows(raw) @ self.x.T >= self.least
        count = near @ self.weight
        self.count += weight @ near
        g, h = np.nonzero(near)
        if len(g):
            self.found(rep[g], self.rep[h])
        linked = count > 0
        return _rows(rep[linked], count[linked]) if linked.any() else None

    def close(self) -> Iterator[pa.RecordBatch]:
        self.ready()
        for first in range(0, len(self.rep), BLOCK):
            near = self.x[first : first + BLOCK] @ self.x.T >= self.least
            near[np.arange(len(near)), np.arange(first, first + len(near))] = False
            self.count[first : first + BLOCK] += near @ self.weight
            a, b = np.nonzero(near)
            if len(a):
                self.found(self.rep[a + first], self.rep[b])
        linked = self.count > 0
        if linked.any():
            yield _rows(self.rep[linked], self.count[linked])
        if self.links:
            a, b = spanning_edges(*map(np.concatenate, zip(*self.links)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64))], names=["a", "b", "n"])


def _rows(rep: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rep), pa.nulls(len(rep), pa.int64()), pa.array(count)], names=["a", "b", "n"])


def _compare(least: float):
    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in it:
            cell, chunk, host, rep, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            raw = batch.column(5)
            moved = (np.diff(cell) != 0) | (np.diff(chunk) != 0) | (np.diff(host.astype(np.int8)) != 0)
            cuts = [0, *(np.flatnonzero(moved) + 1).tolist(), len(cell)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if (cell[s], chunk[s]) != at:
                    if block:
                        yield from block.close()
                    at, block = (cell[s], chunk[s]), _Block(least)
                if host[s]:
                    block.parts.append((rep[s:e].copy(), weight[s:e].copy(), raw[s:e].to_pylist()))
                    continue
                for first in range(s, e, BLOCK):
                    some = slice(first, min(first + BLOCK, e))
                    out = block.guests(rep[some], weight[some], raw[some.start : some.stop].to_pylist())
                    if out is not None:
                        yield out
        if block:
            yield from block.close()

    return compare


def link_vectors(vectors: DataFrame, least: float, filters: int = FILTERS, shared: int = SHARED) -> DataFrame:
    """Distinct (rep, weight, raw) to rows (a, b, n): with b a link of the spanning forests, without b a count for a."""
    lengths = vectors.groupBy((F.octet_length("raw") / 8).cast("int").alias("dims")).count().collect()
    plans = {r["dims"]: plan(r["dims"], r["count"], least, filters, shared) if r["count"] > 1 else (1, 1) for r in lengths}
    decoded = cut(with_filters(vectors, plans).withColumn("cell", F.get("filters", F.lit(0))))
    cells = cut(decoded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks")))
    of = decoded.join(cells, "cell").select(
        "cell", F.pmod(F.xxhash64("rep"), "chunks").cast("int").alias("chunk"), "rep", "weight", "raw"
    )
    members = cut(of)
    seen = decoded.select("cell", F.explode("filters").alias("f")).distinct()
    a, b = (seen.select("f", F.col("cell").alias(name)) for name in ("c1", "c2"))
    met = a.join(b, "f").where("c1 < c2").groupBy("c1", "c2").count().where(F.col("count") >= shared)
    size = lambda c, n: cells.select(F.col("cell").alias(c), F.col("chunks").alias(n))
    met = met.join(size("c1", "k1"), "c1").join(size("c2", "k2"), "c2")
    first = F.col("k1") >= F.col("k2")
    ordered = met.select(
        F.when(first, F.col("c1")).otherwise(F.col("c2")).alias("host"),
        F.when(first, F.col("c2")).otherwise(F.col("c1")).alias("guest"),
        F.greatest("k1", "k2").alias("kh"),
        F.least("k1", "k2").alias("kg"),
    )
    apart = ordered.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("kh") - 1))).withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.col("kg") - 1))
    )
    own = cells.where("chunks > 1").select(F.col("cell").alias("host"), F.col("cell").alias("guest"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 2)).alias("h"), "chunks")
    own = own.withColumn("g", F.explode(F.sequence(F.col("h") + 1, F.col("chunks") - 1)))
    visits = apart.select("host", "h", "guest", "g").union(own.select("host", "h", "guest", "g"))
    guests = visits.join(members, (F.col("guest") == F.col("cell")) & (F.col("g") == F.col("chunk"))).select(
        F.col("host").alias("cell"), F.col("h").alias("chunk"), F.lit(False).alias("host"), "rep", "weight", "raw"
    )
    hosts = members.select("cell", "chunk", F.lit(True).alias("host"), "rep", "weight", "raw")
    together = hosts.union(guests).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", F.col("host").desc())
    return together.mapInArrow(_compare(least), "a long, b long, n long")


def near_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, filters: int = FILTERS, shared: int = SHARED) -> DataFrame:
    """One row (id, n_links, component, kept) per row of df: vectors linked directly at cosine >= least, the smallest id
    reachable over links, and whether that is the row's own."""

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw: list[bytes | None] = []
            for x in batch.column(1).to_pylist():
                v = np.array([np.nan if c is None else c for c in x or ()], dtype="<f8")
                fine = len(v) and np.isfinite(v).all() and v.any()
                raw.append((v + 0.0).tobytes() if fine else None)  # + 0.0: a negative zero is zero
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])

    rows = df.select(F.col(f"`{id_col}`").try_cast("bigint").alias("id"), F.col(f"`{vector_col}`").alias("v")).mapInArrow(packed, "id long, raw binary")
    usable = F.col("raw").isNotNull() & F.col("id").isNotNull()
    rows = cut(rows.withColumn("key", F.when(usable, F.unhex(F.sha2("raw", 256)))))
    vectors = cut(
        rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.any_value("raw").alias("raw"))
    )
    found = cut(link_vectors(vectors, least, filters, shared))
    classes = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("_n"))
    of = (
        vectors.select(F.col("key").alias("_key"), "rep", "weight")
        .join(counts, F.col("rep") == F.col("_a"), "left")
        .join(classes, F.col("rep") == F.col("node"), "left")
        .select("_key", (F.coalesce("_n", F.lit(0)) + F.col("weight") - 1).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    )
    joined = rows.select("id", "key").join(of, F.col("key") == F.col("_key"), "left")
    component = F.coalesce("_component", "id")
    return joined.select(
        "id",
        F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
