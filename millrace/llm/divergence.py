"""How far the sources of a language differ in their words: exact integer divergences over dense blocks of terms.

Tasks count the terms of whole texts by group (language and source) and give partial counts away when they hold too many,
so that neither a common term nor a large group meets in one place before it is summed. Terms in at least `min_docs`
documents of a language are kept. The kept terms of a language are dealt to blocks, and each block becomes a dense matrix,
groups by terms, of exact 64-bit integers: every pair of its rows is compared by broadcasting, a few rows at a time. The
pair matrices of the blocks are partial sums, added up by Spark; each block keeps the `top` best terms of each group, which
are merged in the same way.

A block has about CELLS cells, whatever the number of terms and groups is, and a language of many sources is cut into
bands of rows as well: a task holds a few times 8 * CELLS bytes.

Defined results: null text, lang and source are the empty string; a group without terms, or a language without kept terms,
has its pairs, of value 0 where no term is kept; equal values rank by the item in the order of UTF-8 bytes; repeated rows
are documents of their own; very long texts are counted in pieces; an empty table has no groups; other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, row_slices, small_side

#: Cells of a block's matrix, and of what broadcasting makes at a time.
CELLS = 1 << 19
#: Pairs of groups that one task compares.
PAIRS = 1 << 18
#: Distinct terms of groups that a task holds before it gives its counts away.
HELD = 300_000
#: Bytes of a text that are split at a time.
PIECE = 1 << 22
#: p counts in units of one in SCALE.
SCALE_STEPS, STEP = 3, 1000

_LETTER = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in lists of bounded size: runs of ASCII letters, lower-cased, and all beyond ASCII."""
    plain = text.translate(_LETTER)
    first = 0
    while first < len(plain):
        last = plain.find(b" ", first + PIECE)
        last = len(plain) if last < 0 else last
        yield plain[first:last].split()
        first = last


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, d): occurrences, and documents with the term. A group's empty term
    says that the group occurs."""
    groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

    def given() -> pa.RecordBatch:
        rows = [[], [], [], [], []]
        for (lang, source), (n, d) in groups.items():
            for column, values in zip(rows, ([lang] * (len(n) + 1), [source] * (len(n) + 1), [b"", *n], [0, *n.values()], [0, *map(d.__getitem__, n)])):
                column.extend(values)
        groups.clear()
        texts = [pa.array(c, pa.binary()).cast(pa.string()) for c in rows[:3]]
        return pa.RecordBatch.from_arrays([*texts, *(pa.array(c, pa.int64()) for c in rows[3:])], ["lang", "source", "term", "n", "d"])

    held = 0
    for batch in row_slices(batches):
        for key_lang, key_source, text in zip(*(c.cast(pa.binary()) for c in batch.columns)):
            n, d = groups.setdefault((key_lang.as_py() or b"", key_source.as_py() or b""), (Counter(), Counter()))
            held -= len(n)
            seen: set[bytes] = set()
            for terms in term_lists(text.as_py() or b""):
                n.update(terms)
                seen.update(terms)
            d.update(seen)
            held += len(n)
            if held > HELD:
                yield given()
                held = 0
    if groups:
        yield given()
    give_back()


def term_counts(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, d), one row per group and term; every group has a row of the empty term."""
    own = df.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = own.mapInArrow(_counts, "lang string, source string, term string, n bigint, d bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (total + 2 * terms)), exactly: three decimal digits at a time."""
    whole = np.asarray(total, np.int64) + 2 * terms
    if whole.max(initial=0) >= 1 << 53:
        raise ValueError("counts beyond 2**53 would overflow")
    left = counts + 2
    out = left // whole
    left -= out * whole
    for _ in range(SCALE_STEPS):
        left *= STEP
        digits = left // whole
        out = out * STEP + digits
        left -= digits * whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return apart * apart // (p + q)


def _compare(top: int):
    """One block of terms of a language, and one band of its groups, against all groups of the language."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def compare(key: tuple, block: pa.Table, head: pa.Table) -> pa.Table:
        lang, band = key[0].as_py(), key[2].as_py()
        h = head.to_pylist()[0]
        names = pa.array([g["source"] for g in h["sizes"]], pa.string())
        sizes = np.array([g["size"] for g in h["sizes"]], np.int64)
        block = block.combine_chunks().take(pc.sort_indices(block["term"]))
        terms, found = block["term"].combine_chunks(), block["counts"].combine_chunks()
        if isinstance(terms, pa.ChunkedArray):
            terms, found = pa.array([], pa.string()), pa.array([], block["counts"].type)
        counts = np.zeros((len(names), len(terms)), np.int64)
        if len(terms):
            flat = found.flatten()
            row = pc.index_in(flat.field("source"), value_set=names).to_numpy(zero_copy_only=False)
            counts[row, pc.list_parent_indices(found).to_numpy()] = flat.field("n").to_numpy()
        p = shares(counts.copy(), sizes[:, None], h["terms"])
        q = shares(counts.sum(axis=0), np.array([h["total"]]), h["terms"])
        first = band * h["rows"]
        last = min(first + h["rows"], len(names))
        at_once = max(1, CELLS // max(1, p.size))
        sums = np.zeros((last - first, len(names)), np.int64)
        for k in range(first, last, at_once):
            sums[k - first : min(k + at_once, last) - first] = divergence(p[k : min(k + at_once, last), None, :], p[None, :, :]).sum(axis=2)
        i, j = np.nonzero(np.arange(first, last)[:, None] != np.arange(len(names))[None, :])
        out = [[names.take(pa.array(i + first)), pa.array(["pair"] * len(i), pa.string()), names.take(pa.array(j)), pa.array(sums[i, j])]]
        for k in range(first, last):
            above = np.flatnonzero((counts[k] > 0) & (p[k] > q))
            value = divergence(p[k, above], q[above])
            best = np.argsort(-value, kind="stable")[:top]
            out.append([pa.array([names[k].as_py()] * len(best), pa.string()), pa.array(["term"] * len(best), pa.string()), terms.take(pa.array(above[best])), pa.array(value[best])])
        columns = [pa.chunked_array([o[c] for o in out]) for c in range(4)]
        rows = len(columns[0])
        return pa.table([pa.array([lang] * rows, pa.string()), *columns], schema=schema)

    return compare


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by divergence (part `pair`, all ranks),
    and the terms that the source has more of than its language (part `term`, ranks to `top`)."""
    counted = cut(term_counts(df, lang_col, source_col, text_col))
    kept = counted.where("term <> ''").groupBy("lang", "term").agg(
        F.sum("d").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts")
    )
    kept = cut(kept.where(F.col("docs") >= min_docs).select("lang", "term", "total", "counts"))
    one = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("size"))
    groups = counted.where("term = ''").select("lang", "source").join(one, ["lang", "source"], "left")
    groups = groups.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")))).alias("sizes"), F.count(F.lit(1)).alias("groups")
    )
    langs = groups.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("total")), "lang", "left")
    langs = langs.fillna(0, ["terms", "total"]).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("groups") / CELLS)))
    langs = langs.withColumn("rows", F.greatest(F.lit(1), F.floor(F.lit(PAIRS) / F.col("groups"))))
    langs = cut(langs.withColumn("bands", F.ceil(F.col("groups") / F.col("rows"))))
    every = F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band")
    heads = langs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", "block", every, "sizes", "terms", "total", "rows")
    dealt = kept.join(small_side(langs.select("lang", "blocks", "bands"), langs.count()), "lang")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).select("lang", "block", every, "term", "counts")
    by = ("lang", "block", "band")
    heads = heads.withColumnsRenamed({c: f"_{c}" for c in by})
    compared = dealt.groupBy(*by).cogroup(heads.groupBy(*[f"_{c}" for c in by])).applyInArrow(
        _compare(top), "lang string, source string, part string, item string, value bigint"
    )
    compared = cut(compared)
    pairs = compared.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    terms = compared.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms)


def audit_sql(min_docs: int = 10, top: int = 10) -> str:
    """DuckDB SQL for the rows of audit(documents)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), occurs AS (
  SELECT doc, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM occurs GROUP BY ALL HAVING count(DISTINCT doc) >= {min_docs}
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM occurs SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT lang, source, coalesce(sum(n), 0) AS n FROM groups LEFT JOIN counted USING (lang, source) GROUP BY ALL
), grid AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.n + 2 * l.v))::BIGINT AS p,
    (1 + 1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v))::BIGINT AS q
  FROM sizes s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counted c USING (lang, source, term)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM grid WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts
) WHERE part = 'pair' OR rank <= {top}
"""
