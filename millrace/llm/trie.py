"""The prefix trie of conversations, from a sorted array: each node is an interval of conversations that begin alike.

Conversations are sorted by their sequences of turn codes (an MD5 of role and text) over range partitions. Between two
neighbours stands the length of the prefix that they share (LCP). The branching nodes are the nodes of the Cartesian tree of
that array, nodes of equal LCP in one interval merged: an interval reaches from the nearest smaller value on the left to the
nearest on the right. Each partition finds them with a stack. What an earlier partition has left open is known from the
minima and the open nodes of the partitions, one short row each, which are carried from partition to partition before; a
node that spans partitions is put together from one partial row of each. The nodes between (a turn deeper than its parent,
of the same conversations) come from the turns themselves, below the shared prefix of the conversation that begins the
interval. What is summed over a subtree is a difference of prefix sums over the array.

No conversation is gathered whole: its first BLOCK turns are its sort key, and twice as many more again and again only for
conversations that agree so far. The places of turns in a conversation come from range partitions, so that one conversation
may hold most rows. The ids of equal conversations are hashed as a stream of pieces of PIECE ids.

Defined results: turns are in the order of turn (null first), then role, then text; null role and text are empty; rows
without a conversation id belong to none and are left out; repeated rows are turns of their own; ids are integers; very long
texts are only hashed and counted; an empty table has no nodes; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_slices, with_partition_position
from .mixing import word_count

#: Turns in the first sort key, characters of a turn's code, ids hashed at a time, positions of a block of prefix sums.
BLOCK, CODE, PIECE, SPAN = 64, 32, 4096, 1 << 14
NO_IDS = hashlib.sha256(b"").hexdigest()


def head_turns(conv: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its twenty."""
    return (F.crc32(conv.cast("string").cast("binary")) % 4).cast("bigint")


def rebuilt_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 20) -> tuple[DataFrame, DataFrame]:
    """(conv, d, code, words) of every rebuilt turn, d from 1, and (conv, m) of every rebuilt conversation."""
    rows = df.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
    )
    rows = with_partition_position(rows, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    code = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    placed = cut(rows.select("conv", "pid", "pos", code.alias("code"), word_count(F.col("text")).alias("words")))
    upto = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("conv", "pid").agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first"))
    parts = cut(parts.withColumn("shift", F.coalesce(F.sum("rows").over(upto), F.lit(0)) - F.col("first")))
    convs = cut(parts.groupBy("conv").agg(F.sum("rows").alias("n")))
    heads_of = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = convs.select("conv", "n", (F.col("conv") - F.col("conv") % group).alias("base"), head_turns(F.col("conv")).alias("h"))
    convs = convs.join(heads_of, "base", "left").withColumn("have", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = cut(convs.select("conv", "base", "h", "have", (F.col("have") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("m")))
    turns = placed.join(parts.join(convs, "conv").select("conv", "pid", "shift", "h", "have"), ["conv", "pid"])
    turns = cut(turns.select("conv", (F.col("pos") + F.col("shift")).alias("at"), "h", "have", "code", "words"))
    own = turns.where("at >= h").select("conv", (F.col("at") + 1 - F.col("h") + F.col("have")).alias("d"), "code", "words")
    heads = turns.where((F.col("conv") % group == 0) & (F.col("at") < 3)).select(F.col("conv").alias("base"), "at", "code", "words")
    taken = convs.where("have > 0").select("conv", "base", "have").join(heads, "base").where("at < have")
    return cut(own.unionByName(taken.select("conv", (F.col("at") + 1).alias("d"), "code", "words"))), convs.select("conv", "m")


def _key(turns: DataFrame) -> DataFrame:
    codes = F.sort_array(F.collect_list(F.struct("d", "code")))
    return turns.groupBy("conv").agg(F.array_join(F.transform(codes, lambda x: x["code"]), "").alias("key"))


def sort_keys(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, m, keys): codes of the first turns, in blocks that double, as far as another conversation has the same."""
    keyed = convs.join(_key(turns.where(F.col("d") <= BLOCK)), "conv", "left")
    keyed = cut(keyed.select("conv", "m", F.array(F.coalesce("key", F.lit(""))).alias("keys")))
    reach, size = BLOCK, 2 * BLOCK
    while True:
        agree = keyed.where(F.col("m") > reach).groupBy("keys").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("keys")
        agree = cut(agree)
        if agree.isEmpty():
            return keyed
        some = keyed.where(F.col("m") > reach).join(agree, "keys").select("conv")
        more = _key(turns.where((F.col("d") > reach) & (F.col("d") <= reach + size)).join(some, "conv"))
        longer = F.when(F.col("key").isNull(), F.col("keys")).otherwise(F.concat("keys", F.array("key")))
        keyed = cut(keyed.join(more, "conv", "left").select("conv", "m", longer.alias("keys")))
        reach, size = reach + size, 2 * size


def shared(a: str, b: str) -> int:
    """How many codes two keys begin with alike."""
    most = min(len(a), len(b)) // CODE
    if a[: most * CODE] == b[: most * CODE]:
        return most
    low, high = 0, most  # the first `low` are alike, the first `high` are not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * CODE : middle * CODE] == b[low * CODE : middle * CODE]:
            low = middle
        else:
            high = middle
    return low


_SUMMARY = "first_key string, last_key string, rows bigint, first_m bigint, least bigint, depths array<bigint>, places array<bigint>"


def _lcp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, m, keys, pid, pos) of one partition to (conv, m, pid, pos, lcp) with the partition's summary on its
    last row: the least LCP inside it, and the nodes deeper than that which are open at its end."""
    schema = pa.schema(
        [*((c, pa.int64()) for c in ("conv", "m", "pid", "pos", "lcp")), ("first_key", pa.string()), ("last_key", pa.string())]
        + [(c, pa.int64()) for c in ("rows", "first_m", "least")] + [("depths", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))]
    )
    nothing = (None,) * 7
    last = first_key = first_m = key = least = None
    rows, open_nodes = 0, []
    for batch in row_slices(batches, 2048):
        out = []
        for conv, m, keys, pid, pos in zip(*(c.to_pylist() for c in batch.columns)):
            new = "".join(keys)
            if last is None:
                lcp, first_key, first_m = None, new, m
            else:
                out.append((*last, *nothing))
                lcp = shared(key, new)
                least = lcp if least is None else min(least, lcp)
                place = None
                while open_nodes and open_nodes[-1][0] > lcp:
                    place = open_nodes.pop()[1]
                if lcp > least and (not open_nodes or open_nodes[-1][0] < lcp):
                    open_nodes.append((lcp, place))
                if lcp == least:
                    open_nodes.clear()
                if m > lcp:
                    open_nodes.append((m, pos))
            last, key, rows = (conv, m, pid, pos, lcp), new, rows + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if last is not None:
        end = (*last, first_key, key, rows, first_m, least, [d for d, _ in open_nodes], [p for _, p in open_nodes])
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(end, schema)], schema=schema)


def _meet(stack: list[tuple[int, int]], depth: int) -> None:
    """An LCP of `depth` closes the open (depth, left end) that are deeper, and is open itself."""
    left = None
    while stack and stack[-1][0] > depth:
        left = stack.pop()[1]
    if not stack or stack[-1][0] < depth:
        stack.append((depth, left))


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries in the order of partitions to what each partition starts with: its first place, the LCP of its first row,
    and the nodes open before it."""
    stack, start, before = [(-1, 0)], 0, None
    for batch in batches:
        out = []
        for s in batch.to_pylist():
            lcp = -1 if before is None else shared(before, s["first_key"])
            out.append((s["pid"], start, lcp, [d for d, _ in stack], [p for _, p in stack]))
            _meet(stack, lcp)
            if s["first_m"] > lcp:
                stack.append((s["first_m"], start))
            if s["least"] is not None:
                _meet(stack, s["least"])
                stack.extend((d, start + p) for d, p in zip(s["depths"], s["places"]))
            start, before = start + s["rows"], s["last_key"]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["pid", "start", "lcp", "depths", "places"])


_FOUND = ("node", "at", "depth", "far", "conv", "a", "b")


def _intervals(rows: pa.Table, carried: pa.Table) -> pa.Table:
    """The nodes of one partition, and its places.

    node 1: left end, depth, right end (null if still open), smallest conv, LCPs equal to depth, conversations that end
    there; partial where a node spans partitions. node 0: place, LCP, left end of the node of that depth, conv, turns, 0.
    """
    head = carried.to_pylist()[0]
    rows = rows.sort_by("pos").select(["conv", "m", "lcp"]).to_pydict()
    stack = [[d, p, None, 0, 0] for d, p in zip(head["depths"], head["places"])]  # depth, left, smallest conv, LCPs, ends
    out: list[tuple] = []

    def least(a, b):
        return b if a is None else a if b is None else min(a, b)

    def close(far):
        depth, left, conv, equal, ends = stack.pop()
        out.append((1, left, depth, far, conv, equal, ends))
        return left, conv

    for k, (conv, m, lcp) in enumerate(zip(rows["conv"], rows["m"], rows["lcp"])):
        at, lcp = head["start"] + k, head["lcp"] if k == 0 else lcp
        left, seen = None, None
        while stack[-1][0] > lcp:
            stack[-1][2] = least(stack[-1][2], seen)
            left, seen = close(at)
        if stack[-1][0] < lcp:
            stack.append([lcp, left, None, 0, 0])
        stack[-1][2] = least(stack[-1][2], seen)
        stack[-1][3] += 1
        up = stack[-1][1]
        if m > lcp:
            stack.append([m, at, None, 0, 0])
        stack[-1][2] = least(stack[-1][2], conv)
        stack[-1][4] += 1
        out.append((0, at, lcp, up, conv, m, 0))
    seen = None
    while stack:
        stack[-1][2] = seen = least(stack[-1][2], seen)
        if seen is None:
            stack.pop()
        else:
            close(None)
    return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], names=list(_FOUND))


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, block, ids) in order to (run, ends): the SHA-256 of all ids of a run, joined by commas."""
    run, state = None, None
    for batch in row_slices(batches):
        out = []
        for new, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if new != run:
                if run is not None:
                    out.append((run, state.hexdigest()))
                run, state = new, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["run", "ends"])
    if run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([state.hexdigest()])], ["run", "ends"])


def _sums_before(df: DataFrame, *names: str) -> DataFrame:
    """(place, names) with each name summed over all smaller places: within blocks of places, and over the blocks before."""
    blocks = df.withColumn("span", F.floor(F.col("place") / SPAN))
    inside = Window.partitionBy("span").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("span").agg(*[F.sum(n).alias(f"all_{n}") for n in names])
    totals = totals.select("span", *[F.coalesce(F.sum(f"all_{n}").over(upto), F.lit(0)).alias(f"all_{n}") for n in names])
    found = blocks.select("span", "place", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(n) for n in names]).join(totals, "span")
    return found.select("place", *[(F.col(n) + F.col(f"all_{n}")).alias(n) for n in names])


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 20) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt_turns(df, conv_col, turn_col, role_col, text_col, group)
    ordered = with_partition_position(sort_keys(turns, convs), F.col("keys"), F.col("m"), F.col("conv")).select("conv", "m", "keys", "pid", "pos")
    ordered = cut(ordered.mapInArrow(_lcp, f"conv bigint, m bigint, pid bigint, pos bigint, lcp bigint, {_SUMMARY}"))
    summaries = ordered.where("rows IS NOT NULL").select("pid", *[c.split()[0] for c in _SUMMARY.split(", ")])
    carried = summaries.coalesce(1).sortWithinPartitions("pid").mapInArrow(
        _carry, "pid bigint, start bigint, lcp bigint, depths array<bigint>, places array<bigint>"
    )
    carried = cut(carried.withColumnRenamed("pid", "of"))
    found = ordered.select("conv", "m", "pid", "pos", "lcp").groupBy("pid").cogroup(carried.groupBy("of")).applyInArrow(
        _intervals, ", ".join(f"{c} bigint" for c in _FOUND)
    )
    found = cut(found)
    places = found.where("node = 0").select(F.col("at").alias("place"), F.col("depth").alias("lcp"), F.col("far").alias("up"), "conv", F.col("a").alias("m"))
    rows = places.count()
    nodes = found.where("node = 1 AND depth >= 0").groupBy("at", "depth").agg(
        F.coalesce(F.max("far"), F.lit(rows)).alias("far"), F.min("conv").alias("conv"), (F.sum("a") + 1 - F.sum("b")).alias("children")
    )
    nodes = cut(nodes)
    by_left = nodes.groupBy(F.col("at").alias("place")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "far", "conv", "children"))).alias("nodes"), F.max(F.when(F.col("children") == 0, 1).otherwise(0)).alias("leaf")
    )
    lines = places.where("m > lcp").join(by_left, "place")
    above = nodes.select(F.col("at").alias("up"), F.col("depth").alias("lcp"), F.col("conv").alias("up_conv"))
    lines = cut(lines.join(above, ["up", "lcp"], "left"))

    def reaches(depth: Column) -> Column:
        return F.filter("nodes", lambda n: n["depth"] >= depth)[0]

    deeper = turns.select("conv", "d", "words").join(lines, "conv").where("d > lcp")
    root = lines.where("place = 0").select("conv", F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("words"), *[c for c in lines.columns if c != "conv"])
    each = deeper.unionByName(root).withColumns({"own": reaches(F.col("d")), "over": reaches(F.col("d") - 1)})
    each = each.select(
        "place",
        "d",
        F.col("own.depth").alias("depth"),
        F.col("own.conv").alias("conv"),
        F.when(F.col("d") > 0, F.when(F.col("d") - 1 > F.col("lcp"), F.col("over.conv")).otherwise(F.col("up_conv"))).alias("parent"),
        (F.col("own.far") - F.col("place")).alias("n"),
        F.when(F.col("d") == F.col("own.depth"), F.col("own.children")).otherwise(F.lit(1)).cast("bigint").alias("children"),
        ((F.col("own.far") - F.col("place") - 1) * F.col("words")).alias("saved"),
        (F.col("d") == F.col("m")).alias("ends_here"),
    )
    each = cut(each)
    shared_by = each.where("n > 1")
    down = Window.partitionBy("place").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = shared_by.withColumn("below", F.sum("saved").over(down)).unionByName(each.where("n = 1").withColumn("below", F.lit(0).cast("bigint")))
    saved = shared_by.groupBy("place").agg(F.sum("saved").alias("saved"))
    sums = places.select("place").join(saved, "place", "left").join(by_left.select("place", "leaf"), "place", "left").fillna(0)
    end = df.sparkSession.range(rows, rows + 1).select(F.col("id").alias("place"), F.lit(0).cast("bigint").alias("saved"), F.lit(0).alias("leaf"))
    own = cut(sums.unionByName(end))
    before = cut(_sums_before(own, "saved", "leaf"))
    at_left = before.join(own.select("place", F.col("saved").alias("own_saved")), "place").select(F.col("place").alias("at"), (F.col("saved") + F.col("own_saved")).alias("saved_to"), F.col("leaf").alias("leaf_to"))
    spans = nodes.select("at", "depth", "far").join(before.withColumnRenamed("place", "far"), "far").join(at_left, "at")
    spans = spans.select(F.col("at").alias("place"), "depth", (F.col("saved") - F.col("saved_to")).alias("beside"), (F.col("leaf") - F.col("leaf_to")).alias("leaves"))
    run = F.when(F.col("m") > F.col("lcp"), F.col("place")).otherwise(F.col("up"))
    ids = places.select(run.alias("run"), F.floor(F.col("place") / PIECE).alias("block"), "place", "conv").groupBy("run", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "conv"))), lambda x: x["conv"].cast("string")), ",").alias("ids")
    )
    ends = ids.repartition("run").sortWithinPartitions("run", "block").mapInArrow(_hash_ids, "run bigint, ends string")
    whole = chained.join(spans, ["place", "depth"]).join(ends.select(F.col("run").alias("place"), F.lit(True).alias("ends_here"), "ends"), ["place", "ends_here"], "left")
    return whole.select(
        F.col("conv").alias("conv_id"),
        F.col("d").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").cast("bigint").alias("n_leaves"),
        (F.col("below") + F.col("beside")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"),
    )


def trie_sql(group: int = 20) -> str:
    """DuckDB SQL for the rows of prefix_trie(conversations); the CRC-32 is spelt out."""
    bit = "xor(x >> 1, 3988292384 * (x & 1))"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {bit})"
    crc = f"xor(list_reduce([4294967295::BIGINT] || [ord(d)::BIGINT for d in string_split(conv_id::VARCHAR, '')], lambda c, b: {byte}), 4294967295)"
    return rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % {group} AS base, {crc} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), taken AS (
  SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.h
), rebuilt AS (
  SELECT conv_id, row_number() OVER w AS d, string_agg(md5(len(role) || ':' || role || text), '') OVER w AS key,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM taken WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
), prefixes AS (
  SELECT conv_id, d, key, words FROM rebuilt UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), lengths AS (
  SELECT conv_id, max(d) AS m FROM prefixes GROUP BY conv_id
), nodes AS (
  SELECT key, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = m), '')) AS ends_sha256
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY key
), counted AS (
  SELECT p.key, count(c.key) AS n_children FROM nodes p LEFT JOIN nodes c ON c.depth = p.depth + 1 AND c.key[:-33] = p.key GROUP BY p.key
), below AS (
  SELECT a.key, count(*) FILTER (n.n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM nodes a JOIN nodes b ON b.depth >= a.depth AND starts_with(b.key, a.key) JOIN counted n ON n.key = b.key GROUP BY a.key
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children,
  b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN counted c ON c.key = n.key JOIN below b ON b.key = n.key
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[:-33]
"""
