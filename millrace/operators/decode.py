"""Greedy and beam decoding over a step function, one row at a time inside Arrow batches.

A step function takes the source ids and the ids so far and returns a logit for each token; it is made once per task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .tokens import BOS, EOS

Step = Callable[[Sequence[int], Sequence[int]], list[float]]


def log_softmax(logits: Sequence[float]) -> list[float]:
    top = max(logits)
    total = top + math.log(sum(map(math.exp, [x - top for x in logits])))
    return [x - total for x in logits]


def best(values: Sequence[float], k: int) -> list[int]:
    """Places of the k largest values, earlier ones first where equal."""
    return sorted(range(len(values)), key=values.__getitem__, reverse=True)[:k]


def greedy(step: Step, source: Sequence[int], max_len: int) -> list[int]:
    out: list[int] = []
    while len(out) < max_len:
        logits = step(source, [BOS, *out])
        token = logits.index(max(logits))
        if token == EOS:
            break
        out.append(token)
    return out


def beam(step: Step, source: Sequence[int], max_len: int, width: int = 3, alpha: float = 0.6, over_all: bool = False) -> list[int]:
    """The sequence of the best score by length. Each beam offers its `width` best tokens, or with over_all the
    2 * width best of all beams are looked at. Sequences that end are set aside; the search stops when one of them has
    at least the score of every open one, since scores only fall."""
    if over_all and width <= 1:
        return greedy(step, source, max_len)
    open_: list[tuple[float, list[int]]] = [(0.0, [])]
    ended: list[tuple[float, list[int]]] = []
    for _ in range(max_len):
        offers = []
        for score, ids in open_:
            scores = log_softmax(step(source, [BOS, *ids]))
            offers += [(score + scores[t], ids, t) for t in best(scores, len(scores) if over_all else width)]
        offers.sort(key=lambda o: -o[0])
        fresh: list[tuple[float, list[int]]] = []
        for score, ids, token in offers[: 2 * width] if over_all else offers:
            if token == EOS:
                ended.append((score, ids))
            elif len(fresh) < width:
                fresh.append((score, [*ids, token]))
        if not fresh:
            open_ = [] if not over_all else open_
            break
        open_ = fresh
        if ended and max(s for s, _ in ended) >= max(s for s, _ in open_):
            break

    def by_length(item: tuple[float, list[int]]) -> float:
        score, ids = item
        return score if over_all and not ids else score / max(len(ids), 1) ** alpha

    every = ended + open_
    return max(every, key=by_length)[1] if every else []


#: Sources whose results a task remembers, and the ids of the longest of them.
REMEMBERED, LONGEST = 100_000, 64


def decode(df: DataFrame, make_step: Callable[[], Step], max_len: int, width: int = 1, alpha: float = 0.6, over_all: bool = False, column: str = "src_ids") -> DataFrame:
    """df with `decoded`, array<int>; at most min(max_len, 2 * source) tokens; null for a null source.

    A result depends on the source alone, so that a task searches once for sources that are equal.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", decoded array<int>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, known = make_step(), {}

        def found(ids: list[int]) -> list[int]:
            most = min(max_len, 2 * len(ids))
            return greedy(step, ids, most) if width <= 1 else beam(step, ids, most, width, alpha, over_all)

        def remembered(key: bytes) -> list[int]:
            out = known.get(key)
            if out is None:
                out = found(np.frombuffer(key, np.int64).tolist())
                if len(key) <= 8 * LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = out
            return out

        for batch in it:
            sources = batch.column(batch.schema.get_field_index(column))
            ids = sources.flatten().cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(sources), 0).to_numpy(zero_copy_only=False).astype(np.int64) * 8).tolist()
            results = [remembered(ids[a:b]) for a, b in zip([0, *ends], ends)]
            mask = sources.is_null().to_numpy(zero_copy_only=False)
            sizes = np.where(mask, 0, np.fromiter(map(len, results), np.int64, len(results)))
            flat = np.fromiter((k for r, gone in zip(results, mask.tolist()) if not gone for k in r), np.int32, int(sizes.sum()))
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            decoded = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array(mask))
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, schema)


def copy_step(vocab: int) -> Callable[[], Step]:
    """A step function that copies its source: for tests and for measuring the search itself."""

    def make() -> Step:
        far = [1.0 / (1 + d) for d in range(vocab + 1)]

        def step(source: Sequence[int], ids: Sequence[int]) -> list[float]:
            at = len(ids) - 1
            wanted = source[at] if at < len(source) else EOS
            logits = far[wanted:0:-1] + far[: vocab - wanted]
            logits[wanted] = 4.0
            return logits

        return step

    return make
