"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of PASSAGE words. Each passage is encoded by the words and byte trigrams in it, hashed
into HASHED buckets each, and by its shares of byte classes, word lengths and repetition; a small network turns the
encoding into a representation, gated attention learns from document labels alone how much each passage weighs, and the
weighted sum of the representations is scored.

The network is fitted on the driver with a bounded sample of labelled documents (`sample` of them, of at most `longest`
passages each and `max_passages` together, so that the sample has a bounded size in bytes); everything else, scoring
above all, runs over all documents and whole texts. The fit is deterministic: the sample is the first by a hash of the
id, the optimiser's seed is fixed.

Defined results: null and blank texts are one passage of zeros; a very long text is one bag of many passages; repeated
rows are scored each, equal texts alike; a score of exactly 0.5 is predicted 1; an empty table gives an empty table.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, row_slices

PASSAGE = 64
#: Bytes of text that are encoded together; bounds a worker's memory.
SLICE = 1 << 19

_SIGNS = string.punctuation.encode()
#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 beyond ASCII, then each punctuation sign.
_CLASSES = 7 + len(_SIGNS)


def _class_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[97:123], table[65:91], table[48:58], table[32], table[10], table[128:] = 1, 2, 3, 4, 5, 6
    for k, sign in enumerate(_SIGNS):
        table[sign] = 7 + k
    return table


_CLASS = _class_table()
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Buckets of hashed words, and as many of hashed byte trigrams.
HASHED = 256
_DENSE = _CLASSES + 8
FEATURES = _DENSE + 2 * HASHED
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Random weights of the places in a word, which repeat beyond so many.
_PLACES = np.random.default_rng(23).integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return (h ^ (h >> np.uint64(32))) * _MIX


def _bucket_shares(bag: np.ndarray, hashes: np.ndarray, bags: int) -> np.ndarray:
    """Square roots of the shares of each bag's hashes in the buckets."""
    bucket = (hashes >> np.uint64(64 - HASHED.bit_length() + 1)).astype(np.int64)
    counts = np.bincount(bag * HASHED + bucket, minlength=bags * HASHED).reshape(bags, HASHED)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


def _word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words from starts to ends: all bytes by weights of their places, and the length."""
    lengths = ends - starts
    total = np.cumsum(lengths)
    place = np.arange(total[-1]) - np.repeat(total - lengths, lengths)
    sums = np.append(np.uint64(0), np.cumsum(low[np.repeat(starts, lengths) + place] * _PLACES[place % len(_PLACES)]))
    return _mixed(sums[total] - sums[total - lengths] + lengths.astype(np.uint64))


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passage encodings of the texts, in order, and the text of each; a text without words is one passage of zeros."""
    data = np.frombuffer(b"\n".join(texts) + b"\n" * 9, dtype=np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    lengths = (ends - starts).astype(np.float64)
    owner = np.searchsorted(begins, starts, side="right") - 1
    words_of = np.bincount(owner, minlength=len(texts))
    first_word = np.cumsum(words_of) - words_of
    at = np.arange(len(starts)) - first_word[owner]
    opens = np.flatnonzero(at % PASSAGE == 0)
    whole = np.zeros((int((words_of == 0).sum()) + len(opens), FEATURES))
    text_of = np.concatenate([owner[opens], np.flatnonzero(words_of == 0)])
    if len(opens):
        n = len(opens)
        passage = np.repeat(np.arange(n), np.diff(np.concatenate([opens, [len(starts)]])))
        count = np.bincount(passage, minlength=n).astype(np.float64)
        text_end = begins + np.array([len(t) for t in texts])
        last = np.concatenate([owner[opens][1:] != owner[opens][:-1], [True]])
        byte_from = np.where(at[opens] == 0, begins[owner[opens]], starts[opens])
        byte_to = np.where(last, text_end[owner[opens]], np.concatenate([starts[opens][1:], [0]]))
        runs = np.diff(np.concatenate([[0], np.column_stack([byte_from, byte_to]).ravel(), [len(data)]]))
        of_byte = np.repeat(np.append(np.column_stack([np.full(n, n), np.arange(n)]).ravel(), n), runs)
        classes = np.bincount(of_byte * _CLASSES + _CLASS[data], minlength=(n + 1) * _CLASSES)
        classes = classes.reshape(n + 1, _CLASSES)[:n]
        shares = classes / np.maximum(classes.sum(axis=1, keepdims=True), 1)
        low = _LOWER[data].astype(np.uint64) + np.uint64(1)
        word = _word_hashes(low, starts, ends)
        inside = passage[1:] == passage[:-1]
        same = np.concatenate([[False], (word[1:] == word[:-1]) & inside])
        keyed = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24)))
        new = np.concatenate([[True], keyed[1:] != keyed[:-1]])
        distinct = np.bincount((keyed[new] >> np.uint64(40)).astype(np.int64), minlength=n)
        inner = np.flatnonzero((of_byte[2:] < n) & (of_byte[2:] == of_byte[:-2]))
        three = (low[inner] << np.uint64(18)) | (low[inner + 1] << np.uint64(9)) | low[inner + 2]
        mean = np.bincount(passage, lengths, minlength=n) / count
        spread = np.sqrt(np.maximum(np.bincount(passage, lengths**2, minlength=n) / count - mean**2, 0))
        big = (data[starts] >= 65) & (data[starts] <= 90)
        shout = big & (data[starts + 1] >= 65) & (data[starts + 1] <= 90)
        sign = _CLASS[data[ends - 1]] >= 7
        whole[:n] = np.column_stack(
            [
                np.sqrt(shares),
                np.log1p(count),
                mean / 10,
                np.minimum(spread / 10, 5),
                distinct / count,
                np.bincount(passage, same, minlength=n) / count,
                np.bincount(passage, big, minlength=n) / count,
                np.bincount(passage, shout, minlength=n) / count,
                np.bincount(passage, sign, minlength=n) / count,
                _bucket_shares(passage, word, n),
                _bucket_shares(of_byte[inner], _mixed(three), n),
            ]
        )
    order = np.argsort(text_of, kind="stable")
    return whole[order], text_of[order]


def _slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about SLICE bytes with the place of the first."""
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= SLICE:
            yield first, texts[first : k + 1]
            first, held = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]


@dataclass
class AttentionModel:
    """Gated attention over passages: a = softmax(w (tanh(V h) * sigmoid(U h))), score = sigmoid(c sum(a h) + b)."""

    centre: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        w = self.weights
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        h = np.tanh(z @ w["encode"] + w["encode_b"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (t * g) @ w["attend"]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, e)
        a = np.exp(e - top[bag])
        a /= np.bincount(bag, a, minlength=bags)[bag]
        r = np.stack([np.bincount(bag, a * h[:, k], minlength=bags) for k in range(h.shape[1])], axis=1)
        p = 1 / (1 + np.exp(-np.clip(r @ w["score"] + w["score_b"], -40, 40)))
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "r": r, "p": p}

    def scores(self, x: np.ndarray, bag: np.ndarray, bags: int) -> np.ndarray:
        return self._forward(x, bag, bags)["p"]

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self._forward(x, bag, len(y))
        d = (f["p"] - y) / len(y)
        dr = d[:, None] * w["score"]
        da = (dr[bag] * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.bincount(bag, f["a"] * da, minlength=len(y))[bag])
        dt, dg = (de[:, None] * w["attend"]) * f["g"], (de[:, None] * w["attend"]) * f["t"]
        dv, du = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * dr[bag] + dv @ w["v"].T + du @ w["u"].T
        dz = dh * (1 - f["h"] ** 2)
        return {
            "score": f["r"].T @ d,
            "score_b": d.sum(keepdims=True),
            "attend": (f["t"] * f["g"]).T @ de,
            "v": f["h"].T @ dv,
            "u": f["h"].T @ du,
            "encode": f["z"].T @ dz,
            "encode_b": dz.sum(axis=0),
        }


def fit(
    x: np.ndarray, bag: np.ndarray, y: np.ndarray, share: float, hidden: int = 24, gate: int = 12, steps: int = 300,
    rate: float = 0.01, decay: float = 1e-3, seed: int = 7,
) -> AttentionModel:
    """Adam on the log loss of the bags. share: how often label 1 is in the population, to which scores are set."""
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0, dtype=np.float64)
    spread = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x, dtype=np.float64) / max(len(x), 1) - mean**2, 0))  # no copy of x
    spread[_DENSE:] = np.maximum(spread[_DENSE:], 0.3)  # about their own scale, so that rare buckets are not blown up
    weights = {
        "encode": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)),
        "encode_b": np.zeros(hidden),
        "v": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gate)),
        "u": rng.normal(0, 1 / np.sqrt(hidden), (hidden, gate)),
        "attend": rng.normal(0, 1 / np.sqrt(gate), gate),
        "score": rng.normal(0, 1 / np.sqrt(hidden), hidden),
        "score_b": np.zeros(1),
    }
    model = AttentionModel(mean, np.where(spread > 1e-6, spread, 1.0), weights)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    sizes = np.bincount(bag, minlength=len(y))
    begins = np.cumsum(sizes) - sizes
    for step in range(1, steps + 1):
        some = rng.choice(len(y), min(len(y), 256), replace=False)
        rows = np.concatenate([np.arange(begins[k], begins[k] + sizes[k]) for k in some])
        found = model.gradients(x[rows], np.repeat(np.arange(len(some)), sizes[some]), y[some])
        slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in found.items():
            g = g + decay * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            weights[k] -= slow * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    seen = y.mean()
    weights["score_b"] += np.log(share / (1 - share)) - np.log(seen / (1 - seen))
    return model


def held_out(id_col: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = 4000, longest: int = 2000, max_passages: int = 40_000,
) -> AttentionModel | None:
    """Fit on at most `sample` labelled documents that are not held out, half of each label as far as there are so many.

    Documents of more than `longest` passages are not in the sample, nor what goes beyond `max_passages` passages of all
    of a label, half of them each: the sample has at most max_passages * FEATURES * 4 bytes (90 MB). Labels that are
    null or that contradict each other are left out. With no document of one of the labels there is nothing to learn
    and the result is None. Other columns may have any names.
    """
    known = (
        labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull() & ~held_out(F.col(f"`{id_col}`")))
        .groupBy(F.col(f"`{id_col}`").alias("_of"))
        .agg(F.min(f"`{label_col}`").alias("_y"), F.max(f"`{label_col}`").alias("_top"))
        .where("_y = _top")
    )
    totals = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    if len(totals) < 2:
        return None
    chance = F.md5(F.col("_of").cast("string"))
    picked = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(chance, "_of").limit(sample // 2)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    rows = texts.join(F.broadcast(picked), F.col("_id") == F.col("_of"))  # `sample` ids at most
    words = F.coalesce(F.regexp_count("_text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    rows = cut(rows.withColumn("_passages", F.greatest(F.lit(1), F.ceil(words / PASSAGE))).where(F.col("_passages") <= longest))
    taken = Window.partitionBy("_y").orderBy(chance, "_of", F.md5(F.coalesce("_text", F.lit("")))).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_passages").over(taken)).where(F.col("_sum") <= max_passages // 2)  # sampled rows only
    rows = rows.select(F.col("_of").cast("bigint"), F.col("_y").cast("int"), "_text")

    def encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(it):
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(2)]
            for first, some in _slices(texts):
                x, owner = encode_passages(some)
                parts = np.split(x, np.cumsum(np.bincount(owner, minlength=len(some)))[:-1])
                some = batch.slice(first, len(some))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary())],
                    names=["id", "y", "x"],
                )

    found = sorted(rows.mapInArrow(encoded, "id long, y int, x binary").collect())
    y = np.array([r.y for r in found], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return None
    sizes = np.array([len(r.x) // (4 * FEATURES) for r in found])
    x = np.empty((int(sizes.sum()), FEATURES), dtype=np.float32)
    ends = np.cumsum(sizes)
    while found:  # the rows go as they are copied
        n = len(found)
        x[ends[n - 1] - sizes[n - 1] : ends[n - 1]] = np.frombuffer(found.pop().x, "<f4").reshape(-1, FEATURES)
    return fit(x, np.repeat(np.arange(len(sizes)), sizes), y, totals[1] / (totals[0] + totals[1]))


def score(
    docs: DataFrame, model: AttentionModel | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns in keep with score (0 to 1, higher where label 1 is likelier) and predicted (1 from 0.5 on).

    Every whole text is scored. Without a model (nothing was labelled) every score is 0.5. Columns in keep may have any
    names; one called score or predicted is replaced.
    """
    kept = [c for c in keep if c.lower() not in ("score", "predicted")]
    taken = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text_col}`").alias("value"))
    rows = _scored(taken, model)
    return rows.toDF(*kept, "score", "predicted")


def keep_good(docs: DataFrame, model: AttentionModel | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that are predicted 1, with docs' columns whatever their names."""
    taken = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns)], F.col(f"`{text_col}`").alias("value"))
    return _scored(taken, model).where("predicted = 1").drop("score", "predicted").toDF(*docs.columns)


def _scored(taken: DataFrame, model: AttentionModel | None) -> DataFrame:
    """taken, whose last column is the text, with score and predicted in its place."""

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(it):
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.num_columns - 1)]
            result = np.full(len(texts), 0.5)
            for first, some in _slices(texts) if model else ():
                x, owner = encode_passages(some)
                result[first : first + len(some)] = model.scores(x, owner, len(some))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(result), pa.array((result >= 0.5).astype(np.int32))],
                names=[*batch.schema.names[:-1], "score", "predicted"],
            )
            give_back()

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in taken.schema.fields[:-1])
    return taken.mapInArrow(scored, f"{fields}score double, predicted int")
