"""Language identification of mixed texts: scripts narrow the candidates, word scores, and a Viterbi path over the words.

A word is a letter and the letters and marks after it, 24 code points at most. The scripts of its letters narrow its
candidates to the languages that are learnt to use one of them. Its score for a candidate is the log-likelihood of its hashed
n-grams (1 to 4 code points, with the word's edges, and the word as a whole), told relative to the best candidate. The best
path over all words of the text, in which each change of language costs `PENALTY`, labels spans of one language; the label
with most letters is the text's language.

The model is learnt from at most SAMPLE documents of each language, chosen by a hash of their ids; n-grams are counted by
Spark and the counts, of a size that does not depend on the data, become one table. Texts are labelled batch by batch: one
step of the path at a time for all texts of a batch, so that very long texts take time in proportion and 8 bytes a word.

Defined results: a null text and one without a letter have language `und`, score 0 and no spans, as has every text if
nothing is learnt; ties go to the language first by code point; documents without a language are labelled but not learnt
from; repeated rows are learnt from and labelled as any; an empty table gives an empty table; clashing names of other columns
do not matter, since results carry the id only.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, give_back, row_slices, u01

#: Documents of a language that are learnt from, at most.
SAMPLE = 2000
#: Languages that can be learnt, at most.
LANGUAGES = 1024
#: Cells of the table of n-gram scores, over all languages; buckets of a language at most.
CELLS, BUCKETS = 1 << 23, 1 << 17
#: What a change of language costs, and the most that a word counts against a candidate or a language out of its script.
PENALTY, FLOOR, OUT = 8.0, 6.0, 30.0
#: Share of a language's letters from which a script counts as its own.
OWN_SCRIPT = 0.01
#: Words of a batch times languages, distinct words held, and code points of a text searched at a time.
BATCH, HELD, PIECE = 1 << 23, 150_000, 1 << 20

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,23}")
#: First code points of ranges that belong to one script, in order (Unicode blocks).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"), (0x08A0, "arabic"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2D00, "georgian"),
    (0x2D30, "other"), (0x2DE0, "cyrillic"), (0x2E80, "han"), (0x3040, "kana"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA640, "cyrillic"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF21, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
)
_NAMES = sorted({name for _, name in SCRIPTS})
_FROM = np.array([first for first, _ in SCRIPTS])
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])


def words_of(text: str) -> Iterator[list[tuple[str, int]]]:
    """The words of a text with their places, in lists of bounded size."""
    first = 0
    while first < len(text):
        last = min(first + PIECE, len(text))
        found = [(m.group(), m.start()) for m in _WORD.finditer(text, first, last)]
        if last < len(text) and found and found[-1][1] + len(found[-1][0]) == last and found[-1][1] > first:
            last = found.pop()[1]  # may go on in the next piece
        yield found
        first = last


def _plain_words(text: str) -> list[str]:
    if len(text) <= PIECE:
        return _WORD.findall(text)
    return [w for some in words_of(text) for w, _ in some]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def features(words: Sequence[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, word of each n-gram, script of each letter, word of each letter)."""
    edged = "".join(f" {w.lower()} " for w in words)
    points = np.frombuffer(edged.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = np.flatnonzero(points == 32)
    begins, ends = space[0::2], space[1::2]
    owner = np.repeat(np.arange(len(words)), ends - begins + 1)
    gram, of = [], []
    rolled = np.zeros(len(points), np.uint64)
    whole = np.add.reduceat(_mixed(points * np.uint64(0x100000001B3) + (np.arange(len(points)) - begins[owner]).astype(np.uint64)), begins)
    gram.append(whole)
    of.append(np.arange(len(words)))
    for n in range(1, 5):
        rolled = rolled[: len(points) - n + 1] * np.uint64(0x110000) + points[n - 1 :]
        inside = np.flatnonzero(owner[n - 1 :] == owner[: len(points) - n + 1])
        if n == 1:
            inside = inside[points[inside] != 32]
        gram.append(rolled[inside] * np.uint64(8) + np.uint64(n))
        of.append(owner[inside])
        rolled = _mixed(rolled) if n == 3 else rolled
    letter = np.flatnonzero(points != 32)
    script = _SCRIPT[np.searchsorted(_FROM, points[letter].astype(np.int64), side="right") - 1]
    bucket = (_mixed(_mixed(np.concatenate(gram))) % np.uint64(buckets)).astype(np.int64)
    return bucket, np.concatenate(of), script, owner[letter]


@dataclass
class Model:
    """Languages, log-probabilities of buckets (buckets x languages), and which scripts are whose (scripts x languages)."""

    languages: list[str]
    logs: np.ndarray = field(repr=False)
    scripts: np.ndarray = field(repr=False)

    @staticmethod
    def of_counts(languages: list[str], grams: np.ndarray, letters: np.ndarray) -> Model:
        """From n-gram counts (languages x buckets) and letter counts (languages x scripts)."""
        smooth = grams + 0.5
        logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T
        share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
        return Model(languages, np.ascontiguousarray(logs, dtype=np.float32), (share >= OWN_SCRIPT).T)

    def word_scores(self, words: Sequence[str]) -> np.ndarray:
        """Words x languages: 0 for the best candidate, down to -FLOOR for other candidates, -OUT for the rest."""
        bucket, word, script, of_letter = features(words, len(self.logs))
        order = np.argsort(word, kind="stable")
        begins = np.searchsorted(word[order], np.arange(len(words)))
        total = np.add.reduceat(self.logs[bucket[order]], begins, axis=0) / 3
        mine = np.logical_or.reduceat(self.scripts[script], np.searchsorted(of_letter, np.arange(len(words))), axis=0)
        mine |= ~mine.any(axis=1, keepdims=True)
        best = np.where(mine, total, -np.inf).max(axis=1, keepdims=True)
        return np.where(mine, np.maximum(total - best, -FLOOR), -OUT).astype(np.float32)


def paths(scores: np.ndarray, ids: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word on the best path of its text; ids are rows of scores, text after text.

    All texts take a step together: the texts are put in the order of length, so that those still running come first.
    """
    if not len(ids):
        return np.zeros(0, np.int16)
    order = np.argsort(-sizes, kind="stable")
    length = sizes[order]
    start = (np.cumsum(sizes) - sizes)[order]
    running = len(sizes) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")
    best = np.zeros(len(ids), np.int16)
    moved = np.zeros((len(ids), scores.shape[1]), bool)
    value = np.zeros((len(sizes), scores.shape[1]))
    for t, n in enumerate(running):
        at, v = start[:n] + t, value[:n]
        if t:
            top = v.argmax(axis=1)
            best[at] = top
            change = v[np.arange(n), top][:, None] - penalty
            moved[at] = change > v
            np.maximum(v, change, out=v)
        v += scores[ids[at]]
    label = np.zeros(len(ids), np.int16)
    state = value.argmax(axis=1)
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        at, s = start[:n] + t, state[:n]
        label[at] = s
        state[:n] = np.where(moved[at, s], best[at], s)
    return label


class _Labeller:
    """Words to rows of scores, kept from text to text."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.new: list[str] = []
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        rows, new = self.rows, self.new
        for w in set(words).difference(rows):
            rows[w] = len(rows)
            new.append(w)
        return np.fromiter(map(rows.__getitem__, words), np.int32, len(words))

    def labels(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        for k in range(0, len(self.new), 20_000):
            self.scores = np.concatenate([self.scores, self.model.word_scores(self.new[k : k + 20_000])])
        self.new = []
        return paths(self.scores, ids, sizes, self.penalty)

    def sized(self) -> np.ndarray:
        return np.fromiter(map(len, self.rows), np.int64, len(self.rows))


def _labelled(model: Model, penalty: float, texts: Iterator[str | None], words) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, _Labeller]]:
    """Batches of (what `words` keeps of each text, ids, words of each text, labels)."""
    labeller = _Labeller(model, penalty)
    most = max(1, BATCH // max(1, len(model.languages)))
    kept, ids, held = [], [], 0

    def done():
        sizes = np.array([len(i) for i in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return kept, flat, sizes, labeller.labels(flat, sizes), labeller

    for text in texts:
        own, found = words(text) if text and model.languages else (None, [])
        kept.append(own)
        ids.append(labeller.ids(found))
        held += len(found)
        if held >= most or len(labeller.rows) >= HELD:
            yield done()
            kept, ids, held = [], [], 0
            if len(labeller.rows) >= HELD:
                labeller.forget()
    if kept:
        yield done()


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(id_col, lang_pred, score): the language with most letters on the best path. The score is its share of the letters
    times how likely it is, by the words of the whole text, among all languages."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = sent.value, []
        names = np.array([*m.languages, "und"], object)
        n = len(m.languages)

        def texts():
            for batch in row_slices(batches):
                seen.append(batch.column(0))
                yield from (t.as_py() for t in batch.column(1))

        for _, ids, sizes, label, labeller in _labelled(m, penalty, texts(), lambda t: (None, _plain_words(t))):
            of = np.repeat(np.arange(len(sizes)), sizes)
            letters = np.zeros((len(sizes), n + 1))
            total = np.zeros((len(sizes), n + 1))
            if n:
                letters[:, :n] = np.bincount(of * n + label, labeller.sized()[ids], minlength=len(sizes) * n).reshape(-1, n)
                for k in range(n):
                    total[:, k] = np.bincount(of, labeller.scores[ids, k], minlength=len(sizes))
            letters[:, n] = sizes == 0
            best = letters.argmax(axis=1)
            likely = np.exp(total[:, :n] - total[np.arange(len(sizes)), np.minimum(best, n - 1)][:, None]).sum(axis=1) if n else 1.0
            score = np.where(sizes == 0, 0.0, letters.max(axis=1) / np.maximum(letters.sum(axis=1), 1) / likely)
            ids_out = pa.chunked_array(seen).combine_chunks() if len(seen) > 1 else seen[0]
            taken = len(sizes)
            seen[:] = [ids_out.slice(taken)] if len(ids_out) > taken else []
            yield pa.RecordBatch.from_arrays([ids_out.slice(0, taken), pa.array(names[best], pa.string()), pa.array(score)], ["id", "lang_pred", "score"])
        gc.collect()
        give_back()

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)


def spans(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(id_col, span, begin, length, lang): the runs of one language in order, from the first code point of their first word
    to the last of their last."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def placed(text: str) -> tuple[np.ndarray, list[str]]:
        pairs = [p for some in words_of(text) for p in some]
        return np.array([(at, at + len(w)) for w, at in pairs], np.int64).reshape(-1, 2), [w for w, _ in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = sent.value, []

        def texts():
            for batch in row_slices(batches):
                seen.extend(batch.column(0).to_pylist())
                yield from (t.as_py() for t in batch.column(1))

        for kept, _, sizes, label, _ in _labelled(m, penalty, texts(), placed):
            out = []
            ends = np.cumsum(sizes)
            for key, places, last, n in zip(seen, kept, ends, sizes):
                if not n:
                    continue
                own = label[last - n : last]
                edge = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [n]])
                for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
                    out.append((key, k, int(places[a, 0]), int(places[b - 1, 1] - places[a, 0]), m.languages[own[a]]))
            del seen[: len(sizes)]
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4])], ["id", "span", "begin", "length", "lang"])
        give_back()

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_name = rows.schema["id"].dataType.simpleString()
    id_type = pa.string() if id_name == "string" else pa.int32() if id_name == "int" else pa.int64()
    return rows.mapInArrow(run, f"id {id_name}, span bigint, begin bigint, length bigint, lang string").withColumnRenamed("id", id_col)


def held_out(id_col: Column) -> Column:
    """Documents that are never learnt from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count(languages: list[str], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: k for k, name in enumerate(languages)}
        width = buckets + len(_NAMES)
        counts = np.zeros((len(languages), width), np.int64)
        for batch in row_slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = _plain_words(text.as_py() or "")
                for k in range(0, len(words), 50_000):
                    bucket, _, script, _ = features(words[k : k + 50_000], buckets)
                    counts[place[lang]] += np.bincount(np.concatenate([bucket, script + buckets]), minlength=width)
        lang, cell = np.nonzero(counts)
        for k in range(0, len(lang), 100_000):
            part = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(lang[part]), pa.array(cell[part]), pa.array(counts[lang[part], cell[part]])], ["lang", "cell", "n"])
        give_back()

    return run


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model of the documents that have a language and are not held out."""
    own = df.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "id"), (lang_col, "lang"), (text_col, "text"))])
    learnt = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sizes = {r.lang: r.n for r in learnt.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, (1.2 * sample + 50) / sizes[k]))])
    drawn = learnt.withColumn("u", u01(F.lit("lang"), F.coalesce(F.col("id").cast("string"), F.lit("null")))).where(F.col("u") < F.try_element_at(share, F.col("lang")))
    first = Window.partitionBy("lang").orderBy("u", F.xxhash64("text"))
    drawn = drawn.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample).select("lang", "text")
    buckets = max(1 << 12, min(BUCKETS, 1 << (CELLS // len(languages)).bit_length() - 1))
    drawn = drawn.repartition(max(1, min(64, len(languages) * sample // 500)))
    counted = drawn.mapInArrow(_count(languages, buckets), "lang bigint, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = cut(counted).toArrow()
    counts = np.zeros((len(languages), buckets + len(_NAMES)))
    counts[found["lang"].to_numpy(), found["cell"].to_numpy()] = found["n"].to_numpy()
    return Model.of_counts(languages, counts[:, :buckets], counts[:, buckets:])
