"""The corpus pipeline: documents to token ids in five stages, each one operator of millrace.llm.

1. quality: documents that the classifier rejects go.
2. lines: repeated and nearly repeated lines go; a document whose lines are all gone stays with an empty text.
3. near-duplicates: of each class of SimHash near-duplicates the smallest doc_id stays.
4. mix: sources are mixed to their target weights; a document can be taken more than once or not at all.
5. tokens: what is left is encoded with BPE, and decoded again.

Each stage works on all that its predecessor kept. All but the last return the columns of documents, with n_chars set
anew where texts change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, lines, mixing, quality, simhash
from millrace.llm.common import stored
from millrace.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(docs).select(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (binary, little-endian 32-bit) and the text that they decode to."""
    vocabulary = bpe.Vocabulary.load(tokenizer_path("word_bpe_49k.json"))
    decoded = bpe.round_trip(docs, vocabulary, keep=("doc_id", "lang", "source"))
    return decoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("bigint"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]
#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before return is written and read again in between."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
