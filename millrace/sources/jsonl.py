"""JSON-lines pairs and raw lines, read and written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_tool
from ..operators.placing import with_place

PAIR = "input string, target string"


def read_pairs(spark: SparkSession, path: str, kind: str = "all", strict: bool = False, required: bool = False) -> DataFrame:
    """(input, target) of the *.jsonl files in a folder; lines that are no JSON and pairs with an empty part go.

    strict raises at a line that is no JSON and keeps every pair; required raises if no pair is left.
    """
    pairs = _pairs(spark, path, kind, strict)
    if required and not pairs.head(1):
        raise ValueError(f"no pairs in {path}")
    return pairs


def _pairs(spark: SparkSession, path: str, kind: str, strict: bool) -> DataFrame:
    reader = spark.read.schema(PAIR if strict else PAIR + ", _bad string").option("pathGlobFilter", "*.jsonl")
    if strict:
        return reader.option("mode", "FAILFAST").json(path)
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    pairs = rows.where("coalesce(input, '') <> '' AND coalesce(target, '') <> ''").select("input", "target")
    return pairs if kind == "all" else pairs.where(is_tool("input") if kind == "tool" else ~is_tool("input"))


def read_lines(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Trimmed lines that are not blank as `raw`; numbered adds line_no, 1-based over the sorted files, blanks counted."""
    lines = spark.read.text(path)
    if numbered:
        lines = _placed(lines).select((F.col("_p") + 1).alias("line_no"), "value")
    rows = lines.withColumn("raw", F.regexp_replace("value", r"^\s+|\s+$", "")).where("raw <> ''")
    return rows.select(*(["line_no"] if numbered else []), "raw")


def _placed(lines: DataFrame) -> DataFrame:
    """Lines as read with _p, their 0-based place over the files in the order of names."""
    source = lines.select("value", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    return with_place(source, [F.col("_f"), F.col("_i")], "_p")


def read_head(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n lines over the files in the order of names, with line_no from 1; none is gathered in one task."""
    return _placed(spark.read.text(path)).where(F.col("_p") < n).select((F.col("_p") + 1).alias("line_no"), "value")


def sorted_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines in the order of their bytes, null first."""
    return lines.orderBy(F.col(column).asc_nulls_first())


def read_dictionary(spark: SparkSession, path: str, fallback: Sequence[str] = ()) -> DataFrame:
    """Words of a dictionary file in lower case: of 3 bytes or more and without apostrophe; the fallback's where there is
    no such file or no such word in it."""
    instead = spark.createDataFrame([(w,) for w in fallback], "word string")
    try:
        words = spark.read.text(path).select(F.lower(F.trim("value")).alias("word"))
    except AnalysisException as missing:
        if not fallback or missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return instead
    words = words.where((F.octet_length("word") >= 3) & ~F.col("word").contains("'"))
    return words if not fallback or words.head(1) else instead


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def json_string(c: Column) -> Column:
    """A JSON string literal, with <, >, & and the line separators escaped."""
    quoted = F.to_json(F.struct(c.alias("s")))
    body = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        body = F.replace(body, F.lit(sign), F.lit(code))
    return body


def pair_lines(pairs: DataFrame) -> DataFrame:
    """One line of JSON for each pair."""
    line = F.concat(F.lit('{"input":'), json_string(F.col("input")), F.lit(',"target":'), json_string(F.col("target")), F.lit("}"))
    return pairs.select(line.alias("value"))


def write_pairs(pairs: DataFrame, path: str, shards: int | None = None, mode: str = "error") -> None:
    """JSON lines; shards deals the rows evenly to that many files."""
    lines = pair_lines(pairs)
    (lines.repartition(shards) if shards else lines).write.mode(mode).text(path)


def write_log(rows: DataFrame, path: str) -> None:
    """A run's log, one row an epoch, written anew as JSON lines."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """(n): lines of the files under path, blank ones too."""
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n"))


def newest(spark: SparkSession, path: str, pattern: str = "*") -> str | None:
    """The file under path that was changed last, the last by name of several; None if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime")
    found = files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first().m
    return found.path if found else None


def write_rejects(gated: DataFrame, path: str, column: str = "raw") -> None:
    """The text of rejected rows, appended."""
    gated.where(F.col("reason").isNotNull()).select(column).write.mode("append").text(path)


def write_epochs(rows: DataFrame, path: str) -> None:
    """Inference logs by epoch."""
    rows.write.mode("append").partitionBy("epoch").json(path)
