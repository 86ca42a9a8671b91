"""Chains of gates that accept a record or say why not; the first gate that fails gives the reason.

Each chain is one vectorised function over a batch, since the gates that parse come first and native conditions cannot
short-circuit Python ones. Rejected rows keep their text beside the reason; counts are plain aggregates.
"""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..functions import jsontext, xmltext
from ..functions.types import struct

WRAPPED = "reason string, input string, target string"


def wrap_one(text: str | None) -> tuple[str | None, str | None, str | None]:
    """(reason, input, target) of a line that should be an agent's answer as JSON; reason is None if it is accepted."""
    if text is None:
        return "invalid_json", None, None
    try:
        value = jsontext.parse(text)
    except ValueError:
        return "invalid_json", None, None
    if value is not None and not isinstance(value, dict):
        return "not_object", None, None
    value = value or {}
    if "thought" not in value:
        return "missing_thought", None, None
    if (value.get("answer") is None) == (value.get("tool") is None):
        return "answer_or_tool", None, None
    thought = value["thought"]
    if not isinstance(thought, str) or len(thought.encode()) < 10:
        return "short_thought", None, None
    memory = value.get("memory")
    if memory is not None and not (isinstance(memory, list) and memory):
        return "bad_memory", None, None
    xml = xmltext.to_xml(value)
    if not xmltext.well_formed(xml):
        return "invalid_xml", None, None
    return None, jsontext.pretty(value), xml


@F.pandas_udf(struct(WRAPPED))
def wrap_gate(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([wrap_one(t) for t in text], columns=["reason", "input", "target"])


def wrap(lines: DataFrame, column: str = "raw") -> DataFrame:
    """Lines with reason, input and target; blank lines are not records and go, a null line is invalid JSON. A column
    reason, input or target of the lines is replaced."""
    some = lines.where(F.col(column).isNull() | (F.trim(F.regexp_replace(column, r"\s+", " ")) != ""))
    gated = some.withColumn("_gate", wrap_gate(F.trim(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))))
    return gated.select(*_others(lines), "_gate.reason", "_gate.input", "_gate.target")


def repair_one(original: str | None, fix_a: str | None, fix_b: str | None) -> tuple:
    """(reason, input, target) of a broken text and two fixes, but for how much they differ."""
    if not original or not fix_a or not fix_b:
        return "bad_record", None, None
    values: list[Any] = []
    for name, fix in (("fix_a", fix_a), ("fix_b", fix_b)):
        try:
            values.append(jsontext.parse(fix))
        except ValueError:
            return f"{name}_invalid_json", None, None
    xml = xmltext.to_xml(values[0])
    if not xmltext.well_formed(xml):
        return "xml_invalid", None, None
    return None, original, xml


@F.pandas_udf(struct(WRAPPED))
def repair_gate(original: pd.Series, fix_a: pd.Series, fix_b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repair_one(*r) for r in zip(original, fix_a, fix_b)], columns=["reason", "input", "target"])


def repair(records: DataFrame, max_distance: int = 50, max_change: float = 10.0) -> DataFrame:
    """(original, fix_a, fix_b) with reason, input (the broken text) and target (the XML of the fix).

    How far texts are apart in bytes is told by the native distance, which stops at its bound. A column reason, input or
    target of the records is replaced.
    """
    near = lambda a, b, most: fn.byte_levenshtein(a, b, most) >= 0
    size = F.greatest(F.octet_length("original"), F.lit(1))
    allowed = F.floor(size * max_change / 100).cast("int")
    gated = records.withColumn("_gate", repair_gate("original", "fix_a", "fix_b"))
    early = F.col("_gate.reason").isin("bad_record", "fix_a_invalid_json", "fix_b_invalid_json")
    reason = F.when(early, F.col("_gate.reason")).when(~near("fix_a", "fix_b", max_distance), "fixes_disagree")
    reason = reason.when(~near("original", "fix_a", allowed), "too_many_changes").otherwise(F.col("_gate.reason"))
    judged = gated.withColumn("_reason", reason)
    made = {"reason": F.col("_reason"), **{c: F.when(F.col("_reason").isNull(), F.col(f"_gate.{c}")) for c in ("input", "target")}}
    return judged.withColumns(made).select(*_others(records), *made)


def _others(df: DataFrame) -> list[str]:
    """Columns of df that a gate does not write."""
    return [f"`{c}`" for c in df.columns if c.lower() not in ("reason", "input", "target")]


def change_pct(original: Column, fixed: Column) -> Column:
    """Edit distance in bytes as a percentage of the original's bytes."""
    return 100.0 * fn.byte_levenshtein(original, fixed) / F.greatest(F.octet_length(original), F.lit(1))


def by_reason(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def totals(gated: DataFrame) -> DataFrame:
    return gated.agg(
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
        F.count(F.lit(1)).alias("total"),
    )


def remaining(rejects: DataFrame, accepted: DataFrame, key: str = "line_no") -> DataFrame:
    """Rejects that no repair was accepted for."""
    return rejects.join(accepted.select(key), key, "left_anti")
