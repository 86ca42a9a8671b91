"""Schemas from short text without a session."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}


def struct(text: str) -> T.StructType:
    """A flat struct from 'name kind, name kind'."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (part.split() for part in text.split(","))])


TOKENS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("val", T.StringType())]))
IDS = T.ArrayType(T.IntegerType())
