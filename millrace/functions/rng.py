"""Pseudo-random numbers that depend on a seed and a row's key only, never on partitioning."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex8(seed: int | Column, key: str | Column, draw: int | str | Column = 0) -> Column:
    """The digits of which u01 is made: they sort as it does."""
    parts = [p if isinstance(p, Column) else F.lit(str(p)) for p in (seed, F.col(key) if isinstance(key, str) else key, draw)]
    return F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8)


def stem(seed: int, key: Column, tag: Column) -> Column:
    """What stands before the place in the draws of a key: made once where there are many places."""
    return F.concat_ws(":", F.lit(str(seed)), key.cast("string"), tag)


def u01(seed: int | Column, key: str | Column, draw: int | str | Column = 0) -> Column:
    """A uniform in [0, 1): the first 8 hex digits of md5('seed:key:draw') over 2**32. DuckDB computes the same."""
    return uniform(hex8(seed, key, draw))


def uniform(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(4294967296.0)


def below(digits: Column, p: float) -> Column:
    """Whether the uniform of these digits, or of a whole hash, is less than p, without making it a number."""
    bound = math.ceil(p * 4294967296)
    return F.lit(True) if bound > 0xFFFFFFFF else digits < f"{max(bound, 0):08x}"


def u01_sql(seed: int, key: str, draw: int | str = 0) -> str:
    """The same uniform in DuckDB SQL; key is an expression."""
    return f"(('0x' || substr(md5('{seed}:' || {key} || ':{draw}'), 1, 8))::BIGINT / 4294967296.0)"


def pick(n: int, seed: int, key: str | Column, draw: int | str = 0) -> Column:
    """An integer in [0, n)."""
    return F.floor(u01(seed, key, draw) * n).cast("int")


def row_random(seed: int, key: object, operator: str) -> random.Random:
    """The generator of one row for one operator, for use inside Python functions."""
    return random.Random(f"{seed}:{key}:{operator}")
