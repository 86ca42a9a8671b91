"""Extra pairs mixed into train and validation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corrupt, sampling

#: Fixed value: what the seed of the validation mix is beyond that of the train mix.
VAL_SEED = 2_000_000


def mix_extra(train: DataFrame, val: DataFrame, extra: DataFrame, pct: float, corrupt_pct: float = 0.0, key: str = "sample_id", seed: int = 42) -> DataFrame:
    """(key, input, target, split, mixed): both sets, each with pct percent of the extra pairs.

    The train set's share is drawn with the seed and corrupt_pct percent of its inputs are corrupted; the validation set's is
    drawn with seed + VAL_SEED and stays as it is. The two draws may have pairs in common. Other columns are left out; null
    inputs stay null; empty tables add nothing.
    """
    own = lambda df, split, mixed: df.select(key, "input", "target", F.lit(split).alias("split"), F.lit(mixed).alias("mixed"))
    broken = corrupt.corrupt_lines(sampling.random_sample(extra, pct, key, seed), seed, corrupt_pct, key)
    clean = sampling.random_sample(extra, pct, key, seed + VAL_SEED)
    return sampling.union_all(own(train, "train", False), own(broken, "train", True), own(val, "val", False), own(clean, "val", True))
