"""Row filters: samples and complete tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _slots(percent: int) -> list[int]:
    if not 0 < percent < 100:
        raise ValueError("a sample needs 0 < percent < 100")
    return [int(i * (100.0 / percent)) for i in range(percent)]


def round_robin_sample(df: DataFrame, percent: int) -> DataFrame:
    """``percent`` of every 100 consecutive rows of each partition, evenly spread."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.where((row % 100).isin(_slots(percent)))


def key_sample(df: DataFrame, key: Column, percent: int) -> DataFrame:
    """The same slots taken from an integer key, so that the sample can be repeated."""
    return df.where(F.pmod(key, F.lit(100)).isin(_slots(percent)))


def complete_tuples(df: DataFrame, fields: str = "f") -> DataFrame:
    """Only tuples without a null or empty field."""
    return df.where(F.forall(fields, lambda x: x.isNotNull() & (x != "")))
