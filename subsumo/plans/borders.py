"""Borders that are kept up while levels arrive.

A border stands for all dependencies that came: the positive one for those that hold, by its
maximal ones, the negative one for those that do not, by its minimal ones. Each update joins the border with the
level alone and writes a new table, so neither lineage nor work grows with the levels before.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from subsumo.operators.algebra import extended_negative_border, extended_positive_border
from subsumo.session import counted

_IND = "dep array<int>, ref array<int>"

_EXTENDED = {"positive": extended_positive_border, "negative": extended_negative_border}


@dataclass
class Border:
    """``kind`` is positive or negative. ``size`` is the number of dependencies in the border."""

    spark: SparkSession
    kind: str = "positive"
    size: int = 0
    df: DataFrame = field(init=False)

    def __post_init__(self):
        if self.kind not in _EXTENDED:
            raise ValueError(f"unknown border {self.kind!r}; choose from {sorted(_EXTENDED)}")
        self.df = self.spark.createDataFrame([], _IND)

    def add(self, level: DataFrame) -> "Border":
        """Takes in (dep, ref) of any arities, also such as came before."""
        self.df, self.size = counted(_EXTENDED[self.kind](self.df, level.select("dep", "ref")))
        return self

    def on_level(self, level: DataFrame, arity: int) -> None:
        """A callback for ``discover``: the border after every finished level."""
        self.add(level)
