"""Sets of small integers (*members*) as bit words.

Member ``m`` is bit ``m % 63`` of word ``m // 63``. A set is stored sparsely as
``array<struct<k int, bits bigint>>`` holding its non-zero words in order. Set union and
intersection of whole words are then ``bit_or`` and ``bit_and`` aggregates, which stay in
generated code and pre-aggregate before the shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 63


def slot(member: int) -> tuple[int, int]:
    """(word number, bit value) of a member."""
    return member // BITS, 1 << (member % BITS)


def members(words: str) -> Column:
    """All members of a word array, ascending."""
    return F.expr(
        f"flatten(transform({words}, w -> transform("
        f"filter(sequence(0, {BITS - 1}), b -> getbit(w.bits, b) = 1), b -> w.k * {BITS} + b)))"
    )


def contains(words: str, member: str) -> Column:
    return F.expr(
        f"exists({words}, w -> w.k = {member} div {BITS} and getbit(w.bits, cast({member} % {BITS} as int)) = 1)"
    )


def int_array(values: Sequence[int]) -> Column:
    """One literal for a driver-known list of integers, whatever its length."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<int>")


def string_array(values: Sequence[str]) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")
