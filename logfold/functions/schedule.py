"""The counts at which bounded re-emission speaks up.

A signature is emitted at its first record and then whenever its count has grown by the
factor ``1 + eps`` since the last emission. The counts at which that happens depend on
``eps`` alone, so they form one fixed list: 1, 2, ... and later steps of about eps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_EPS = 0.02
# The largest count that a 64-bit number holds, so no signature falls silent.
MAX_COUNT = 2 ** 63 - 1
MAX_STEPS = 1_300_000


@lru_cache(maxsize=32)
def emission_counts(eps: float = DEFAULT_EPS, limit: int = MAX_COUNT) -> tuple[int, ...]:
    """All emission counts up to ``limit``, in order. The list grows with log(limit)/eps."""
    if eps <= 0:
        raise ValueError("with eps <= 0 every count is emitted; there is no list")
    counts, count = [], 1
    while count <= limit:
        counts.append(count)
        if len(counts) > MAX_STEPS:
            raise ValueError(f"eps={eps} needs over {MAX_STEPS} steps; pass the largest count as limit")
        count = max(count + 1, math.ceil(count * (1 + eps)))
    return tuple(counts)


def _long_array(values: Sequence[int]) -> str:
    """One literal: the optimizer folds the split."""
    return f"cast(split('{','.join(map(str, values))}', ',') AS array<bigint>)"


def emission_table(spark: SparkSession, eps: float = DEFAULT_EPS, limit: int = MAX_COUNT) -> DataFrame:
    """The list as rows ``(e)``; its length is checked, so it may be broadcast."""
    return spark.range(1).select(F.expr(f"explode({_long_array(emission_counts(eps, limit))})").alias("e"))


def _search(count: str, eps: float, limit: int) -> str:
    values = emission_counts(eps, limit)
    top = 1 << (len(values) - 1).bit_length()
    table = _long_array(list(values) + [2 ** 63 - 1] * (2 * top - len(values)))
    steps = ", ".join(str(1 << k) for k in reversed(range(top.bit_length())))
    return (f"aggregate(array({steps}), 0, (at, step) -> "
            f"CASE WHEN element_at({table}, at + step) <= ({count}) THEN at + step ELSE at END)")


def emissions_until(count: str, eps: float = DEFAULT_EPS, limit: int = MAX_COUNT) -> Column:
    """How many emissions a signature has made after ``count`` records, a column or expression.

    Binary search in the list as one expression: no join, no extra rows.
    """
    return F.expr(f"cast({count} AS bigint)" if eps <= 0 else f"cast({_search(count, eps, limit)} AS bigint)")


def last_emitted(count: str, eps: float = DEFAULT_EPS, limit: int = MAX_COUNT) -> Column:
    """The largest emission count that is at most ``count``: what the store ends up with.

    0 where nothing was counted.
    """
    if eps <= 0:
        return F.expr(f"cast({count} AS bigint)")
    return F.expr(f"coalesce(get({_long_array(emission_counts(eps, limit))}, {_search(count, eps, limit)} - 1), 0L)")
