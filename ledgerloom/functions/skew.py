"""Joins whose key may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(many: DataFrame, few: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``many`` joined with ``few`` (one row per key, or few) so that a key holding any share of ``many`` is split.

    The rows of ``many`` are spread over ``salts`` parts of their key by a hash of ``spread``; each row of
    ``few`` is repeated once per part. No part depends on the size of a key's group. Null keys never match.
    ``how`` may be inner, left, left_semi or left_anti. Neither side is broadcast: the planner takes the repeated
    rows for the size of ``few``, so that a broadcast would hold ``salts`` times what its limit allows.
    """
    part = "__part"
    left = many.withColumn(part, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = few.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, part], how).drop(part)
