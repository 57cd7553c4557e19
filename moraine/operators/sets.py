"""Unions, differences and first-seen dedup."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from moraine.operators.joins import anti
from moraine.operators.windows import first_of


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows, columns matched by name, null where a table lacks one."""
    some = [f for f in frames if f is not None]
    if not some:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some)


def new_rows(df: DataFrame, known: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key that is not known."""
    return first_of(anti(df, known, keys), keys, order)
