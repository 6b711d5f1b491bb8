"""Bounded samples of rows, the same in every run."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_sample(rows: DataFrame, size: int, *by: str, total: int | None = None) -> DataFrame:
    """At most `size` rows, the first in the order of a hash of the columns `by`.

    Rows beyond a share that holds `size` of them (with six deviations to spare) are left out first, so that tasks
    together hand over little more than `size` rows, whatever their number; where rows that repeat `by` leave fewer, the
    share grows. `total` is the number of rows, if known.
    """
    total = rows.count() if total is None else total
    key = F.xxhash64(*by)
    if total > size:
        share = min(1.0, (size + 6 * math.sqrt(size) + 6) / total)
        while share < 1.0:
            some = rows.where(key <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2.0**64))))
            if some.limit(size).count() >= size:
                rows = some
                break
            share = min(1.0, 4 * share)
    return rows.orderBy(key, *by).limit(size)
