"""Table functions for SQL: bins that an interval touches, and the members of a numbered combination."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class TouchedBins:
    """One row per bin of a width that [start, end) touches; a point touches one bin, an interval that ends before it starts none."""

    def eval(self, start: float, end: float, origin: float, width: float):
        if None in (start, end, origin, width) or not width > 0 or not math.isfinite(start) or not math.isfinite(end) or end < start:
            return
        first = math.floor((start - origin) / width)
        last = first if start == end else math.ceil((end - origin) / width) - 1
        for b in range(first, last + 1):
            yield b, origin + b * width, origin + (b + 1) * width


class Unranked:
    """The members, in order, of the combination of ``k`` out of ``n`` with a rank in the order of their lists; nothing for a rank that isn't there."""

    def eval(self, n: int, k: int, rank: int):
        if None in (n, k, rank) or not 0 <= k <= n or not 0 <= rank < math.comb(n, k):
            return
        member = 0
        for place in range(k):
            # how many combinations keep this member is what is left to choose from behind it
            while rank >= (behind := math.comb(n - member - 1, k - place - 1)):
                rank -= behind
                member += 1
            yield place, member
            member += 1


def register(spark: SparkSession) -> None:
    """Makes ``touched_bins(start, end, origin, width)`` and ``unranked(n, k, rank)`` known to SQL, for lateral joins."""
    spark.udtf.register("touched_bins", udtf(TouchedBins, returnType="bin bigint, bin_start double, bin_end double"))
    spark.udtf.register("unranked", udtf(Unranked, returnType="place int, member int"))
