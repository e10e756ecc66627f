"""Continuous periods and gaps of overlapping intervals, per entity.

Two-level merge. The intervals of huge entities are cut into time shards whose bounds are quantiles of the intervals'
starts, so that a shard holds about as many intervals as any other, wherever they lie. Intervals are clipped at the end
of the shard that they start in and merged there; what reached over is stitched by a running maximum over one summary
row per shard, and coalesces with the periods that it touches. Entities of ordinary size are a shard by themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolith.runtime import few, heavy_keys, materialize, ranges

#: An entity with more intervals is huge, and a shard of one has about as many.
SHARD_ROWS = 20_000


def _spans(intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    spans = intervals.select(*keys, F.col(start).cast("bigint").alias("lo"), F.col(end).cast("bigint").alias("hi"))
    return spans.where("lo is not null and hi is not null and lo <= hi").dropna(subset=list(keys))


def _split(spans: DataFrame, keys: Sequence[str], shard_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The intervals of ordinary entities, and those of huge ones in time shards (``part``), if there are any."""
    huge = heavy_keys(spans, keys, shard_rows)
    if huge is None:
        return spans, None
    huge = few(huge)
    # repeated starts keep their longest interval, so that no start is heavier than a row
    longest = spans.join(huge, list(keys), "left_semi").groupBy(*keys, "lo").agg(F.max("hi").alias("hi"))
    return spans.join(huge, list(keys), "left_anti"), ranges(materialize(longest, "huge-intervals"), [*keys, "lo"], shard_rows, "time-shards")


def _islands(spans: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Merged coverage within each unit: ``lo``, ``hi``, and ``seen``, where the coverage before it ends (null for none)."""
    ordered = Window.partitionBy(*unit).orderBy("lo", "hi")
    seen = F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("seen", seen).withColumn("island", F.sum(F.when(F.col("lo") > F.col("seen"), 1).otherwise(0)).over(ordered))
    return marked.groupBy(*unit, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.when(F.col("lo") > F.col("seen"), F.col("seen"))).alias("seen"))


def _stitched(shards: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Merged coverage of every (entity, shard) with the coverage ``before`` it, and one summary row per shard.

    A shard's ``reach`` is the last bound of what starts in it, and ``carry`` the greatest reach of the shards before.
    """
    keys = list(keys)
    every = Window.partitionBy(*keys)
    summary = shards.groupBy(*keys, "part").agg(F.min("lo").alias("first"), F.max("hi").alias("reach"))
    summary = materialize(
        summary.withColumns({
            "carry": F.max("reach").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
            "stop": F.lead("first").over(every.orderBy("part")),
            "top": F.max("reach").over(every),
        }),
        "shards",
    )
    clipped = shards.join(summary.select(*keys, "part", "stop", "carry"), [*keys, "part"]).withColumn("hi", F.least("hi", "stop"))
    local = _islands(clipped, [*keys, "part", "carry"])
    # greatest() skips nulls: the first period of an entity has nothing before it
    return local.select(*keys, "part", "lo", "hi", F.greatest("seen", "carry").alias("before")), summary


def interval_gaps(intervals: DataFrame, keys: Sequence[str], start: str, end: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Gaps between successive continuous periods: ``keys``, ``gap_start``, ``gap_end`` (exclusive of the periods).

    ``start`` and ``end`` are integers of one unit. Intervals that overlap or touch form one period; one with
    start = end is a period of no length that splits the gap it lies in. Rows with a null key or bound, or whose end
    lies before their start, are ignored; repeated rows count once; an empty input gives no rows; other columns are
    ignored, whatever their names. ``shard_rows`` doesn't change the result.
    """
    ordinary, shards = _split(_spans(intervals, keys, start, end), keys, shard_rows)
    w = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    gaps = ordinary.withColumn("before", F.max("hi").over(w)).select(*keys, "lo", "before")
    if shards is not None:
        gaps = gaps.unionByName(_stitched(shards, keys)[0].select(*keys, "lo", "before"))
    return gaps.where(F.col("lo") > F.col("before")).select(*keys, F.col("before").alias("gap_start"), F.col("lo").alias("gap_end"))


def interval_periods(intervals: DataFrame, keys: Sequence[str], start: str, end: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Continuous periods: ``keys``, ``period_start``, ``period_end``. Same rules as :func:`interval_gaps`.

    In a huge entity a period ends where the coverage before the next period's start ends, and the last one at the
    entity's last bound; the successor is found among one summary row per shard, so no task sorts a whole entity.
    """
    keys = list(keys)
    ordinary, shards = _split(_spans(intervals, keys, start, end), keys, shard_rows)
    periods = _islands(ordinary, keys).select(*keys, F.col("lo").alias("period_start"), F.col("hi").alias("period_end"))
    if shards is None:
        return periods
    located, summary = _stitched(shards, keys)
    begins = materialize(located.where(F.col("before").isNull() | (F.col("lo") > F.col("before"))).select(*keys, "part", "lo", "before"), "begins")
    first = begins.groupBy(*keys, "part").agg(F.min_by("before", "lo").alias("first_end"))
    later = F.first("first_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("part").rowsBetween(1, Window.unboundedFollowing))
    ends = summary.select(*keys, "part", "top").join(first, [*keys, "part"], "left").select(*keys, "part", F.coalesce(later, "top").alias("fallback"))
    following = F.lead("before").over(Window.partitionBy(*keys, "part").orderBy("lo"))
    long = begins.withColumn("next_end", following).join(ends, [*keys, "part"])
    return periods.unionByName(long.select(*keys, F.col("lo").alias("period_start"), F.coalesce("next_end", "fallback").alias("period_end")))
