"""Irregular readings onto a regular grid.

Every source has a grid of equal periods. Within a segment (readings no further apart than ``max_gap`` periods) the
value of a period is the shape-preserving monotone cubic through the readings, taken at the period's middle; a period
in a longer gap stays marked. All of it is one shuffle: readings are placed in time shards of their source, those near
a shard bound are also given to the neighbour (the halo), and the four readings around a period come from lag and lead.
Sources that are known to have very many readings a period are thinned first to the readings that a value can need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolith.runtime import few, materialize

SHARD_PERIODS = 8_192
MAX_GAP = 5
#: Readings a period beyond which a source is thinned, so that a shard stays small.
DENSE = 64


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Shape-preserving three-point slope at the end of a segment."""
    m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.signum(m) != F.signum(d0), 0.0).when((F.signum(d0) != F.signum(d1)) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0).otherwise(m)


def _inner_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Weighted harmonic mean of the neighbouring secants; 0 at a turning point."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(F.signum(d0) * F.signum(d1) <= 0, 0.0).otherwise((w0 + w1) / (w0 / d0 + w1 / d1))


def _thinned(usable: DataFrame) -> DataFrame:
    """The readings that values of periods can need: between the middles of two periods, the first two and the last two
    instants, each with its least and greatest value. Every step is an aggregate that is combined before the shuffle."""
    cells = usable.withColumn("cell", F.ceil(F.col("x") - 0.5))
    ends = materialize(cells.groupBy("k", "cell").agg(F.min("x").alias("a"), F.max("x").alias("d")), "ends")
    inner = cells.join(ends, ["k", "cell"]).where((F.col("x") > F.col("a")) & (F.col("x") < F.col("d")))
    seconds = materialize(inner.groupBy("k", "cell").agg(F.min("x").alias("b"), F.max("x").alias("c")), "ends")
    kept = [table.select("k", F.col(c).alias("x")) for table, c in ((ends, "a"), (ends, "d"), (seconds, "b"), (seconds, "c"))]
    instants = reduce(DataFrame.unionByName, kept).distinct()
    values = usable.groupBy("k", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.max("n").alias("n")).join(instants, ["k", "x"], "left_semi")
    return values.select("k", "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"), "n")


def regular_grid(
    readings: DataFrame,
    sources: DataFrame,
    key: str,
    *,
    time: str = "time",
    value: str = "value",
    start: str = "start",
    period: str = "period",
    bins: str = "bins",
    max_gap: int = MAX_GAP,
    shard_periods: int = SHARD_PERIODS,
    count: str | None = None,
    dense: int = DENSE,
) -> DataFrame:
    """One row per source and period: ``key``, ``bin``, ``time``, ``value``, ``observed``, ``status``.

    ``readings`` has ``key``, ``time``, ``value``, and the source's ``start``, ``period`` and number of ``bins``;
    ``sources`` has one row per ``key`` with the latter three. ``status`` is ``observed`` (a usable reading lies
    in the period), ``filled`` (none does, but the readings around are at most ``max_gap`` periods apart) or
    ``missing`` (value null).

    Readings with a null, NaN or infinite time or value, or outside the grid, are not usable. Readings of equal time
    count as one, halfway between their least and greatest value, so rows delivered twice change nothing. An observed
    period whose middle lies outside its segment takes the nearest reading. A source without usable readings gives
    only missing periods; one with null key, start, period or bins, or a period that isn't positive, gives no rows.
    Further columns are ignored. ``count`` names a column of ``sources`` with their numbers of readings; those with more than
    ``dense`` a period are thinned, which doesn't change the result.
    """
    if max_gap < 1 or shard_periods < 1:
        raise ValueError("max_gap and shard_periods must be positive")
    halo = 2 * max_gap + 2
    grids = sources.select(
        F.col(key).alias("k"), F.col(start).cast("double").alias("g0"), F.col(period).cast("double").alias("g1"), F.col(bins).cast("bigint").alias("n")
    ).where("k is not null and g0 is not null and g1 > 0 and n > 0")
    marks = grids.select(
        "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / shard_periods))).alias("shard"), "g0", "g1", "n"
    ).select("k", "shard", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), "g0", "g1", "n")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x, y = F.col(time).cast("double"), F.col(value).cast("double")
    usable = (
        readings.where(finite(x) & finite(y) & F.col(key).isNotNull())
        .where(F.col(period) > 0)
        # offsets to the microsecond, so that a reading on a bound isn't moved by the last bits of a large epoch
        .select(F.col(key).alias("k"), (F.rint((x - F.col(start)) * 1e6) / 1e6 / F.col(period)).alias("x"), y.alias("y"), F.col(bins).alias("n"))
        .where("x >= 0 and x < n")
    )
    if count is not None:
        crowded = materialize(sources.where(F.col(count) > dense * F.col(bins)).select(F.col(key).alias("k")).distinct(), "dense-sources")
        if not crowded.isEmpty():
            crowded = few(crowded)
            usable = usable.join(crowded, "k", "left_anti").unionByName(_thinned(usable.join(crowded, "k", "left_semi")))
    near = lambda d: F.floor((F.floor("x") + d) / shard_periods)
    placed = usable.select("k", F.explode(F.sequence(near(-halo), near(halo))).alias("shard"), "x", "y").where("shard >= 0")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("g0", "double"), ("g1", "double"), ("n", "bigint"))]
    # the grid's own row sorts first (null x) and carries what the shard needs
    rows = placed.select("k", "shard", "x", "y", *nothing).unionByName(marks).repartition("k", "shard")
    knots = (
        rows.groupBy("k", "shard", "x")
        .agg(((F.min("y") + F.max("y")) / 2).alias("y"), F.max("g0").alias("g0"), F.max("g1").alias("g1"), F.max("n").alias("n"))
    )
    w = Window.partitionBy("k", "shard").orderBy(F.col("x").asc_nulls_first())
    around = knots.select(
        "k", "shard", "x", "y",
        *(F.first(c).over(w).alias(c) for c in ("g0", "g1", "n")),
        F.lag("x").over(w).alias("xp"), F.lag("y").over(w).alias("yp"),
        F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"),
        F.lead("x", 2).over(w).alias("x2"), F.lead("y", 2).over(w).alias("y2"),
    )
    # each reading serves the periods whose middle lies between it and the next one
    core_lo, core_hi = F.col("shard") * shard_periods, F.least((F.col("shard") + 1) * shard_periods, F.col("n")) - 1
    lo = F.greatest(core_lo, F.when(F.col("x").isNull(), core_lo).otherwise(F.ceil(F.col("x") - 0.5)))
    hi = F.least(core_hi, F.when(F.col("x1").isNull(), core_hi).otherwise(F.ceil(F.col("x1") - 0.5) - 1))
    cells = (
        around.withColumns({"lo": lo, "hi": hi})
        .where(F.col("n").isNotNull() & (F.col("lo") <= F.col("hi")))
        .select("*", F.explode(F.sequence("lo", "hi")).alias("bin"))
    )
    h, hp, hn = F.col("x1") - F.col("x"), F.col("x") - F.col("xp"), F.col("x2") - F.col("x1")
    d, dp, dn = (F.col("y1") - F.col("y")) / h, (F.col("y") - F.col("yp")) / hp, (F.col("y2") - F.col("y1")) / hn
    left, right = F.coalesce(hp <= max_gap, F.lit(False)), F.coalesce(hn <= max_gap, F.lit(False))
    m0 = F.when(left, _inner_slope(hp, h, dp, d)).when(right, _end_slope(h, hn, d, dn)).otherwise(d)
    m1 = F.when(right, _inner_slope(h, hn, d, dn)).when(left, _end_slope(h, hp, d, dp)).otherwise(d)
    t = (F.col("bin") + 0.5 - F.col("x")) / h
    cubic = (
        F.col("y") * (1 + 2 * t) * (1 - t) * (1 - t) + h * m0 * t * (1 - t) * (1 - t) + F.col("y1") * t * t * (3 - 2 * t) + h * m1 * t * t * (t - 1)
    )
    after, before = F.coalesce(F.col("bin") == F.floor("x"), F.lit(False)), F.coalesce(F.col("bin") == F.floor("x1"), F.lit(False))
    joined = F.coalesce(h <= max_gap, F.lit(False))
    return cells.select(
        F.col("k").alias(key),
        "bin",
        (F.col("g0") + (F.col("bin") + 0.5) * F.col("g1")).alias("time"),
        F.when(joined, cubic).when(after, F.col("y")).when(before, F.col("y1")).alias("value"),
        (after | before).alias("observed"),
        F.when(after | before, "observed").when(joined, "filled").otherwise("missing").alias("status"),
    )
