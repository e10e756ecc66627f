"""Exact robust statistics per group: percentiles, the scale ladder, grid intervals, pooled means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolith.runtime import materialize, sharded

#: Buckets per doubling of a value; a bucket's width is 0.004 % of its values.
PER_OCTAVE = 16_384


def _bucket(v: Column) -> Column:
    """An order-preserving bucket number of a finite double."""
    steps = F.floor(F.log2(F.abs(v)) * PER_OCTAVE) + 1100 * PER_OCTAVE
    return F.when(v > 0, steps).when(v < 0, -steps).otherwise(0).cast("bigint")


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """``groups``, ``v``, ``c``: how often each value that isn't null occurs; combined before the shuffle."""
    return df.select(*groups, F.col(value).alias("v")).where(F.col("v").isNotNull()).groupBy(*groups, "v").agg(F.count("*").alias("c"))


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``groups``, ``n`` and one column per share: exact percentiles, interpolated between ranks."""
    return counted_percentiles(value_counts(df, groups, value), groups, shares)


def counted_percentiles(counts: DataFrame, groups: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """:func:`exact_percentiles` of ``groups``, ``v``, ``c``.

    A histogram of fine buckets locates the ranks; only the values of the buckets that hold one are sorted. No task
    sorts a whole group, and repeated values travel once.
    """
    groups = list(groups)
    counts = counts.withColumn("b", _bucket(F.col("v")))
    every = Window.partitionBy(*groups)
    buckets = counts.groupBy(*groups, "b").agg(F.sum("c").alias("m")).withColumns({
        "before": F.coalesce(F.sum("m").over(every.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "n": F.sum("m").over(every),
    })
    position = lambda q: (F.col("n") - 1) * F.lit(float(q))
    low, high = (lambda q: F.floor(position(q)) + 1), (lambda q: F.ceil(position(q)) + 1)
    ranks = [r(q) for q in shares.values() for r in (low, high)]
    holds = F.lit(False)
    for r in ranks:
        holds = holds | r.between(F.col("before") + 1, F.col("before") + F.col("m"))
    chosen = counts.join(buckets.where(holds).select(*groups, "b", "before", "n"), [*groups, "b"])
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*groups, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ordered = chosen.withColumn("upto", upto)
    at = lambda r: F.min(F.when((F.col("upto") >= r) & (F.col("upto") - F.col("c") < r), F.col("v")))
    picked = ordered.groupBy(*groups).agg(F.max("n").alias("n"), *(at(r(q)).alias(f"{k}{i}") for i, q in enumerate(shares.values()) for k, r in (("lo", low), ("hi", high))))
    part = lambda q: position(q) - F.floor(position(q))
    return picked.select(*groups, "n", *((F.col(f"lo{i}") * (1 - part(q)) + F.col(f"hi{i}") * part(q)).alias(name) for i, (name, q) in enumerate(shares.items())))


def robust_scale(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """``groups``, ``center``, ``scale``, ``observations`` of finite values.

    The center is the median. The scale is the first that isn't 0 of: 1.4826 times the median absolute deviation, the
    interquartile range over 1.349, the population standard deviation (computed on residuals divided by the largest
    one, so that it can't overflow), 1. A scale that isn't finite is an error.
    """
    groups = list(groups)
    # written once for three passes; counts per value are far fewer than the readings of most channels
    counts = materialize(value_counts(df, groups, value), "counts")
    shares = {"least": 0.0, "q25": 0.25, "center": 0.5, "q75": 0.75, "most": 1.0}
    quartiles = materialize(counted_percentiles(counts, groups, shares), "quartiles")
    amplitude = F.greatest(F.col("most") - F.col("center"), F.col("center") - F.col("least"))
    off = counts.join(quartiles.select(*groups, "center", amplitude.alias("amplitude")), groups).withColumn("r", F.col("v") - F.col("center"))
    deviation = counted_percentiles(off.select(*groups, F.abs("r").alias("v"), "c").groupBy(*groups, "v").agg(F.sum("c").alias("c")), groups, {"mad": 0.5})
    part = F.when(F.col("amplitude") > 0, F.col("r") / F.col("amplitude")).otherwise(0.0)
    mean, square = F.sum(part * F.col("c")) / F.sum("c"), F.sum(part * part * F.col("c")) / F.sum("c")
    spread = off.groupBy(*groups).agg(F.max("amplitude").alias("amplitude"), (F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) * F.max("amplitude")).alias("deviation"))
    mad, iqr = F.col("mad") * 1.4826, (F.col("q75") - F.col("q25")) / 1.349
    scale = F.when(mad != 0, mad).when(iqr != 0, iqr).when(F.col("amplitude") != 0, F.col("deviation")).otherwise(1.0)
    checked = F.when(F.isnan(scale) | (F.abs(scale) == float("inf")), F.raise_error(F.lit("a scale is not finite")).cast("double")).otherwise(scale)
    return quartiles.join(deviation.select(*groups, "mad"), groups).join(spread, groups).select(*groups, "center", checked.alias("scale"), F.col("n").alias("observations"))


def grid_interval(df: DataFrame, series: str, time: str, order: str, least: int = 3, shard_rows: int = 200_000) -> DataFrame:
    """One row: ``delta``, the median over series of the median positive step of their times, and the ``series`` counted.
    Series of fewer than ``least`` readings don't count. No such series gives null. Series of more than ``shard_rows``
    readings are cut by position."""
    rows = df.select(series, F.col(time).alias("t"), F.col(order).alias("o"))
    cut = sharded(rows, [series], ["t", "o"], shard_rows, 1)
    step = F.col("t") - F.lag("t").over(Window.partitionBy(series, "__shard").orderBy("t", "o"))
    # one reading more than its steps, whether positive or not
    steps = cut.withColumn("step", step).where(F.col("__core"))
    counted = value_counts(steps.withColumn("step", F.when(F.col("step") > 0, F.col("step")).otherwise(float("-inf"))), [series], "step")
    counted = materialize(counted, "steps")
    enough = counted.groupBy(series).agg(F.sum("c").alias("members")).where(F.col("members") >= least).select(series)
    each = counted_percentiles(counted.where(F.col("v") > 0).join(enough, series, "left_semi"), [series], {"p": 0.5})
    return exact_percentiles(each.withColumn("__all", F.lit(1)), ["__all"], "p", {"delta": 0.5}).select("delta", F.col("n").alias("series"))


def thin_references(samples: DataFrame, keys: Sequence[str], least: int = 1) -> DataFrame:
    """``keys``, ``observations`` of what occurs in the incident but has fewer than ``least`` observed readings in the reference."""
    reference = F.col("observed") & (F.col("time") >= F.col("reference_start")) & (F.col("time") < F.col("incident_start"))
    found = samples.groupBy(*keys).agg(F.count_if(reference).alias("observations"), F.max(F.col("time") >= F.col("incident_start")).alias("__seen"))
    return found.where(F.col("__seen") & (F.col("observations") < least)).drop("__seen")


def weighted_mean(df: DataFrame, groups: Sequence[str], value: Column, weight: Column) -> DataFrame:
    """``groups``, ``mean``, ``weight``; rows of null value or weight don't count."""
    ok = value.isNotNull() & weight.isNotNull()
    total = F.sum(F.when(ok, weight))
    return df.groupBy(*groups).agg((F.sum(F.when(ok, value * weight)) / F.nullif(total, F.lit(0))).alias("mean"), total.alias("weight"))


def weighted_mean_vectors(df: DataFrame, groups: Sequence[str], vector: str, weight: Column) -> DataFrame:
    """``groups``, ``mean`` (array), ``weight``: the weighted mean of vectors of one length. Rows of a null vector or weight don't
    count; a group whose weights sum to 0 has a null mean. Coordinates are summed before they are shuffled."""
    rows = df.select(*groups, F.col(vector).alias("__v"), weight.cast("double").alias("__w")).where("__v is not null and __w is not null")
    cells = rows.select(*groups, "__w", F.posexplode("__v").alias("__i", "__x"))
    sums = cells.groupBy(*groups, "__i").agg(F.sum(F.col("__x").cast("double") * F.col("__w")).alias("__s"), F.sum("__w").alias("__w"))
    # a row per coordinate of one vector, so the array is as long as the vectors
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__s"))), lambda c: c["__s"])
    out = sums.groupBy(*groups).agg(ordered.alias("__sums"), F.max("__w").alias("weight"))
    return out.select(*groups, F.when(F.col("weight") != 0, F.transform("__sums", lambda x: x / F.col("weight"))).alias("mean"), "weight")
