"""Exact percentiles of very large columns by cumulative frequencies.

Values are reduced to counts per group and value, range-sorted, and numbered: the total of every (range partition,
group) gives the offset of the next, a window sums within one of them, and a percentile is the first value whose
cumulative count reaches the target rank. A window never spans more than one range partition of one group. The sorted
table has a folder per range partition, so only those that hold a target rank are read. Frequency tables are the mergeable state: those of days, data sets
or shards combine by adding counts, and the percentiles of the whole follow from the combined table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolith.runtime import discard, materialize

#: Parts that one value of a group is split into while repeated readings are dropped.
SALTS = 32


def rounded(v: Column, relative_error: float) -> Column:
    """The representative of v's logarithmic bucket: off by at most ``relative_error`` times |v|."""
    ratio = (1 + relative_error) / (1 - relative_error)
    step = F.ceil(F.log(F.abs(v)) / F.log(F.lit(ratio)))
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * 2 * F.pow(F.lit(ratio), step) / (ratio + 1))


def frequencies(df: DataFrame, groups: Sequence[str], value: str, identity: Sequence[str] = (), relative_error: float = 0.0) -> DataFrame:
    """Counts per group and value: ``groups``, ``value``, ``n`` (partial: a pair may have several rows).

    Null, NaN and infinite values are ignored; null groups are a group. Rows that agree in ``identity`` and value count
    once (all rows count, if it is empty). ``relative_error`` > 0 rounds values to logarithmic buckets, which bounds the
    table's size whatever the number of rows; 0 is exact. Repeated identities meet in the partition of their group,
    value and a salt of the identity, so that neither a hot group nor a hot value is one task.
    """
    v = F.col(value).cast("double")
    rows = df.select(*groups, v.alias("value"), *(F.col(c).alias(f"__id{i}") for i, c in enumerate(identity)))
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    ids = [f"__id{i}" for i in range(len(identity))]
    if ids:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*ids), F.lit(SALTS)).cast("int")).repartition(*groups, "value", "__salt")
        rows = rows.dropDuplicates([*groups, "value", "__salt", *ids])
    if relative_error:
        rows = rows.withColumn("value", rounded(F.col("value"), relative_error))
    return rows.groupBy(*groups, "value", *(["__salt"] if ids else [])).agg(F.count("*").alias("n")).drop("__salt")


def merge(*tables: DataFrame) -> DataFrame:
    """The frequency table of all inputs together."""
    return reduce(DataFrame.unionByName, tables)


class Cumulative:
    """A range-sorted frequency table, written once, with its offsets."""

    def __init__(self, table: DataFrame, groups: Sequence[str]):
        self.groups = list(groups)
        # written first, as range bounds take a sample of the rows before they are moved
        table = materialize(table, "unsorted")
        summed = table.repartitionByRange(*self.groups, "value").groupBy(*self.groups, "value").agg(F.sum("n").alias("n"))
        ordered = summed.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *self.groups, "value")
        self.sorted = materialize(ordered, "frequencies", by=["part"])
        discard(table)
        totals = self.sorted.groupBy("part", *self.groups).agg(F.sum("n").alias("m"), F.min("value").alias("least"), F.max("value").alias("most"))
        w = Window.partitionBy(*self.groups)
        #: One row per range partition and group: what comes before (``offset``), its own count ``m``, the group's ``total``.
        self.parts = materialize(
            totals.withColumns({
                "offset": F.coalesce(F.sum("m").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "total": F.sum("m").over(w),
            }),
            "offsets",
        )

    def _at(self, parts: DataFrame) -> DataFrame:
        """The sorted rows of the given parts; null groups match."""
        right = parts.select(F.col("part").alias("__part"), *(F.col(c).alias(f"__{c}") for c in self.groups), *(c for c in parts.columns if c not in ("part", *self.groups)))
        on = reduce(lambda a, c: a & self.sorted[c].eqNullSafe(right[f"__{c}"]), self.groups, self.sorted["part"] == right["__part"])
        return self.sorted.join(right, on).drop("__part", *(f"__{c}" for c in self.groups))

    def percentiles(self, shares: Sequence[float], interpolate: bool = True) -> DataFrame:
        """``groups``, ``observations``, and p0, p1, ... for the shares: linear interpolation between neighbouring ranks, or
        the value of the lower of both."""
        if any(not 0 <= q <= 1 for q in shares):
            raise ValueError("shares lie between 0 and 1")
        rank = lambda q, up: (F.ceil if up else F.floor)((F.col("total") - 1) * F.lit(float(q))) + 1
        holds = reduce(lambda a, b: a | b, (rank(q, up).between(F.col("offset") + 1, F.col("offset") + F.col("m")) for q in shares for up in (0, 1)))
        rows = self._at(self.parts.where(holds).select("part", *self.groups, "offset", "total"))
        w = Window.partitionBy("part", *self.groups).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("upto", F.col("offset") + F.sum("n").over(w))
        first = lambda q, up: F.min(F.when((F.col("upto") >= rank(q, up)) & (F.col("upto") - F.col("n") < rank(q, up)), F.col("value")))
        picked = rows.groupBy(*self.groups).agg(
            F.max("total").alias("total"), *(first(q, up).alias(f"{'hi' if up else 'lo'}{i}") for i, q in enumerate(shares) for up in (0, 1))
        )
        part = lambda q: (F.col("total") - 1) * F.lit(float(q)) - F.floor((F.col("total") - 1) * F.lit(float(q)))
        between = lambda i, q: F.col(f"lo{i}") * (1 - part(q)) + F.col(f"hi{i}") * part(q) if interpolate else F.col(f"lo{i}")
        return picked.select(*self.groups, F.col("total").alias("observations"), *(between(i, q).alias(f"p{i}") for i, q in enumerate(shares)))

    def counts(self, points: DataFrame, point: str) -> DataFrame:
        """``groups``, ``point``, ``observations``, ``below`` (values < point) and ``upto`` (values <= point).

        ``points`` has one or more points per group; null points give no rows. Partitions wholly on one side are
        counted by their totals; only those that a point falls into are read.
        """
        named = points.select(*self.groups, F.col(point).alias("point")).where("point is not null").distinct()
        at = named.join(self.parts, self.groups)
        whole = at.groupBy(*self.groups, "point").agg(
            F.max("total").alias("observations"),
            F.sum(F.when(F.col("most") < F.col("point"), F.col("m")).otherwise(0)).alias("under"),
        )
        inside = self._at(at.where((F.col("least") <= F.col("point")) & (F.col("most") >= F.col("point"))).select("part", *self.groups, "point"))
        local = inside.groupBy(*self.groups, "point").agg(
            F.sum(F.when(F.col("value") < F.col("point"), F.col("n"))).alias("b"), F.sum(F.when(F.col("value") <= F.col("point"), F.col("n"))).alias("u")
        )
        under = lambda c: F.col("under") + F.coalesce(F.col(c), F.lit(0))
        return whole.join(local, [*self.groups, "point"], "left").select(
            *self.groups, F.col("point").alias(point), "observations", under("b").alias("below"), under("u").alias("upto")
        )

    def deviations(self, centers: DataFrame, center: str) -> DataFrame:
        """Frequency table of the distances from each group's center (one per group)."""
        with_center = self.parts.join(centers.select(*self.groups, F.col(center).alias("__c")), self.groups).select("part", *self.groups, "__c")
        return self._at(with_center).select(*self.groups, F.abs(F.col("value") - F.col("__c")).alias("value"), "n")


def median_and_spread(table: DataFrame, groups: Sequence[str]) -> tuple[Cumulative, DataFrame]:
    """The sorted table, and ``groups``, ``observations``, ``median``, ``mad`` (median absolute deviation from the median)."""
    values = Cumulative(table, groups)
    medians = values.percentiles([0.5]).withColumnRenamed("p0", "median")
    # written: one row per group, used by the second pass and by the result
    medians = materialize(medians, "medians")
    spread = Cumulative(values.deviations(medians, "median"), groups).percentiles([0.5]).select(*groups, F.col("p0").alias("mad"))
    return values, medians.join(spread, list(groups))
