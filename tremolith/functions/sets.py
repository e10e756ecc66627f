"""Functions on arrays as sets and multisets, and on maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all different members; 1 for two empty sets, null if either is null."""
    every = F.size(F.array_union(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every))


def overlap(a: Column, b: Column) -> Column:
    """Shared members over those of the smaller set; 1 if that is empty, null if either is null."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(least == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / least))


def occurrences(a: Column) -> Column:
    """A map of each member that isn't null to how often it occurs."""
    members = F.array_compact(F.array_distinct(a))
    return F.map_from_arrays(members, F.transform(members, lambda x: F.size(F.filter(a, lambda y: y == x))))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Sum of the lesser over sum of the greater counts of two maps of counts; 1 for two empty ones, null if either is null."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0)).cast("double")
    total = lambda pick: F.aggregate(keys, F.lit(0.0), lambda s, k: s + pick(at(a, k), at(b, k)))
    most = total(F.greatest)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(most == 0, 1.0).otherwise(total(F.least) / most))


def merge_maps(a: Column, b: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """All keys of both maps; values of shared keys are combined, others stay. A null map counts as empty."""
    both = F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(combine(x, y)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def top_entry(m: Column) -> Column:
    """The key of the greatest value, the least such key; null for an empty map."""
    best = F.array_max(F.map_values(m))
    return F.array_min(F.map_keys(F.map_filter(m, lambda _, v: v == best)))
