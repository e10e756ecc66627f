"""Relational operators of incident analysis: spans, windows, placement, pooling by bin and radius, population checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolith.operators.observations import bin_index, is_active
from tremolith.runtime import greatest_before, sharded

#: A series with more readings is cut by position where windows run over it.
SHARD_ROWS = 200_000


def span_conflicts(spans: DataFrame, key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """``key``, ``copies``, ``versions`` of span keys that occur more than once; more than one version is a conflict."""
    return spans.groupBy(*key).agg(F.count("*").alias("copies"), F.countDistinct(F.struct(*payload)).alias("versions")).where("copies > 1")


def distinct_spans(spans: DataFrame, key: Sequence[str], order: Sequence[str], conflicts: str = "error") -> DataFrame:
    """One row per span key; an aggregate, so that copies are combined before the shuffle.

    Copies of one key must agree in all other columns. If they don't, the row fails, or with ``conflicts='least'`` the
    least in ``order`` stands for them; :func:`span_conflicts` lists them.
    """
    if conflicts not in ("error", "least"):
        raise ValueError("conflicts are an error or resolved to the least")
    rest = [c for c in spans.columns if c not in key and c not in order]
    row = F.struct(*order, *rest)
    out = spans.groupBy(*key).agg(F.min(row).alias("s"), F.max(row).alias("t"))
    if conflicts == "error":
        out = out.withColumn("s", F.when(F.col("s").eqNullSafe(F.col("t")), F.col("s")).otherwise(F.raise_error(F.lit("a span has copies that differ")).cast(out.schema["s"].dataType)))
    return out.select(*key, "s.*")


def parent_links(spans: DataFrame, *, trace: str = "trace", span: str = "span", parent: str = "parent", service: str = "service") -> DataFrame:
    """Every span with ``parent_service`` and ``link``: parentless (no parent, empty or 0), unresolved or call.

    The lookup side holds all spans, so a parent may lie outside the window that the caller filters the children by.
    """
    up = spans.select(F.col(trace).alias("__t"), F.col(span).alias("__s"), F.col(service).alias("parent_service"))
    none = F.col(parent).isNull() | F.trim(F.col(parent)).isin("", "0")
    child = spans.withColumn("__p", F.when(~none, F.col(parent)))
    linked = child.join(up, (child[trace] == up["__t"]) & (child["__p"] == up["__s"]), "left")
    kind = F.when(F.col("__p").isNull(), "parentless").when(F.col("parent_service").isNull(), "unresolved").otherwise("call")
    return linked.withColumn("link", kind).drop("__t", "__s", "__p")


def clipped_references(faults: DataFrame, day: str, start: str, end: str, order: str, lookback: float) -> DataFrame:
    """Adds ``reference_start`` and ``evidence``: the reference reaches ``lookback`` before a fault's start, but not into
    an earlier fault of its day. As-of state is the running maximum of earlier ends."""
    full = F.col(start) - F.lit(float(lookback))
    previous = F.col("previous_end")
    return greatest_before(faults, [day], [start, end, order], F.col(end), "previous_end").withColumns({
        "reference_start": F.least(F.col(start), F.greatest(full, previous)),
        "evidence": F.when(previous > F.col(start), "overlap").when(previous == F.col(start), "boundary").when(previous > full, "clipped").otherwise("full"),
    })


def length_class(length, full: float):
    """zero, full or shortened."""
    return F.when(length == 0, "zero").when(length == full, "full").otherwise("shortened")


def placements(names: DataFrame, raw: str) -> DataFrame:
    """``service``, ``host`` of container names ``host.pod``, split at the last dot; others give no row."""
    part = lambda i: F.regexp_extract(raw, r"^(.*)\.([^.]*)$", i)
    return names.where(F.col(raw).contains(".")).select(part(2).alias("service"), part(1).alias("host")).distinct()


def merge_prior(observed: DataFrame, prior: DataFrame, key: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """Prior relations added to observed ones: full outer join on ``key``, observed wins; a relation that differs in
    ``identity`` is an error. Adds ``origin``: both, observed or prior."""
    a, b = observed.alias("a"), prior.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    both = a.join(b, on, "full_outer")
    clash = F.lit(False)
    for c in identity:
        clash = clash | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    there, here = F.col(f"b.{key[0]}").isNotNull(), F.col(f"a.{key[0]}").isNotNull()
    origin = F.when(here & there & clash, F.raise_error(F.lit("a prior relation has another identity"))).when(here & there, "both").when(here, "observed").otherwise("prior")
    return both.select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in [*key, *identity]), origin.alias("origin"))


def active_bins(relations: DataFrame, cases: DataFrame, delta: float) -> DataFrame:
    """``case_id``, ``id``, ``bin`` of every tumbling bin in which a relation is active.

    Intervals are exploded to the bins that they touch, instead of testing every bin against every interval; the exact
    predicate then decides at the edges.
    """
    own = F.array(F.struct(F.col("start_time").alias("a"), F.col("end_time").alias("b")))
    listed = F.when(F.size("active_intervals") > 0, F.col("active_intervals")).otherwise(own)
    joined = relations.join(cases.select("case_id", "reference_start", "incident_end"), "case_id").select("case_id", "id", "reference_start", "incident_end", F.explode(listed).alias("i"))
    start, width = F.col("reference_start"), F.lit(float(delta))
    last = F.ceil((F.col("incident_end") - start) / width) - 1
    lo = F.greatest(bin_index(F.col("i.a"), start, width) - 1, F.lit(0))
    hi = F.least(bin_index(F.col("i.b"), start, width) + 1, last.cast("bigint"))
    begin = start + F.col("bin") * width
    until = F.least(begin + width, F.col("incident_end"))
    active = is_active(F.array(F.col("i")), F.col("i.a"), F.col("i.b"), begin, until)
    return joined.where(lo <= hi).select("*", F.explode(F.sequence(lo, hi)).alias("bin")).where(active).select("case_id", "id", "bin").distinct()


def pooled_bins(samples: DataFrame, delta: float) -> DataFrame:
    """``case_id``, ``owner``, ``bin``, ``coverage``, ``mean``, ``most``: the mean and maximum over series of their mean
    available value in the bin, and the share of available readings (null means where there are none)."""
    binned = samples.withColumn("bin", bin_index(F.col("time"), F.col("reference_start"), F.lit(float(delta))))
    series = binned.groupBy("case_id", "owner", "bin", "series_id").agg(
        F.avg(F.when(F.col("observed"), F.col("value"))).alias("m"), F.count_if("observed").alias("ok"), F.count("*").alias("n")
    )
    return series.groupBy("case_id", "owner", "bin").agg(
        (F.sum("ok") / F.greatest(F.sum("n"), F.lit(1))).alias("coverage"), F.avg("m").alias("mean"), F.max("m").alias("most")
    )


def radius_pool(logs: DataFrame, cases: DataFrame, value: str, delta: float, radius: float) -> DataFrame:
    """``case_id``, ``owner``, ``bin``, ``mean``, ``weight``: frequency-weighted mean of the records within ``radius`` bins
    of a bin's center (closed). Candidate bins are over-generated by one on either side, then the literal predicate filters."""
    joined = logs.join(cases.select("case_id", "reference_start", "incident_end"), "case_id")
    start, width = F.col("reference_start"), F.lit(float(delta))
    last = (F.ceil((F.col("incident_end") - start) / width) - 1).cast("bigint")
    at = (F.col("time") - start) / width - 0.5
    lo, hi = F.greatest(F.ceil(at - radius).cast("bigint") - 1, F.lit(0)), F.least(F.floor(at + radius).cast("bigint") + 1, last)
    center = start + (F.col("bin") + 0.5) * width
    near = joined.where(lo <= hi).select("*", F.explode(F.sequence(lo, hi)).alias("bin")).where(F.abs(F.col("time") - center) <= radius * width)
    return near.groupBy("case_id", "owner", "bin").agg((F.sum(F.col(value) * F.col("frequency")) / F.sum("frequency")).alias("mean"), F.sum("frequency").alias("weight"))


def context(samples: DataFrame, series: str, order: str, flag: str, reach: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Adds ``elapsed`` (seconds since the reading before, 0 for the first) and ``context`` (any ``flag`` within ``reach``
    positions). Series of more than ``shard_rows`` readings are cut by position, with a halo of ``reach`` readings."""
    cut = sharded(samples, [series], [order], shard_rows, max(reach, 1))
    w = Window.partitionBy(series, "__shard").orderBy(order)
    seen = cut.withColumns({
        "elapsed": F.coalesce(F.col("time") - F.lag("time").over(w), F.lit(0.0)),
        "context": F.max(flag).over(w.rowsBetween(-reach, reach)),
    })
    return seen.where("__core").drop("__shard", "__core")


def population_difference(actual: DataFrame, frozen: DataFrame, key: str) -> DataFrame:
    """``key``, ``side``: missing (frozen only) or extra (actual only)."""
    a = actual.select(F.col(key)).distinct().withColumn("__a", F.lit(True))
    b = frozen.select(F.col(key)).distinct().withColumn("__b", F.lit(True))
    return a.join(b, key, "full_outer").where("__a is null or __b is null").select(key, F.when(F.col("__a").isNull(), "missing").otherwise("extra").alias("side"))


def fan_in(edges: DataFrame, measured: DataFrame) -> DataFrame:
    """``case_id``, ``node``, ``bin``, ``direction``, ``kind``, ``degree``, ``mean``: measured active edges of every node and bin.

    ``edges``: case_id, id, source, target, kind, bin; ``measured``: case_id, id, bin, value.
    """
    joined = edges.join(measured, ["case_id", "id", "bin"])
    ends = F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit("out").alias("direction")), F.struct(F.col("target").alias("node"), F.lit("in").alias("direction"))))
    return joined.select("case_id", "bin", "kind", "value", ends.alias("e")).groupBy("case_id", F.col("e.node").alias("node"), "bin", F.col("e.direction").alias("direction"), "kind").agg(
        F.count("*").alias("degree"), F.avg("value").alias("mean")
    )
