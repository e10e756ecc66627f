"""Call edges that later cases inherit from the earliest permitted reference window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolith.operators.observations import relation_id
from tremolith.operators.relations import distinct_spans, parent_links
from tremolith.runtime import few


def earliest_reference(windows: DataFrame, permitted: DataFrame) -> DataFrame:
    """One row: ``case_id``, ``reference_start``, ``reference_end`` of the earliest reference that isn't empty, of the permitted
    cases. None of them having one is an error when the row is read."""
    key = F.struct("reference_start", "reference_end", "case_id")
    open_ = windows.join(permitted.select("case_id").distinct(), "case_id", "left_semi").where(F.col("reference_start") < F.col("reference_end"))
    found = open_.agg(F.min(key).alias("w"))
    sure = F.when(F.col("w").isNotNull(), F.col("w")).otherwise(F.raise_error(F.lit("no permitted reference window")).cast(found.schema["w"].dataType))
    return found.select(sure.alias("w")).select("w.case_id", "w.reference_start", "w.reference_end")


def static_calls(spans: DataFrame, reference: DataFrame) -> DataFrame:
    """``id``, ``source``, ``target``, ``times`` of the calls between services whose child span lies within the reference window.

    ``spans``: trace, span, parent, service, time. Only spans of the window take part, on either end; times are sorted and
    each stands for an interval of no length. Copies of a span must agree. A call within one service is none.
    """
    w = reference.select("reference_start", "reference_end").first()  # one row by construction
    inside = spans.where(F.col("time").between(w["reference_start"], w["reference_end"]) & (F.col("time") < w["reference_end"]))
    once = distinct_spans(inside.select("trace", "span", "parent", "service", "time"), ["trace", "span"], ["time"])
    calls = parent_links(once).where((F.col("link") == "call") & (F.col("parent_service") != F.col("service")))
    edges = calls.groupBy(F.col("parent_service").alias("source"), F.col("service").alias("target")).agg(F.array_sort(F.collect_set("time")).alias("times"))
    return edges.select(relation_id(F.lit("call"), F.col("source"), F.col("target")).alias("id"), "source", "target", "times")


def inherit(relations: DataFrame, static: DataFrame, cases: DataFrame) -> DataFrame:
    """Relations of all cases with the static calls added: ``case_id``, ``id``, ``source``, ``target``, ``kind``, ``active_intervals``,
    ``origin`` (observed, inherited, both).

    A static call is active over a case's reference and incident windows, and takes the place of an observed call of its
    id; one that names other endpoints is an error. The static calls are one catalog's edges, joined with every case.
    """
    spans = F.filter(F.array(F.struct(F.col("reference_start").alias("a"), F.col("reference_end").alias("b")), F.struct(F.col("incident_start").alias("a"), F.col("incident_end").alias("b"))), lambda i: i["a"] < i["b"])
    calls = few(static.select("id", "source", "target"))
    added = cases.select("case_id", spans.alias("active_intervals")).join(calls).select("case_id", "id", "source", "target", F.lit("call").alias("kind"), "active_intervals")
    both = relations.alias("o").join(added.alias("i"), ["case_id", "id"], "full_outer")
    clash = F.col("o.source").isNotNull() & F.col("i.source").isNotNull() & ((F.col("o.source") != F.col("i.source")) | (F.col("o.target") != F.col("i.target")) | (F.col("o.kind") != "call"))
    pick = lambda c: F.coalesce(F.col(f"i.{c}"), F.col(f"o.{c}")).alias(c)
    origin = F.when(clash, F.raise_error(F.lit("a static call has another identity"))).when(F.col("i.source").isNull(), "observed").when(F.col("o.source").isNull(), "inherited").otherwise("both")
    return both.select("case_id", "id", *(pick(c) for c in ("source", "target", "kind", "active_intervals")), origin.alias("origin"))
