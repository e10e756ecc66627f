"""Exact numbers of connected fragments of one to three edges, without building the triples.

A case is a multigraph of events. Fragments of three edges are parallel edges, a pair of parallel edges with a third one,
stars, paths and triangles. All but triangles follow from degrees: how many edges lead from an event to each entity, in
either direction. Fragments without a repeated entity are counted by products of such numbers over different entities,
and all fragments that touch an entity are those of the graph less those of the graph without its events; the rest
repeat an entity (``revisit``). The only structures that are listed are pairs of neighbours, which triangles need.
Numbers are doubles within and exact up to 2^53.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolith.operators.fragments import FAMILIES
from tremolith.runtime import materialize

REVISIT, MIXED, BRANCH, CONVERGENCE, CHAIN = FAMILIES
#: What rows of counts are of: fragments without a repeated entity, by family, or all that touch the anchor.
ALL = "all"


def _two(x: Column) -> Column:
    return x * (x - 1) / 2


def _three(x: Column) -> Column:
    return x * (x - 1) * (x - 2) / 6


def _rows(df: DataFrame, anchors: list[Column], size: int, counts: dict[str, Column]) -> DataFrame:
    """``case_id``, ``anchor`` (null for the whole case), ``size``, ``family``, ``n`` for each anchor and the case itself."""
    every = F.array(*(F.struct(F.lit(f).alias("family"), c.cast("double").alias("n")) for f, c in counts.items()))
    named = F.array(*(a.cast("string") for a in anchors))
    out = df.select("case_id", named.alias("anchors"), every.alias("cs"))
    out = out.select("case_id", F.explode("anchors").alias("anchor"), "cs").select("case_id", "anchor", F.explode("cs").alias("c"))
    return out.select("case_id", "anchor", F.lit(size).alias("size"), "c.family", "c.n").where("n <> 0")


def _graph(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbours (``v``, ``w``, their entities ``ve``, ``we``, edges out ``o`` and in ``i``, all ``m``), each pair seen from both ends; and
    the events' edges per entity of the neighbour (``o``, ``i``, and sums of ``m``, its square and cube over neighbours)."""
    side = lambda a, b, o, i: F.struct(F.col(a).alias("v"), F.col(b).alias("w"), F.col(f"{a}_entity").alias("ve"), F.col(f"{b}_entity").alias("we"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    halves = links.select("case_id", F.explode(F.array(side("source", "target", 1.0, 0.0), side("target", "source", 0.0, 1.0))).alias("h")).select("case_id", "h.*")
    near = materialize(halves.groupBy("case_id", "v", "w", "ve", "we").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).withColumn("m", F.col("o") + F.col("i")), "neighbours")
    m = F.col("m")
    degrees = near.groupBy("case_id", "v", "ve", "we").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum(m).alias("q1"), F.sum(m * m).alias("q2"), F.sum(m * m * m).alias("q3"))
    return near, materialize(degrees, "degrees")


def _per_event(degrees: DataFrame) -> DataFrame:
    """Adds the event's totals: ``p1`` to ``p3`` over neighbours, and over other entities ``so``, ``si`` and their products."""
    w = Window.partitionBy("case_id", "v")
    proper = lambda c: F.sum(F.when(F.col("we") != F.col("ve"), c).otherwise(0.0)).over(w)
    o, i = F.col("o"), F.col("i")
    return degrees.withColumns({
        "p1": F.sum("q1").over(w), "p2": F.sum("q2").over(w), "p3": F.sum("q3").over(w), "so": proper(o), "si": proper(i), "oo": proper(o * o), "oi": proper(o * i), "ii": proper(i * i),
        "ooo": proper(o * o * o), "ooi": proper(o * o * i), "oii": proper(o * i * i), "iii": proper(i * i * i), "first": F.row_number().over(w.orderBy("we")) == 1,
    })


def _pairs_by_entity(near: DataFrame, degrees: DataFrame) -> DataFrame:
    """Every pair ``v`` to ``w`` with each entity ``a`` beside theirs that either has edges to: ``vo``, ``vi``, ``wo``, ``wi``, ``vq``, ``wq``."""
    pair = ["case_id", "v", "w", "ve", "we", "o", "i", "m"]
    group = lambda end, p: degrees.select("case_id", F.col("v").alias(end), F.col("we").alias("a"), F.col("o").alias(f"{p}o"), F.col("i").alias(f"{p}i"), F.col("q1").alias(f"{p}q"))
    zero = lambda p: [F.lit(0.0).alias(f"{p}{c}") for c in "oiq"]
    cols = lambda p: [F.col(f"{p}{c}") for c in "oiq"]
    left = near.join(group("v", "v"), ["case_id", "v"]).select(*pair, "a", *cols("v"), *zero("w"))
    right = near.join(group("w", "w"), ["case_id", "w"]).select(*pair, "a", *zero("v"), *cols("w"))
    both = left.unionByName(right).where((F.col("a") != F.col("ve")) & (F.col("a") != F.col("we")))
    return both.groupBy(*pair, "a").agg(*(F.sum(f"{p}{c}").alias(f"{p}{c}") for p in "vw" for c in "oiq"))


def counts(links: DataFrame, largest: int = 3) -> DataFrame:
    """``case_id``, ``anchor``, ``size``, ``family``, ``fragments``: numbers of connected fragments of each size and family that
    touch an entity, and of the whole case (null anchor).

    ``links``: case_id, edge, source, target, source_entity, target_entity; an edge joins two different events. Families
    are those of :func:`tremolith.operators.fragments.family`. Nothing of three edges is listed but triangles.
    """
    near, degrees = _graph(links)
    none = F.lit(None).cast("string")
    o, i, m = F.col("o"), F.col("i"), F.col("m")
    V, W, A = F.col("ve"), F.col("we"), F.col("a")
    once, proper = F.col("v") < F.col("w"), F.col("ve") != F.col("we")
    pairs = near.where(once)
    parts = [
        _rows(pairs.where(proper), [V, W, none], 1, {CHAIN: m, ALL: m}), _rows(pairs.where(~proper), [V, none], 1, {ALL: m}),
    ]
    events = materialize(_per_event(degrees), "events")
    event = events.where("first")
    # an event's groups of other entities, and what is left without one of them
    other = events.where(F.col("we") != F.col("ve"))
    O, I = F.col("so"), F.col("si")  # noqa: E741
    O1, I1 = O - o, I - i
    oo1, ii1, oi1 = F.col("oo") - o * o, F.col("ii") - i * i, F.col("oi") - o * i
    p1, p2, p3 = F.col("p1"), F.col("p2"), F.col("p3")
    a1, a2, a3 = p1 - F.col("q1"), p2 - F.col("q2"), p3 - F.col("q3")
    if largest >= 2:
        parts += [
            _rows(pairs.where(proper), [V, W, none], 2, {CHAIN: _two(m), ALL: _two(m)}), _rows(pairs.where(~proper), [V, none], 2, {ALL: _two(m)}),
            _rows(event, [V, none], 2, {BRANCH: (O * O - F.col("oo")) / 2, CONVERGENCE: (I * I - F.col("ii")) / 2, CHAIN: O * I - F.col("oi"), ALL: (p1 * p1 - p2) / 2}),
            _rows(other, [W], 2, {BRANCH: o * O1, CONVERGENCE: i * I1, CHAIN: o * I1 + i * O1, ALL: (p1 * p1 - p2 - a1 * a1 + a2) / 2}),
        ]
    if largest >= 3:
        star = lambda x, y, z: (x * x * x - 3 * x * y + 2 * z) / 6
        two_one = lambda x, y, xx, xy, xxy: (x * x * y - xx * y - 2 * x * xy + 2 * xxy) / 2
        e2o, e2i, mix = (O1 * O1 - oo1) / 2, (I1 * I1 - ii1) / 2, O1 * I1 - oi1
        parts += [
            _rows(pairs.where(proper), [V, W, none], 3, {CHAIN: _three(m)}),
            # stars
            _rows(event, [V, none], 3, {
                BRANCH: star(O, F.col("oo"), F.col("ooo")) + two_one(O, I, F.col("oo"), F.col("oi"), F.col("ooi")),
                CONVERGENCE: star(I, F.col("ii"), F.col("iii")) + two_one(I, O, F.col("ii"), F.col("oi"), F.col("oii")), ALL: star(p1, p2, p3),
            }),
            _rows(other, [W], 3, {BRANCH: o * e2o + o * mix + i * e2o, CONVERGENCE: i * e2i + i * mix + o * e2i, ALL: star(p1, p2, p3) - star(a1, a2, a3)}),
        ]
        # parallel pairs with a third edge at v, and paths whose middle edge leads from v to w
        grouped = materialize(_pairs_by_entity(near, degrees), "pair-entities")
        vo, vi, wo, wi = (F.col(c) for c in ("vo", "vi", "wo", "wi"))
        has_out, no_out, has_in, no_in = _two(o) + o * i, _two(i), _two(i) + o * i, _two(o)
        w = Window.partitionBy("case_id", "v", "w")
        sums = grouped.where(proper).withColumns({
            "xo": F.sum(vo).over(w), "xi": F.sum(vi).over(w), "yo": F.sum(wo).over(w), "yi": F.sum(wi).over(w),
            "s_oi": F.sum(vo * wi).over(w), "s_oo": F.sum(vo * wo).over(w), "s_ii": F.sum(vi * wi).over(w), "s_io": F.sum(vi * wo).over(w), "lead": F.row_number().over(w.orderBy("a")) == 1,
        })
        xo, xi, yo, yi = (F.col(c) for c in ("xo", "xi", "yo", "yi"))
        through = lambda x, xa, y, ya: o * (xa * (y - ya) + ya * (x - xa))
        parts += [
            _rows(sums.where("lead"), [V, W, none], 3, {
                BRANCH: xo * has_out + o * (xo * yo - F.col("s_oo")), CONVERGENCE: xi * has_in + o * (xi * yi - F.col("s_ii")),
                CHAIN: xo * no_out + xi * no_in + o * (xi * yo - F.col("s_io")), MIXED: o * (xo * yi - F.col("s_oi")),
            }),
            _rows(sums, [A], 3, {
                BRANCH: vo * has_out + through(xo, vo, yo, wo), CONVERGENCE: vi * has_in + through(xi, vi, yi, wi),
                CHAIN: vo * no_out + vi * no_in + through(xi, vi, yo, wo), MIXED: through(xo, vo, yi, wi),
            }),
        ]
        # all fragments in which a pair is parallel or the middle: by the degrees of both ends, with and without an entity
        degree = event.select("case_id", F.col("v").alias("x"), F.col("p1").alias("d"))
        ended = pairs.join(degree.withColumnsRenamed({"x": "v", "d": "dv"}), ["case_id", "v"]).join(degree.withColumnsRenamed({"x": "w", "d": "dw"}), ["case_id", "w"])
        ended = materialize(ended, "pairs")
        dv, dw = F.col("dv"), F.col("dw")
        span = lambda x, y: _three(m) + _two(m) * (x + y - 2 * m) + m * (x - m) * (y - m)
        with_entity = grouped.where(once).join(ended.select("case_id", "v", "w", "dv", "dw"), ["case_id", "v", "w"])
        parts += [
            _rows(ended.where(proper), [V, W, none], 3, {ALL: span(dv, dw)}), _rows(ended.where(~proper), [V, none], 3, {ALL: span(dv, dw)}),
            _rows(with_entity, [A], 3, {ALL: span(dv, dw) - span(dv - F.col("vq"), dw - F.col("wq"))}),
        ]
        parts += _triangles(near)
    summed = reduce(DataFrame.unionByName, parts).groupBy("case_id", "anchor", "size", "family").agg(F.sum("n").alias("n"))
    mine = Window.partitionBy("case_id", "anchor", "size")
    rest = F.sum(F.when(F.col("family") == ALL, F.col("n")).otherwise(-F.col("n"))).over(mine)
    named = summed.withColumn("rest", rest)
    out = named.select("case_id", "anchor", "size", F.when(F.col("family") == ALL, REVISIT).otherwise(F.col("family")).alias("family"), F.round(F.when(F.col("family") == ALL, F.col("rest")).otherwise(F.col("n"))).cast("bigint").alias("fragments"))
    return out.where("fragments > 0")


def _triangles(near: DataFrame) -> list[DataFrame]:
    """Triangles: of different entities by direction, and all of them twice less, as each is a path by three middles and a triangle once."""
    up = near.where(F.col("v") < F.col("w")).select("case_id", "v", "w", "ve", "we", "o", "i", "m")
    first = up.select("case_id", F.col("v").alias("x"), F.col("w").alias("y"), F.col("ve").alias("xe"), F.col("we").alias("ye"), F.col("o").alias("o1"), F.col("i").alias("i1"), F.col("m").alias("m1"))
    second = up.select("case_id", F.col("v").alias("x"), F.col("w").alias("z"), F.col("we").alias("ze"), F.col("o").alias("o2"), F.col("i").alias("i2"), F.col("m").alias("m2"))
    third = up.select("case_id", F.col("v").alias("y"), F.col("w").alias("z"), F.col("o").alias("o3"), F.col("i").alias("i3"), F.col("m").alias("m3"))
    found = materialize(first.join(third, ["case_id", "y"]).join(second, ["case_id", "x", "z"]), "triangles")
    X, Y, Z = F.col("xe"), F.col("ye"), F.col("ze")
    every = F.col("m1") * F.col("m2") * F.col("m3")
    # x to y to z to x, and the other way round
    cycles = F.col("o1") * F.col("o3") * F.col("i2") + F.col("i1") * F.col("i3") * F.col("o2")
    none = F.lit(None).cast("string")
    apart = (X != Y) & (Y != Z) & (X != Z)
    kinds = found.withColumn("entities", F.array_distinct(F.array(X, Y, Z)))
    total = kinds.select("case_id", F.explode(F.concat("entities", F.array(none))).alias("anchor"), every.alias("n"))
    return [
        _rows(found.where(apart), [X, Y, Z, none], 3, {CHAIN: cycles, MIXED: every - cycles}),
        total.select("case_id", "anchor", F.lit(3).alias("size"), F.lit(ALL).alias("family"), (-2 * F.col("n")).alias("n")),
    ]
