"""Queries of the problems on readings and intervals: regular grids (2), active periods (3), implausible readings (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolith.operators.control_chart import implausible_readings
from tremolith.operators.intervals import interval_gaps, interval_periods
from tremolith.operators.regular_grid import regular_grid
from tremolith.runtime import materialize, table

USABLE = "(observed is null or observed) and value is not null and not isnan(value) and abs(value) < double('infinity')"


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "incident_case").select("case_id", F.col("reference_start").alias("start"), "incident_end").dropDuplicates(["case_id"])
    channels = table(spark, sf, "channel_catalog").select("channel", F.col("period_s").cast("double").alias("period"))
    samples = table(spark, sf, "numeric_sample")
    bins = F.rint((F.col("incident_end") - F.col("start")) / F.col("period")).cast("bigint")
    placed = lambda df: df.join(cases, "case_id").join(channels, "channel").withColumn("bins", bins)
    # one row per series, read for its grid and for its density
    sources = materialize(placed(samples.groupBy("series_id", "case_id", "channel").agg(F.count("*").alias("readings"))), "sources")
    return regular_grid(placed(samples.where(USABLE)), sources, "series_id", count="readings")


def p2_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every series on the grid of its channel."""
    # single precision, which any order of operations gives
    return _grid(spark, sf).withColumn("value", F.col("value").cast("float").cast("double"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Periods without any usable reading."""
    return _grid(spark, sf).where(~F.col("observed")).select("series_id", "bin")


def _active(spark: SparkSession, sf: str) -> DataFrame:
    """Reported intervals of every relation in whole milliseconds."""
    reports = table(spark, sf, "topology_relation")
    own = F.array(F.struct(F.col("start_time").alias("a"), F.col("end_time").alias("b")))
    listed = F.when(F.size("active_intervals") > 0, F.col("active_intervals")).otherwise(own)
    ms = lambda c: F.rint(F.col(c) * 1000).cast("bigint")
    return reports.select("case_id", "id", F.explode(listed).alias("i")).select("case_id", "id", ms("i.a").alias("lo"), ms("i.b").alias("hi"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps of every relation."""
    gaps = interval_gaps(_active(spark, sf), ["case_id", "id"], "lo", "hi")
    return gaps.select("case_id", "id", F.col("gap_start").alias("gap_start_ms"), F.col("gap_end").alias("gap_end_ms"))


def p3_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous active periods of every relation."""
    return interval_periods(_active(spark, sf), ["case_id", "id"], "lo", "hi")


def p5_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Implausible readings with the reasons."""
    limits = table(spark, sf, "channel_catalog").select("channel", "lowest", "highest")
    usable = table(spark, sf, "numeric_sample").where(USABLE).select("series_id", "seq", "value", "channel")
    return implausible_readings(usable.join(limits, "channel", "left"), "series_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Implausible readings."""
    return p5_flags(spark, sf).select("series_id", "seq")


QUERIES = {f.__name__: f for f in (p2_found, p2_grid, p3_found, p3_periods, p5_found, p5_flags)}

_MERGED = """
WITH i AS (
  SELECT case_id, id, unnest(CASE WHEN len(active_intervals) > 0 THEN active_intervals
    ELSE [{'a': start_time, 'b': end_time}] END) AS x FROM topology_relation),
r AS (SELECT DISTINCT case_id, id, CAST(round(x.a * 1000) AS BIGINT) AS lo, CAST(round(x.b * 1000) AS BIGINT) AS hi FROM i),
s AS (SELECT *, max(hi) OVER (PARTITION BY case_id, id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM r WHERE lo <= hi)
"""

# the same cubic over whole series, from the last reading at or before a period's middle and its neighbours
_INNER = "CASE WHEN sign({d0}) * sign({d1}) <= 0 THEN 0 ELSE ((2 * {h1} + {h0}) + ({h1} + 2 * {h0})) / ((2 * {h1} + {h0}) / {d0} + ({h1} + 2 * {h0}) / {d1}) END"
_EDGE = "(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
_END = f"CASE WHEN sign({_EDGE}) <> sign({{d0}}) THEN 0 WHEN sign({{d0}}) <> sign({{d1}}) AND abs({_EDGE}) > 3 * abs({{d0}}) THEN 3 * {{d0}} ELSE {_EDGE} END"
_CUBIC = f"""
WITH g AS (SELECT s.series_id, c.reference_start AS t0, k.period_s AS p, CAST(round((c.incident_end - c.reference_start) / k.period_s) AS BIGINT) AS n
  FROM (SELECT series_id, min(case_id) AS case_id, min(channel) AS channel FROM numeric_sample GROUP BY 1) s JOIN incident_case c USING (case_id) JOIN channel_catalog k USING (channel)),
u AS (SELECT series_id, (round_even((r.time - t0) * 1e6, 0) / 1e6) / p AS x, r.value AS y, n FROM numeric_sample r JOIN g USING (series_id)
  WHERE (observed IS NULL OR observed) AND value IS NOT NULL AND isfinite(value)),
q AS (SELECT series_id, x, (min(y) + max(y)) / 2 AS y FROM u WHERE x >= 0 AND x < n GROUP BY series_id, x),
w AS (SELECT *, lag(x) OVER o AS xp, lag(y) OVER o AS yp, lead(x) OVER o AS x1, lead(y) OVER o AS y1, lead(x, 2) OVER o AS x2, lead(y, 2) OVER o AS y2 FROM q WINDOW o AS (PARTITION BY series_id ORDER BY x)),
f AS (SELECT series_id, min(x) AS fx, arg_min(y, x) AS fy FROM q GROUP BY series_id),
b AS (SELECT g.series_id, t0, p, b.bin, b.bin + 0.5 AS mid FROM g, unnest(range(n)) AS b(bin)),
a AS (SELECT b.*, w.x, w.y, w.xp, w.yp, CASE WHEN w.x IS NULL THEN f.fx ELSE w.x1 END AS x1, CASE WHEN w.x IS NULL THEN f.fy ELSE w.y1 END AS y1, w.x2, w.y2
  FROM b ASOF LEFT JOIN w ON w.series_id = b.series_id AND w.x <= b.mid LEFT JOIN f ON f.series_id = b.series_id),
h AS (SELECT *, x1 - x AS h, x - xp AS hp, x2 - x1 AS hn, (y1 - y) / (x1 - x) AS d, (y - yp) / (x - xp) AS dp, (y2 - y1) / (x2 - x1) AS dn, (mid - x) / (x1 - x) AS t,
  coalesce(bin = floor(x), false) AS after, coalesce(bin = floor(x1), false) AS before FROM a),
m AS (SELECT *, CASE WHEN hp <= 5 THEN {_INNER.format(h0='hp', h1='h', d0='dp', d1='d')} WHEN hn <= 5 THEN {_END.format(h0='h', h1='hn', d0='d', d1='dn')} ELSE d END AS m0,
  CASE WHEN hn <= 5 THEN {_INNER.format(h0='h', h1='hn', d0='d', d1='dn')} WHEN hp <= 5 THEN {_END.format(h0='h', h1='hp', d0='d', d1='dp')} ELSE d END AS m1 FROM h)
SELECT series_id, bin, t0 + mid * p AS time, after OR before AS observed, CASE WHEN after OR before THEN 'observed' WHEN h <= 5 THEN 'filled' ELSE 'missing' END AS status,
  CAST(CAST(CASE WHEN h <= 5 THEN y * (1 + 2 * t) * (1 - t) * (1 - t) + h * m0 * t * (1 - t) * (1 - t) + y1 * t * t * (3 - 2 * t) + h * m1 * t * t * (t - 1) WHEN after THEN y WHEN before THEN y1 END AS FLOAT) AS DOUBLE) AS value FROM m
"""

SQL = {
    "p2_grid": _CUBIC,
    "p2_found": """
SELECT s.series_id, b.bin
FROM (SELECT series_id, min(case_id) AS case_id, min(channel) AS channel FROM numeric_sample GROUP BY 1) s
JOIN incident_case c USING (case_id) JOIN channel_catalog k USING (channel),
unnest(range(CAST(round((c.incident_end - c.reference_start) / k.period_s) AS BIGINT))) AS b(bin)
WHERE NOT EXISTS (
  SELECT 1 FROM numeric_sample n WHERE n.series_id = s.series_id AND (n.observed IS NULL OR n.observed)
    AND n.value IS NOT NULL AND isfinite(n.value)
    AND CAST(floor((n.time - c.reference_start) / k.period_s) AS BIGINT) = b.bin)
""",
    "p3_found": _MERGED + "SELECT case_id, id, seen AS gap_start_ms, lo AS gap_end_ms FROM s WHERE lo > seen",
    "p3_periods": _MERGED
    + """, g AS (SELECT *, sum(CASE WHEN lo > seen THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, id ORDER BY lo, hi) AS island FROM s)
SELECT case_id, id, min(lo) AS period_start, max(hi) AS period_end FROM g GROUP BY case_id, id, island""",
}
