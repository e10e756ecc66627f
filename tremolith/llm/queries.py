"""Queries of the problems on values, logs and texts: percentiles (1), runs (4), encoding (6), mixing (7), look-alikes (8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolith.llm import canonical_text, mixing, quantiles, runs, tokens
from tremolith.runtime import materialize, spread, table

USABLE = "(observed is null or observed) and value is not null and not isnan(value) and abs(value) < double('infinity')"
KEY = ("dataset_id", "day", "category", "channel")
SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Relative error of the tables of bounded size.
ERROR = 0.01


def _reference_readings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Usable readings of the reference windows (``g``, ``value``, ``series_id``, ``seq``), and the key columns of each ``g``.

    Keys are found once per series, and numbered by what was written, so that shuffles of readings carry 8 bytes instead of
    four texts, and no two keys can meet."""
    cases = table(spark, sf, "incident_case").select("case_id", "dataset_id", "day", "reference_start", "reference_end").dropDuplicates(["case_id"])
    owners = table(spark, sf, "entity_catalog").select("case_id", F.col("id").alias("owner"), F.col("category").alias("owned")).dropDuplicates(["case_id", "owner"])
    samples = table(spark, sf, "numeric_sample")
    category = F.when(F.col("modality") == "trace", "service->service").otherwise(F.col("owned"))
    series = samples.select("series_id", "case_id", "owner", "modality", "channel").distinct()
    series = materialize(
        series.join(cases, "case_id").join(owners, ["case_id", "owner"], "left").select("series_id", *KEY[:2], category.alias("category"), "channel", "reference_start", "reference_end"),
        "series",
    )
    keys = materialize(series.select(*KEY).distinct().withColumn("g", F.monotonically_increasing_id()), "keys")
    named = keys.select("g", *(F.col(c).alias(f"__{c}") for c in KEY))
    same = reduce(lambda a, b: a & b, (series[c].eqNullSafe(named[f"__{c}"]) for c in KEY))
    placed = series.join(named, same).select("series_id", "g", "reference_start", "reference_end")
    readings = samples.where(USABLE).select("series_id", "seq", "time", "value").join(placed, "series_id")
    return readings.where("time >= reference_start and time < reference_end").select("g", "value", "series_id", "seq"), keys


def _daily(spark: SparkSession, sf: str, relative_error: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Frequency table per data set, day, category and channel (``g``), and its keys."""
    readings, keys = _reference_readings(spark, sf)
    return quantiles.frequencies(readings, ["g"], "value", identity=["series_id", "seq"], relative_error=relative_error), keys


def _percents(shares=SHARES) -> list[Column]:
    return [F.col(f"p{i}").alias(f"p{round(100 * q):02d}") for i, q in enumerate(shares)]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Published scales that don't fit their values."""
    daily, keys = _daily(spark, sf)
    values, measured = quantiles.median_and_spread(daily, ["g"])
    published = table(spark, sf, "daily_scale").select(*KEY, "center", "scale").join(keys, list(KEY))
    ranks = values.counts(published, "center")
    mad = 1.4826 * F.col("mad")
    off_center = (F.col("below") > 0.55 * F.col("observations")) | (F.col("upto") < 0.45 * F.col("observations"))
    off_scale = (mad != 0) & (F.abs(F.col("scale") - mad) > 0.25 * mad)
    return (
        published.join(measured.select("g", "mad"), "g")
        .join(ranks, ["g", "center"], "left")
        .where(F.coalesce(off_center, F.lit(False)) | F.coalesce(off_scale, F.lit(False)))
        .select(*KEY)
    )


def p1_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles per data set, day, category and channel."""
    daily, keys = _daily(spark, sf)
    return quantiles.Cumulative(daily, ["g"]).percentiles(SHARES).join(keys, "g").select(*KEY, "observations", *_percents())


def p1_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per channel over all data sets and days, from the combined daily tables."""
    daily, keys = _daily(spark, sf)
    whole = quantiles.merge(daily).join(keys.select("g", "channel"), "g").groupBy("channel", "value").agg(F.sum("n").alias("n"))
    return quantiles.Cumulative(whole, ["channel"]).percentiles(SHARES).select("channel", "observations", *_percents())


def p1_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Whether percentiles from tables of bounded size (1 % buckets) lie within 1 % of the exact ones, per group."""
    daily, keys = _daily(spark, sf)
    daily = materialize(daily, "daily")
    bounded = daily.select("g", quantiles.rounded(F.col("value"), ERROR).alias("value"), "n").groupBy("g", "value").agg(F.sum("n").alias("n"))
    exact = quantiles.Cumulative(daily, ["g"]).percentiles(SHARES, interpolate=False)
    rough = quantiles.Cumulative(bounded, ["g"]).percentiles(SHARES, interpolate=False)
    rough = rough.select("g", *(F.col(f"p{i}").alias(f"r{i}") for i in range(len(SHARES))))
    near = reduce(lambda a, b: a & b, (F.abs(F.col(f"r{i}") - F.col(f"p{i}")) <= ERROR * F.abs(F.col(f"p{i}")) * (1 + 1e-9) for i in range(len(SHARES))))
    return exact.join(rough, "g").join(keys, "g").select(*KEY, "observations", near.alias("within"))


def _runs(spark: SparkSession, sf: str, least: int) -> DataFrame:
    logs = spread(table(spark, sf, "log_record").select("case_id", "owner", "log_id", "time", "text", "frequency"), by=["log_id"]).withColumn("said", runs.message(F.col("text")))
    return runs.collapse_runs(logs, ["case_id", "owner"], id="log_id", time="time", said="said", frequency="frequency", least=least)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of at least two records."""
    return _runs(spark, sf, 2).select(F.col("first_id").alias("first_log_id"), F.col("last_id").alias("last_log_id"))


def p4_runs(spark: SparkSession, sf: str) -> DataFrame:
    """All runs with counts and durations."""
    found = _runs(spark, sf, 1).drop("start_time", "end_time").withColumn("duration", F.round("duration", 3))
    return found.withColumnsRenamed({"first_id": "first_log_id", "last_id": "last_log_id"})


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_documents(_texts(spark, sf))


def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Per document, the characters that its decoded ids give, and whether these are its text."""
    documents = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = materialize(tokens.encode_documents(documents), "ids")
    back = tokens.decode_documents(encoded).withColumnRenamed("text", "decoded")
    same = documents.join(back, "doc_id")
    return same.select("doc_id", F.char_length("decoded").cast("bigint").alias("chars"), (F.col("text") == F.col("decoded")).alias("same"))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    documents = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return mixing.mix(tokens.token_counts(documents, keep=["source"]), table(spark, sf, "mix_target"))


def p7_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Goals, rates and shortfalls of every source for a mix as large as the corpus, with sizes in characters."""
    sizes = table(spark, sf, "documents").select("source", F.coalesce("n_chars", F.lit(0)).alias("tokens"))
    found = mixing.plan(sizes, table(spark, sf, "mix_target"))
    return found.select("source", "documents", "size", F.round("goal", 3).alias("goal"), F.round("rate", 6).alias("rate"), F.round("shortfall", 3).alias("shortfall"), "full")


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents drawn, with their number of copies."""
    return _mixed(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached shares of every source."""
    return _mixed(spark, sf)[1]


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that look the same but aren't equal."""
    return canonical_text.look_alike_pairs(_texts(spark, sf)).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of every document whose text isn't blank, and the documents of other texts that look like it."""
    return canonical_text.look_alike_classes(_texts(spark, sf))


def p8_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent form of every document."""
    return canonical_text.canonical_documents(_texts(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_percentiles, p1_merged, p1_bounded, p4_found, p4_runs, p6_ids, p6_round_trip, p7_mix, p7_shares, p7_plan, p8_found, p8_classes, p8_forms)}

_READINGS = """
WITH n AS (
  SELECT DISTINCT s.series_id, s.seq, c.dataset_id, c.day, s.channel, s.value,
    CASE WHEN s.modality = 'trace' THEN 'service->service' ELSE e.category END AS category
  FROM numeric_sample s JOIN incident_case c USING (case_id)
  LEFT JOIN (SELECT DISTINCT case_id, id, category FROM entity_catalog) e ON e.case_id = s.case_id AND e.id = s.owner
  WHERE (s.observed IS NULL OR s.observed) AND s.value IS NOT NULL AND isfinite(s.value)
    AND s.time >= c.reference_start AND s.time < c.reference_end)
"""
_QUANTILES = ", ".join(f"quantile_cont(value, {q}) AS p{round(100 * q):02d}" for q in SHARES)

_MESSAGE = "lower(text)"
for _pattern, _by in (
    (r"\s+", " "),
    (r"^ ?(\d{4}-\d\d-\d\dt\d\d:\d\d:\d\d\.\d+z ?)+", ""),
    (r"\b(request|trace|span)([_-]?id) ?[=:] ?[\w-]+", r"\1\2=#"),
    (r"\b[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "#"),
    (r"\b(service|host|pod|node):[\w-]+", "#"),
    (r"\b[a-z]+(-[a-z0-9]+)*-[0-9a-f]{7,10}-[a-z0-9]{5}\b", "#"),
    (r"\b(\d{1,3}\.){3}\d{1,3}(:\d+)?\b", "#"),
    (r"\b[0-9a-f]{9,}\b", "#"),
    (r"\b\d+(\.\d+)?( ?(s|ms|us|ns|bytes|days|min|h)\b| ?%)?", "#"),
):
    _MESSAGE = f"regexp_replace({_MESSAGE}, '{_pattern}', '{_by}', 'g')"

_LOGS = f"""
WITH r AS (SELECT log_id, any_value(case_id) AS case_id, any_value(owner) AS owner, any_value(time) AS time,
    trim(min({_MESSAGE})) AS said, any_value(coalesce(frequency, 1)) AS frequency FROM log_record GROUP BY log_id),
b AS (SELECT *, CASE WHEN said = lag(said) OVER w THEN 0 ELSE 1 END AS begins FROM r WHERE owner IS NOT NULL
  WINDOW w AS (PARTITION BY case_id, owner ORDER BY time, log_id)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY case_id, owner ORDER BY time, log_id) AS run FROM b),
f AS (SELECT case_id, owner, arg_min(log_id, (time, log_id)) AS first_log_id, arg_max(log_id, (time, log_id)) AS last_log_id,
  round(max(time) - min(time), 3) AS duration, count(*) AS records, CAST(sum(frequency) AS BIGINT) AS occurrences FROM g GROUP BY case_id, owner, run)
"""

SQL = {
    "p1_found": _READINGS
    + """, m AS (SELECT dataset_id, day, category, channel, median(value) AS med FROM n GROUP BY ALL),
d AS (SELECT n.*, abs(n.value - m.med) AS dev FROM n JOIN m USING (dataset_id, day, category, channel)),
a AS (SELECT dataset_id, day, category, channel, 1.4826 * median(dev) AS spread FROM d GROUP BY ALL)
SELECT dataset_id, day, category, channel FROM (
  SELECT p.dataset_id, p.day, p.category, p.channel, p.center, p.scale, a.spread, count(*) AS total,
    count(*) FILTER (n.value < p.center) AS below, count(*) FILTER (n.value <= p.center) AS upto
  FROM daily_scale p JOIN a USING (dataset_id, day, category, channel) JOIN n USING (dataset_id, day, category, channel) GROUP BY ALL)
WHERE below > 0.55 * total OR upto < 0.45 * total OR (spread <> 0 AND abs(scale - spread) > 0.25 * spread)""",
    "p1_percentiles": _READINGS + f"SELECT dataset_id, day, category, channel, count(*) AS observations, {_QUANTILES} FROM n GROUP BY ALL",
    "p1_merged": _READINGS + f"SELECT channel, count(*) AS observations, {_QUANTILES} FROM n GROUP BY ALL",
    "p1_bounded": _READINGS + "SELECT dataset_id, day, category, channel, count(*) AS observations, true AS within FROM n GROUP BY ALL",
    "p6_round_trip": "SELECT doc_id, coalesce(length(text), 0) AS chars, true AS same FROM documents",
    "p7_plan": """
WITH RECURSIVE d AS (SELECT source, count(*) AS documents, CAST(sum(n_chars) AS DOUBLE) AS size FROM documents WHERE n_chars > 0 GROUP BY source),
s AS (SELECT t.source, t.weight AS w, coalesce(d.documents, 0) AS documents, coalesce(d.size, 0) AS size, t.max_repeats * coalesce(d.size, 0) AS room FROM mix_target t LEFT JOIN d USING (source)),
a AS (SELECT sum(size) AS total, sum(w) AS weights FROM s),
-- sources that their share would overfill are full; what they leave is spread over the others, until none is overfilled
it(k, lam) AS (SELECT 0, (SELECT total FROM a) / (SELECT sum(w) FROM s WHERE size > 0)
  UNION ALL SELECT k + 1, (SELECT ((SELECT total FROM a) - coalesce(sum(room) FILTER (room <= w * it.lam), 0)) / sum(w) FILTER (room > w * it.lam) FROM s WHERE size > 0) FROM it WHERE k < 20),
lam AS (SELECT arg_max(lam, k) AS lam FROM it),
g AS (SELECT s.*, CASE WHEN size = 0 THEN 0 WHEN lam IS NULL THEN room ELSE least(room, w * lam) END AS goal FROM s, lam)
SELECT source, documents, CAST(size AS BIGINT) AS size, round(goal, 3) AS goal, round(CASE WHEN size > 0 THEN goal / size ELSE 0 END, 6) AS rate,
  round(greatest(w / weights * total - goal, 0), 3) AS shortfall, size > 0 AND goal >= room AS full FROM g, a""",
    "p4_found": _LOGS + "SELECT first_log_id, last_log_id FROM f WHERE records >= 2",
    "p4_runs": _LOGS + "SELECT case_id, owner, first_log_id, last_log_id, duration, records, occurrences FROM f",
}
