"""Queries of the incident-analysis operators over the supplied tables, with the SQL that defines their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolith.operators import observations as obs
from tremolith.operators import relations, statistics
from tremolith.runtime import materialize, table

DELTA = 300.0
EVENT_DELTA = 900.0
EPOCH = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})/1e6D"

#: name -> query, name -> SQL
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def single(c):
    """A double with the digits that survive any order of summation."""
    return c.cast("float").cast("double")


# --- the tables that the queries share -------------------------------------------------------------------------------

_BASE = """
WITH cases AS (SELECT * FROM incident_case),
ent AS (SELECT DISTINCT case_id, id, category, candidate FROM entity_catalog),
rel AS (SELECT DISTINCT case_id, id, source, target, kind, owner, response FROM topology_relation),
s AS (
  SELECT DISTINCT n.series_id, n.seq, n.case_id, n.modality, n.owner, n.channel, n.time, c.reference_start, c.incident_start, c.incident_end,
    CASE WHEN coalesce(n.observed, true) AND isfinite(n.value) THEN n.value ELSE 0 END AS value,
    coalesce(coalesce(n.observed, true) AND isfinite(n.value), false) AS observed,
    CASE WHEN n.modality = 'trace' THEN es.category || '->' || et.category ELSE e.category END AS category
  FROM numeric_sample n JOIN cases c USING (case_id)
  LEFT JOIN ent e ON e.case_id = n.case_id AND e.id = n.owner
  LEFT JOIN rel r ON r.case_id = n.case_id AND r.id = n.owner
  LEFT JOIN ent es ON es.case_id = n.case_id AND es.id = r.source
  LEFT JOIN ent et ON et.case_id = n.case_id AND et.id = r.target),
pool AS (SELECT * FROM s WHERE observed AND time >= reference_start AND time < incident_start),
med AS (SELECT category, channel, median(value) AS center, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, count(*) AS observations FROM pool GROUP BY ALL),
dev AS (SELECT category, channel, 1.4826 * median(abs(value - center)) AS mad, max(abs(value - center)) AS amp, stddev_pop(value - center) AS sd FROM pool JOIN med USING (category, channel) GROUP BY ALL),
scale AS (SELECT category, channel, center, observations, CASE WHEN mad <> 0 THEN mad WHEN q75 <> q25 THEN (q75 - q25) / 1.349 WHEN amp <> 0 THEN sd ELSE 1.0 END AS scale
  FROM med JOIN dev USING (category, channel)),
z AS (SELECT s.*, CASE WHEN s.observed AND k.scale > 0 THEN (s.value - k.center) / k.scale ELSE 0 END AS z, coalesce(s.observed AND k.scale > 0, false) AS supported
  FROM s LEFT JOIN scale k USING (category, channel)),
logs AS (SELECT log_id, any_value(case_id) AS case_id, any_value(owner) AS owner, any_value(time) AS time, min(text) AS text, any_value(coalesce(frequency, 1)) AS frequency FROM log_record GROUP BY log_id)
"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "incident_case").dropDuplicates(["case_id"])


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entity_catalog").dropDuplicates(["case_id", "id"])


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Every reading once, with its case's windows, masked value and the category of its owner or call."""
    n = table(spark, sf, "numeric_sample").select("series_id", "seq", "case_id", "modality", "owner", "channel", "time", "value", "observed").distinct()
    value, ok = obs.masked(F.col("value"), F.col("observed"))
    cat = entities(spark, sf).select("case_id", "id", "category")
    ends = table(spark, sf, "topology_relation").select("case_id", "id", "source", "target").dropDuplicates(["case_id", "id"])
    calls = (
        ends.join(cat.select("case_id", F.col("id").alias("source"), F.col("category").alias("cs")), ["case_id", "source"])
        .join(cat.select("case_id", F.col("id").alias("target"), F.col("category").alias("ct")), ["case_id", "target"])
        .select("case_id", "id", F.concat_ws("->", "cs", "ct").alias("category"))
    )
    owners = cat.unionByName(calls).withColumnRenamed("id", "owner")
    window = cases(spark, sf).select("case_id", "reference_start", "incident_start", "incident_end")
    return n.withColumns({"value": value, "observed": ok}).join(window, "case_id").join(owners, ["case_id", "owner"], "left")


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Every log record once."""
    rows = table(spark, sf, "log_record").groupBy("log_id").agg(F.min(F.struct("text", "case_id", "owner", "time", F.coalesce("frequency", F.lit(1)).alias("frequency"))).alias("r"))
    return rows.select("log_id", "r.*")


def _pool(s: DataFrame) -> DataFrame:
    return s.where("observed and time >= reference_start and time < incident_start")


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Every reading with its z-score; readings are written once, for their statistics and for themselves."""
    s = materialize(samples(spark, sf), "samples")
    stats = statistics.robust_scale(_pool(s), ["category", "channel"], "value")
    z, ok = obs.standardised(F.when(F.col("observed"), F.col("value")), F.col("center"), F.col("scale"))
    return s.join(stats, ["category", "channel"], "left").withColumns({"z": z, "supported": ok})


# --- statistics ------------------------------------------------------------------------------------------------------


@query(_BASE + "SELECT category, channel, center, round(scale, 6) AS scale, observations FROM scale")
def robust_scale_stats(spark, sf):
    found = statistics.robust_scale(_pool(samples(spark, sf)), ["category", "channel"], "value")
    return found.select("category", "channel", "center", F.round("scale", 6).alias("scale"), "observations")


@query(_BASE + """, d AS (SELECT series_id, time - lag(time) OVER (PARTITION BY series_id ORDER BY time, seq) AS step, count(*) OVER (PARTITION BY series_id) AS n FROM pool),
m AS (SELECT series_id, median(step) AS p FROM d WHERE n >= 3 AND step > 0 GROUP BY 1)
SELECT round(median(p), 6) AS delta, count(*) AS series FROM m""")
def grid_interval(spark, sf):
    found = statistics.grid_interval(_pool(samples(spark, sf)), "series_id", "time", "seq")
    return found.select(F.round("delta", 6).alias("delta"), "series")


@query(_BASE + """SELECT series_id, seq, round(z, 4) AS z, supported,
CASE WHEN NOT supported THEN 'unknown' WHEN z < -1 THEN 'low' WHEN z > 1 THEN 'high' ELSE 'reference-band' END AS band FROM z""")
def zscore_samples(spark, sf):
    return _scaled(spark, sf).select("series_id", "seq", F.round("z", 4).alias("z"), "supported", obs.band(F.col("z"), F.col("supported")).alias("band"))


@query(_BASE + """SELECT case_id, owner, channel, count(*) FILTER (observed AND time >= reference_start AND time < incident_start) AS observations FROM s
GROUP BY case_id, owner, channel HAVING bool_or(time >= incident_start) AND count(*) FILTER (observed AND time >= reference_start AND time < incident_start) < 20""")
def unsupported_channels(spark, sf):
    """Channels of an owner that occur in the incident, but hardly in the case's own reference."""
    s = samples(spark, sf).select("case_id", "owner", "channel", "time", "observed", "reference_start", "incident_start")
    return statistics.thin_references(s, ["case_id", "owner", "channel"], 20)


@query(_BASE + """SELECT c.dataset_id, n.modality, count(*) AS records,
count(*) FILTER (NOT ((n.time >= c.reference_start AND n.time < c.reference_end) OR (n.time >= c.incident_start AND n.time < c.incident_end))) AS outside
FROM numeric_sample n JOIN cases c USING (case_id) GROUP BY ALL""")
def window_membership_audit(spark, sf):
    n = table(spark, sf, "numeric_sample").select("case_id", "modality", "time")
    inside = obs.inside_windows(*(F.col(c) for c in ("time", "reference_start", "reference_end", "incident_start", "incident_end")))
    return n.join(cases(spark, sf), "case_id").groupBy("dataset_id", "modality").agg(F.count("*").alias("records"), F.count_if(~inside).alias("outside"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, 'hist/' || h.part AS channel, h.value FROM lineitem,
unnest([{'part': 'count', 'value': CAST(l_linenumber AS DOUBLE)}, {'part': 'sum', 'value': l_extendedprice}, {'part': 'min', 'value': l_discount}, {'part': 'max', 'value': l_quantity}]) AS u(h)""")
def histogram_unpivot(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("count"), F.col("l_extendedprice").alias("sum"), F.col("l_discount").alias("min"), F.col("l_quantity").alias("max"))
    return obs.histogram_channels(rows, ["l_orderkey", "l_partkey", "l_suppkey"], F.lit("hist"))


# --- names and identities --------------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT DISTINCT case_id, regexp_extract(identity, 'pod=([^,]+)', 1) AS pod FROM numeric_sample WHERE identity LIKE '%pod=%'),
k AS (SELECT DISTINCT case_id, id FROM entity_catalog WHERE id LIKE 'service:%' AND candidate),
q AS (SELECT *, 'service:' || pod AS whole, 'service:' || regexp_replace(pod, '-(\d+|[0-9a-f]{8,10}-[a-z0-9]{5})$', '') AS short FROM p)
SELECT q.case_id, q.pod, coalesce(a.id, b.id, q.short) AS resolved FROM q LEFT JOIN k a ON a.case_id = q.case_id AND a.id = q.whole LEFT JOIN k b ON b.case_id = q.case_id AND b.id = q.short""")
def owner_resolution(spark, sf):
    pods = table(spark, sf, "numeric_sample").where("identity like '%pod=%'").select("case_id", F.regexp_extract("identity", "pod=([^,]+)", 1).alias("pod")).distinct()
    return obs.resolve_owner(pods, "pod", table(spark, sf, "entity_catalog").where("candidate"))


@query(r"""SELECT kind, count(*) AS rows_, count(DISTINCT owner) AS owners FROM (
SELECT CASE WHEN identity LIKE '%pod=%' THEN regexp_replace(regexp_extract(identity, 'pod=([^,]+)', 1), '-[0-9a-fA-F]{8,10}(-[a-z0-9]{5})?$', '') ELSE replace(owner, 'service:', '') END AS owner,
CASE WHEN identity LIKE '%pod=%' THEN 'resource' ELSE 'direct' END AS kind FROM numeric_sample WHERE modality = 'metric') GROUP BY kind""")
def metric_owner_kinds(spark, sf):
    pod = F.nullif(F.regexp_extract(F.coalesce("identity", F.lit("")), "pod=([^,]+)", 1), F.lit(""))
    rows = table(spark, sf, "numeric_sample").where("modality = 'metric'").select("channel", pod.alias("pod"), F.when(pod.isNull(), F.replace("owner", F.lit("service:"), F.lit(""))).alias("service_name"))
    owned = rows.select(obs.metric_owner(F.col("channel"), rows.columns).alias("o"))
    return owned.groupBy(F.col("o.kind").alias("kind")).agg(F.count("*").alias("rows_"), F.countDistinct("o.owner").alias("owners"))


@query(r"""WITH n AS (SELECT lower(n_name) || CASE WHEN s_suppkey % 2 = 0 THEN 'service' ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN '2' ELSE '' END || CASE WHEN s_suppkey % 5 < 3 THEN '-' || (s_suppkey % 4) ELSE '' END AS name
FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT DISTINCT name, CASE WHEN regexp_matches(name, '^(.*?service)(?:\d+)?-\d+$') THEN regexp_extract(name, '^(.*?service)(?:\d+)?-\d+$', 1)
WHEN regexp_matches(name, '^(.*?)(?:\d+)-\d+$') THEN regexp_extract(name, '^(.*?)(?:\d+)-\d+$', 1) WHEN regexp_matches(name, '^(.*?)-\d+$') THEN regexp_extract(name, '^(.*?)-\d+$', 1)
WHEN regexp_matches(name, '^(.*?service)\d+$') THEN regexp_extract(name, '^(.*?service)\d+$', 1) ELSE name END AS service FROM n""")
def replica_names(spark, sf):
    key = F.col("s_suppkey")
    name = F.concat(F.lower("n_name"), F.when(key % 2 == 0, "service").otherwise(""), F.when(key % 3 == 0, "2").otherwise(""), F.when(key % 5 < 3, F.concat(F.lit("-"), (key % 4).cast("string"))).otherwise(""))
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(name.alias("name")).distinct()
    return rows.select("name", obs.replica_name(F.col("name")).alias("service"))


@query("""SELECT DISTINCT kind, source, target, kind || ':' || substr(sha256('["' || kind || '","' || source || '","' || target || '"]'), 1, 24) AS id FROM topology_relation""")
def relation_ids(spark, sf):
    rows = table(spark, sf, "topology_relation").select("kind", "source", "target").distinct()
    return rows.withColumn("id", obs.relation_id(F.col("kind"), F.col("source"), F.col("target")))


# RE2 has no look-around: the character before an id is kept, and a second pass takes ids that shared one
_PASS = r"""list_reduce(list_prepend({text}, ids), lambda t, n: CASE WHEN contains(t, n)
THEN regexp_replace(t, '(^|[^\pL\pN_])' || regexp_replace(n, '([^\pL\pN_])', '\\\1', 'g') || '($|[^\pL\pN_])', '\1<ENTITY>\2', 'g') ELSE t END)"""
_SANITIZED = _PASS.format(text=_PASS.format(text="text"))
_SANITIZED = rf"regexp_replace(regexp_replace(regexp_replace(coalesce({_SANITIZED}, text), '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b', '<IP>', 'g'), '\b[0-9a-fA-F]{{8}}(?:-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}\b', '<UUID>', 'g'), '(?i)\b(request[_-]?id|trace[_-]?id|span[_-]?id)\s*[=:]\s*[\w-]+', '\1=<REQUEST>', 'g')"


@query(_BASE + f""", ids AS (SELECT case_id, list(id ORDER BY length(id) DESC, id) AS ids FROM (SELECT DISTINCT case_id, id FROM entity_catalog) GROUP BY case_id)
SELECT log_id, {_SANITIZED} AS text FROM logs LEFT JOIN ids USING (case_id)""")
def sanitized_logs(spark, sf):
    """Masks all catalog ids of each record's case."""
    return obs.sanitize_by_catalog(logs(spark, sf), entities(spark, sf)).select("log_id", "text")


# --- spans, windows, placement, topology -----------------------------------------------------------------------------

_SPANS = """
WITH d AS (SELECT l_orderkey AS trace, l_linenumber AS span, epoch_us(l_shipdate) / 1e6 AS time, l_partkey AS part, l_suppkey AS supp, l_quantity AS duration FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY trace, span ORDER BY time, part, supp, duration) AS k FROM d),
spans AS (SELECT trace, span, CASE WHEN span = 1 THEN '0' ELSE CAST(span - 1 AS VARCHAR) END AS parent, supp % 10 AS service, time, duration FROM p WHERE k = 1),
linked AS (SELECT c.*, q.service AS parent_service, CASE WHEN c.parent = '0' THEN 'parentless' WHEN q.span IS NULL THEN 'unresolved' ELSE 'call' END AS link
  FROM spans c LEFT JOIN spans q ON c.trace = q.trace AND c.parent = CAST(q.span AS VARCHAR))
"""


def _raw_spans(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("trace"), F.col("l_linenumber").cast("string").alias("span"), F.expr(EPOCH.format("l_shipdate")).alias("time"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("duration"), (F.col("l_linenumber") - 1).cast("string").alias("parent"),
    )


def _linked(spark, sf):
    spans = relations.distinct_spans(_raw_spans(spark, sf), ["trace", "span"], ["time", "part", "supp", "duration"], conflicts="least")
    return relations.parent_links(spans.withColumn("service", F.col("supp") % 10))


@query(_SPANS + "SELECT trace, CAST(span AS VARCHAR) AS span, count(*) AS copies, count(DISTINCT (time, part, supp, duration)) AS versions FROM d GROUP BY ALL HAVING count(*) > 1")
def span_conflicts(spark, sf):
    return relations.span_conflicts(_raw_spans(spark, sf), ["trace", "span"], ["time", "part", "supp", "duration"])


@query(_SPANS + "SELECT link, count(*) AS spans FROM linked GROUP BY link")
def span_audit_counts(spark, sf):
    return _linked(spark, sf).groupBy("link").agg(F.count("*").alias("spans"))


@query(_SPANS + "SELECT trace, CAST(span AS VARCHAR) AS span, parent_service, service, time, duration FROM linked WHERE link = 'call'")
def span_parent_join(spark, sf):
    return _linked(spark, sf).where("link = 'call'").select("trace", "span", "parent_service", "service", "time", "duration")


@query(_SPANS + "SELECT parent_service, service, count(*) AS calls, min(time) AS first_time, max(time) AS last_time, avg(duration) AS duration FROM linked WHERE link = 'call' GROUP BY ALL")
def call_edges(spark, sf):
    calls = _linked(spark, sf).where("link = 'call'").groupBy("parent_service", "service")
    return calls.agg(F.count("*").alias("calls"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.avg("duration").alias("duration"))


_FAULTS = """
WITH f AS (SELECT o_custkey AS day, o_orderkey AS id, epoch_us(o_orderdate) / 1e6 AS start, epoch_us(o_orderdate) / 1e6 + (1 + o_orderkey % 5) * 7 * 86400 AS stop FROM orders),
w AS (SELECT *, max(stop) OVER (PARTITION BY day ORDER BY start, stop, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM f),
c AS (SELECT day, id, start, least(start, greatest(start - 2592000, coalesce(prev, start - 2592000))) AS reference_start,
  CASE WHEN prev > start THEN 'overlap' WHEN prev = start THEN 'boundary' WHEN prev > start - 2592000 THEN 'clipped' ELSE 'full' END AS evidence FROM w)
"""


def _clipped(spark, sf):
    start = F.expr(EPOCH.format("o_orderdate"))
    f = table(spark, sf, "orders").select(F.col("o_custkey").alias("day"), F.col("o_orderkey").alias("id"), start.alias("start"), (start + (1 + F.col("o_orderkey") % 5) * 7 * 86400).alias("stop"))
    return relations.clipped_references(f, "day", "start", "stop", "id", 30 * 86400.0)


@query(_FAULTS + "SELECT day, id, start, reference_start, evidence FROM c")
def asof_reference_windows(spark, sf):
    return _clipped(spark, sf).select("day", "id", "start", "reference_start", "evidence")


@query(_FAULTS + "SELECT evidence, CASE WHEN start = reference_start THEN 'zero' WHEN start - reference_start = 2592000 THEN 'full' ELSE 'shortened' END AS reference, count(*) AS windows FROM c GROUP BY ALL")
def reference_class_counts(spark, sf):
    c = _clipped(spark, sf).withColumn("reference", relations.length_class(F.col("start") - F.col("reference_start"), 2592000.0))
    return c.groupBy("evidence", "reference").agg(F.count("*").alias("windows"))


@query("""SELECT DISTINCT lower(n_name) AS service, lower(r_name) || '.' || s_suppkey % 7 AS host FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def hosted_on_edges(spark, sf):
    joined = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = joined.select(F.concat(F.lower("r_name"), F.lit("."), (F.col("s_suppkey") % 7).cast("string"), F.lit("."), F.lower("n_name")).alias("raw"))
    return relations.placements(names, "raw")


@query(_BASE + """, o AS (SELECT DISTINCT r.case_id, r.id, r.kind, r.source, r.target FROM topology_relation r JOIN cases c USING (case_id) WHERE r.start_time < c.reference_start + 600),
p AS (SELECT case_id, id, kind, source, target FROM rel WHERE kind = 'call')
SELECT coalesce(o.case_id, p.case_id) AS case_id, coalesce(o.id, p.id) AS id, coalesce(o.kind, p.kind) AS kind, coalesce(o.source, p.source) AS source, coalesce(o.target, p.target) AS target,
CASE WHEN o.id IS NOT NULL AND p.id IS NOT NULL THEN 'both' WHEN o.id IS NOT NULL THEN 'observed' ELSE 'prior' END AS origin
FROM o FULL JOIN p ON o.case_id = p.case_id AND o.id = p.id""")
def topology_upsert(spark, sf):
    r = table(spark, sf, "topology_relation").select("case_id", "id", "kind", "source", "target", "start_time")
    early = r.join(cases(spark, sf).select("case_id", "reference_start"), "case_id").where(F.col("start_time") < F.col("reference_start") + 600)
    keep = ["case_id", "id", "kind", "source", "target"]
    return relations.merge_prior(early.select(*keep).distinct(), r.where("kind = 'call'").select(*keep).distinct(), ["case_id", "id"], ["kind", "source", "target"])


@query(_BASE + """SELECT id, kind, source, target, owner, start_time + 60 AS start_time, coalesce(len(active_intervals), 0) AS intervals, active_intervals[1].a + 60 AS first_a FROM (SELECT DISTINCT * FROM topology_relation) t""")
def shifted_relations(spark, sf):
    moved = obs.shift_relation(table(spark, sf, "topology_relation").distinct(), 60.0)
    size = F.when(F.col("active_intervals").isNotNull(), F.size("active_intervals")).otherwise(0).cast("bigint")
    return moved.select("id", "kind", "source", "target", "owner", "start_time", size.alias("intervals"), F.try_element_at("active_intervals", F.lit(1))["a"].alias("first_a"))


# --- binning and pooling ---------------------------------------------------------------------------------------------

_ACTIVE = """, iv AS (SELECT case_id, id, unnest(CASE WHEN len(active_intervals) > 0 THEN active_intervals ELSE [{'a': start_time, 'b': end_time}] END) AS i FROM topology_relation),
act AS (SELECT DISTINCT iv.case_id, iv.id, b.bin FROM iv JOIN cases c USING (case_id), unnest(range(CAST(ceil((c.incident_end - c.reference_start) / 300) AS BIGINT))) AS b(bin)
  WHERE CASE WHEN i.a = i.b THEN c.reference_start + b.bin * 300 <= i.a AND i.a < least(c.reference_start + b.bin * 300 + 300, c.incident_end)
    ELSE i.a < least(c.reference_start + b.bin * 300 + 300, c.incident_end) AND i.b > c.reference_start + b.bin * 300 END)
"""


@query(_BASE + _ACTIVE + "SELECT case_id, id, bin FROM act")
def edge_activity_bins(spark, sf):
    return relations.active_bins(table(spark, sf, "topology_relation"), cases(spark, sf), DELTA)


@query(_BASE + """, b AS (SELECT case_id, owner, CAST(floor((time - reference_start) / 300) AS BIGINT) AS bin, series_id, avg(value) FILTER (observed) AS m, count(*) FILTER (observed) AS ok, count(*) AS n FROM s
WHERE time >= reference_start AND time < incident_end GROUP BY ALL)
SELECT case_id, owner, bin, sum(ok) / sum(n) AS coverage, CAST(CAST(avg(m) AS FLOAT) AS DOUBLE) AS mean, CAST(CAST(max(m) AS FLOAT) AS DOUBLE) AS most FROM b GROUP BY ALL""")
def bin_coverage(spark, sf):
    found = relations.pooled_bins(samples(spark, sf).where("time >= reference_start and time < incident_end"), DELTA)
    return found.select("case_id", "owner", "bin", "coverage", single(F.col("mean")).alias("mean"), single(F.col("most")).alias("most"))


@query(_BASE + """SELECT l.case_id, l.owner, CAST(floor((l.time - c.reference_start) / 300) AS BIGINT) AS bin, round(ln(1 + sum(frequency)), 6) AS log_frequency
FROM logs l JOIN cases c USING (case_id) WHERE l.owner IS NOT NULL GROUP BY ALL""")
def log_bin_frequency(spark, sf):
    joined = logs(spark, sf).where("owner is not null").join(cases(spark, sf).select("case_id", "reference_start"), "case_id")
    b = obs.bin_index(F.col("time"), F.col("reference_start"), F.lit(DELTA)).alias("bin")
    return joined.groupBy("case_id", "owner", b).agg(F.round(F.log1p(F.sum("frequency").cast("double")), 6).alias("log_frequency"))


@query(_BASE + """SELECT l.case_id, l.owner, CAST(floor((l.time - c.reference_start) / 300) AS BIGINT) AS bin, round(sum(length(text) * frequency) / sum(frequency), 6) AS mean, CAST(sum(frequency) AS BIGINT) AS weight
FROM logs l JOIN cases c USING (case_id) WHERE l.owner IS NOT NULL GROUP BY ALL""")
def log_weighted_pool(spark, sf):
    joined = logs(spark, sf).where("owner is not null").join(cases(spark, sf).select("case_id", "reference_start"), "case_id")
    binned = joined.withColumn("bin", obs.bin_index(F.col("time"), F.col("reference_start"), F.lit(DELTA)))
    found = statistics.weighted_mean(binned, ["case_id", "owner", "bin"], F.char_length("text").cast("double"), F.col("frequency"))
    return found.withColumn("mean", F.round("mean", 6))


@query(_BASE + """SELECT l.case_id, l.owner, b.bin, round(sum(length(l.text) * l.frequency) / sum(l.frequency), 6) AS mean, CAST(sum(l.frequency) AS BIGINT) AS weight
FROM logs l JOIN cases c USING (case_id), unnest(range(CAST(ceil((c.incident_end - c.reference_start) / 300) AS BIGINT))) AS b(bin)
WHERE l.owner IS NOT NULL AND abs(l.time - (c.reference_start + (b.bin + 0.5) * 300)) <= 600 GROUP BY ALL""")
def log_radius_recovery(spark, sf):
    rows = logs(spark, sf).where("owner is not null").withColumn("size", F.char_length("text"))
    return relations.radius_pool(rows, cases(spark, sf), "size", DELTA, 2.0).withColumn("mean", F.round("mean", 6))


_BLOCKS = """, bs AS (SELECT *, CAST(floor((time - reference_start) / 300) AS BIGINT) AS bin FROM s), blocks AS (SELECT DISTINCT case_id, modality, owner, bin FROM bs WHERE bin % 5 = 2)
"""


def _masked(spark, sf):
    s = samples(spark, sf).withColumn("bin", obs.bin_index(F.col("time"), F.col("reference_start"), F.lit(DELTA)))
    unit = ["case_id", "modality", "owner", "bin"]
    return obs.apply_mask(s, s.where("pmod(bin, 5) = 2").select(*unit), unit)


@query(_BASE + _BLOCKS.replace("bin % 5 = 2", "((bin % 5) + 5) % 5 = 2") + "SELECT b.series_id, b.seq, CASE WHEN k.bin IS NULL THEN b.value ELSE 0 END AS value, b.observed AND k.bin IS NULL AS observed FROM bs b LEFT JOIN blocks k USING (case_id, modality, owner, bin)")
def mask_blocks_apply(spark, sf):
    return _masked(spark, sf)[0].select("series_id", "seq", "value", "observed")


@query(_BASE + _BLOCKS.replace("bin % 5 = 2", "((bin % 5) + 5) % 5 = 2") + "SELECT case_id, modality, owner, bin, channel, CAST(CAST(avg(value) AS FLOAT) AS DOUBLE) AS value FROM bs WHERE observed AND ((bin % 5) + 5) % 5 = 2 GROUP BY ALL")
def masked_targets(spark, sf):
    return _masked(spark, sf)[1].groupBy("case_id", "modality", "owner", "bin", "channel").agg(single(F.avg("value")).alias("value"))


@query(_BASE + """SELECT series_id, seq, round(coalesce(time - lag(time) OVER (PARTITION BY series_id ORDER BY seq), 0), 6) AS elapsed,
bool_or(observed) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM s""")
def receptive_context(spark, sf):
    found = relations.context(samples(spark, sf).select("series_id", "seq", "time", "observed"), "series_id", "seq", "observed", 2)
    return found.select("series_id", "seq", F.round("elapsed", 6).alias("elapsed"), "context")


@query(_BASE + """SELECT l.log_id, ((CAST(floor((l.time - c.reference_start) / 300) AS BIGINT) % 5) + 5) % 5 = 2 AS hidden FROM logs l JOIN cases c USING (case_id) WHERE l.owner IS NOT NULL""")
def mask_blocks_logs(spark, sf):
    """Log records in masked blocks of their nodes, and the others."""
    at = obs.bin_index(F.col("time"), F.col("reference_start"), F.lit(DELTA)).alias("bin")
    placed = logs(spark, sf).where("owner is not null").join(cases(spark, sf).select("case_id", "reference_start"), "case_id").select("case_id", "owner", "log_id", at)
    kept, hidden = obs.mask_logs(placed, placed.where("pmod(bin, 5) = 2"))
    return kept.select("log_id", F.lit(False).alias("hidden")).unionByName(hidden.select("log_id", F.lit(True).alias("hidden")))


@query(_BASE + _ACTIVE + """, m AS (SELECT case_id, owner AS id, CAST(floor((time - reference_start) / 300) AS BIGINT) AS bin, avg(value) AS value FROM s WHERE observed AND modality = 'trace' GROUP BY ALL),
e AS (SELECT act.case_id, act.bin, rel.kind, rel.source, rel.target, m.value FROM act JOIN rel USING (case_id, id) JOIN m USING (case_id, id, bin)),
f AS (SELECT case_id, source AS node, bin, 'out' AS direction, kind, value FROM e UNION ALL SELECT case_id, target, bin, 'in', kind, value FROM e)
SELECT case_id, node, bin, direction, kind, count(*) AS degree, CAST(CAST(avg(value) AS FLOAT) AS DOUBLE) AS mean FROM f GROUP BY ALL""")
def fan_in_degrees(spark, sf):
    rel = table(spark, sf, "topology_relation")
    edges = relations.active_bins(rel, cases(spark, sf), DELTA).join(rel.select("case_id", "id", "source", "target", "kind").distinct(), ["case_id", "id"])
    s = samples(spark, sf).where("observed and modality = 'trace'")
    measured = s.groupBy("case_id", F.col("owner").alias("id"), obs.bin_index(F.col("time"), F.col("reference_start"), F.lit(DELTA)).alias("bin")).agg(F.avg("value").alias("value"))
    return relations.fan_in(edges, measured).withColumn("mean", single(F.col("mean")))
