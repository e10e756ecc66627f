"""Queries of sources, annotation rules, labels, ledgers and streams over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tremolith.functions import sets, tables
from tremolith.operators import annotations, curation, fragment_index, labels, ledger, protocol, schedule, statistics, topology
from tremolith.operators import observations as obs
from tremolith.plans.graphs import _FRAGMENTS, _ORDERED, _RANKED, _STREAM, _eligible, _marked
from tremolith.plans.reference import _BASE, DELTA, _scaled, cases, entities, logs, samples, single
from tremolith.runtime import many, materialize, scratch_dir, table
from tremolith.sources import documents, files
from tremolith.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _place(spark, name: str) -> str:
    """A new folder in the shared scratch folder."""
    return f"{scratch_dir(spark)}/tremolith/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# --- sources ---------------------------------------------------------------------------------------------------------


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def strict_csv_rows(spark, sf):
    """A table written as CSV and read back by the strict reader, all columns as text."""
    path = _place(spark, "csv")
    table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).option("escape", '"').csv(path)
    return files.strict_csv(spark, path, ("s_suppkey",)).drop("_source")


@query("SELECT doc_id, sha256(text) AS sha256, length(text) AS chars FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0)) AND regexp_matches(text, '[^\\s]')")
def json_lines_round_trip(spark, sf):
    """Documents written as JSON lines and read back by fields; what JSON must escape comes back as it was."""
    path = _place(spark, "jsonl")
    d = table(spark, sf, "documents").where(F.col("text").isNotNull() & ~F.contains("text", F.lit("\x00")) & F.col("text").rlike(r"[^\s]"))
    d.select("doc_id", "text").write.json(path)
    back = spark.read.schema("doc_id bigint, text string").option("mode", "FAILFAST").json(path)
    return back.select("doc_id", F.sha2("text", 256).alias("sha256"), F.char_length("text").cast("bigint").alias("chars"))


@query("SELECT DISTINCT case_id FROM incident_case")
def jsonl_case_ids(spark, sf):
    """Case ids from JSON lines whose other fields are never read."""
    path = _place(spark, "ids")
    cases(spark, sf).select("case_id", F.array("day").alias("roots")).write.json(path)
    return files.jsonl_ids(spark, path)


@query("SELECT channel, modality, category, period_s FROM channel_catalog")
def parallel_array_rows(spark, sf):
    """Rows of a document that holds an array per column."""
    path = _place(spark, "arrays")
    rows = table(spark, sf, "channel_catalog").select("channel", "modality", "category", "period_s")
    # the catalog of channels is one small document by definition
    rows.agg(*(F.collect_list(c).alias(c) for c in rows.columns)).coalesce(1).write.json(path)
    return files.parallel_arrays(spark, path, {"channel": "string", "modality": "string", "category": "string", "period_s": "bigint"})


@query("SELECT case_id, any_value(dataset_id) AS dataset_id, any_value(day) AS day FROM incident_case GROUP BY case_id")
def case_cache_rows(spark, sf):
    """Cases from the content-addressed cache: made once, then read."""
    cache = files.CaseCache(spark, _place(spark, "cache"))
    for _ in range(2):
        out = cache.get("c" * 64, lambda: cases(spark, sf).select("case_id", "dataset_id", "day"))
    return out


# --- annotations -----------------------------------------------------------------------------------------------------


def _annotations(spark, sf):
    """An annotation per case: its catalog as reported (some entities twice), its relations, an event per log record."""
    at = lambda c: F.timestamp_micros(F.rint(F.col(c) * 1e6).cast("bigint"))
    gather = lambda df, name, item: many(df.groupBy("case_id").agg(F.collect_list(item).alias(name)))
    nothing = F.array().cast("array<string>")
    ents = gather(table(spark, sf, "entity_catalog"), "entities", F.struct("id", "candidate", F.lit("unknown").alias("root_role"), F.lit("unknown").alias("observation_state"), nothing.alias("evidence_refs")))
    text = lambda c: F.lit(None).cast("string").alias(c)
    call = lambda c: F.when(F.col("kind") == "call", F.col(c))
    rels = gather(
        table(spark, sf, "topology_relation").select("case_id", "id", "kind", "source", "target").distinct(), "relations",
        F.struct("id", F.col("kind").alias("type"), F.col("source").alias("source_entity"), F.col("target").alias("target_entity"), call("source").alias("call_source"), call("target").alias("call_target"),
                 F.when(F.col("kind") == "impact", "supported").otherwise("unknown").alias("impact_status"), text("impact_source"), text("impact_target")),
    )
    span = F.struct(at("time").alias("start"), F.timestamp_micros(F.rint(F.col("time") * 1e6).cast("bigint") + F.when(F.col("log_id") % 50 == 0, -1_000_000).otherwise(1_000_000)).alias("end")).alias("interval")
    events = gather(logs(spark, sf).where("owner is not null"), "events", F.struct(F.col("log_id").cast("string").alias("id"), F.col("owner").alias("entity_id"), nothing.alias("symptom_ids"), nothing.alias("evidence_refs"), span))
    base = cases(spark, sf).select("case_id", at("reference_start").alias("window_start"), at("incident_end").alias("window_end"))
    joined = base.join(ents, "case_id", "left").join(rels, "case_id", "left").join(events, "case_id", "left")
    shape = spark.createDataFrame([], annotations.SCHEMA).schema
    given = {"doc": F.col("case_id"), "status": F.lit("draft"), "availability": F.lit("unavailable"), "confirmation": F.lit("not_reviewed"), "time_origin": F.col("window_start")}
    return joined.select(*(given.get(f.name, F.col(f.name) if f.name in joined.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields))


@query(_BASE + """, ev AS (SELECT case_id AS doc, 'events/' || log_id AS path, CAST(round(time * 1e6) AS BIGINT) AS a, CAST(round(time * 1e6) AS BIGINT) + CASE WHEN log_id % 50 = 0 THEN -1000000 ELSE 1000000 END AS b, owner FROM logs WHERE owner IS NOT NULL),
w AS (SELECT case_id AS doc, CAST(round(reference_start * 1e6) AS BIGINT) AS lo, CAST(round(incident_end * 1e6) AS BIGINT) AS hi FROM cases)
SELECT doc, path, 'an interval ends before it starts' AS message FROM ev WHERE b < a
UNION ALL SELECT doc, path, 'an interval lies outside the window' FROM ev JOIN w USING (doc) WHERE a < lo OR b > hi
UNION ALL SELECT case_id, 'entities/' || id, 'an id occurs twice' FROM entity_catalog GROUP BY case_id, id HAVING count(*) > 1
UNION ALL SELECT doc, path || '/entity_id', 'an unknown reference to entities' FROM ev WHERE NOT EXISTS (SELECT 1 FROM entity_catalog e WHERE e.case_id = ev.doc AND e.id = ev.owner)
UNION ALL SELECT DISTINCT case_id, 'relations/' || id, 'an impact without a direction' FROM rel WHERE kind = 'impact'""")
def annotation_violations(spark, sf):
    """Violations of all rules in annotations made of the tables."""
    return annotations.violations(materialize(_annotations(spark, sf), "annotations"))


# --- labels, ledgers, orders -----------------------------------------------------------------------------------------


@query("SELECT case_id, min(id) AS root FROM entity_catalog WHERE candidate AND case_id IN (SELECT DISTINCT case_id FROM incident_case ORDER BY case_id LIMIT 4) GROUP BY case_id")
def label_reservations(spark, sf):
    """Answers of the first four cases, reserved and settled one after the other."""
    known = entities(spark, sf).where("candidate").select("case_id", F.col("id").alias("entity"))
    answers = materialize(known.groupBy("case_id").agg(F.array(F.min("entity")).alias("roots")), "answers")
    book = labels.Reservations(spark, _place(spark, "labels"), answers, budget=5)
    for row in cases(spark, sf).select("case_id").orderBy("case_id").limit(4).collect():
        book.reserve(spark.createDataFrame([tuple(row)], "case_id string"))
        book.settle(known)
    return book.revealed().select("case_id", F.col("roots")[0].alias("root"))


@query("""WITH c AS (SELECT DISTINCT case_id, dataset_id, day FROM incident_case), o AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY sha256(case_id), case_id) AS place,
row_number() OVER (PARTITION BY dataset_id ORDER BY day, case_id) AS attempt FROM c)
SELECT dataset_id AS ledger, attempt, 'the search leaves the frozen order' AS fault FROM o WHERE place <> attempt UNION ALL SELECT dataset_id, attempt, 'a score with a reason for failure' FROM o WHERE attempt % 7 = 0""")
def search_attempt_faults(spark, sf):
    """Faults of searches that took the cases by day instead of in their frozen order."""
    from pyspark.sql import Window

    mine = Window.partitionBy("dataset_id")
    placed = cases(spark, sf).select("case_id", "dataset_id", "day").withColumns({
        "place": F.row_number().over(mine.orderBy(F.sha2(F.col("case_id"), 256), "case_id")), "attempt": F.row_number().over(mine.orderBy("day", "case_id")),
    }).withColumnRenamed("dataset_id", "ledger")
    attempts = placed.select(
        "ledger", "attempt", "case_id", F.lit("search").alias("stage"), F.lit("scored").alias("status"), F.lit(None).cast("int").alias("repeat_of"), F.lit(0.0).alias("started"), F.lit(1.0).alias("finished"),
        F.lit(False).alias("hit"), F.when(F.col("attempt") % 7 == 0, "late").alias("reason"),
    )
    return ledger.attempt_faults(attempts, placed).select("ledger", F.col("attempt").cast("bigint").alias("attempt"), "fault")


@query(_RANKED + """, t AS (SELECT case_id, first, sum(CASE WHEN first = 1 THEN 1 ELSE 0 END) OVER (ORDER BY case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (ORDER BY case_id) AS attempt FROM hits)
SELECT attempt, 'a decision without a first-rank hit' AS fault FROM t WHERE first > 1
UNION ALL SELECT attempt, 'an earlier hit was not rejected' FROM t WHERE first = 1 AND before > 0
UNION ALL SELECT attempt, 'another case is selected' FROM t WHERE attempt > 1""")
def decision_faults(spark, sf):
    """Faults of decisions that select every case as it is scored."""
    from tremolith.operators import selection
    from tremolith.runtime import numbered

    hits = numbered(selection.case_hits(_marked(spark, sf)).select("case_id", "first"), ["case_id"], "attempt")
    attempts = hits.select(F.lit("l").alias("ledger"), "attempt", "case_id", F.lit("search").alias("stage"), F.lit("scored").alias("status"), (F.col("first") == 1).alias("hit"))
    decisions = attempts.select("ledger", "attempt", F.col("attempt").alias("number"), "case_id", F.lit("selected").alias("event"), F.lit("because").alias("reason"))
    return ledger.decision_faults(decisions, attempts).select("attempt", "fault")


@query(_RANKED + """, k AS (SELECT case_id, list(owner ORDER BY owner) AS roots, count(*) AS n FROM roots WHERE owner LIKE 'service:%' GROUP BY case_id), c AS (SELECT DISTINCT case_id FROM incident_case)
SELECT case_id, 'no record' AS issue FROM c WHERE case_id NOT IN (SELECT case_id FROM k)
UNION ALL SELECT case_id, 'joint roots without confirmation' FROM k WHERE n > 1 AND right(case_id, 1) IN ('1', '3', '5', '7', '9')
UNION ALL SELECT case_id, 'incomplete roots' FROM k WHERE right(case_id, 1) = '4'
UNION ALL SELECT case_id, 'roots outside the catalog' FROM k WHERE right(case_id, 1) = '2'""")
def label_record_issues(spark, sf):
    """Issues of label records made of the loudest owners, with planted faults."""
    from tremolith.runtime import numbered

    roots = _marked(spark, sf).where("is_root and entity like 'service:%'").groupBy("case_id").agg(F.sort_array(F.collect_list("entity")).alias("roots"))
    last = F.substring("case_id", -1, 1)
    records = roots.select(
        "case_id", F.col("case_id").alias("source_id"), F.lit("service").alias("granularity"), F.when(last == "2", F.concat("roots", F.array(F.lit("nowhere")))).otherwise(F.col("roots")).alias("raw_roots"), F.lit("f").alias("fault_type"),
        F.col("case_id").alias("evidence_path"), F.sha2("case_id", 256).alias("evidence_sha256"), (last != "4").alias("complete"), F.when(last.isin("1", "3", "5", "7", "9"), None).otherwise("both").alias("confirmation"),
    )
    windows = cases(spark, sf).select("case_id", F.col("case_id").alias("source_id"))
    catalog = numbered(entities(spark, sf).where("candidate").select("id").distinct(), ["id"], "position")
    return curation.record_issues(materialize(records, "records"), windows, catalog)


@query(f"""WITH c AS (SELECT case_id, min(dataset_id || '/' || substr(day, 6, 2)) AS stratum FROM incident_case GROUP BY case_id), n AS (SELECT stratum, count(*) AS members FROM c GROUP BY 1), t AS (SELECT sum(members) AS total FROM n),
b AS (SELECT stratum, members, CAST(floor(12 * members / total) AS BIGINT) AS base, CAST((12 * members) % total AS BIGINT) AS remainder, sha256('{{"stratum_id":"' || stratum || '","substream_seed":"' || {_STREAM % 'stratum-tie'} || '"}}') AS tie FROM n, t),
q AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY remainder DESC, tie, stratum) <= 12 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS quota FROM b),
m AS (SELECT c.*, row_number() OVER (PARTITION BY stratum ORDER BY sha256('{{"case_id":"' || case_id || '","stratum_id":"' || stratum || '","substream_seed":"' || {_STREAM % 'within-stratum'} || '"}}'), case_id) AS r FROM c),
d AS (SELECT case_id, stratum, CASE WHEN r <= quota THEN 'selected' ELSE 'search' END AS role FROM m JOIN q USING (stratum))
SELECT case_id, stratum, role, row_number() OVER (ORDER BY {_ORDERED % (_STREAM % 'semantic-presentation')}, case_id) AS place FROM d WHERE role = 'selected'
UNION ALL SELECT case_id, stratum, role, row_number() OVER (ORDER BY {_ORDERED % (_STREAM % 'demo-search')}, case_id) FROM d WHERE role = 'search'""")
def stratified_partition(spark, sf):
    """Twelve cases held out in proportion to data set and month."""
    strata = cases(spark, sf).select("case_id", F.concat_ws("/", "dataset_id", F.substring("day", 6, 2)).alias("s"))
    return protocol.stratified_partition(strata, "s", 12, "incidents", 7)


@query(_BASE.replace("SELECT DISTINCT case_id, id, category, candidate FROM entity_catalog", "SELECT DISTINCT case_id, id, category, candidate FROM entity_catalog WHERE candidate") + """, nr AS (SELECT DISTINCT series_id, seq, case_id, modality, owner, CASE WHEN seq % 50 = 49 THEN time - 10000 ELSE time END AS time FROM numeric_sample),
tr AS (SELECT DISTINCT * REPLACE ((start_time + end_time) / 2 AS end_time) FROM topology_relation),
iv AS (SELECT case_id, id, start_time, end_time, unnest(active_intervals) AS i FROM tr)
SELECT case_id, id AS what, 'an id with several meanings' AS fault FROM ent GROUP BY case_id, id HAVING count(*) > 1
UNION ALL SELECT case_id, id, 'an id with several meanings' FROM (SELECT DISTINCT case_id, id, source, target, kind FROM tr) GROUP BY case_id, id HAVING count(*) > 1
UNION ALL SELECT DISTINCT case_id, id, 'an endpoint that isn''t there' FROM (SELECT case_id, id, unnest([source, target]) AS x FROM tr) WHERE (case_id, x) NOT IN (SELECT (case_id, id) FROM ent)
UNION ALL SELECT DISTINCT case_id, owner, 'a metric without its owner' FROM nr WHERE modality = 'metric' AND (case_id, owner) NOT IN (SELECT (case_id, id) FROM ent)
UNION ALL SELECT DISTINCT case_id, owner, 'a trace without its relation' FROM nr WHERE modality = 'trace' AND (case_id, owner) NOT IN (SELECT (case_id, id) FROM tr)
UNION ALL SELECT DISTINCT case_id, owner, 'a record without its owner' FROM logs WHERE owner IS NOT NULL AND (case_id, owner) NOT IN (SELECT (case_id, id) FROM ent)
UNION ALL SELECT DISTINCT case_id, id, 'an interval outside its relation' FROM iv WHERE i.b < i.a OR i.a < start_time OR i.b > end_time
UNION ALL SELECT DISTINCT case_id, id, 'a relation that ends before it starts' FROM tr WHERE end_time < start_time
UNION ALL SELECT DISTINCT case_id, CAST(series_id AS VARCHAR), 'a series that runs backwards' FROM (SELECT *, lag(time) OVER (PARTITION BY series_id ORDER BY seq) AS p FROM nr) WHERE time < p""")
def case_faults(spark, sf):
    """Parts of cases that don't fit together, after three changes: the catalog is that of the candidates alone, relations end
    halfway, and every fiftieth reading is too early."""
    late = F.when(F.col("seq") % 50 == 49, F.col("time") - 10_000).otherwise(F.col("time")).alias("time")
    n = table(spark, sf, "numeric_sample").select("series_id", "seq", "case_id", "modality", "owner", late).distinct()
    r = table(spark, sf, "topology_relation").withColumn("end_time", (F.col("start_time") + F.col("end_time")) / 2).distinct()
    return obs.case_faults(cases(spark, sf), table(spark, sf, "entity_catalog").where("candidate"), n, logs(spark, sf), r)


@query("""WITH s AS (SELECT case_id, count(*) AS n, least(count(*), 3) AS k FROM (SELECT DISTINCT case_id, id FROM entity_catalog) GROUP BY case_id)
SELECT case_id, k AS ranks, k AS different, true AS inside FROM s""")
def sampled_rank_counts(spark, sf):
    """How many ranks were drawn from each case's catalog, how many differ, and whether all lie within it."""
    sizes = entities(spark, sf).groupBy("case_id").agg(F.count("*").alias("n")).withColumn("k", F.least("n", F.lit(3)))
    drawn = schedule.sampled_ranks(sizes, ["case_id"], "n", "k", seed=5).join(sizes, "case_id")
    return drawn.groupBy("case_id").agg(F.count("*").alias("ranks"), F.countDistinct("rank").alias("different"), F.min(F.col("rank").between(0, F.col("n") - 1)).alias("inside"))


@query("""WITH c AS (SELECT DISTINCT case_id FROM incident_case), d AS (SELECT case_id, r.r AS round FROM c, unnest(range(3)) AS r(r))
SELECT case_id, CAST(round AS INT) AS round, row_number() OVER (PARTITION BY round ORDER BY sha256('9|' || round || '|' || case_id), case_id) AS place FROM d""")
def eligible_decks(spark, sf):
    """Three rounds of all cases, each in an order of its own."""
    return schedule.shuffled_decks(cases(spark, sf), 3, seed=9).withColumn("place", F.col("place").cast("bigint"))


@query(_FRAGMENTS + """, nn AS (SELECT case_id, len(es) AS size, family, count(*) AS n FROM k GROUP BY ALL),
bb AS (SELECT *, sum(n) OVER (PARTITION BY case_id ORDER BY size, family) AS stop FROM nn), tt AS (SELECT case_id, sum(n) AS total FROM nn GROUP BY case_id),
rr AS (SELECT case_id, CAST(floor(total * q.q / 5) AS BIGINT) AS rank FROM tt, unnest(range(5)) AS q(q))
SELECT DISTINCT rr.case_id, rank, size, family, CAST(rank - (stop - n) AS BIGINT) AS local FROM rr JOIN bb ON bb.case_id = rr.case_id AND rank < stop AND rank >= stop - n""")
def fragment_rank_blocks(spark, sf):
    """Five ranks among all fragments of each case, with the size and family that hold them."""
    counts = materialize(fragment_index.counts(_eligible(spark, sf)).where("anchor is null").select("case_id", F.col("size").cast("bigint").alias("size"), "family", "fragments"), "counts")
    totals = counts.groupBy("case_id").agg(F.sum("fragments").alias("total"))
    ranks = totals.select("case_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda q: F.floor(F.col("total") * q / 5))).alias("rank"))
    return schedule.located_ranks(counts, ranks, ["case_id"], ["size", "family"], "fragments").distinct()


@query("""WITH c AS (SELECT DISTINCT case_id, dataset_id || '/' || day AS day, reference_start, reference_end, incident_start FROM incident_case), n AS (SELECT day, arg_min(reference_start, case_id) AS normal_start FROM c GROUP BY day)
SELECT case_id, normal_start FROM c JOIN n USING (day)""")
def paired_windows(spark, sf):
    """Every incident with the one normal window of its data set and day."""
    from tremolith.operators import cases as case_tables

    c = cases(spark, sf).select("case_id", F.concat_ws("/", "dataset_id", "day").alias("day"), "reference_start", "reference_end", "incident_start", "incident_end")
    normal = c.groupBy("day").agg(F.min_by(F.struct("reference_start", "reference_end"), "case_id").alias("w")).select(F.lit(None).cast("string").alias("case_id"), "day", F.lit("normal").alias("kind"), F.col("w.reference_start").alias("start"), F.col("w.reference_end").alias("end"))
    faults = c.select("case_id", "day", F.lit("fault").alias("kind"), F.col("incident_start").alias("start"), F.col("incident_end").alias("end"))
    return case_tables.paired_windows(normal.unionByName(faults), "day", "kind").select("case_id", "normal_start")


# --- inherited calls, losses -----------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey AS trace, l_linenumber AS span, l_suppkey % 10 AS service, epoch_us(l_shipdate) / 1e6 AS time, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY epoch_us(l_shipdate), l_suppkey) AS k FROM lineitem),
w AS (SELECT min(epoch_us(o_orderdate) / 1e6) + 86400 * 30 AS lo FROM orders), i AS (SELECT s.* FROM s, w WHERE k = 1 AND time >= lo AND time < lo + 86400 * 365)
SELECT 'service:' || p.service AS source, 'service:' || c.service AS target, count(DISTINCT c.time) AS instants FROM i c JOIN i p ON p.trace = c.trace AND p.span = c.span - 1 WHERE p.service <> c.service GROUP BY ALL""")
def static_call_edges(spark, sf):
    """Calls within the earliest permitted reference of a year, from the order lines as spans."""
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)/1e6D")
    first = table(spark, sf, "orders").agg(F.min(start).alias("t"))
    windows = first.select(F.explode(F.array(*(F.struct(F.lit(f"w{d}").alias("case_id"), (F.col("t") + 86400.0 * d).alias("reference_start"), (F.col("t") + 86400.0 * (d + w)).alias("reference_end")) for d, w in ((30, 365), (10, 365), (5, 0), (400, 30))))).alias("w")).select("w.*")
    permitted = spark.createDataFrame([("w30",), ("w5",), ("w400",)], "case_id string")
    reference = topology.earliest_reference(windows, permitted)
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)/1e6D")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("trace"), F.col("l_linenumber").alias("n")).agg(F.min(F.struct(at.alias("time"), "l_suppkey")).alias("s"))
    spans = lines.select("trace", F.col("n").cast("string").alias("span"), F.when(F.col("n") > 1, (F.col("n") - 1).cast("string")).alias("parent"), F.concat(F.lit("service:"), (F.col("s.l_suppkey") % 10).cast("string")).alias("service"), "s.time")
    return topology.static_calls(spans, reference).select("source", "target", F.size("times").cast("bigint").alias("instants"))


@query(_RANKED + """, e AS (SELECT case_id, rank, score AS error, rank = 1 AS is_true FROM ranked),
o AS (SELECT case_id, max(error) FILTER (is_true) AS own FROM e GROUP BY case_id)
SELECT e.case_id, round(max(own) + coalesce(avg(greatest(own - error, 0) + ln(1 + exp(-abs(own - error)))) FILTER (NOT is_true), 0), 5) AS loss FROM e JOIN o USING (case_id) GROUP BY e.case_id""")
def labeled_source_loss(spark, sf):
    """Loss of the best candidate as the true source against all others, with scores as errors."""
    from tremolith.plans.graphs import _ranked

    rows = _ranked(spark, sf)[0].select("case_id", F.col("score").alias("error"), (F.col("rank") == 1).alias("true"))
    return protocol.labeled_source_loss(rows, "case_id", "error", "true").withColumn("loss", F.round("loss", 5))


@query(_BASE + """, p AS (SELECT case_id, owner, CAST(floor((time - reference_start) / 300) AS BIGINT) AS bin, channel, avg(value) AS m FROM s WHERE observed AND time >= reference_start AND time < incident_end GROUP BY ALL)
SELECT case_id, owner, bin, count(*) AS channels, CAST(CAST(min(m) AS FLOAT) AS DOUBLE) AS least, CAST(CAST(max(m) AS FLOAT) AS DOUBLE) AS most FROM p GROUP BY ALL""")
def motif_sample_means(spark, sf):
    """Means per owner, channel and bin that motif codes band, summed up per bin."""
    at = obs.bin_index(F.col("time"), F.col("reference_start"), F.lit(DELTA)).alias("bin")
    means = samples(spark, sf).where("observed and time >= reference_start and time < incident_end").groupBy("case_id", "owner", at, "channel").agg(F.avg("value").alias("m"))
    return means.groupBy("case_id", "owner", "bin").agg(F.count("*").alias("channels"), single(F.min("m")).alias("least"), single(F.max("m")).alias("most"))


@query("""WITH x AS (SELECT label, 1 + vec_id % 5 AS w, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT label, i, round(sum(v * w) / sum(w), 6) AS x, CAST(sum(w) AS DOUBLE) AS weight FROM x GROUP BY label, i""")
def weighted_mean_vectors(spark, sf):
    """Weighted mean vectors by label, as text references and pooled logs are made."""
    found = statistics.weighted_mean_vectors(table(spark, sf, "embeddings"), ["label"], "embedding", 1 + F.col("vec_id") % 5)
    return found.select("label", F.posexplode("mean").alias("i", "x"), "weight").select("label", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"), "weight")


@query(_BASE + """, b AS (SELECT e.category, ln(1 + sum(l.frequency)) AS v FROM logs l JOIN cases c USING (case_id) JOIN ent e ON e.case_id = l.case_id AND e.id = l.owner
  WHERE l.time >= c.reference_start AND l.time < c.incident_start GROUP BY l.case_id, l.owner, e.category, floor((l.time - c.reference_start) / 300)),
m2 AS (SELECT category, median(v) AS center, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, count(*) AS n FROM b GROUP BY category),
d2 AS (SELECT category, 1.4826 * median(abs(v - center)) AS mad, max(abs(v - center)) AS amp, stddev_pop(v) AS sd FROM b JOIN m2 USING (category) GROUP BY category)
SELECT category, '__log_frequency__' AS channel, round(center, 6) AS center, round(CASE WHEN mad <> 0 THEN mad WHEN q75 <> q25 THEN (q75 - q25) / 1.349 WHEN amp <> 0 THEN sd ELSE 1 END, 6) AS scale, n AS observations
FROM m2 JOIN d2 USING (category)""")
def log_frequency_scale(spark, sf):
    """Robust scales of the log frequency per owner and bin of the references, a channel of its own."""
    kinds = entities(spark, sf).select("case_id", F.col("id").alias("owner"), "category")
    window = cases(spark, sf).select("case_id", "reference_start", "incident_start")
    inside = logs(spark, sf).join(window, "case_id").where("time >= reference_start and time < incident_start").join(kinds, ["case_id", "owner"])
    at = obs.bin_index(F.col("time"), F.col("reference_start"), F.lit(DELTA)).alias("bin")
    pool = inside.groupBy("case_id", "owner", "category", at).agg(F.log1p(F.sum("frequency").cast("double")).alias("value")).withColumn("channel", F.lit("__log_frequency__"))
    found = statistics.robust_scale(pool, ["category", "channel"], "value")
    return found.select("category", "channel", F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"), "observations")


@query(_BASE + """, e AS (SELECT case_id, channel AS mask, owner = 'service:gateway' AS is_true, abs(z) AS err FROM z WHERE supported AND time >= incident_start AND time < incident_end),
m AS (SELECT case_id, mask, avg(err) FILTER (NOT is_true) - avg(err) FILTER (is_true) AS g FROM e GROUP BY ALL), q AS (SELECT case_id, avg(g) AS gap FROM m GROUP BY case_id)
SELECT count(gap) AS cases, round(avg(gap), 4) AS gap, round(avg(CASE WHEN gap IS NOT NULL THEN CAST(gap > 0 AS INT) END), 6) AS positive, count(*) FILTER (gap IS NULL) AS ineligible FROM q""")
def completion_report(spark, sf):
    """Cases, mean gap, share of positive gaps and ineligible cases of the completion by the true source."""
    rows = _scaled(spark, sf).where("supported and time >= incident_start and time < incident_end")
    rows = rows.select("case_id", F.col("channel").alias("mask"), F.abs("z").alias("err"), (F.col("owner") == "service:gateway").alias("is_true"))
    found = protocol.completion_summary(rows, "case_id", "mask", "err", "is_true")
    return found.select("cases", F.round("gap", 4).alias("gap"), F.round("positive", 6).alias("positive"), F.size("ineligible").cast("bigint").alias("ineligible"))


@query("""WITH s AS (SELECT case_id, list(DISTINCT id) AS ids FROM entity_catalog GROUP BY case_id), c AS (SELECT DISTINCT case_id, dataset_id FROM incident_case),
f AS (SELECT dataset_id, min(case_id) AS first FROM c GROUP BY dataset_id)
SELECT c.case_id, round(len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids))), 6) AS jaccard FROM c JOIN f USING (dataset_id) JOIN s a ON a.case_id = c.case_id JOIN s b ON b.case_id = f.first""")
def catalog_jaccard(spark, sf):
    """How much of its catalog each case shares with the first case of its data set."""
    ids = entities(spark, sf).groupBy("case_id").agg(F.collect_set("id").alias("ids"))
    mine = cases(spark, sf).select("case_id", "dataset_id")
    first = mine.groupBy("dataset_id").agg(F.min("case_id").alias("first")).join(ids.withColumnsRenamed({"case_id": "first", "ids": "base"}), "first")
    return mine.join(ids, "case_id").join(first, "dataset_id").select("case_id", F.round(sets.jaccard(F.col("ids"), F.col("base")), 6).alias("jaccard"))


@query("""SELECT case_id, id, b.bin FROM (SELECT DISTINCT case_id, id, start_time, end_time FROM topology_relation WHERE end_time >= start_time) r,
unnest(range(CAST(floor(start_time / 600) AS BIGINT), CASE WHEN start_time = end_time THEN CAST(floor(start_time / 600) AS BIGINT) + 1 ELSE CAST(ceil(end_time / 600) AS BIGINT) END)) AS b(bin)""")
def relation_touched_bins(spark, sf):
    """Ten-minute bins that each relation's hull touches, by the table function."""
    tables.register(spark)
    hulls = table(spark, sf, "topology_relation").select("case_id", "id", "start_time", "end_time").where("end_time >= start_time").distinct()
    return spark.sql("select r.case_id, r.id, b.bin from {hulls} r, lateral touched_bins(r.start_time, r.end_time, 0.0D, 600.0D) b", hulls=hulls)


@query("SELECT case_id, sha256(case_id) AS sha256 FROM (SELECT DISTINCT case_id FROM incident_case)")
def case_documents(spark, sf):
    """Every case as a canonical document and back: the ids that come back, with their hashes."""
    ents, c = entities(spark, sf).select("case_id", "id", "category", "candidate"), cases(spark, sf)
    readings = samples(spark, sf).select("case_id", "modality", "owner", "channel", F.col("series_id").cast("string").alias("identity"), "seq", "time", "value", "observed")
    rel = table(spark, sf, "topology_relation").dropDuplicates(["case_id", "id"]).select("case_id", "id", "source", "target", "kind", "owner", "response", "start_time", "end_time", "active_intervals")
    said = logs(spark, sf).where("owner is not null").select("case_id", "owner", "time", "text", "frequency")
    text = materialize(documents.to_text(documents.case_rows(c, ents, readings, said, rel)), "case-text")
    return documents.from_text(text).select("case_id", F.sha2("case_id", 256).alias("sha256"))


# --- streams ---------------------------------------------------------------------------------------------------------


def _stream(spark, sf):
    """The events table as a stream of files, every twentieth event delivered twice."""
    folder = _place(spark, "events")
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.unionByName(e.where("event_id % 20 = 0")).repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(folder)
    return ingest.event_stream(spark, folder, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double", files_per_trigger=2)


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def stream_bins(spark, sf):
    """Hourly bins of the event stream, without repeated deliveries."""
    once = ingest.deduplicated(_stream(spark, sf), ["event_id"], "ts", "400 days")
    found = ingest.latest_table(ingest.tumbling(once, ["event_type"], "ts", "value", "1 hour", None), ["start", "event_type"], _place(spark, "bins"), _place(spark, "checkpoint"))
    return found.select("event_type", F.unix_seconds("start").alias("start"), "n", F.round("mean", 6).alias("mean"), "least", "most")


@query("""WITH b AS (SELECT event_type, value, epoch_us(ts) // 1000000 AS t FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 20 = 0)),
w AS (SELECT event_type, value, (t // 1800) * 1800 - 1800 * k.k AS start FROM b, unnest(range(2)) AS k(k))
SELECT event_type, start, count(value) AS n, round(avg(value), 6) AS mean FROM w GROUP BY ALL""")
def stream_context_windows(spark, sf):
    """Overlapping hours, one every half hour, over the stream as it is delivered."""
    found = ingest.latest_table(ingest.sliding(_stream(spark, sf), ["event_type"], "ts", "value", "1 hour", "30 minutes", "400 days"), ["start", "event_type"], _place(spark, "slides"), _place(spark, "checkpoint"))
    return found.select("event_type", F.unix_seconds("start").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf):
    """Every event of the stream once."""
    path = _place(spark, "once")
    once = ingest.deduplicated(_stream(spark, sf).select("event_id", "user_id", "ts"), ["event_id"], "ts", "400 days")
    once.writeStream.format("parquet").option("path", path).option("checkpointLocation", _place(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id bigint, user_id bigint").parquet(path)
