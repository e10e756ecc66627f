"""Queries on event graphs, fragments, vectors, selection, ranking, partitions, ledgers and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremolith.operators import cases as case_tables
from tremolith.operators import fragment_index, fragments, protocol, selection, statistics
from tremolith.operators import observations as obs
from tremolith.plans.reference import _BASE, EVENT_DELTA, _pool, _scaled, cases, entities, logs, samples
from tremolith.runtime import materialize, numbered, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- event graphs ----------------------------------------------------------------------------------------------------

_LINKS = _BASE + """, ev AS (SELECT DISTINCT s.case_id, s.owner || '/' || CAST(floor((time - reference_start) / 900) AS BIGINT) AS event, s.owner AS entity, CAST(floor((time - reference_start) / 900) AS BIGINT) AS bin,
  reference_start + floor((time - reference_start) / 900) * 900 AS st, least(reference_start + floor((time - reference_start) / 900) * 900 + 900, incident_end) AS en
  FROM s WHERE modality = 'metric' AND observed AND time >= incident_start AND time < incident_end),
r AS (SELECT DISTINCT case_id, id, source, target, owner, response, start_time, end_time, active_intervals FROM topology_relation),
links AS (SELECT DISTINCT r.case_id, r.id AS relation, coalesce(r.owner, r.id) AS owner, r.response, a.event AS source, b.event AS target, a.entity AS source_entity, b.entity AS target_entity, a.st AS ss, a.en AS se, b.st AS ts, b.en AS te
  FROM r JOIN ev a ON a.case_id = r.case_id AND a.entity = r.source JOIN ev b ON b.case_id = r.case_id AND b.entity = r.target
  WHERE a.event <> b.event AND abs(a.bin - b.bin) <= 9 AND len(list_filter(CASE WHEN len(r.active_intervals) > 0 THEN r.active_intervals ELSE [{'a': r.start_time, 'b': r.end_time}] END,
    lambda i: CASE WHEN i.a = i.b THEN least(a.st, b.st) <= i.a AND i.a < greatest(a.en, b.en) ELSE i.a < greatest(a.en, b.en) AND i.b > least(a.st, b.st) END)) > 0),
good AS (SELECT * FROM links WHERE NOT te < ss AND NOT ts - se > 7200),
g AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY source, target, relation, owner, response) AS edge FROM good)
"""


def _events(spark, sf):
    s = samples(spark, sf).where("modality = 'metric' and observed and time >= incident_start and time < incident_end")
    b = obs.bin_index(F.col("time"), F.col("reference_start"), F.lit(EVENT_DELTA))
    start = F.col("reference_start") + F.col("bin") * EVENT_DELTA
    rows = s.select("case_id", F.col("owner").alias("entity"), b.alias("bin"), "reference_start", "incident_end").distinct()
    return rows.select("case_id", F.concat_ws("/", "entity", F.col("bin").cast("string")).alias("event"), "entity", "bin", start.alias("start"), F.least(start + EVENT_DELTA, F.col("incident_end")).alias("end"))


def _links(spark, sf):
    found = fragments.event_links(_events(spark, sf), table(spark, sf, "topology_relation"))
    return found.distinct()


def _eligible(spark, sf):
    """Eligible links with an id, numbered within their case."""
    good = fragments.eligible_links(_links(spark, sf), EVENT_DELTA)
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("case_id").orderBy("source", "target", "relation", "owner", "response"))
    return materialize(good.withColumn("edge", number.cast("bigint")), "links")


@query(_LINKS + "SELECT case_id, relation, owner, response, source, target FROM links")
def event_links(spark, sf):
    return _links(spark, sf).select("case_id", "relation", "owner", "response", "source", "target")


@query(_LINKS + "SELECT case_id, relation, owner, response, source, target FROM good")
def eligible_links(spark, sf):
    return fragments.eligible_links(_links(spark, sf), EVENT_DELTA).select("case_id", "relation", "owner", "response", "source", "target")


@query(_LINKS + """SELECT relation, source, target, CASE WHEN (ts - se) / 900 >= 0 AND (te - ss) / 900 < 1 THEN '[0,1)' WHEN (ts - se) / 900 >= 1 AND (te - ss) / 900 < 2 THEN '[1,2)'
WHEN (ts - se) / 900 >= 2 AND (te - ss) / 900 < 4 THEN '[2,4)' WHEN (ts - se) / 900 >= 4 AND (te - ss) / 900 <= 8 THEN '[4,8]' ELSE 'unknown' END AS delay FROM links""")
def delay_buckets(spark, sf):
    delay = obs.delay_class(*(F.col(c) for c in ("source_start", "source_end", "target_start", "target_end")), F.lit(EVENT_DELTA))
    return _links(spark, sf).select("relation", "source", "target", delay.alias("delay"))


_FRAGMENTS = _LINKS + """, v AS (SELECT case_id, edge, source AS event FROM g UNION SELECT case_id, edge, target FROM g),
p AS (SELECT DISTINCT a.case_id, a.edge AS x, b.edge AS y FROM v a JOIN v b USING (case_id, event) WHERE a.edge < b.edge),
pv AS (SELECT p.case_id, p.x, p.y, v.event FROM p JOIN v ON v.case_id = p.case_id AND v.edge IN (p.x, p.y)),
t AS (SELECT DISTINCT pv.case_id, list_sort([pv.x, pv.y, v.edge]) AS es FROM pv JOIN v USING (case_id, event) WHERE v.edge NOT IN (pv.x, pv.y)),
f AS (SELECT case_id, [edge] AS es FROM g UNION ALL SELECT case_id, [x, y] FROM p UNION ALL SELECT * FROM t),
m AS (SELECT f.case_id, f.es, g.source, g.target, g.source_entity, g.target_entity FROM (SELECT case_id, es, unnest(es) AS edge FROM f) f JOIN g USING (case_id, edge)),
o AS (SELECT case_id, es, max(n) > 1 AS fork FROM (SELECT case_id, es, count(DISTINCT target) AS n FROM m GROUP BY case_id, es, source) GROUP BY ALL),
i AS (SELECT case_id, es, max(n) > 1 AS meet FROM (SELECT case_id, es, count(DISTINCT source) AS n FROM m GROUP BY case_id, es, target) GROUP BY ALL),
e AS (SELECT case_id, es, source AS event, source_entity AS entity FROM m UNION SELECT case_id, es, target, target_entity FROM m),
d AS (SELECT case_id, es, count(*) > count(DISTINCT entity) AS again FROM e GROUP BY ALL),
k AS (SELECT case_id, es, CASE WHEN again THEN 'revisit' WHEN fork AND meet THEN 'mixed_branch_convergence' WHEN fork THEN 'branch' WHEN meet THEN 'convergence' ELSE 'chain' END AS family
  FROM d JOIN o USING (case_id, es) JOIN i USING (case_id, es))
"""


@query(_FRAGMENTS + "SELECT case_id, len(es) AS size, family, count(*) AS fragments FROM k GROUP BY ALL")
def fragment_family_counts(spark, sf):
    found = fragment_index.counts(_eligible(spark, sf)).where("anchor is null")
    return found.select("case_id", F.col("size").cast("bigint").alias("size"), "family", "fragments")


@query(_FRAGMENTS + "SELECT case_id, entity AS anchor, family, count(*) AS fragments FROM (SELECT DISTINCT case_id, es, entity FROM e) JOIN k USING (case_id, es) GROUP BY ALL")
def anchor_family_counts(spark, sf):
    found = fragment_index.counts(_eligible(spark, sf)).where("anchor is not null")
    return found.groupBy("case_id", "anchor", "family").agg(F.sum("fragments").alias("fragments"))


_SAMPLED = _FRAGMENTS + """, a AS (SELECT DISTINCT k.case_id, k.family, e.entity AS anchor, array_to_string(k.es, ',') AS key FROM k JOIN e USING (case_id, es)),
b AS (SELECT *, row_number() OVER (PARTITION BY case_id, anchor, family ORDER BY sha256('0|' || case_id || '|' || anchor || '|' || key), key) AS turn FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY case_id, anchor ORDER BY turn, sha256('0|' || case_id || '|' || anchor || '|' || turn || '|' || family), family) AS place FROM b WHERE turn <= 8),
kept AS (SELECT DISTINCT case_id, family, key FROM c WHERE place <= 8),
h AS (SELECT *, row_number() OVER (PARTITION BY case_id, family ORDER BY sha256('0:' || case_id || ':' || key), key) AS turn FROM kept),
q AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY turn, family) AS place FROM h WHERE turn <= 128)
"""


def _sampled(links):
    return fragments.balanced_sample(fragments.anchor_sample(fragments.fragments(links)), cap=128)


@query(_SAMPLED + "SELECT case_id, key AS edges, family, turn, place FROM q WHERE place <= 128")
def fragment_balanced_sample(spark, sf):
    found = _sampled(_eligible(spark, sf))
    edges = F.concat_ws(",", F.transform("edges", lambda e: e.cast("string"))).alias("edges")
    return found.select("case_id", edges, "family", F.col("turn").cast("bigint").alias("turn"), F.col("place").cast("bigint").alias("place"))


@query(_SAMPLED + """, z1 AS (SELECT case_id, family, count(*) AS population FROM k GROUP BY ALL), z2 AS (SELECT case_id, family, count(*) AS taken FROM q WHERE place <= 128 GROUP BY ALL),
z3 AS (SELECT case_id, sha256(string_agg(key, ';' ORDER BY key)) AS sample FROM q WHERE place <= 128 GROUP BY case_id)
SELECT case_id, family, population, coalesce(taken, 0) AS taken, sample FROM z1 LEFT JOIN z2 USING (case_id, family) LEFT JOIN z3 USING (case_id)""")
def fragment_sample_audit(spark, sf):
    """What each case's sample of fragments was drawn from and what it is."""
    links = _eligible(spark, sf)
    return fragments.sample_audit(links, materialize(_sampled(links), "sample"), fragment_index.counts(links)).drop("inventory")


# --- vectors and selection -------------------------------------------------------------------------------------------

#: The query set of similarities is the tokens whose number is divisible by this; all tokens are candidates.
REFERENCE = 100

_TOKENS = f"""
WITH t AS (SELECT 'case-' || lpad(CAST(vec_id % 40 AS VARCHAR), 2, '0') AS case_id, CAST(vec_id AS VARCHAR) AS token, CAST(label % 5 AS VARCHAR) AS family, CAST(embedding AS DOUBLE[]) AS vec, vec_id % {REFERENCE} = 0 AS asked FROM embeddings),
c AS (SELECT case_id, family, count(*) AS own FROM t GROUP BY ALL), f AS (SELECT family, count(*) AS n FROM c GROUP BY ALL),
w AS (SELECT t.*, 1.0 / ((SELECT count(*) FROM f) * f.n * c.own) AS weight FROM t JOIN c USING (case_id, family) JOIN f USING (family)),
o AS (SELECT token AS occurrence, family, vec, weight FROM w WHERE asked),
m AS (SELECT o.occurrence, t.case_id, max(least(greatest((1 + list_dot_product(o.vec, t.vec)) / 2, 0), 1)) AS similarity FROM o, t GROUP BY ALL)
"""


def _tokens(spark, sf):
    case = F.concat(F.lit("case-"), F.lpad((F.col("vec_id") % 40).cast("string"), 2, "0"))
    return table(spark, sf, "embeddings").select(case.alias("case_id"), F.col("vec_id").cast("string").alias("token"), (F.col("label") % 5).cast("string").alias("family"), F.col("embedding").alias("vec"))


def _asked(tokens):
    return tokens.where(F.col("token").cast("bigint") % REFERENCE == 0).withColumnRenamed("token", "occurrence")


def _weights(spark, sf):
    return _asked(selection.occurrence_weights(_tokens(spark, sf))).select("occurrence", "weight")


def _maxima(spark, sf):
    tokens = _tokens(spark, sf)
    return selection.case_maxima(_asked(tokens), tokens)


def _priority(spark, sf):
    ids = _tokens(spark, sf).select("case_id").distinct()
    order = protocol.hash_priority(F.col("case_id"), protocol.substream("vectors", "priority", 1))
    return numbered(ids.withColumn("o", order), ["o", "case_id"], "priority").select("case_id", F.col("priority").cast("double").alias("priority"))


# what the frontend would give: vectors of any length, some unobserved, some delivered twice
_SYMPTOMS = f"""
WITH raw AS (SELECT 'case-' || lpad(CAST(vec_id % 40 AS VARCHAR), 2, '0') AS case_id, vec_id, CASE WHEN label % 2 = 0 THEN 'node' ELSE 'edge' END AS kind,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN vec_id % 11 = 5 THEN 0.0 ELSE x * (1 + label) END) AS vec FROM embeddings WHERE vec_id % 7 <> 3),
t AS (SELECT case_id, CAST(vec_id AS VARCHAR) AS token, kind AS family, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec, vec_id % {REFERENCE} = 0 AS asked FROM raw WHERE list_dot_product(vec, vec) > 0),
c AS (SELECT case_id, family, count(*) AS own FROM t GROUP BY ALL), f AS (SELECT family, count(*) AS n FROM c GROUP BY ALL),
o AS (SELECT token AS occurrence, family, vec, 1.0 / ((SELECT count(*) FROM f) * f.n * c.own) AS weight FROM t JOIN c USING (case_id, family) JOIN f USING (family) WHERE asked),
m AS (SELECT o.occurrence, t.case_id, max(least(greatest((1 + list_dot_product(o.vec, t.vec)) / 2, 0), 1)) AS similarity FROM o JOIN t USING (family) GROUP BY ALL)
"""


def _symptoms(spark, sf):
    case = F.concat(F.lit("case-"), F.lpad((F.col("vec_id") % 40).cast("string"), 2, "0"))
    scaled = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 11 == 5, 0.0).otherwise(x.cast("double") * (1 + F.col("label"))))
    raw = table(spark, sf, "embeddings").select(
        case.alias("case_id"), F.when(F.col("label") % 2 == 0, "node").otherwise("edge").alias("kind"), F.col("vec_id").cast("string").alias("provenance"), scaled.alias("vec"), (F.col("vec_id") % 7 != 3).alias("observed")
    )
    twice = raw.unionByName(raw.where(F.col("provenance").endswith("1")))
    return selection.symptom_tokens(twice).withColumnsRenamed({"provenance": "token", "kind": "family"})


@query(_TOKENS + "SELECT token, case_id, family, round(weight, 12) AS weight FROM w")
def token_weights(spark, sf):
    return selection.occurrence_weights(_tokens(spark, sf)).select("token", "case_id", "family", F.round("weight", 12).alias("weight"))


@query(_TOKENS + "SELECT occurrence, case_id, round(similarity, 6) AS similarity FROM m")
def token_case_max_similarity(spark, sf):
    return _maxima(spark, sf).withColumn("similarity", F.round("similarity", 6))


@query(_SYMPTOMS + "SELECT occurrence, case_id, round(similarity, 6) AS similarity FROM m")
def symptom_max_similarity(spark, sf):
    tokens = materialize(_symptoms(spark, sf), "symptoms")
    return selection.case_maxima(_asked(tokens), tokens, kind="family").withColumn("similarity", F.round("similarity", 6))


@query(_TOKENS + "SELECT case_id, round(sum(weight * similarity), 6) AS coverage FROM m JOIN o USING (occurrence) GROUP BY case_id")
def coverage_by_case(spark, sf):
    joined = _maxima(spark, sf).join(_weights(spark, sf), "occurrence")
    return joined.groupBy("case_id").agg(F.round(F.sum(F.col("weight") * F.col("similarity")), 6).alias("coverage"))


def _greedy_sql(steps: int) -> str:
    """Greedy cover over m and o, written out step by step."""
    order = """sha256('{"case_id":"' || case_id || '","substream_seed":"' || sha256('{"dataset":"vectors","purpose":"priority","schema":"tremolith/partition/1","seed":1}') || '"}')"""
    out = f", pr AS (SELECT case_id, row_number() OVER (ORDER BY {order}, case_id) AS p FROM (SELECT DISTINCT case_id FROM t)), b0 AS (SELECT occurrence, weight, 0.0 AS base FROM o)"
    taken = "SELECT NULL AS case_id"
    for k in range(steps):
        out += f""", g{k} AS (SELECT pr.case_id, pr.p, coalesce(x.gain, 0) AS gain FROM pr LEFT JOIN
  (SELECT m.case_id, sum(b.weight * greatest(m.similarity - b.base, 0)) AS gain FROM m JOIN b{k} b USING (occurrence) GROUP BY m.case_id) x USING (case_id)
  WHERE pr.case_id NOT IN (SELECT case_id FROM ({taken}) WHERE case_id IS NOT NULL)),
s{k} AS (SELECT case_id, gain FROM g{k} ORDER BY round(gain, 12) DESC, p LIMIT 1),
b{k + 1} AS (SELECT b.occurrence, b.weight, greatest(b.base, coalesce(m.similarity, 0)) AS base FROM b{k} b LEFT JOIN m ON m.occurrence = b.occurrence AND m.case_id = (SELECT case_id FROM s{k}))"""
        taken += f" UNION ALL SELECT case_id FROM s{k}"
    return out + " " + " UNION ALL ".join(f"SELECT {k} AS step, case_id, round(gain, 6) AS gain FROM s{k}" for k in range(steps))


@query(_TOKENS + _greedy_sql(3))
def propcover_round(spark, sf):
    maxima = materialize(_maxima(spark, sf), "maxima")
    return selection.greedy_cover(spark, maxima, materialize(_weights(spark, sf), "weights"), _priority(spark, sf), 3).withColumn("gain", F.round("gain", 6))


@query(_SYMPTOMS + _greedy_sql(3))
def symptom_cover_round(spark, sf):
    tokens = materialize(_symptoms(spark, sf), "symptoms")
    maxima = materialize(selection.case_maxima(_asked(tokens), tokens, kind="family"), "maxima")
    weights = materialize(_asked(selection.occurrence_weights(tokens)).select("occurrence", "weight"), "weights")
    priority = _priority(spark, sf).join(tokens.select("case_id").distinct(), "case_id", "left_semi")
    return selection.greedy_cover(spark, maxima, weights, priority, 3).withColumn("gain", F.round("gain", 6))


_POOLED = _TOKENS + """, x AS (SELECT case_id, unnest(vec) AS v, unnest(range(len(vec))) AS i FROM t), a AS (SELECT case_id, i, avg(v) AS v FROM x GROUP BY ALL),
l AS (SELECT case_id, list(v ORDER BY i) AS vec, sqrt(sum(v * v)) AS len FROM a GROUP BY case_id)
"""


@query(_POOLED + "SELECT case_id, i, round(v / len, 6) AS x FROM a JOIN l USING (case_id)")
def pooled_case_vectors(spark, sf):
    return selection.pooled_vectors(_tokens(spark, sf)).select("case_id", F.posexplode("vec").alias("p", "x")).select("case_id", F.col("p").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query(_POOLED + """, n AS (SELECT case_id, list_transform(vec, lambda v: v / len) AS vec, len FROM l),
d AS (SELECT n.case_id, k.case_id AS center, (1 - list_dot_product(n.vec, k.vec)) / 2 AS d FROM n, n k WHERE k.case_id IN ('case-03', 'case-11', 'case-27'))
SELECT case_id, arg_min(center, (d, center)) AS center, round(min(d), 6) AS distance FROM d GROUP BY case_id""")
def medoid_assignments(spark, sf):
    vectors = materialize(selection.pooled_vectors(_tokens(spark, sf)), "vectors")
    centers = vectors.where(F.col("case_id").isin("case-03", "case-11", "case-27")).withColumn("priority", F.substring("case_id", 6, 2).cast("int"))
    return selection.medoid_assignments(vectors, centers).withColumn("distance", F.round("distance", 6))


@query()
def pooled_medoids(spark, sf):
    vectors = selection.pooled_vectors(_tokens(spark, sf)).withColumn("priority", F.substring("case_id", 6, 2).cast("int"))
    return case_tables.pooled_medoids(vectors, 3, locked=["case-03"]).withColumn("cost", F.round("cost", 6))


def _spread_sql(steps: int) -> str:
    out = """
WITH c AS (SELECT DISTINCT case_id, incident_start FROM incident_case),
t AS (SELECT case_id, (incident_start - (SELECT min(incident_start) FROM c)) / (SELECT max(incident_start) - min(incident_start) FROM c) AS x, CAST(CAST('0x' || substr(sha256(case_id), 1, 12) AS BIGINT) AS DOUBLE) AS p FROM c),
s0 AS (SELECT case_id, x, 0.0 AS gain FROM t ORDER BY round((SELECT sum(abs(t.x - u.x)) FROM t u), 9), p LIMIT 1)"""
    picked = "SELECT case_id, x FROM s0"
    for k in range(1, steps):
        out += f", s{k} AS (SELECT case_id, x, gain FROM (SELECT t.*, (SELECT min(abs(t.x - q.x)) FROM ({picked}) q) AS gain FROM t WHERE case_id NOT IN (SELECT case_id FROM ({picked}))) ORDER BY round(gain, 12) DESC, p LIMIT 1)"
        picked += f" UNION ALL SELECT case_id, x FROM s{k}"
    return out + " " + " UNION ALL ".join(f"SELECT {k} AS step, case_id, round(gain, 6) AS gain FROM s{k}" for k in range(steps))


@query(_spread_sql(5))
def time_spread(spark, sf):
    order = F.sha2(F.col("case_id"), 256)
    return selection.time_spread(spark, cases(spark, sf).withColumn("p", F.conv(F.substring(order, 1, 12), 16, 10).cast("double")), "incident_start", "p", 5).withColumn("gain", F.round("gain", 6))


@query()
def motif_cover(spark, sf):
    codes = materialize(_motif_counts(spark, sf).select("case_id", "code"), "codes")
    order = cases(spark, sf).select("case_id", F.conv(F.substring(F.sha2(F.col("case_id"), 256), 1, 12), 16, 10).cast("double").alias("priority"))
    return selection.motif_cover(spark, codes, order, 3)


# --- ranking and evaluation ------------------------------------------------------------------------------------------

_RANKED = _BASE + """, sc AS (SELECT case_id, owner, max(abs(z)) AS score FROM z WHERE supported AND time >= incident_start AND time < incident_end GROUP BY ALL),
full_ AS (SELECT e.case_id, e.id AS entity, round(coalesce(sc.score, 0), 4) AS score FROM ent e LEFT JOIN sc ON sc.case_id = e.case_id AND sc.owner = e.id WHERE e.candidate),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, entity) AS rank FROM full_),
lf AS (SELECT l.case_id, l.owner, sum(l.frequency) AS n FROM logs l JOIN cases c USING (case_id) JOIN ent e ON e.case_id = l.case_id AND e.id = l.owner AND e.candidate WHERE l.time >= c.incident_start AND l.time < c.incident_end GROUP BY ALL),
roots AS (SELECT case_id, owner FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, owner) AS k FROM lf) WHERE k <= 2),
marked AS (SELECT r.*, q.owner IS NOT NULL AS is_root FROM ranked r LEFT JOIN roots q ON q.case_id = r.case_id AND q.owner = r.entity),
hits AS (SELECT case_id, count(*) FILTER (is_root) AS roots, min(rank) FILTER (is_root) AS first FROM marked GROUP BY case_id HAVING count(*) FILTER (is_root) > 0)
"""


def _ranked(spark, sf):
    """Candidates ranked by their largest |z|, which the extremes of each channel give, as z grows with the value."""
    s = materialize(samples(spark, sf).where("observed").select("case_id", "owner", "category", "channel", "time", "value", "reference_start", "incident_start", "incident_end"), "observed")
    stats = statistics.robust_scale(s.where("time >= reference_start and time < incident_start"), ["category", "channel"], "value")
    ends = s.where("time >= incident_start and time < incident_end").groupBy("case_id", "owner", "category", "channel").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    z = lambda c: obs.standardised(F.col(c), F.col("center"), F.col("scale"))
    far = ends.join(stats, ["category", "channel"]).where(z("lo")[1]).withColumn("far", F.greatest(F.abs(z("lo")[0]), F.abs(z("hi")[0])))
    scores = far.groupBy("case_id", F.col("owner").alias("entity")).agg(F.max("far").alias("score"))
    candidates = entities(spark, sf).where("candidate").select("case_id", F.col("id").alias("entity"))
    full = candidates.join(scores, ["case_id", "entity"], "left").select("case_id", "entity", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"))
    return materialize(selection.ranking(full), "ranked"), candidates


def _marked(spark, sf):
    from pyspark.sql import Window

    ranked, candidates = _ranked(spark, sf)
    window = cases(spark, sf).select("case_id", "incident_start", "incident_end")
    loud = logs(spark, sf).join(window, "case_id").where("time >= incident_start and time < incident_end").groupBy("case_id", F.col("owner").alias("entity")).agg(F.sum("frequency").alias("n"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("n").desc(), "entity"))
    roots = loud.join(candidates, ["case_id", "entity"]).withColumn("k", place).where("k <= 2").select("case_id", "entity", F.lit(True).alias("is_root"))
    return ranked.join(roots, ["case_id", "entity"], "left").fillna(False, ["is_root"])


@query(_RANKED + "SELECT case_id, entity, score, rank FROM ranked")
def candidate_ranking(spark, sf):
    return _ranked(spark, sf)[0].withColumn("rank", F.col("rank").cast("bigint"))


@query(_RANKED + "SELECT case_id, roots, first, CAST(first <= 1 AS INT) AS hit_1, CAST(first <= 3 AS INT) AS hit_3, CAST(first <= 5 AS INT) AS hit_5 FROM hits")
def case_hits(spark, sf):
    return selection.case_hits(_marked(spark, sf)).select("case_id", "roots", F.col("first").cast("bigint").alias("first"), "hit_1", "hit_3", "hit_5")


@query(_RANKED + """, h AS (SELECT count(*) AS n, CAST(count(*) FILTER (first <= 1) AS DOUBLE) AS h1, CAST(count(*) FILTER (first <= 2) AS DOUBLE) AS h2, CAST(count(*) FILTER (first <= 3) AS DOUBLE) AS h3,
CAST(count(*) FILTER (first <= 4) AS DOUBLE) AS h4, CAST(count(*) FILTER (first <= 5) AS DOUBLE) AS h5, avg(1.0 / first) AS mrr FROM hits)
SELECT n AS cases, round((h1 + h3 + h5) / (3 * n), 6) AS top135, round((h1 + h2 + h3 + h4 + h5) / (5 * n), 6) AS avg5, round(mrr, 6) AS mrr,
round((h1 + (h2 - h1) / 2 + (h3 - h2) / 3 + (h4 - h3) / 4 + (h5 - h4) / 5) / n, 6) AS mrr_lower, round((h1 + (h2 - h1) / 2 + (h3 - h2) / 3 + (h4 - h3) / 4 + (h5 - h4) / 5 + (n - h5) / 6) / n, 6) AS mrr_upper FROM h""")
def metric_summary(spark, sf):
    found = selection.metric_summary(selection.case_hits(_marked(spark, sf)))
    return found.select("cases", *(F.round(c, 6).alias(c) for c in ("top135", "avg5", "mrr", "mrr_lower", "mrr_upper")))


@query(_RANKED + "SELECT case_id, round((avg(ln(1 + exp(-least(score, 30)))) FILTER (is_root) + avg(ln(1 + exp(least(score, 30)))) FILTER (NOT is_root)) / 2, 5) AS loss FROM marked GROUP BY case_id HAVING bool_or(is_root)")
def class_bce(spark, sf):
    rows = _marked(spark, sf).withColumn("s", F.least("score", F.lit(30.0)))
    rooted = rows.where("is_root").select("case_id").distinct()
    return protocol.class_bce(rows.join(rooted, "case_id", "left_semi"), "case_id", "s", "is_root").withColumn("loss", F.round("loss", 5))


@query(_RANKED + "SELECT entity, CASE WHEN bool_or(src = 'a') THEN 'extra' ELSE 'missing' END AS side FROM (SELECT DISTINCT entity, 'a' AS src FROM ranked UNION ALL SELECT DISTINCT owner, 'b' FROM roots) GROUP BY entity HAVING count(*) = 1")
def population_diff(spark, sf):
    from tremolith.operators.relations import population_difference

    marked = _marked(spark, sf)
    return population_difference(marked, marked.where("is_root"), "entity")


@query(_BASE + """, e AS (SELECT modality, case_id || owner AS unit, channel, value - center AS err, scale FROM s JOIN scale USING (category, channel) WHERE observed AND time >= incident_start AND time < incident_end),
h AS (SELECT modality, unit, channel, avg(CASE WHEN abs(err / scale) <= 1 THEN 0.5 * (err / scale) * (err / scale) ELSE abs(err / scale) - 0.5 END) AS l FROM e GROUP BY ALL),
u AS (SELECT modality, unit, avg(l) AS l FROM h GROUP BY ALL), m AS (SELECT modality, avg(l) AS l FROM u GROUP BY ALL) SELECT round(avg(l), 4) AS loss FROM m""")
def huber_hierarchy(spark, sf):
    rows = _scaled(spark, sf).where("supported and time >= incident_start and time < incident_end").withColumn("unit", F.concat("case_id", "owner"))
    return protocol.hierarchical_huber(rows, ["modality", "unit", "channel"], F.col("z")).select(F.round("loss", 4).alias("loss"))


@query(_RANKED + """, c AS (SELECT case_id, least(score, 30) - 0.5 * (1 + rank % 3) AS a, rank / 10.0 AS e FROM ranked),
b AS (SELECT case_id, a - (SELECT NULL) AS x FROM c WHERE false),
n AS (SELECT case_id, max(a) AS top, ln(sum(exp(a - m))) + max(m) AS z FROM (SELECT *, max(a) OVER (PARTITION BY case_id) AS m FROM c) GROUP BY case_id)
SELECT case_id, round(-ln(sum(exp(a - n.z - e))), 5) AS loss FROM c JOIN n USING (case_id) GROUP BY case_id""".replace("b AS (SELECT case_id, a - (SELECT NULL) AS x FROM c WHERE false),\n", ""))
def source_logsumexp(spark, sf):
    rows = _ranked(spark, sf)[0].select("case_id", F.least("score", F.lit(30.0)).alias("logit"), (F.col("rank") / 10.0).alias("energy"), (1 + F.col("rank") % 3).alias("size"))
    return protocol.soft_source_loss(rows, "case_id", "logit", "energy", "size").withColumn("loss", F.round("loss", 5))


@query("""WITH p AS (SELECT a.label % 2 = 0 AS affected, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT affected, count(*) AS n, round(avg(sqrt(list_sum(list_transform(list_zip(x, y), lambda q: (q[2] - q[1]) * (q[2] - q[1]))))), 6) AS l2,
round(avg(sqrt(list_sum(list_transform(list_zip(x, y), lambda q: (q[2] - q[1]) * (q[2] - q[1])))) / greatest(sqrt(list_dot_product(x, x)), 1e-12)), 6) AS relative FROM p GROUP BY affected""")
def representation_change(spark, sf):
    e = table(spark, sf, "embeddings")
    later = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    pairs = e.select("vec_id", F.col("embedding").alias("before"), (F.col("label") % 2 == 0).alias("affected")).join(later, "vec_id")
    found = protocol.representation_change(pairs, "before", "after", "affected")
    return found.select("affected", "n", F.round("l2", 6).alias("l2"), F.round("relative", 6).alias("relative"))


@query(_BASE + """, e AS (SELECT case_id, channel AS mask, owner = 'service:gateway' AS is_true, abs(z) AS err FROM z WHERE supported AND time >= incident_start AND time < incident_end),
m AS (SELECT case_id, mask, avg(err) FILTER (NOT is_true) - avg(err) FILTER (is_true) AS g FROM e GROUP BY ALL) SELECT case_id, round(avg(g), 4) AS gap FROM m WHERE g IS NOT NULL GROUP BY case_id""")
def completion_gap(spark, sf):
    rows = _scaled(spark, sf).where("supported and time >= incident_start and time < incident_end")
    rows = rows.select("case_id", F.col("channel").alias("mask"), F.abs("z").alias("err"), (F.col("owner") == "service:gateway").alias("is_true"))
    return protocol.completion_gap(rows, "case_id", "mask", "err", "is_true").withColumn("gap", F.round("gap", 4))


# --- partitions and ledgers ------------------------------------------------------------------------------------------

_STREAM = """sha256('{"dataset":"incidents","purpose":"%s","schema":"tremolith/partition/1","seed":7}')"""
_ORDERED = """sha256('{"case_id":"' || case_id || '","substream_seed":"' || %s || '"}')"""


@query(f"SELECT case_id, row_number() OVER (ORDER BY {_ORDERED % (_STREAM % 'reserve')}, case_id) AS place FROM (SELECT DISTINCT case_id FROM incident_case)")
def hash_priority_order(spark, sf):
    p = protocol.hash_priority(F.col("case_id"), protocol.substream("incidents", "reserve", 7))
    return numbered(cases(spark, sf).select("case_id").withColumn("p", p), ["p", "case_id"]).select("case_id", "place")


@query(f"""WITH c AS (SELECT DISTINCT case_id FROM incident_case), a AS (SELECT case_id, row_number() OVER (ORDER BY {_ORDERED % (_STREAM % 'reserve')}, case_id) AS place FROM c)
SELECT case_id, 'demo' AS role, place FROM a WHERE place <= 10 UNION ALL
SELECT case_id, 'search', row_number() OVER (ORDER BY {_ORDERED % (_STREAM % 'search')}, case_id) FROM a WHERE place > 10""")
def demo_partition(spark, sf):
    return protocol.demo_partition(cases(spark, sf), "incidents", 7, reserve=10).withColumn("place", F.col("place").cast("bigint"))


@query("""WITH n AS (SELECT coalesce(source, 'none') AS stratum, count(*) AS members FROM documents GROUP BY 1), t AS (SELECT sum(members) AS total FROM n),
b AS (SELECT stratum, members, CAST(floor(30 * members / total) AS BIGINT) AS base, CAST((30 * members) % total AS BIGINT) AS remainder, sha256('{"stratum_id":"' || stratum || '","substream_seed":"' || """ + _STREAM % "stratum-tie" + """ || '"}') AS tie FROM n, t),
p AS (SELECT *, row_number() OVER (ORDER BY remainder DESC, tie, stratum) AS place, 30 - (SELECT sum(base) FROM b) AS seats FROM b)
SELECT stratum, members, base, remainder, base + CASE WHEN place <= seats THEN 1 ELSE 0 END AS quota FROM p""")
def hamilton_quotas(spark, sf):
    strata = table(spark, sf, "documents").select(F.coalesce("source", F.lit("none")).alias("stratum"))
    return protocol.hamilton_quotas(strata, "stratum", 30, "incidents", 7)


def _chained(spark, sf):
    rows = cases(spark, sf).groupBy("dataset_id", "day").agg(F.count("*").alias("n"), F.min("case_id").alias("first"))
    from pyspark.sql import Window

    numbered = rows.withColumn("sequence", F.row_number().over(Window.partitionBy("dataset_id").orderBy("day")).cast("bigint") - 1)
    return protocol.chain(numbered.withColumn("payload", F.concat_ws(",", "day", "first", F.col("n").cast("string"))), "dataset_id", "sequence", "payload")


_CHAIN = """
WITH RECURSIVE r AS (SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY day) - 1 AS sequence, day || ',' || min(case_id) || ',' || count(*) AS payload FROM incident_case GROUP BY dataset_id, day),
c AS (SELECT dataset_id, sequence, payload, repeat('0', 64) AS previous, sha256(sequence || '|' || repeat('0', 64) || '|' || payload) AS hash FROM r WHERE sequence = 0
UNION ALL SELECT r.dataset_id, r.sequence, r.payload, c.hash, sha256(r.sequence || '|' || c.hash || '|' || r.payload) FROM r JOIN c ON r.dataset_id = c.dataset_id AND r.sequence = c.sequence + 1)
"""


@query(_CHAIN + "SELECT dataset_id, sequence, payload, previous, hash FROM c")
def hash_chain(spark, sf):
    return _chained(spark, sf)


@query(_CHAIN + "SELECT dataset_id, sequence, 'hash' AS fault FROM c WHERE sequence % 3 = 1")
def hash_chain_check(spark, sf):
    """Faults found after every third payload was changed."""
    changed = _chained(spark, sf).withColumn("payload", F.when(F.col("sequence") % 3 == 1, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return protocol.chain_faults(changed, "dataset_id")


@query(_RANKED + """, a AS (SELECT c.dataset_id, h.case_id, h.first <= 3 AS hit FROM hits h JOIN cases c USING (case_id))
SELECT dataset_id, case_id, count(*) OVER w AS scored, CAST(sum(CAST(hit AS INT)) OVER w AS BIGINT) AS hits FROM a WINDOW w AS (PARTITION BY dataset_id ORDER BY case_id)""")
def ledger_cumulative_hits(spark, sf):
    hits = selection.case_hits(_marked(spark, sf)).join(cases(spark, sf).select("case_id", "dataset_id"), "case_id")
    rows = hits.select("dataset_id", F.col("case_id").alias("attempt"), "case_id", (F.col("first") <= 3).alias("hit"))
    return protocol.cumulative_hits(rows, "dataset_id", "attempt", "case_id", "hit").select("dataset_id", "case_id", "scored", "hits")


# --- cases, labels, attempts -----------------------------------------------------------------------------------------


def _labels(spark, sf):
    """Stand-in labels: kind by the day's last digit, roots by the loudest owners."""
    roots = _marked(spark, sf).where("is_root").groupBy("case_id").agg(F.collect_list("entity").alias("roots"))
    return cases(spark, sf).join(roots, "case_id").select("case_id", "dataset_id", F.substring("day", 10, 1).alias("kind"), "roots")


_LABELS = _RANKED + """, lab AS (SELECT q.case_id, c.dataset_id, substr(c.day, 10, 1) AS kind, count(DISTINCT q.owner) AS cardinality FROM roots q JOIN cases c USING (case_id) GROUP BY ALL)
"""


@query(_LABELS + "SELECT CASE WHEN grouping(kind) = 1 THEN NULL ELSE kind END AS kind, cardinality, count(*) AS cases FROM lab GROUP BY GROUPING SETS ((cardinality), (kind, cardinality))")
def root_cardinality(spark, sf):
    return case_tables.root_cardinality(_labels(spark, sf), "kind", "roots").withColumn("cardinality", F.col("cardinality").cast("bigint"))


def _attempts(spark, sf):
    """Attempts in order of time of all log records, a ledger for each case and owner."""
    return logs(spark, sf).select("case_id", "owner", F.col("log_id").alias("attempt"), F.pmod("log_id", F.lit(7)).alias("item"), (F.pmod("log_id", F.lit(3)) == 0).alias("failed"), (F.pmod("log_id", F.lit(11)) == 0).alias("hit"))


_ATTEMPTS = _BASE + """, att AS (SELECT case_id, owner, log_id AS attempt, log_id % 7 AS item, log_id % 3 = 0 AS failed, log_id % 11 = 0 AS hit FROM logs),
ret AS (SELECT *, max(CASE WHEN failed THEN attempt END) OVER (PARTITION BY case_id, owner, item ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS retry_of FROM att)
"""


@query(_ATTEMPTS + "SELECT case_id, owner, attempt, coalesce(retry_of, -1) AS retry_of FROM ret")
def retry_links(spark, sf):
    found = case_tables.retry_links(_attempts(spark, sf), ["case_id", "owner"], "attempt", "item", "failed")
    return found.select("case_id", "owner", "attempt", F.coalesce("retry_of", F.lit(-1)).cast("bigint").alias("retry_of"))


@query(_ATTEMPTS + """SELECT case_id, owner, count(*) AS attempts, count(DISTINCT item) AS cases, count(*) FILTER (failed) AS errors, count(retry_of) AS retries,
coalesce(min(CASE WHEN hit THEN attempt END), -1) AS first_hit FROM ret GROUP BY case_id, owner""")
def ledger_summary(spark, sf):
    found = case_tables.ledger_summary(_attempts(spark, sf), ["case_id", "owner"], "attempt", "item", "failed", "hit")
    return found.withColumn("first_hit", F.coalesce("first_hit", F.lit(-1)).cast("bigint"))


@query(_BASE + """, p AS (SELECT DISTINCT case_id FROM cases), l AS (SELECT DISTINCT case_id FROM logs WHERE log_id % 2 = 0 AND frequency > 1), u AS (SELECT case_id FROM p WHERE right(case_id, 1) < '5')
SELECT case_id, CASE WHEN l.case_id IS NOT NULL THEN 'both' ELSE 'neither' END AS fault FROM p LEFT JOIN l USING (case_id) LEFT JOIN u USING (case_id)
WHERE (l.case_id IS NOT NULL AND u.case_id IS NOT NULL) OR (l.case_id IS NULL AND u.case_id IS NULL)""")
def partition_faults(spark, sf):
    pool = cases(spark, sf)
    loud = logs(spark, sf).where("log_id % 2 = 0 and frequency > 1")
    return case_tables.partition_faults(pool, loud, pool.where(F.substring("case_id", -1, 1) < "5"))


@query(f"SELECT case_id FROM (SELECT DISTINCT case_id FROM incident_case WHERE right(case_id, 1) <> '3') ORDER BY {_ORDERED % (_STREAM % 'reserve')}, case_id LIMIT 5")
def random_select(spark, sf):
    pool = cases(spark, sf).select("case_id").withColumn("priority", protocol.hash_priority(F.col("case_id"), protocol.substream("incidents", "reserve", 7)))
    return case_tables.first_by_priority(pool, pool.where(F.substring("case_id", -1, 1) == "3"), 5).select("case_id")


_BLOCK_Z = """, st AS (SELECT series_id, time - lag(time) OVER (PARTITION BY series_id ORDER BY time, seq) AS step, count(*) OVER (PARTITION BY series_id) AS n FROM pool),
md AS (SELECT series_id, median(step) AS p FROM st WHERE n >= 3 AND step > 0 GROUP BY 1), dl AS (SELECT median(p) AS delta FROM md),
rd AS (SELECT case_id, CASE WHEN modality = 'metric' THEN 'node' ELSE 'edge' END AS unit, owner, CAST(floor((time - reference_start) / delta) AS BIGINT) AS bin, abs(z) > 1 AS moved
  FROM z, dl WHERE supported AND time >= reference_start AND time < incident_end
  UNION ALL SELECT l.case_id, 'node', l.owner, CAST(floor((l.time - c.reference_start) / delta) AS BIGINT), false FROM logs l JOIN cases c USING (case_id), dl WHERE l.time >= c.reference_start AND l.time < c.incident_end),
bl AS (SELECT case_id, unit, owner, bin, bool_or(moved) AS moved FROM rd GROUP BY ALL),
b AS (SELECT *, sha256(concat_ws('|', '0', case_id, unit, owner, bin)) AS o, count(*) OVER (PARTITION BY case_id) AS n FROM bl),
t AS (SELECT *, CAST(ceil(n * 0.2) AS BIGINT) AS take, row_number() OVER (PARTITION BY case_id ORDER BY o) AS r FROM b WHERE n >= 2),
q AS (SELECT *, r <= take // 2 AS uni FROM t), w AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY uni DESC, moved DESC, o) AS rest FROM q)
"""


@query(_BASE + _BLOCK_Z + "SELECT case_id, unit, owner, bin, CASE WHEN uni THEN 'uniform' WHEN moved THEN 'response' ELSE 'fill' END AS reason FROM w WHERE rest <= take")
def mask_block_sample(spark, sf):
    """Blocks are (unit, owner, bin of the grid interval) over the whole case, with those of logs."""
    scaled = _scaled(spark, sf)
    grid = materialize(statistics.grid_interval(_pool(scaled), "series_id", "time", "seq").select("delta"), "grid")
    at = obs.bin_index(F.col("time"), F.col("reference_start"), F.col("delta")).cast("bigint").alias("bin")
    visible = "time >= reference_start and time < incident_end"
    unit = F.when(F.col("modality") == "metric", "node").otherwise("edge").alias("unit")
    read = scaled.where("supported").where(visible).crossJoin(grid).select("case_id", unit, "owner", at, F.abs("z").alias("z"))
    window = cases(spark, sf).select("case_id", "reference_start", "incident_end")
    said = logs(spark, sf).join(window, "case_id").where(visible).crossJoin(grid).select("case_id", F.lit("node").alias("unit"), "owner", at, F.lit(0.0).alias("z"))
    blocks = read.unionByName(said).groupBy("case_id", "unit", "owner", "bin").agg(F.max("z").alias("z"))
    return case_tables.mask_blocks(blocks, "case_id", ["unit", "owner", "bin"], "z")


@query(_RANKED + """, top AS (SELECT case_id, list(entity ORDER BY rank) AS o, list(entity ORDER BY entity) AS names, count(*) AS n FROM ranked GROUP BY case_id),
one AS (SELECT case_id, [unnest(names)] AS s FROM top),
heads AS (SELECT case_id, k.k - 1000 AS pos, list_sort(o[1:k.k]) AS s FROM top, unnest(range(2, 10)) AS k(k) WHERE k.k <= n),
keys AS (SELECT case_id, names, n, i.i AS pos, '42|0|' || case_id || '|' || i.i AS key FROM top, unnest(range(512)) AS i(i) WHERE n >= 2),
draws AS (SELECT case_id, pos, list_sort(list_transform(list_sort(list_transform(names, lambda e: {'h': md5(key || '|' || e), 'e': e}))[1:(2 + CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % (n - 1))], lambda x: x.e)) AS s FROM keys),
every AS (SELECT case_id, s, min(pos) AS pos FROM (SELECT * FROM heads UNION ALL SELECT * FROM draws) GROUP BY case_id, s),
many AS (SELECT case_id, s FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS r FROM every) JOIN top USING (case_id) WHERE r <= 16 AND n >= 5),
few AS (SELECT case_id, list_filter(names, lambda e, i: (m.m >> (i - 1)) % 2 = 1) AS s FROM top, unnest(range(16)) AS m(m) WHERE n <= 4 AND m.m < (1 << n))
SELECT case_id, array_to_string(s, ',') AS sources FROM (SELECT * FROM one UNION ALL SELECT * FROM many UNION ALL SELECT * FROM few WHERE len(s) >= 2)""")
def source_library(spark, sf):
    return case_tables.source_sets(_ranked(spark, sf)[0]).select("case_id", F.concat_ws(",", "sources").alias("sources"))


def _letters(bands, vocabulary, keys):
    """Per key one text with the first letter of each channel's band (low, high, reference-band, unknown), in the order of all channels."""
    maps = bands.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("channel", F.substring("band", 1, 1)))).alias("m"))
    return maps.crossJoin(vocabulary).select(*keys, F.concat_ws("", F.transform("channels", lambda c: F.coalesce(F.col("m")[c], F.lit("u")))).alias("bands"))


def _motif_fragments(spark, sf):
    """All fragments, their events with category, bands of each metric channel and of the log count in their bin, their
    edges with relation, response, delay class and the bands of their call's channels in both ends' bins."""
    at = obs.bin_index(F.col("time"), F.col("reference_start"), F.lit(EVENT_DELTA)).cast("bigint").alias("bin")
    s = materialize(samples(spark, sf).where("observed and time >= reference_start and time < incident_end"), "readings")
    stats = statistics.robust_scale(s.where("time < incident_start"), ["category", "channel"], "value")

    def banded(means, stats, keys):
        z, ok = obs.standardised(F.col("value"), F.col("center"), F.col("scale"))
        return means.join(stats, keys, "left").withColumn("band", obs.band(z, ok))

    means = s.groupBy("case_id", "modality", "owner", "category", "channel", at).agg(F.avg("value").alias("value"))
    bands = materialize(banded(means, stats, ["category", "channel"]).select("case_id", "modality", "owner", "channel", "bin", "band"), "bands")
    kinds = entities(spark, sf).select("case_id", F.col("id").alias("owner"), "category")
    window = cases(spark, sf).select("case_id", "reference_start", "incident_start", "incident_end")
    visible = logs(spark, sf).join(window, "case_id").where("time >= reference_start and time < incident_end")
    count = lambda df: df.groupBy("case_id", "owner", at).agg(F.log1p(F.sum("frequency")).alias("value")).join(kinds, ["case_id", "owner"])
    usual = statistics.robust_scale(count(visible.where("time < incident_start")), ["category"], "value")
    loud = banded(count(visible), usual, ["category"]).select("case_id", "owner", "bin", F.substring("band", 1, 1).alias("loud"))

    of = lambda m: (bands.where(F.col("modality") == m), bands.where(F.col("modality") == m).agg(F.array_sort(F.collect_set("channel")).alias("channels")))
    keys = ["case_id", "owner", "bin"]
    metric, metrics = of("metric")
    trace, traces = of("trace")
    states = _events(spark, sf).select("case_id", "event", F.col("entity").alias("owner"), F.col("bin").cast("bigint").alias("bin"))
    states = states.join(kinds, ["case_id", "owner"], "left").join(_letters(metric, metrics, keys), keys, "left").join(loud, keys, "left")
    state = F.concat_ws("|", F.coalesce("category", F.lit("")), F.coalesce("bands", F.lit("")), F.coalesce("loud", F.lit("u")))
    states = materialize(states.select("case_id", "event", "bin", state.alias("state")), "states")
    calls = materialize(_letters(trace, traces, keys), "calls")

    kind = table(spark, sf, "topology_relation").select("case_id", F.col("id").alias("relation"), "kind").dropDuplicates(["case_id", "relation"])
    links = _eligible(spark, sf).join(kind, ["case_id", "relation"], "left").crossJoin(traces.select(F.repeat(F.lit("u"), F.size("channels")).alias("none")))
    for end in ("source", "target"):
        links = links.join(states.select("case_id", F.col("event").alias(end), F.col("bin").alias(f"{end}_bin"), F.col("state").alias(f"{end}_state")), ["case_id", end])
        links = links.join(calls.select("case_id", "owner", F.col("bin").alias(f"{end}_bin"), F.col("bands").alias(f"{end}_calls")), ["case_id", "owner", f"{end}_bin"], "left")
    delay = obs.delay_class(*(F.col(c) for c in ("source_start", "source_end", "target_start", "target_end")), F.lit(EVENT_DELTA))
    both = F.when(F.col("source_bin") == F.col("target_bin"), F.coalesce("source_calls", "none")).otherwise(F.concat_ws(";", F.coalesce("source_calls", "none"), F.coalesce("target_calls", "none")))
    edge = F.concat_ws("|", "kind", F.coalesce("response", F.lit(False)).cast("string"), delay, both)
    return fragments.fragments(materialize(links.withColumn("state", edge), "motif-links"), carry=case_tables.MOTIF)


def _motif_counts(spark, sf):
    return case_tables.motif_codes(_motif_fragments(spark, sf)).groupBy("case_id", "code").agg(F.count("*").alias("fragments"))


@query()
def motif_codes(spark, sf):
    return _motif_counts(spark, sf)
