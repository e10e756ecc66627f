"""Row normalisation and predicates on observations: times, numbers, owners, identities, windows, masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units of declared times, label-bearing column names, and dimensions that tell physical series apart.
TIME_UNITS = {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9}
LABEL_COLUMNS = ("ground_truth", "roots", "root", "targets", "target", "labels", "label", "fault_type", "injection", "positive_ids", "positive_types", "is_positive", "metadata_json", "conclusion")
LABEL_PREFIXES = ("root_cause", "fault_", "positive_")
IDENTITY_COLUMNS = ("source_workload", "destination_workload", "pod", "pod_name", "replicaset_name", "deployment_name", "statefulset_name")
REPLICA_SUFFIX = r"-(?:\d+|[0-9a-f]{8,10}-[a-z0-9]{5})$"
NAME_PATTERNS = (r"^(.*?service)(?:\d+)?-\d+$", r"^(.*?)(?:\d+)-\d+$", r"^(.*?)-\d+$", r"^(.*?service)\d+$")
#: Delay classes in units of the grid interval; the last one includes its upper bound.
DELAYS = ((0.0, 1.0, "[0,1)"), (1.0, 2.0, "[1,2)"), (2.0, 4.0, "[2,4)"), (4.0, 8.0, "[4,8]"))


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def native_seconds(c: Column, unit: str) -> Column:
    """Seconds as double from a declared unit, or from a timestamp with ``unit='datetime'``; fails on other values."""
    if unit == "datetime":
        seconds = F.unix_micros(c.cast("timestamp")) / 1e6
    elif unit in TIME_UNITS:
        seconds = c.cast("double") / TIME_UNITS[unit]
    else:
        raise ValueError(f"undeclared time unit {unit!r}")
    return F.when(finite(seconds), seconds).otherwise(F.raise_error(F.lit("a time is missing or not finite")).cast("double"))


def number_or_nan(c: Column) -> Column:
    """A number from text; null and empty text are NaN, malformed text fails."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(float("nan"))).otherwise(c.cast("double"))


def required_text(c: Column, name: str) -> Column:
    """The text, or a failure if it is null or blank."""
    return F.when(F.trim(c) != "", c).otherwise(F.raise_error(F.lit(f"{name} is missing or blank")))


def first_text(*columns: Column) -> Column:
    """The first text that isn't blank, stripped; empty if there is none."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns), F.lit(""))


def workload_service(c: Column) -> Column:
    """Service of a workload name: what follows the last slash, without the suffix of a replica set or its pod."""
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"-[0-9a-fA-F]{8,10}(?:-[a-z0-9]{5})?$", "")


def metric_owner(metric: Column, columns: Sequence[str]) -> Column:
    """``struct(owner, kind)`` of a metric row, from whichever resource columns the table has.

    Network flows belong to their source workload, then come the named service, the replica set, deployment, stateful
    set and pod; the namespace phase has no owner; anything else fails.
    """
    have = set(columns)
    pick = lambda *names: first_text(*(F.col(f"`{n}`") for n in names if n in have)) if have & set(names) else F.lit("")
    flow_from = workload_service(pick("source_workload", "attr.source_workload", "attr.source"))
    flow_to = workload_service(pick("destination_workload", "attr.destination_workload", "attr.destination"))
    answer = lambda owner, kind: F.struct(owner.cast("string").alias("owner"), F.lit(kind).alias("kind"))
    direct, replicas = pick("service", "service_name"), pick("attr.k8s.replicaset.name", "replicaset_name")
    deployment, stateful = pick("attr.k8s.deployment.name", "deployment_name"), pick("attr.k8s.statefulset.name", "statefulset_name")
    pod, namespace = pick("attr.k8s.pod.name", "pod", "pod_name"), pick("attr.k8s.namespace.name")
    return (
        F.when(F.lower(metric).contains("hubble") & (flow_from != "") & (flow_to != ""), answer(flow_from, "hubble"))
        .when(direct != "", answer(direct, "direct"))
        .when(replicas != "", answer(workload_service(replicas), "resource"))
        .when(deployment != "", answer(deployment, "resource"))
        .when(stateful != "", answer(stateful, "resource"))
        .when(pod != "", answer(workload_service(pod), "resource"))
        .when((metric == "k8s.namespace.phase") & (namespace != ""), answer(F.lit(None), "namespace-only"))
        .otherwise(F.raise_error(F.lit("a metric row has no owner")).cast("struct<owner:string,kind:string>"))
    )


def reject_label_columns(df: DataFrame) -> DataFrame:
    """The frame itself, or an error if a column, or a field at any depth of one, could hold labels."""
    held: list[str] = []

    def walk(kind, path: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                name = f.name.lower()
                if name in LABEL_COLUMNS or name.startswith(LABEL_PREFIXES):
                    held.append(f"{path}{f.name}")
                walk(f.dataType, f"{path}{f.name}.")
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, path)
        elif isinstance(kind, T.MapType):
            walk(kind.keyType, path)
            walk(kind.valueType, path)

    walk(df.schema, "")
    if held:
        raise ValueError(f"label-bearing columns are forbidden in observations: {held}")
    return df


def physical_identity(columns: Sequence[str]) -> Column:
    """Name=value text of a row's physical dimensions, in order of name, without nulls; tells series of one channel apart."""
    names = sorted(c for c in columns if c.startswith("attr.") or c in IDENTITY_COLUMNS)
    if not names:
        return F.lit("")
    return F.concat_ws(",", *(F.concat(F.lit(f"{n}="), F.col(f"`{n}`").cast("string")) for n in names))


def relation_id(kind: Column, source: Column, target: Column) -> Column:
    """``kind:`` and 24 hex digits of the SHA-256 of the compact JSON list [kind, source, target] (for ASCII names)."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = F.concat(F.lit("["), quoted(kind), F.lit(","), quoted(source), F.lit(","), quoted(target), F.lit("]"))
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(text, 256), 1, 24))


def inside_windows(time: Column, reference_start: Column, reference_end: Column, incident_start: Column, incident_end: Column) -> Column:
    """True within the half-open reference or incident window."""
    return ((time >= reference_start) & (time < reference_end)) | ((time >= incident_start) & (time < incident_end))


def histogram_channels(df: DataFrame, keep: Sequence[str], name: Column, parts: Sequence[str] = ("count", "sum", "min", "max")) -> DataFrame:
    """One row per histogram statistic: ``keep``, ``channel`` (name/statistic), ``value``."""
    stats = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).cast("double").alias("value")) for p in parts))).alias("h")
    return df.select(*keep, name.alias("__name"), stats).select(*keep, F.concat_ws("/", "__name", "h.part").alias("channel"), F.col("h.value").alias("value"))


def resolve_owner(observations: DataFrame, raw: str, catalog: DataFrame, entity: str = "id", by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Adds ``resolved``: the service of the row's own case (the columns ``by``) for a name or one of its replicas, else the
    name as context. ``catalog`` has ``by`` and the ids that names may stand for, its candidates as a rule.

    A name in the catalog stands for itself. Otherwise a replica suffix is removed; as a suffix has one place where it
    can begin, the longest catalog name is the one that remains, so an equi-join finds it and no prefix scan is needed.
    """
    name = F.regexp_replace(F.col(raw), "^service:", "")
    by = list(by)
    known = catalog.select(*by, F.col(entity).alias("__id")).where(F.col("__id").startswith("service:")).distinct()
    named = lambda n: known.select(*(F.col(c).alias(f"__{n}_{c}") for c in by), F.col("__id").alias(f"__{n}"))
    exact, bare = named("exact"), named("bare")
    mine = lambda df, n: [df[c] == F.col(f"__{n}_{c}") for c in by]
    whole = F.concat(F.lit("service:"), name)
    short = F.concat(F.lit("service:"), F.regexp_replace(name, REPLICA_SUFFIX, ""))
    joined = observations.withColumns({"__whole": whole, "__short": short})
    joined = joined.join(exact, [*mine(joined, "exact"), joined["__whole"] == F.col("__exact")], "left")
    joined = joined.join(bare, [*mine(joined, "bare"), joined["__short"] == F.col("__bare")], "left")
    out = joined.withColumn("resolved", F.coalesce("__exact", "__bare", "__short"))
    return out.drop("__whole", "__short", "__exact", "__bare", *(f"__{n}_{c}" for n in ("exact", "bare") for c in by))


def replica_name(c: Column) -> Column:
    """The service name before a replica number, by the first of four patterns that matches."""
    out = None
    for p in NAME_PATTERNS:
        out = F.when(c.rlike(p), F.regexp_extract(c, p, 1)) if out is None else out.when(c.rlike(p), F.regexp_extract(c, p, 1))
    return out.otherwise(c)


def bin_index(time: Column, start: Column, width: Column) -> Column:
    """Number of the tumbling bin that holds a time."""
    return F.floor((time - start) / width).cast("bigint")


def rfc3339(c: Column) -> Column:
    """Timestamp of an RFC 3339 text with an explicit offset, to the microsecond; null stays null, any other text fails."""
    ok = c.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    parsed = F.try_to_timestamp(F.regexp_replace(F.upper(c), r"(\.\d{6})\d+", "$1"))
    return F.when(c.isNull(), F.lit(None)).when(ok & parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit("no RFC 3339 time")).cast("timestamp"))


def shift_times(df: DataFrame, seconds: float, columns: Sequence[str] = ("time",)) -> DataFrame:
    """Readings, records or windows with all their times moved by a number of seconds; null times stay null."""
    return df.withColumns({c: F.col(c) + F.lit(float(seconds)) for c in columns})


def shift_relation(df: DataFrame, seconds: float, columns: Sequence[str] = ("start_time", "end_time"), intervals: str = "active_intervals") -> DataFrame:
    """Moves times and active intervals by a number of seconds."""
    by = F.lit(float(seconds))
    moved = F.transform(intervals, lambda i: F.struct((i["a"] + by).alias("a"), (i["b"] + by).alias("b")))
    return df.withColumns({c: F.col(c) + by for c in columns} | {intervals: moved})


def masked(value: Column, observed: Column) -> tuple[Column, Column]:
    """Value and availability: numbers that aren't finite, and unobserved ones, are 0 and unavailable."""
    ok = F.coalesce(observed, F.lit(True)) & finite(value)
    return F.when(ok, value).otherwise(0.0), ok


def is_active(intervals: Column, start: Column, end: Column, begin: Column, until: Column) -> Column:
    """Whether a relation is active within [begin, until): a point a=b if begin <= a < until, else if the intervals overlap;
    the hull [start, end] counts where there are none."""
    own = F.array(F.struct(start.alias("a"), end.alias("b")))
    listed = F.when(F.size(intervals) > 0, intervals).otherwise(own)
    meets = lambda i: F.when(i["a"] == i["b"], (begin <= i["a"]) & (i["a"] < until)).otherwise((i["a"] < until) & (i["b"] > begin))
    return F.coalesce((begin < until) & F.exists(listed, meets), F.lit(False))


def standardised(value: Column, center: Column, scale: Column) -> tuple[Column, Column]:
    """(value - center) / scale and whether it is supported; without a scale or a finite value 0 and false."""
    ok = finite(value) & center.isNotNull() & (scale > 0)
    return F.when(ok, (value - center) / scale).otherwise(0.0), F.coalesce(ok, F.lit(False))


def band(z: Column, supported: Column) -> Column:
    """low, reference-band, high or unknown."""
    return F.when(~supported, "unknown").when(z < -1, "low").when(z > 1, "high").otherwise("reference-band")


def delay_class(source_start: Column, source_end: Column, target_start: Column, target_end: Column, delta: Column) -> Column:
    """The delay class that holds the whole interval of possible delays; unknown if none does."""
    least, most = (target_start - source_end) / delta, (target_end - source_start) / delta
    out = F.when(F.lit(False), "")
    for lo, hi, name in DELAYS:
        out = out.when((least >= lo) & ((most <= hi) if name.endswith("]") else (most < hi)), name)
    return out.otherwise("unknown")


def sanitize(text: Column, names: Sequence[str]) -> Column:
    """Log text without identities: entity names (longest first), addresses, UUIDs, and request, trace and span ids."""
    literal = lambda s: "".join("\\" + c if not c.isalnum() and c != "_" else c for c in s)
    out = text
    for name in sorted((n for n in names if n), key=lambda n: (-len(n), n)):
        out = F.when(F.contains(out, F.lit(name)), F.regexp_replace(out, rf"(?U)(?<!\w){literal(name)}(?!\w)", "<ENTITY>")).otherwise(out)
    return _without_ids(out)


def _without_ids(out: Column) -> Column:
    out = F.regexp_replace(out, r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>")
    out = F.regexp_replace(out, r"(?U)\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b", "<UUID>")
    return F.regexp_replace(out, r"(?iU)\b(request[_-]?id|trace[_-]?id|span[_-]?id)\s*[=:]\s*[\w-]+", "$1=<REQUEST>")


def sanitize_by_catalog(records: DataFrame, catalog: DataFrame, key: Sequence[str] = ("case_id",), text: str = "text", id: str = "id") -> DataFrame:  # noqa: A002
    """``records`` with ``text`` as :func:`sanitize` leaves it, the names being all ids of ``catalog`` with the record's ``key``.

    The ids come as one array per key, longest first; they are replaced one after the other, each in the text that the
    ones before left. Records whose key has no ids keep their names.
    """
    order = F.struct((-F.length(id)).alias("l"), F.col(id).alias("n"), F.concat(F.lit(r"(?U)(?<!\w)"), F.regexp_replace(id, r"([^\p{L}\p{N}_])", r"\\$1"), F.lit(r"(?!\w)")).alias("p"))
    names = catalog.where(F.length(id) > 0).groupBy(*key).agg(F.array_sort(F.collect_set(order)).alias("__names"))
    masked = lambda t, n: F.when(F.contains(t, n["n"]), F.regexp_replace(t, n["p"], F.lit("<ENTITY>"))).otherwise(t)
    joined = records.join(names, list(key), "left")
    out = F.when(F.col("__names").isNull(), F.col(text)).otherwise(F.aggregate("__names", F.col(text), masked))
    return joined.withColumn(text, _without_ids(out)).drop("__names")


def apply_mask(samples: DataFrame, blocks: DataFrame, unit: Sequence[str] = ("modality", "owner", "bin")) -> tuple[DataFrame, DataFrame]:
    """Samples with those of the blocks unobserved and 0, and the hidden values as targets. Blocks are distinct ``unit`` rows."""
    marked = samples.join(blocks.select(*unit).distinct().withColumn("__hit", F.lit(True)), list(unit), "left")
    hit = F.coalesce("__hit", F.lit(False))
    kept = marked.withColumns({"value": F.when(hit, 0.0).otherwise(F.col("value")), "observed": F.col("observed") & ~hit}).drop("__hit")
    return kept, marked.where(hit & F.col("observed")).drop("__hit")


def mask_logs(records: DataFrame, blocks: DataFrame, unit: Sequence[str] = ("case_id", "owner", "bin")) -> tuple[DataFrame, DataFrame]:
    """The log records outside the blocks, and those inside, which are hidden whole and become targets. ``blocks`` are those
    of nodes, with the columns ``unit``; records without an owner are in no block."""
    hidden = blocks.select(*unit).distinct()
    return records.join(hidden, list(unit), "left_anti"), records.join(hidden, list(unit), "left_semi")


def case_faults(cases: DataFrame, entities: DataFrame, readings: DataFrame, logs: DataFrame, relations: DataFrame) -> DataFrame:
    """``case_id``, ``what``, ``fault`` of cases whose parts don't fit: ids that occur twice with other attributes, windows out of
    order, owners and endpoints that aren't there, series that run backwards, records without a positive frequency, and
    active intervals that run backwards or leave their relation's hull.

    ``readings`` have ``series_id``, ``seq``, ``modality``, ``owner``, ``time``; metrics belong to entities, traces to relations.
    Copies of one row are no fault.
    """
    from functools import reduce

    from pyspark.sql import Window

    def found(df: DataFrame, what: Column, fault: str) -> DataFrame:
        return df.select("case_id", what.cast("string").alias("what"), F.lit(fault).alias("fault")).distinct()

    def twice(df: DataFrame, *attributes: str) -> DataFrame:
        versions = df.groupBy("case_id", "id").agg(F.countDistinct(F.struct(*attributes)).alias("__k")).where("__k > 1")
        return found(versions, F.col("id"), "an id with several meanings")

    known = entities.select("case_id", F.col("id").alias("owner")).distinct()
    calls = relations.select("case_id", F.col("id").alias("owner")).distinct()
    ends = relations.select("case_id", "id", F.explode(F.array("source", "target")).alias("owner")).distinct()
    owned = readings.select("case_id", "modality", "owner").distinct()
    step = F.lag("time").over(Window.partitionBy("series_id").orderBy("seq"))
    spans = relations.select("case_id", "id", "start_time", "end_time", F.explode("active_intervals").alias("i"))
    outside = (F.col("i.b") < F.col("i.a")) | (F.col("i.a") < F.col("start_time")) | (F.col("i.b") > F.col("end_time"))
    return reduce(DataFrame.unionByName, [
        found(cases.where("not (reference_start <= incident_start and incident_start < incident_end)"), F.col("case_id"), "windows out of order"),
        twice(entities, "category", "candidate"), twice(relations, "source", "target", "kind"),
        found(ends.join(known, ["case_id", "owner"], "left_anti"), F.col("id"), "an endpoint that isn't there"),
        found(owned.where("modality = 'metric'").join(known, ["case_id", "owner"], "left_anti"), F.col("owner"), "a metric without its owner"),
        found(owned.where("modality = 'trace'").join(calls, ["case_id", "owner"], "left_anti"), F.col("owner"), "a trace without its relation"),
        found(logs.where("owner is not null").select("case_id", "owner").distinct().join(known, ["case_id", "owner"], "left_anti"), F.col("owner"), "a record without its owner"),
        found(logs.where("frequency < 1"), F.col("log_id"), "a frequency below one"),
        found(relations.where("end_time < start_time"), F.col("id"), "a relation that ends before it starts"),
        found(spans.where(outside), F.col("id"), "an interval outside its relation"),
        found(readings.withColumn("__before", step).where(F.col("time") < F.col("__before")), F.col("series_id"), "a series that runs backwards"),
    ])
