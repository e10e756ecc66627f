"""Runs of consecutive events that say the same, by pointer doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolith.runtime import discard, few, heavy_keys, materialize, ranges

#: A sequence with more records is cut into shards of about as many, within which predecessors are found by a window.
SHARD_ROWS = 50_000

#: Kinds that prefix entity names, and units of amounts.
ENTITY_KINDS = ("service", "host", "pod", "node")
UNITS = (
    "ns", "us", "µs", "μs", "ms", "s", "sec", "secs", "second", "seconds", "m", "min", "mins", "minute", "minutes", "h", "hr", "hrs",
    "hour", "hours", "d", "day", "days", "%", "percent", "b", "byte", "bytes", "kb", "kib", "mb", "mib", "gb", "gib", "tb", "tib",
)


def message(text: Column) -> Column:
    """What a log text says: lower case, single blanks, no leading time stamps, and ``#`` for entities and their pods,
    ids, addresses and numbers with their units. A step whose pattern needs a certain sign looks for that first."""
    steps = [
        ("", r"(?U)\s{2,}|[\s&&[^ ]]", " "),
        ("", r"^ ?(?:\[?\d{4}-\d\d-\d\d[t ]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)? ?(?:z|[+-]\d\d:?\d\d)?\]?[:,]? ?)+", ""),
        ("id", r"\b(request|trace|span)([_-]?id) ?[=:] ?[\w-]+", "$1$2=#"),
        ("-", r"\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "#"),
        (":", rf"\b(?:{'|'.join(ENTITY_KINDS)}):[\w-]+(?:\.[\w-]+)*", "#"),
        ("-", r"\b[a-z][a-z0-9]*(?:-[a-z0-9]+)*-[0-9a-f]{7,10}-[a-z0-9]{5}\b", "#"),
        (".", r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", "#"),
        ("", r"\b(?:[0-9a-f]{9,}|(?=[a-f]*\d)[0-9a-f]{6,}|0x[0-9a-f]+)\b", "#"),
        ("", rf"\b\d[\d,]*(?:\.\d+)?(?:e[+-]?\d+)?(?: ?(?:{'|'.join(u for u in UNITS if u != '%')})\b| ?%)?", "#"),
        ("", r"\d+", "#"),
        ("#", r"[+-]#", "#"),
    ]

    def step(sign: str, pattern: str, by: str):
        return lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, by)).otherwise(t) if sign else F.regexp_replace(t, pattern, by)

    # an array of one names the text of each step, which is used twice
    out = F.array(F.lower(text))
    for sign, pattern, by in steps:
        out = F.transform(out, step(sign, pattern, by))
    return F.trim(F.element_at(out, 1))


def _predecessors(records: DataFrame, keys: Sequence[str], hot: DataFrame | None, shard_rows: int) -> DataFrame:
    """Every record with ``pointer``: the id of the record before it if that says the same, else null.

    Ordinary sequences are sorted whole. Those of more than ``shard_rows`` records are ranged by time into shards of about
    as many, however close in time they lie; the first record of a shard follows the last one of the shard before, which a
    window over one row per shard gives. ``hot`` are the keys of the latter, if any.
    """
    before = F.struct("id", "said")

    def pointed(df: DataFrame, previous: Column) -> DataFrame:
        return df.withColumn("pointer", F.when(previous["said"] == F.col("said"), previous["id"]))

    ordinary = records if hot is None else records.join(few(hot), keys, "left_anti")
    whole = pointed(ordinary.withColumn("p", F.lag(before).over(Window.partitionBy(*keys).orderBy("time", "id"))), F.col("p")).drop("p")
    if hot is None:
        return whole
    shards = ranges(materialize(records.join(few(hot), keys, "left_semi"), "hot-sequences"), [*keys, "time", "id"], shard_rows, "hot-shards")
    local = shards.withColumn("p", F.lag(before).over(Window.partitionBy(*keys, "part").orderBy("time", "id")))
    carried = (
        shards.groupBy(*keys, "part")
        .agg(F.max_by(before, F.struct("time", "id")).alias("last"))
        .select(*keys, "part", F.lag("last").over(Window.partitionBy(*keys).orderBy("part")).alias("carried"))
        .where("carried is not null")
    )
    stitched = local.join(carried, [*keys, "part"], "left")
    return whole.unionByName(pointed(stitched, F.coalesce("p", "carried")).drop("p", "carried", "part"))


def _double(linked: DataFrame) -> DataFrame:
    """``start``, ``id``, ``time``, ``amount``: the start of the run of every record of ``linked`` that has a ``pointer``.

    Each round replaces a pointer by its target's pointer, so a run of n records takes log2(n) rounds. A record leaves the
    rounds once it points to a start, and starts are never looked up: the records that are still on their way are those of
    one distance, of which each target has one, so no join has a hot key. Rounds are written to the shared scratch folder.
    """
    kept = ["id", "pointer", "time", "amount"]
    followers = linked.where("pointer is not null").select(*kept)
    starts = linked.where("pointer is null").select(F.col("id").alias("t_id"), F.lit(True).alias("at_start"))
    first = followers.join(starts, F.col("pointer") == F.col("t_id"), "left").select(*kept, F.coalesce("at_start", F.lit(False)).alias("done"))
    state = materialize(first, "pointers")
    finished = [state.where("done").select(*kept)]
    running = state.where(~F.col("done"))
    while not running.isEmpty():
        arrived = finished[0]
        for more in finished[1:]:
            arrived = arrived.unionByName(more)
        targets = arrived.select("id", "pointer", F.lit(True).alias("done")).unionByName(running.select("id", "pointer", "done"))
        targets = targets.select(F.col("id").alias("t_id"), F.col("pointer").alias("t_pointer"), F.col("done").alias("t_done"))
        moved = materialize(running.join(targets, F.col("pointer") == F.col("t_id")).select("id", F.col("t_pointer").alias("pointer"), "time", "amount", F.col("t_done").alias("done")), "pointers")
        finished.append(moved.where("done").select(*kept))
        running = moved.where(~F.col("done"))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("pointer", "start")


def collapse_runs(events: DataFrame, keys: Sequence[str], *, id: str, time: str, said: str, frequency: str | None = None, least: int = 1, shard_rows: int = SHARD_ROWS) -> DataFrame:  # noqa: A002
    """One row per run of consecutive events of a sequence that say the same.

    ``keys``, ``first_id``, ``last_id``, ``start_time``, ``end_time``, ``duration`` (seconds), ``records`` and
    ``occurrences`` (sum of ``frequency``; null, or no such column, counts 1), for runs of at least ``least`` records.
    Sequences are the rows of equal ``keys`` in order of (time, id).

    Rows of one id are one event (the least of them in the order of its columns). Events with a null key, id, time or
    text belong to no sequence; a NaN time counts as null. Equal times are ordered by id. An empty input gives no rows;
    other columns are ignored. ``shard_rows`` doesn't change the result.
    """
    keys = list(keys)
    amount = F.coalesce(F.col(frequency), F.lit(1)).cast("bigint") if frequency else F.lit(1).cast("bigint")
    columns = [*keys, "time", "said", "amount"]
    # the text is read once and travels as its digest, which is null where the text is
    records = (
        events.select(*keys, F.col(id).alias("id"), F.col(time).cast("double").alias("time"), F.unhex(F.md5(F.col(said))).alias("said"), amount.alias("amount"))
        .where("id is not null and time is not null and not isnan(time)")
        .dropna(subset=keys)
        .groupBy("id")
        .agg(F.min(F.when(F.col("said").isNotNull(), F.struct(*columns))).alias("r"))
        .where("r is not null")
        .select("id", "r.*")
    )
    # repeated deliveries count here, so no hot sequence is missed; only its keys are read
    hot = heavy_keys(events.select(*keys).dropna(), keys, shard_rows)
    records = records if hot is None else materialize(records, "records")
    linked = materialize(_predecessors(records, keys, hot, shard_rows), "linked")
    if hot is not None:
        discard(records)
    members = (
        _double(linked)
        .groupBy(F.col("start").alias("id"))
        .agg(F.max(F.struct("time", "id")).alias("last"), F.count("*").alias("n"), F.sum("amount").alias("more"))
    )
    starts = linked.where("pointer is null").select(*keys, "id", "time", "amount")
    runs = starts.join(members, "id", "inner" if least > 1 else "left")
    end = F.coalesce(F.col("last.time"), F.col("time"))
    return runs.select(
        *keys,
        F.col("id").alias("first_id"),
        F.coalesce(F.col("last.id"), F.col("id")).alias("last_id"),
        F.col("time").alias("start_time"),
        end.alias("end_time"),
        (end - F.col("time")).alias("duration"),
        (F.coalesce("n", F.lit(0)) + 1).alias("records"),
        (F.coalesce("more", F.lit(0)) + F.col("amount")).alias("occurrences"),
    ).where(F.col("records") >= least)
