"""Streams of observations: windows with late data, repeated deliveries, parents of spans, recovery windows, ledgers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tremolith.operators.protocol import GENESIS, record_hash


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(stream: DataFrame, key: Sequence[str], time: str, delay: str) -> DataFrame:
    """Each key once; state is kept for the watermark's delay only."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def _watermarked(stream: DataFrame, time: str, delay: str | None) -> DataFrame:
    return stream if delay is None else stream.withWatermark(time, delay)


def tumbling(stream: DataFrame, keys: Sequence[str], time: str, value: str, width: str, delay: str | None, start: str = "0 seconds") -> DataFrame:
    """Count, mean, least and most per key and bin; late data within ``delay`` still counts (None: the stream has
    its watermark already)."""
    w = F.window(time, width, width, start)
    grouped = _watermarked(stream, time, delay).groupBy(w, *keys)
    return grouped.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most")).select("window.start", "window.end", *keys, "n", "mean", "least", "most")


def sliding(stream: DataFrame, keys: Sequence[str], time: str, value: str, width: str, slide: str, delay: str | None) -> DataFrame:
    """Count and mean per key over overlapping windows, the context around every bin."""
    grouped = _watermarked(stream, time, delay).groupBy(F.window(time, width, slide), *keys)
    return grouped.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select("window.start", "window.end", *keys, "n", "mean")


def sessions(stream: DataFrame, keys: Sequence[str], time: str, gap: str, delay: str | None) -> DataFrame:
    """Number of events per key and stretch without a gap."""
    grouped = _watermarked(stream, time, delay).groupBy(F.session_window(time, gap), *keys)
    return grouped.agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", *keys, "n")


def parents(spans: DataFrame, callers: DataFrame, time: str, delay: str, horizon: str) -> DataFrame:
    """Spans with the service of their parent, which may arrive up to ``horizon`` before or after; null if it doesn't.

    ``spans``: trace, span, parent, service, time; ``callers`` the same stream read once more.
    """
    child = spans.withWatermark(time, delay).alias("c")
    up = callers.select(F.col("trace").alias("p_trace"), F.col("span").alias("p_span"), F.col("service").alias("parent_service"), F.col(time).alias("p_time")).withWatermark("p_time", delay)
    near = F.expr(f"p_time >= c.{time} - interval {horizon} and p_time <= c.{time} + interval {horizon}")
    on = (F.col("c.trace") == F.col("p_trace")) & (F.col("c.parent") == F.col("p_span")) & near
    return child.join(up, on, "left").select("c.trace", "c.span", "c.parent", "c.service", f"c.{time}", "parent_service")


def stuck_counters(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key``, ``order``, ``run``: how many equal values in succession each reading ends, across micro-batches.

    The state of a key is its last value and the run's length, so it doesn't grow.
    """
    schema = f"{key} bigint, {order} bigint, run bigint"

    def count(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, carried = state.get if state.exists else (None, 0)
        whole = pd.concat(list(frames)).sort_values(order)
        v = whole[value].to_numpy(float)
        fresh = np.r_[last is None or v[0] != last, v[1:] != v[:-1]]
        # position of the latest fresh value, or the run that was carried over
        since = np.maximum.accumulate(np.where(fresh, np.arange(len(v)), -carried))
        runs = np.arange(len(v)) - since + 1
        state.update((float(v[-1]), int(runs[-1])))
        yield pd.DataFrame({key: k[0], order: whole[order].to_numpy(), "run": runs})

    return stream.groupBy(key).applyInPandasWithState(count, schema, "last double, run bigint", "append", "NoTimeout")


def latest_table(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """What a stream of changing results has come to, once all that has arrived is read: the last row of each key.

    Each micro-batch adds its changed rows under its own number, so one that runs again replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def chained_sink(stream: DataFrame, path: str, checkpoint: str, payload: str, order: str) -> StreamingQuery:
    """Appends records to a hash-chained ledger; one writer, one record after the other.

    A batch that was written before a failure is not written twice: its number is part of its folder's name. Each batch
    finds the chain's head in the last batch that has records, whose folder alone is read; a writer that has an older view
    than the folder fails, as its batch's folder is there already.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number:012d}")
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number:012d}/_SUCCESS")):
            return
        head, previous = 0, GENESIS
        for before in range(number - 1, -1, -1):
            folder = f"{path}/batch={before:012d}"
            if fs.exists(jvm.org.apache.hadoop.fs.Path(folder)):
                last = spark.read.schema("sequence bigint, payload string, previous string, hash string").parquet(folder).agg(F.max_by(F.struct("sequence", "hash"), "sequence").alias("h")).first()["h"]
                if last:
                    head, previous = last["sequence"] + 1, last["hash"]
                    break
        start = F.array().cast("array<struct<sequence:bigint,payload:string,previous:string,hash:string>>")
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(payload).cast("string").alias("p"))))
        at = lambda acc: F.lit(head) + F.size(acc)
        before = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["hash"], F.lit(previous))
        step = lambda acc, r: F.concat(acc, F.array(F.struct(at(acc).cast("bigint").alias("sequence"), r["p"].alias("payload"), before(acc).alias("previous"), record_hash(at(acc), before(acc), r["p"]).alias("hash"))))
        # a chain is sequential: a micro-batch is folded by one task, so the trigger bounds its size
        folded = batch.groupBy().agg(rows.alias("rows")).select(F.explode(F.aggregate("rows", start, step)).alias("r")).select("r.*")
        folded.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
