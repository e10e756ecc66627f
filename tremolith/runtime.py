"""Session helpers: table access, lineage cuts in the shared scratch folder, and ranges of bounded size."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key list that may be broadcast (the keys and two numbers each, some tens of MB).
BROADCAST_ROWS = 200_000


def session(app: str = "tremolith", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the library is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a local session that has none gets a temporary one; a cluster
    without a shared folder is an error, as its executors could not read each other's files."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "tremolith-scratch"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _scratch(spark: SparkSession) -> str:
    """The application's own part of the shared folder, which its file system removes when the application ends."""
    path = f"{scratch_dir(spark)}/tremolith/{spark.sparkContext.applicationId}"
    fs, target = _filesystem(spark, path)
    if not fs.exists(target):
        fs.mkdirs(target)
        fs.deleteOnExit(target)
    return path


def materialize(df: DataFrame, label: str = "cut", by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back; ``by`` names columns that lay out its folders.

    Cuts the lineage as a checkpoint does: a lost executor re-reads files, it re-runs nothing. Parquet is several
    times smaller than checkpoint()'s serialised rows, keeps column statistics, and lets later stages prune columns.
    Tables live until :func:`discard`, :func:`release` or the end of the application.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialize` that nothing will read any more, such as the rounds of a loop."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            fs, target = _filesystem(df.sparkSession, path)
            fs.delete(target, True)


def release(spark: SparkSession) -> None:
    """Remove everything that this application wrote to the scratch folder; results not yet read are lost."""
    fs, target = _filesystem(spark, _scratch(spark))
    fs.delete(target, True)


def spread(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows over at least as many partitions as there are cores.

    A table in fewer files than cores would leave cores idle through the costly part of a scan; larger tables have
    partitions enough and stay as they are. Only the layout changes, never the rows. ``by`` names columns that the rows are
    grouped by next, so that they needn't move again; their values should be many.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < cores else df


def ranges(written: DataFrame, order: Sequence[str], rows: int, label: str = "ranges") -> DataFrame:
    """A written table once more, in ranges of about ``rows`` rows in the order of the columns ``order``.

    ``part`` numbers the ranges, so all rows of one part precede those of the next. Bounds are quantiles of a sample of
    the rows, so neither a hot key nor an outlier gives a large range; only rows that agree in all of ``order`` stay
    together. ``written`` must read the same rows each time (a table of :func:`materialize`).
    """
    parts = max(1, math.ceil(written.count() / rows))
    return materialize(written.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), label)


def numbered(df: DataFrame, order: Sequence[str], name: str = "place", rows: int = 1_000_000) -> DataFrame:
    """Adds the 1-based position of every row in the order of the columns ``order``, without a window over all rows.

    Rows are ranged, numbered within their range, and moved by the rows of the ranges before, of which there is one
    summary row each. ``order`` should tell all rows apart.
    """
    from pyspark.sql import Window

    ranged = ranges(materialize(df, "unnumbered"), order, rows)
    sizes = ranged.groupBy("part").agg(F.count("*").alias("__n"))
    before = sizes.select("part", F.coalesce(F.sum("__n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("__local", local).join(before, "part").withColumn(name, F.col("__before") + F.col("__local")).drop("part", "__before", "__local")


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary keys, and those of keys with more than ``rows`` rows in ranges (``part``), if there are any."""
    hot = heavy_keys(df, keys, rows)
    if hot is None:
        return df, None
    hot = few(hot)
    return df.join(hot, list(keys), "left_anti"), ranges(materialize(df.join(hot, list(keys), "left_semi"), "heavy-rows"), [*keys, *order], rows)


def numbered_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place", rows: int = 1_000_000) -> DataFrame:
    """Adds the 1-based position of every row among those of its key, in the order of ``order``, which should tell the rows of a
    key apart. Keys of more than ``rows`` rows are numbered in ranges, moved by one summary row each."""
    from pyspark.sql import Window

    whole, heavy = _cut(df, keys, order, rows)
    out = whole.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    if heavy is None:
        return out
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = heavy.groupBy(*keys, "part").agg(F.count("*").alias("__n")).select(*keys, "part", F.coalesce(before, F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order))
    numbered_ = heavy.withColumn("__local", local).join(offsets, [*keys, "part"]).withColumn(name, F.col("__before") + F.col("__local"))
    return out.unionByName(numbered_.select(*out.columns))


def greatest_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value, name: str, rows: int = 1_000_000) -> DataFrame:
    """Adds the greatest ``value`` of the rows before each row of its key in the order of ``order`` (null for none). Keys of more than
    ``rows`` rows are cut into ranges, each with the greatest value of the ranges before."""
    from pyspark.sql import Window

    valued = df.withColumn("__value", value)
    whole, heavy = _cut(valued, keys, order, rows)
    earlier = lambda w: F.max("__value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = whole.withColumn(name, earlier(Window.partitionBy(*keys).orderBy(*order)))
    if heavy is not None:
        reach = heavy.groupBy(*keys, "part").agg(F.max("__value").alias("__value"))
        carried = reach.select(*keys, "part", earlier(Window.partitionBy(*keys).orderBy("part")).alias("__carried"))
        local = heavy.withColumn("__local", earlier(Window.partitionBy(*keys, "part").orderBy(*order))).join(carried, [*keys, "part"])
        out = out.unionByName(local.withColumn(name, F.greatest("__local", "__carried")).select(*out.columns))
    return out.drop("__value")


def few(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written list of keys, marked for broadcast if counting shows that it is short; beyond that Spark joins it as it likes."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def many(rows: DataFrame) -> DataFrame:
    """A side of a join that is sorted and merged at any size, never broadcast. For lists and their items: Spark takes their size
    from the compressed file and counts one item a list, so it would broadcast more of them than a driver holds."""
    return rows.hint("merge")


def heavy_keys(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame | None:
    """The keys that have more than ``rows`` rows, written, or None if there are none."""
    found = materialize(df.groupBy(*keys).agg(F.count("*").alias("__rows")).where(F.col("__rows") > rows).select(*keys), "heavy")
    return None if found.isEmpty() else found


def sharded(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, halo: int) -> DataFrame:
    """The rows with ``__shard`` and ``__core``, so that windows by ``keys`` and ``__shard`` in the order of ``order`` see
    ``halo`` rows before and after each core row.

    A key of at most ``rows`` rows is one shard of core rows. Others are numbered in order and cut by position; a row near a
    bound is also given to the neighbour, where it isn't core. Results are kept for core rows only. ``order`` should tell
    the rows of a key apart.
    """
    hot = heavy_keys(df, keys, rows)
    plain = lambda d: d.withColumns({"__shard": F.lit(0).cast("bigint"), "__core": F.lit(True)})
    if hot is None:
        return plain(df)
    hot = few(hot)
    placed = numbered_within(df.join(hot, list(keys), "left_semi"), keys, order, "__at", rows)
    shard = lambda d: F.floor((F.col("__at") - 1 + d) / rows)
    cut = placed.withColumn("__shard", F.explode(F.array_distinct(F.array(shard(-halo), shard(0), shard(halo))))).withColumn("__core", F.col("__shard") == shard(0))
    return plain(df.join(hot, list(keys), "left_anti")).unionByName(cut.select(*df.columns, "__shard", "__core"))


def before_and_total(df: DataFrame, order: Sequence[str], values: Sequence[str], rows: int = 1_000_000) -> DataFrame:
    """Adds ``<v>_upto`` (running sum, the row's own included) and ``<v>_total`` for each of ``values`` in the order of
    ``order``, without a window over all rows: ranges are summed by themselves and moved by one summary row each."""
    from pyspark.sql import Window

    ranged = ranges(materialize(df, "unsummed"), order, rows)
    sums = ranged.groupBy("part").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    across = Window.orderBy("part")
    moved = sums.select(
        "part",
        *(F.coalesce(F.sum(f"__{v}").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__{v}_before") for v in values),
        *(F.sum(f"__{v}").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{v}_total") for v in values),
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({f"__{v}_local": F.sum(v).over(within) for v in values}).join(moved, "part")
    out = out.withColumns({f"{v}_upto": F.col(f"__{v}_before") + F.col(f"__{v}_local") for v in values})
    return out.drop("part", *(f"__{v}_before" for v in values), *(f"__{v}_local" for v in values))
