"""Implausible readings: spikes, stuck values and values outside physical limits, per source.

Each source is judged by robust exponentially weighted control charts that run over its readings in order, once from
either end. A suspected reading is clipped before it updates the chart's mean and scale; a run-length counter of
suspected readings on one side re-anchors the chart when a new level lasts. A reading is a spike if it is far from the
chart of the readings before it and from that of the readings after it, so a lasting change of level is none. Another
run-length counter finds stretches of equal values.

Sources are cut into shards of ``SHARD`` positions with ``HALO`` positions of warm-up from both neighbours (by then the
charts have forgotten their start), so no task holds a whole source. Whether a source varies, and how long a stretch of
equal values is, is known of the whole source before its shards are judged. In a task, all shards of a batch advance in
lockstep: one numpy step per position for thousands of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolith.runtime import few, materialize

SHARD, HALO = 4_096, 256
#: Weights of a reading in the charts' mean and squared scale.
MEAN_WEIGHT, SCALE_WEIGHT = 0.2, 0.02
#: Scales from the mean beyond which a reading is a spike, on the reading's own scale and, for positive sources, on the logarithmic one.
FAR, FAR_LOG = 7.0, 4.6
#: So many suspected readings in succession on one side are a new level.
LASTING = 7
#: Equal values in succession that are stuck, and the greatest share of equal neighbours in a source that varies.
STUCK, REPEATS = 10, 0.15
BATCH_ROWS = 200_000


def _median(a: np.ndarray) -> np.ndarray:
    """Row medians that ignore NaN; 0 where all are."""
    a = np.sort(a, axis=1)
    n = np.sum(~np.isnan(a), axis=1)
    rows = np.arange(len(a))
    out = (a[rows, np.maximum(n - 1, 0) // 2] + a[rows, np.minimum(n // 2, a.shape[1] - 1)]) / 2
    return np.where(n > 0, out, 0.0)


def robust_scale(x: np.ndarray) -> np.ndarray:
    """Scatter of each row from its successive differences, which spikes and changes of level leave alone."""
    if x.shape[1] < 2:
        return np.zeros(len(x))
    return 1.4826 * _median(np.abs(np.diff(x, axis=1))) / np.sqrt(2)


def chart(x: np.ndarray, scale: np.ndarray, floor: np.ndarray, far: float, mean_weight: float = MEAN_WEIGHT, scale_weight: float = SCALE_WEIGHT, lasting: int = LASTING) -> np.ndarray:
    """Signed distance of every reading from its row's chart, in scales. NaN readings are passed over."""
    rows, steps = x.shape
    mean = _median(np.where(np.cumsum(~np.isnan(x), axis=1) <= lasting, x, np.nan))
    scale = np.maximum(scale, floor)
    var = scale**2
    run = np.zeros(rows)
    recent = np.full((rows, lasting), np.nan)
    z = np.zeros_like(x)
    for i in range(steps):
        v = x[:, i]
        ok = ~np.isnan(v)
        s = np.sqrt(var)
        with np.errstate(invalid="ignore"):
            zi = np.where(ok, (v - mean) / s, 0.0)
        z[:, i] = zi
        side = np.where(np.abs(zi) > far, np.sign(zi), 0.0)
        # run-length counter of suspected readings on one side
        run = np.where(ok, np.where(side == 0, 0.0, np.where(np.sign(run) == side, run + side, side)), run)
        recent[:, i % lasting] = np.where(ok, v, recent[:, i % lasting])
        # suspected values count as one scale off, others at most three
        step = np.where(side != 0, side, np.clip(zi, -3.0, 3.0)) * s
        mean = mean + mean_weight * step
        var = np.where(ok, np.maximum((1 - scale_weight) * var + scale_weight * step**2, floor**2), var)
        lasts = np.abs(run) >= lasting
        if lasts.any():
            mean = np.where(lasts, _median(recent), mean)
            run = np.where(lasts, 0.0, run)
    return z


def _flipped(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's readings in reverse; what pads a row stays behind them."""
    back = lengths[:, None] - 1 - np.arange(x.shape[1])
    return np.where(back >= 0, np.take_along_axis(x, np.maximum(back, 0), axis=1), np.nan)


def _far_both_ways(x: np.ndarray, lengths: np.ndarray, floor: np.ndarray, far: float) -> np.ndarray:
    """Positions far from both charts, on the same side."""
    scale = robust_scale(x)
    forward = chart(x, scale, floor, far)
    backward = _flipped(chart(_flipped(x, lengths), scale, floor, far), lengths)
    with np.errstate(invalid="ignore"):
        return (np.minimum(forward, backward) > far) | (np.maximum(forward, backward) < -far)


def stretches(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the run of equal successive values that each position belongs to, and whether it equals its predecessor."""
    same = np.zeros(len(values), bool)
    same[1:] = (values[1:] == values[:-1]) & (group[1:] == group[:-1])
    run = np.cumsum(~same) - 1
    return np.bincount(run)[run] if len(run) else run, same


def _grain(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Least scale of a row: 1 for counts, else its least step, but no more than a tenth of its level."""
    steps = np.diff(np.sort(x, axis=1), axis=1)
    with np.errstate(invalid="ignore"):
        least = np.where(steps > 0, steps, np.inf).min(axis=1, initial=np.inf)
        whole = np.all(np.isnan(x) | (x == np.floor(x)), axis=1)
    return np.where(whole, 1.0, np.minimum(np.where(np.isfinite(least), least, 0.0), 0.1 * middle))


def judge(group: np.ndarray, value: np.ndarray, outside: np.ndarray, known: np.ndarray | None = None, given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spike and stuck flags of readings that are sorted by source and position; ``group`` numbers the sources. Where
    ``known``, the stuck flag is ``given``, as the readings are but a part of their source."""
    n = len(value)
    spike = np.zeros(n, bool)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    lengths = np.diff(np.r_[starts, n])
    which = np.repeat(np.arange(len(starts)), lengths)

    run, same = stretches(value, group)
    first = np.zeros(n, bool)
    first[starts] = True
    pairs = ~first & ~(same & (run >= STUCK))
    repeats = np.bincount(which, same & pairs, len(starts)) / np.maximum(np.bincount(which, pairs, len(starts)), 1)
    stuck = (run >= STUCK) & ((repeats < REPEATS) & (np.bincount(which, pairs, len(starts)) >= STUCK))[which]
    if known is not None:
        stuck = np.where(known, given, stuck)

    # rows of similar length together, so that padding stays small
    order = np.argsort(lengths, kind="stable")
    clean = np.where(outside | stuck, np.nan, value)
    begin = 0
    while begin < len(order):
        stop = begin + 1
        while stop < len(order) and (stop - begin + 1) * lengths[order[stop]] <= BATCH_ROWS:
            stop += 1
        rows = order[begin:stop]
        at = starts[rows, None] + np.arange(lengths[rows].max())
        there = np.arange(at.shape[1]) < lengths[rows][:, None]
        x = np.where(there, clean[np.minimum(at, n - 1)], np.nan)
        middle = np.abs(_median(x))
        floor = np.maximum(_grain(x, middle), 1e-6 * middle + 1e-12)
        far = _far_both_ways(x, lengths[rows], floor, FAR)
        with np.errstate(invalid="ignore", divide="ignore"):
            positive = np.nanmin(np.where(np.isnan(x), np.inf, x), axis=1) > 0
            logs = np.where(positive[:, None], np.log(np.where(x > 0, x, 1.0)), 0.0)
        logs = np.where(np.isnan(x), np.nan, logs)
        if positive.any():
            far_log = _far_both_ways(logs, lengths[rows], np.where(middle > 0, floor / np.maximum(middle, 1e-300), 1.0), FAR_LOG)
            far &= far_log | ~positive[:, None]
        spike[at[there]] = far[there]
        begin = stop
    return spike & ~outside, stuck


def _flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole shards, gathered over batch bounds; at most BATCH_ROWS readings and one shard are held."""
    held: list[pd.DataFrame] = []
    count = 0

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        is_mark = frame["mark"].notna().to_numpy()
        marks, frame = frame[is_mark], frame[~is_mark]
        k, sh, q = (frame[c].to_numpy() for c in ("k", "shard", "seq"))
        keep = np.r_[True, (k[1:] != k[:-1]) | (sh[1:] != sh[:-1]) | (q[1:] != q[:-1])] if len(q) else np.zeros(0, bool)
        frame = frame[keep]
        k, sh, q = k[keep], sh[keep], q[keep]
        group = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (sh[1:] != sh[:-1])][: len(q)]) - 1
        outside = frame["outside"].to_numpy(dtype=bool)
        known, given = np.zeros(len(q), bool), np.zeros(len(q), bool)
        if len(marks):
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(q)])
            bounds = {(k[i], sh[i]): (i, j) for i, j in zip(starts, np.r_[starts[1:], len(q)])}
            for mk, ms, begin, end in zip(marks["k"], marks["shard"], marks["seq"], marks["mark"]):
                i, j = bounds.get((mk, ms), (0, 0))
                known[i:j] = True
                given[i + np.searchsorted(q[i:j], begin) : i + np.searchsorted(q[i:j], end, side="right")] |= begin >= 0
        spike, stuck = judge(group, frame["value"].to_numpy(dtype=float), outside, known, given)
        hit = (outside | spike | stuck) & (q // SHARD == sh)
        return pd.DataFrame({"k": k[hit], "seq": q[hit], "value": frame["value"].to_numpy()[hit], "outside": outside[hit], "spike": spike[hit], "stuck": stuck[hit]})

    for frame in batches:
        if not len(frame):
            continue
        held.append(frame)
        count += len(frame)
        if count >= BATCH_ROWS:
            whole = pd.concat(held, ignore_index=True)
            k, sh = whole["k"].to_numpy(), whole["shard"].to_numpy()
            cut = np.flatnonzero((k != k[-1]) | (sh != sh[-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                yield work(whole.iloc[:cut])
            held, count = [whole.iloc[cut:]], len(whole) - cut
    if count:
        yield work(pd.concat(held, ignore_index=True))


def _equal_stretches(readings: DataFrame) -> DataFrame:
    """``k``, ``begin``, ``end``, ``length`` of all stretches of equal values of the sources in ``readings`` (k, seq, value).

    Stretches are numbered within shards of positions; one that goes on from the shard before is found among one summary
    row per shard, so neither a long source nor a long stretch is one task.
    """
    once = readings.groupBy("k", "seq").agg(F.min("value").alias("value")).withColumn("shard", F.floor(F.col("seq") / SHARD))
    within = Window.partitionBy("k", "shard").orderBy("seq")
    begins = F.lag("value").over(within).isNull() | (F.lag("value").over(within) != F.col("value"))
    cells = materialize(once.withColumn("begins", begins.cast("int")).withColumn("n", F.sum("begins").over(within)), "stretches")
    mine = Window.partitionBy("k").orderBy("shard")
    shards = cells.groupBy("k", "shard").agg(F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last"), F.max("n").alias("m"))
    shards = shards.withColumn("goes_on", F.coalesce(F.lag("last").over(mine) == F.col("first"), F.lit(False)))
    # the stretch that a shard's first one belongs to begins in the latest shard with a stretch of its own
    own = F.when(~F.col("goes_on") | (F.col("m") > 1), F.struct("shard", "m"))
    origin = F.last(own, ignorenulls=True).over(mine.rowsBetween(Window.unboundedPreceding, -1))
    origins = shards.withColumn("origin", F.when(F.col("goes_on"), origin)).where("origin is not null").select("k", "shard", F.col("origin.shard").alias("o"), F.col("origin.m").alias("om"), F.lit(1).alias("n"))
    local = cells.groupBy("k", "shard", "n").agg(F.min("seq").alias("begin"), F.max("seq").alias("end"), F.count("*").alias("length"))
    whole = local.join(origins, ["k", "shard", "n"], "left").select("k", F.coalesce("o", "shard").alias("shard"), F.coalesce("om", "n").alias("n"), "begin", "end", "length")
    return whole.groupBy("k", "shard", "n").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("length").alias("length")).drop("shard", "n")


def _marks(long: DataFrame, readings: DataFrame) -> DataFrame:
    """Rows for the shards of long sources: one with seq -1 that says that the source is known, and one per stuck stretch
    (``seq`` to ``mark``) that reaches into the shard."""
    mine = readings.join(few(long), "k", "left_semi").select("k", "seq", "value")
    found = materialize(_equal_stretches(mine), "stretch-list")
    short = F.when(F.col("length") < STUCK, F.col("length") - 1).otherwise(0)
    sources = found.groupBy("k").agg((F.sum(short + 1) - 1).alias("pairs"), F.sum(short).alias("repeats"), F.max("end").alias("last"))
    varies = (F.col("repeats") < REPEATS * F.greatest("pairs", F.lit(1))) & (F.col("pairs") >= STUCK)
    shards = lambda a, b: F.explode(F.sequence(F.greatest(F.floor((a - HALO) / SHARD), F.lit(0).cast("bigint")), F.floor((b + HALO) / SHARD)))
    known = sources.select("k", shards(F.lit(0), F.col("last")).alias("shard"), F.lit(-1).cast("bigint").alias("seq"), F.lit(-1).cast("bigint").alias("mark"))
    stuck = found.where(F.col("length") >= STUCK).join(sources.where(varies).select("k"), "k").select("k", shards(F.col("begin"), F.col("end")).alias("shard"), F.col("begin").alias("seq"), F.col("end").alias("mark"))
    return known.unionByName(stuck)


def implausible_readings(
    readings: DataFrame, key: str, seq: str = "seq", value: str = "value", lowest: str = "lowest", highest: str = "highest"
) -> DataFrame:
    """Flagged readings only: ``key``, ``seq``, ``value``, ``outside``, ``spike``, ``stuck``.

    ``readings`` has a ``key`` (bigint), the position ``seq`` (bigint, 0 or more) and the ``value`` of every usable
    reading, with the source's physical limits (inclusive, null for none). Rows of one key and position are one reading
    (the one with the least value, should they differ). Rows whose key, position or value is null, or whose value is
    NaN or infinite, are ignored. Constant sources and sources whose neighbours are often equal have no stuck
    stretches. An empty input gives no rows; further columns are ignored.

    Sources of more than ``SHARD`` positions are read twice: their stretches of equal values, and whether they vary, are
    found over the whole source, so a stuck stretch may be longer than a shard. The charts of a shard begin ``HALO``
    positions before it.
    """
    v = F.col(value).cast("double")
    s = F.col(seq).cast("bigint")
    shard = F.floor(F.col("seq") / SHARD)
    rows = (
        readings.select(
            F.col(key).cast("bigint").alias("k"),
            s.alias("seq"),
            v.alias("value"),
            (F.coalesce(v < F.col(lowest), F.lit(False)) | F.coalesce(v > F.col(highest), F.lit(False))).alias("outside"),
        )
        .where("k is not null and seq >= 0 and value is not null")
        .where(~F.isnan("value") & (F.abs("value") < float("inf")))
    )
    near = F.array_distinct(F.array(F.floor((F.col("seq") - HALO) / SHARD), shard, F.floor((F.col("seq") + HALO) / SHARD)))
    placed = rows.select("k", F.explode(near).alias("shard"), "seq", "value", "outside", F.lit(None).cast("bigint").alias("mark")).where("shard >= 0")
    # pruned by the columns' statistics where no source is long
    long = materialize(rows.where(F.col("seq") >= SHARD).select("k").distinct(), "long-sources")
    if not long.isEmpty():
        placed = placed.unionByName(_marks(long, rows).withColumns({"value": F.lit(0.0), "outside": F.lit(False)}))
    return (
        placed.repartition("k", "shard")
        .sortWithinPartitions("k", "shard", "seq", "value")
        .mapInPandas(_flag, "k bigint, seq bigint, value double, outside boolean, spike boolean, stuck boolean")
        .withColumnRenamed("k", key)
    )
