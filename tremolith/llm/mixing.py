"""Mixing sources to target weights, by pivotal dependent rounding.

A mix of a stated size gives every source its weight of it. A source that its cap keeps below that is used up, and what
it lacks is spread over the others by weight. Every document of a source has the same expected number of copies. Its whole part is certain; the fractions are rounded together: two documents at a time exchange
tokens, in a random direction whose odds keep both expectations, until one fraction is 0 or 1. Only one fraction is
left at the end, so a source's tokens differ from its target by less than one document. Buckets of documents round by
themselves, and the one fraction that each leaves goes up a tree of further rounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolith.runtime import materialize

#: Documents that one task rounds, and residuals that one task of a further level combines.
BUCKET, FAN_IN = 20_000, 4_096
EPSILON = 1e-9


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row per target source: ``source``, ``weight``, ``max_repeats``, ``documents``, ``size``, ``goal``, ``rate``,
    ``shortfall``, ``full``.

    ``sizes``: ``source``, ``tokens`` per document. ``total`` is the size of the mix in tokens, that of all documents of
    the target sources if not given. Each source gets its weight of it. Where that is more than its documents give within
    ``max_repeats`` the source is ``full``, and what it lacks goes to the other sources in proportion to their weights; so
    does the share of a source without documents. The goals sum to ``total`` unless all sources are full. ``shortfall``
    says by how many tokens a goal lies below the source's own weight of the total; ``rate`` is the expected number of
    copies of a document. There is a row per source, so the windows over all rows are small.
    """
    have = sizes.where("tokens > 0").groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("size"))
    joined = (
        targets.where("source is not null and weight > 0 and max_repeats > 0")
        .groupBy("source")
        .agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
        .join(have, "source", "left")
        .fillna(0, ["documents", "size"])
    )
    everything = Window.partitionBy(F.lit(0))
    size, weight = F.col("size"), F.col("weight")
    whole = F.lit(float(total)) if total is not None else F.sum("size").over(everything).cast("double")
    rows = joined.withColumns({"room": (F.col("max_repeats") * size).cast("double"), "whole": whole, "weights": F.sum("weight").over(everything)})
    # tokens per weight at which a source is full; sources fill up in this order
    rows = rows.withColumn("level", F.when(size > 0, F.col("room") / weight))
    order = everything.orderBy(F.col("level").asc_nulls_last(), "source")
    used = F.coalesce(F.sum(F.when(size > 0, F.col("room"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum(F.when(size > 0, weight)).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("offer", (F.col("whole") - used) / left)
    # the first source that its offer doesn't fill settles the level of all that aren't full
    reached = F.min(F.when(F.col("offer") <= F.col("level"), F.struct("level", "offer"))).over(everything)["offer"]
    goal = F.when(size <= 0, 0.0).otherwise(F.least(F.col("room"), F.coalesce(weight * reached, F.col("room"))))
    return rows.withColumn("goal", goal).select(
        "source", "weight", "max_repeats", "documents", "size", "goal",
        F.when(size > 0, F.col("goal") / size).otherwise(0.0).alias("rate"),
        F.greatest(weight / F.col("weights") * F.col("whole") - F.col("goal"), F.lit(0.0)).alias("shortfall"),
        ((size > 0) & (F.col("goal") >= F.col("room"))).alias("full"),
    )


def pivot(share: np.ndarray, size: np.ndarray, coin: np.ndarray) -> np.ndarray:
    """Round fractions in order, keeping sum(share * size); at most one stays fractional. ``coin``: uniform numbers."""
    out, size, coin = share.tolist(), size.tolist(), coin.tolist()
    held = -1
    for j in range(len(out)):
        q = out[j]
        if q <= EPSILON or q >= 1 - EPSILON:
            out[j] = round(q)
            continue
        if held < 0:
            held = j
            continue
        p, a, b = out[held], size[held], size[j]
        give, take = min(p * a, (1 - q) * b), min((1 - p) * a, q * b)
        moved = -give if coin[j] * (give + take) < take else take
        p, q = p + moved / a, q - moved / b
        p, q = (round(x) if x <= EPSILON or x >= 1 - EPSILON else x for x in (p, q))
        out[held], out[j] = p, q
        if 0 < q < 1:
            held = j
        elif not 0 < p < 1:
            held = -1
    return np.array(out, float)


def _rounder(last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["coin", "doc_id"], kind="stable").reset_index(drop=True)
        share = pivot(frame["share"].to_numpy(float), frame["tokens"].to_numpy(float), frame["toss"].to_numpy(float))
        if last:
            share = np.where((share > 0) & (share < 1), frame["final"].to_numpy(float) < share, share).astype(float)
        return frame.assign(share=share)

    return run


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, bucket: int = BUCKET, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """The mix and the shares reached.

    ``documents``: ``doc_id``, ``source``, ``tokens``. The mix has ``doc_id``, ``source``, ``tokens``, ``copies`` (1 or
    more, at most the source's ``max_repeats``); the shares have ``source``, ``weight``, ``goal`` (tokens), ``tokens``,
    ``share``, ``documents``, ``drawn`` (documents in the mix), ``most_copies``, ``shortfall`` and ``full`` for every target
    source. ``total`` is the mix's size in tokens; see :func:`plan`.

    Documents without tokens, with a null id, and of null or unlisted sources aren't drawn. Repeated rows of one id
    count as one document (its least source and size). A target row with null or non-positive weight or cap is ignored.
    The draw depends on ``seed`` and the ids alone. Empty tables give no mix and shares of 0.
    """
    known = documents.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("d")).select("doc_id", "d.source", "d.tokens")
    known = materialize(known.where("source is not null and tokens > 0"), "sizes")
    goals = materialize(plan(known, targets, total), "goals")
    rate = F.col("rate")
    draws = known.join(goals.select("source", "rate", "documents"), "source").where("rate > 0")
    uniform = lambda salt: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "doc_id"), 11) / F.lit(float(1 << 53)))
    state = draws.select(
        "doc_id", "source", "tokens", F.floor(rate + EPSILON).alias("sure"), F.greatest(rate - F.floor(rate + EPSILON), F.lit(0.0)).alias("share"),
        uniform("order").alias("coin"), uniform("final").alias("final"), uniform("toss 0").alias("toss"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), "doc_id"), F.ceil(F.col("documents") / bucket)).alias("bucket"),
    )
    # sources are few (the rows of targets), so their largest count is a number for the driver
    buckets = math.ceil((goals.agg(F.max("documents").alias("n")).first()["n"] or 0) / bucket)
    shape = state.schema
    done = []
    while True:
        last = buckets <= 1
        state = materialize(state.groupBy("source", "bucket").applyInPandas(_rounder(last), shape), "rounded")
        open_ = (F.col("share") > 0) & (F.col("share") < 1)
        done.append(state.where(~open_))
        if last:
            break
        state = state.where(open_).withColumns({"bucket": F.floor(F.col("bucket") / fan_in), "toss": uniform(f"toss {len(done)}")})
        buckets = math.ceil(buckets / fan_in)
    rounded = done[0]
    for more in done[1:]:
        rounded = rounded.unionByName(more)
    drawn = rounded.select("doc_id", "source", "tokens", (F.col("sure") + F.col("share")).cast("bigint").alias("copies")).where("copies > 0")
    reached = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("drawn"), F.max("copies").alias("most_copies"))
    reached = goals.select("source", "weight", "goal", "documents", "shortfall", "full").join(reached, "source", "left").fillna(0, ["tokens", "drawn", "most_copies"])
    total_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    shares = reached.select("source", "weight", "goal", "tokens", F.when(total_tokens > 0, F.col("tokens") / total_tokens).otherwise(0.0).alias("share"), "documents", "drawn", "most_copies", "shortfall", "full")
    return drawn, shares
