"""Vector similarity, coverage, and budgeted selection of cases; ranking and evaluation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremolith.functions.vectors import dot, norm
from tremolith.runtime import before_and_total, discard, materialize


def similarity(a: Column, b: Column) -> Column:
    """(1 + inner product) / 2, within 0 and 1."""
    return F.least(F.greatest((F.lit(1.0) + dot(a, b)) / 2, F.lit(0.0)), F.lit(1.0))


def occurrence_weights(tokens: DataFrame) -> DataFrame:
    """Adds ``weight``: 1 / (families x cases with the family x occurrences of the family in the case); sums to 1."""
    counts = tokens.groupBy("case_id", "family").agg(F.count("*").alias("own"))
    families = counts.groupBy("family").agg(F.count("*").alias("cases"))
    n = families.agg(F.count("*").alias("families"))
    scaled = counts.join(families, "family").crossJoin(F.broadcast(n))  # one row
    return tokens.join(scaled.select("case_id", "family", (1.0 / (F.col("families") * F.col("cases") * F.col("own"))).alias("weight")), ["case_id", "family"])


def symptom_tokens(tokens: DataFrame) -> DataFrame:
    """``case_id``, ``kind``, ``provenance``, ``vec`` of the tokens that count: observed, finite, of a length above 1e-12;
    once per provenance, at unit length.

    ``tokens``: case_id, kind, provenance, vec and observed (null counts as true). Copies of one provenance whose vectors
    differ are an error.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = tokens.where(F.coalesce("observed", F.lit(True))).select("case_id", "kind", "provenance", F.col("vec").cast("array<double>").alias("v"))
    rows = rows.where(finite & (norm(F.col("v")) > 1e-12))
    once = rows.groupBy("case_id", "kind", "provenance").agg(F.min("v").alias("v"), F.max("v").alias("w"))
    same = F.when(F.col("v") == F.col("w"), F.col("v")).otherwise(F.raise_error(F.lit("one provenance has two vectors")).cast("array<double>"))
    unit = once.select("case_id", "kind", "provenance", same.alias("v"))
    return unit.select("case_id", "kind", "provenance", F.transform("v", lambda x: x / norm(F.col("v"))).alias("vec"))


def _packed(df: DataFrame, id: str, kind: Column, block: int) -> DataFrame:  # noqa: A002
    """Rows packed into blocks of at most ``block`` vectors of one kind: ``kind``, ``ids``, ``cases``, ``vecs`` (all vectors one
    after the other), ``width``. Each partition packs its own rows as they come, so nothing is shuffled or counted."""
    rows = df.select(kind.alias("kind"), F.col(id).cast("string").alias("i"), F.col("case_id").cast("string").alias("c"), F.col("vec").cast("array<double>").alias("v"))

    def pack(batches):
        held: dict[str, list] = {}

        def block_of(k, rows):
            return pd.DataFrame({"kind": [k], "ids": [[r[0] for r in rows]], "cases": [[r[1] for r in rows]], "vecs": [np.concatenate([r[2] for r in rows])], "width": [len(rows[0][2])]})

        for frame in batches:
            for k, i, c, v in zip(frame["kind"], frame["i"], frame["c"], frame["v"]):
                mine = held.setdefault(k, [])
                mine.append((i, c, v))
                if len(mine) == block:
                    yield block_of(k, held.pop(k))
        for k, mine in held.items():
            yield block_of(k, mine)

    return rows.mapInPandas(pack, "kind string, ids array<string>, cases array<string>, vecs array<double>, width int")


def case_maxima(occurrences: DataFrame, candidates: DataFrame, kind: str | None = None, block: int = 512, chunks: int | None = None) -> DataFrame:
    """``occurrence``, ``case_id``, ``similarity``: the largest similarity of every occurrence to a case's tokens.

    The occurrences are a stated query set (``occurrence``, ``case_id``, ``vec``) against all candidates (``token``,
    ``case_id``, ``vec``), both of unit length. Candidates are packed into blocks of at most ``block`` vectors (of one
    ``kind``, if given) and written once; query blocks meet them by the number of a chunk: candidates are dealt to
    ``chunks`` (twice the cores, if not given), and each query block goes to every chunk of its kind. A pair of blocks is
    one matrix product that emits only a maximum per occurrence and case, combined before the shuffle. All queries meet
    all candidates; nothing is cut.
    """
    kinds = F.coalesce(F.col(kind).cast("string"), F.lit("")) if kind else F.lit("")
    chunks = chunks or 2 * candidates.sparkSession.sparkContext.defaultParallelism
    deal = F.pmod(F.monotonically_increasing_id(), F.lit(chunks)).cast("int")
    right = materialize(_packed(candidates, "token", kinds, block).withColumn("chunk", deal), "candidate-blocks")
    left = _packed(occurrences, "occurrence", kinds, block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    named = lambda df, p: df.select("kind", "chunk", *(F.col(c).alias(f"{p}_{c}") for c in ("ids", "cases", "vecs", "width")))
    pairs = named(left, "q").join(named(right, "t"), ["kind", "chunk"])

    def products(batches):
        for frame in batches:
            for qi, qv, qw, tc, tv, tw in zip(frame["q_ids"], frame["q_vecs"], frame["q_width"], frame["t_cases"], frame["t_vecs"], frame["t_width"]):
                s = np.clip((1 + np.asarray(qv).reshape(-1, qw) @ np.asarray(tv).reshape(-1, tw).T) / 2, 0, 1)
                cases, where = np.unique(np.asarray(tc, dtype=str), return_inverse=True)
                order = np.argsort(where, kind="stable")
                best = np.maximum.reduceat(s[:, order], np.searchsorted(where[order], np.arange(len(cases))), axis=1)
                yield pd.DataFrame({"occurrence": np.repeat(qi, len(cases)), "case_id": np.tile(cases, len(qi)), "similarity": best.ravel()})

    found = pairs.mapInPandas(products, "occurrence string, case_id string, similarity double")
    return found.groupBy("occurrence", "case_id").agg(F.max("similarity").alias("similarity"))


def greedy_cover(spark: SparkSession, maxima: DataFrame, weights: DataFrame, priority: DataFrame, count: int, labeled: Sequence[str] = ()) -> DataFrame:
    """``step``, ``case_id``, ``gain``: cases picked one by one for the largest gain in weighted coverage.

    Ties go to the least ``priority``; zero gains still fill the budget. Only the chosen case's name reaches the driver
    in each of ``count`` steps; coverage so far is a column of the occurrences, written between steps.
    """
    cached = maxima.join(weights, "occurrence")
    base = weights.select("occurrence", F.lit(0.0).alias("base"))
    pool = priority
    if labeled:
        mine = maxima.where(F.col("case_id").isin(*labeled)).groupBy("occurrence").agg(F.max("similarity").alias("base"))
        base, pool = weights.select("occurrence").join(mine, "occurrence", "left").fillna(0.0, ["base"]), priority.where(~F.col("case_id").isin(*labeled))
    base = materialize(base, "base")
    steps = []
    for step in range(count):
        gains = cached.join(base, "occurrence").groupBy("case_id").agg(F.sum(F.col("weight") * F.greatest(F.col("similarity") - F.col("base"), F.lit(0.0))).alias("gain"))
        offers = pool.join(gains, "case_id", "left").fillna(0.0, ["gain"])
        best = offers.agg(F.max_by(F.struct("case_id", "gain"), F.struct(F.round("gain", 12), -F.col("priority"))).alias("b")).first()["b"]
        if best is None:
            break
        steps.append((step, best["case_id"], float(best["gain"])))
        pool = pool.where(F.col("case_id") != best["case_id"])
        chosen = maxima.where(F.col("case_id") == best["case_id"]).select("occurrence", "similarity")
        last, base = base, materialize(base.join(chosen, "occurrence", "left").select("occurrence", F.greatest("base", F.coalesce("similarity", F.lit(0.0))).alias("base")), "base")
        discard(last)
    return spark.createDataFrame(steps, "step int, case_id string, gain double")


def pooled_vectors(tokens: DataFrame) -> DataFrame:
    """``case_id``, ``vec``: mean of a case's different tokens, normalised; null if it has (nearly) no length."""
    each = tokens.groupBy("case_id", "token").agg(F.first("vec").alias("vec"))
    mean = each.select("case_id", F.posexplode("vec").alias("i", "x")).groupBy("case_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return mean.groupBy("case_id").agg(ordered.alias("vec")).withColumn("len", length).select("case_id", F.when(F.col("len") > 1e-12, F.transform("vec", lambda x: x / F.col("len"))).alias("vec"))


def medoid_assignments(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """``case_id``, ``center``, ``distance`` ((1 - cosine) / 2): every case's nearest center, ties to the least priority.

    ``centers`` (case_id, vec, priority) are a selection within the label budget, so their number is bounded by it.
    """
    c = centers.where("vec is not null").select(F.col("case_id").alias("center"), F.col("vec").alias("cv"), "priority")
    all_centers = c.agg(F.collect_list(F.struct("priority", "center", "cv")).alias("cs"))
    near = F.transform("cs", lambda x: F.struct(((F.lit(1.0) - dot(F.col("vec"), x["cv"])) / 2).alias("d"), x["priority"].alias("p"), x["center"].alias("c")))
    picked = vectors.where("vec is not null").crossJoin(F.broadcast(all_centers)).select("case_id", F.array_min(near).alias("m"))  # one row
    return picked.select("case_id", F.col("m.c").alias("center"), F.col("m.d").alias("distance"))


def time_spread(spark: SparkSession, cases: DataFrame, time: str, priority: str, count: int) -> DataFrame:
    """``step``, ``case_id``, ``gain``: the case in the middle in time, then those farthest from all picked ones.

    Times are scaled to 0..1; the least sum of absolute differences is found from prefix sums of the sorted times, not
    from pairs. Null times have distance 0. Ties go to the least priority.
    """
    t = F.col(time)
    ok = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    bounds = cases.where(ok).agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    lo, width = bounds["lo"] or 0.0, (bounds["hi"] or 0.0) - (bounds["lo"] or 0.0)
    scaled = materialize(cases.select("case_id", F.col(priority).alias("p"), F.when(ok, (t - lo) / width if width > 0 else F.lit(0.0)).alias("x")), "times")
    # sum over all of |x - y| at x, from counts per value and their running sums
    values = scaled.where("x is not null").groupBy("x").agg(F.count("*").alias("n")).withColumn("nx", F.col("n") * F.col("x"))
    sums = before_and_total(values, ["x"], ["n", "nx"])
    right = F.col("nx_total") - F.col("nx_upto") - F.col("x") * (F.col("n_total") - F.col("n_upto"))
    spread = sums.select("x", (F.col("x") * F.col("n_upto") - F.col("nx_upto") + right).alias("cost"))
    steps, picked = [], []
    pool = scaled
    for step in range(count):
        if step == 0 and (first := scaled.join(spread, "x").agg(F.min_by(F.struct("case_id", "x"), F.struct(F.round("cost", 9), "p")).alias("b")).first()["b"]):
            best, gain = first, 0.0
        else:
            near = F.least(*(F.abs(F.col("x") - F.lit(v)) for v in picked), F.lit(float("inf"))) if picked else F.lit(0.0)
            offers = pool.select("case_id", "x", "p", F.when(F.col("x").isNull() | F.lit(not picked), 0.0).otherwise(near).alias("gain"))
            best = offers.agg(F.max_by(F.struct("case_id", "x", "gain"), F.struct(F.round("gain", 12), -F.col("p"))).alias("b")).first()["b"]
            if best is None:
                break
            gain = best["gain"]
        steps.append((step, best["case_id"], float(gain)))
        if best["x"] is not None:
            picked.append(best["x"])
        pool = pool.where(F.col("case_id") != best["case_id"])
    return spark.createDataFrame(steps, "step int, case_id string, gain double")


def motif_cover(spark: SparkSession, codes: DataFrame, priority: DataFrame, count: int) -> DataFrame:
    """``step``, ``case_id``, ``gain``: greedy set cover of different ``code``s by cases, ties to the least priority."""
    pairs = materialize(codes.select("case_id", "code").distinct(), "codes")
    steps, pool, left = [], priority, pairs
    for step in range(count):
        offers = pool.join(left.groupBy("case_id").agg(F.count("*").cast("double").alias("gain")), "case_id", "left").fillna(0.0, ["gain"])
        best = offers.agg(F.max_by(F.struct("case_id", "gain"), F.struct("gain", -F.col("priority"))).alias("b")).first()["b"]
        if best is None:
            break
        steps.append((step, best["case_id"], float(best["gain"])))
        pool = pool.where(F.col("case_id") != best["case_id"])
        left = materialize(left.join(pairs.where(F.col("case_id") == best["case_id"]).select("code"), "code", "left_anti"), "codes")
    return spark.createDataFrame(steps, "step int, case_id string, gain double")


def ranking(scores: DataFrame) -> DataFrame:
    """Adds ``rank`` to ``case_id``, ``entity``, ``score``: by falling score, then entity; no ties."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("score").desc(), "entity")))


def case_hits(ranked: DataFrame, largest: int = 5) -> DataFrame:
    """``case_id``, ``roots``, ``first`` (rank of the best root), ``within_k`` and ``hit_k`` for k up to ``largest``."""
    root = F.col("is_root")
    out = ranked.groupBy("case_id").agg(
        F.count_if(root).alias("roots"), F.min(F.when(root, F.col("rank"))).alias("first"), *(F.count_if(root & (F.col("rank") <= k)).alias(f"within_{k}") for k in range(1, largest + 1))
    )
    return out.where("roots > 0").withColumns({f"hit_{k}": (F.col("first") <= k).cast("int") for k in range(1, largest + 1)})


def metric_summary(hits: DataFrame) -> DataFrame:
    """One row: cases, h1..h5, top135, avg5, mrr and its bounds from hits alone, root recall and all-roots at 1, 3, 5."""
    ks = range(1, 6)
    sums = hits.agg(
        F.count("*").alias("cases"), *(F.sum(f"hit_{k}").alias(f"h{k}") for k in ks), F.avg(1.0 / F.col("first")).alias("mrr"),
        *(F.avg(F.col(f"within_{k}") / F.col("roots")).alias(f"root_recall_{k}") for k in (1, 3, 5)),
        *(F.avg((F.col(f"within_{k}") == F.col("roots")).cast("double")).alias(f"all_roots_{k}") for k in (1, 3, 5)),
    )
    n, h = F.col("cases"), [F.lit(0)] + [F.col(f"h{k}") for k in ks]
    lower = sum((h[k] - h[k - 1]) / k for k in ks) / n
    return sums.withColumns({
        "top135": (h[1] + h[3] + h[5]) / (3 * n), "avg5": sum(h[1:], F.lit(0)) / (5 * n), "mrr_lower": lower, "mrr_upper": lower + (n - h[5]) / 6 / n,
    })
