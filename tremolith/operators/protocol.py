"""Hash-ordered partitions and quotas, hash-chained ledgers, losses and diagnostics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolith.runtime import few, materialize, numbered, numbered_within

SCHEMA = "tremolith/partition/1"
GENESIS = "0" * 64
#: Records of a ledger that are folded in one row.
LEDGER_RECORDS = 100_000


def json_text(**fields: Column | str | int) -> Column:
    """Canonical JSON of one object with sorted keys and no blanks; values are text, whole numbers or text columns."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields)):
        value = fields[key]
        parts.append(F.lit(("," if i else "{") + f'"{key}":'))
        parts.append(F.lit(str(value)) if isinstance(value, int) else quote(F.lit(value) if isinstance(value, str) else value))
    return F.concat(*parts, F.lit("}"))


def substream(dataset: str, purpose: str, seed: int) -> Column:
    """Seed of one purpose: SHA-256 of its canonical description."""
    return F.sha2(json_text(dataset=dataset, purpose=purpose, schema=SCHEMA, seed=seed), 256)


def hash_priority(id: Column, stream: Column) -> Column:  # noqa: A002
    """Priority of an id in a stream; independent of order, partitions and random state."""
    return F.sha2(json_text(case_id=id, substream_seed=stream), 256)


def demo_partition(cases: DataFrame, dataset: str, seed: int, reserve: int = 30) -> DataFrame:
    """``case_id``, ``role`` (demo or search), ``place``: the first ``reserve`` ids by one hash order, the rest by another.

    The reserve is a top-k; the places of the rest come from ranges of their hashes, numbered by themselves.
    """
    ids = cases.select("case_id").distinct().withColumn("priority", hash_priority(F.col("case_id"), substream(dataset, "reserve", seed)))
    demo = materialize(ids.orderBy("priority", "case_id").limit(reserve), "reserve")
    placed = demo.withColumn("place", F.row_number().over(Window.orderBy("priority", "case_id")).cast("bigint"))  # at most ``reserve`` rows
    rest = ids.join(few(demo.select("case_id")), "case_id", "left_anti").withColumn("priority", hash_priority(F.col("case_id"), substream(dataset, "search", seed)))
    searched = numbered(rest, ["priority", "case_id"])
    return placed.select("case_id", F.lit("demo").alias("role"), "place").unionByName(searched.select("case_id", F.lit("search").alias("role"), "place"))


def hamilton_quotas(strata: DataFrame, stratum: str, seats: int, dataset: str, seed: int) -> DataFrame:
    """``stratum``, ``members``, ``base``, ``remainder``, ``quota``: largest remainders, ties by hash. One row per stratum."""
    sizes = strata.groupBy(stratum).agg(F.count("*").alias("members")).withColumn("total", F.sum("members").over(Window.partitionBy(F.lit(0))))
    share = F.col("members") * F.lit(seats)
    rows = sizes.withColumns({"base": F.floor(share / F.col("total")), "remainder": F.pmod(share, F.col("total"))})
    tie = F.sha2(json_text(stratum_id=F.col(stratum).cast("string"), substream_seed=substream(dataset, "stratum-tie", seed)), 256)
    rows = rows.withColumns({"left": F.lit(seats) - F.sum("base").over(Window.partitionBy(F.lit(0))), "tie": tie})
    place = F.row_number().over(Window.orderBy(F.col("remainder").desc(), "tie", stratum))
    return rows.withColumn("place", place).select(stratum, "members", "base", "remainder", (F.col("base") + (F.col("place") <= F.col("left")).cast("bigint")).alias("quota"))


def stratified_partition(cases: DataFrame, stratum: str, seats: int, dataset: str, seed: int) -> DataFrame:
    """``case_id``, ``stratum``, ``role`` (selected or search), ``place``: a holdout of ``seats`` cases in proportion to the strata.

    Each stratum gives its quota of largest remainders, the members of least hash first; the selected cases are presented,
    and the others searched, in hash orders of their own. A case has one stratum (its least, should rows disagree).
    """
    once = cases.groupBy("case_id").agg(F.min(stratum).alias(stratum))
    quotas = hamilton_quotas(once, stratum, seats, dataset, seed).select(stratum, "quota")
    text = F.col(stratum).cast("string")
    priority = F.sha2(json_text(case_id=F.col("case_id"), stratum_id=text, substream_seed=substream(dataset, "within-stratum", seed)), 256)
    ranked = numbered_within(once.withColumn("priority", priority), [stratum], ["priority", "case_id"])
    chosen = materialize(ranked.join(quotas, stratum).withColumn("role", F.when(F.col("place") <= F.col("quota"), "selected").otherwise("search")).select("case_id", stratum, "role"), "strata")
    out = []
    for role, purpose in (("selected", "semantic-presentation"), ("search", "demo-search")):
        part = chosen.where(F.col("role") == role).withColumn("priority", hash_priority(F.col("case_id"), substream(dataset, purpose, seed)))
        out.append(numbered(part, ["priority", "case_id"]).select("case_id", F.col(stratum).alias("stratum"), "role", "place"))
    return out[0].unionByName(out[1])


def record_hash(sequence: Column, previous: Column, payload: Column) -> Column:
    """Hash of one ledger record."""
    return F.sha2(F.concat_ws("|", sequence.cast("string"), previous, payload), 256)


def chain(records: DataFrame, ledger: str, sequence: str, payload: str) -> DataFrame:
    """Hash-chained records of every ledger: ``ledger``, ``sequence``, ``payload``, ``previous``, ``hash``.

    A chain is sequential by nature: each ledger is folded in order, different ledgers in parallel. A ledger is one row
    while it is folded, so it may have at most ``LEDGER_RECORDS`` records; a longer one is an error. Longer chains are
    appended in batches, see ``streaming.ingest.chained_sink``.
    """
    size = records.groupBy(ledger).agg(F.count("*").alias("__n")).where(F.col("__n") > LEDGER_RECORDS)
    if not size.isEmpty():
        raise ValueError(f"a ledger has more than {LEDGER_RECORDS} records; append it in batches")
    ordered = records.groupBy(ledger).agg(F.array_sort(F.collect_list(F.struct(F.col(sequence).alias("s"), F.col(payload).alias("p")))).alias("rows"))
    start = F.array().cast("array<struct<s:bigint,p:string,previous:string,hash:string>>")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["hash"], F.lit(GENESIS))
    step = lambda acc, r: F.concat(acc, F.array(F.struct(r["s"].cast("bigint").alias("s"), r["p"].cast("string").alias("p"), last(acc).alias("previous"), record_hash(r["s"], last(acc), r["p"]).alias("hash"))))
    return ordered.select(ledger, F.explode(F.aggregate("rows", start, step)).alias("r")).select(ledger, F.col("r.s").alias("sequence"), F.col("r.p").alias("payload"), F.col("r.previous").alias("previous"), F.col("r.hash").alias("hash"))


def chain_faults(chained: DataFrame, ledger: str) -> DataFrame:
    """Records whose number, link or hash is wrong: ``ledger``, ``sequence``, ``fault``. Checked by one window per ledger."""
    w = Window.partitionBy(ledger).orderBy("sequence")
    checked = chained.withColumns({"ordinal": F.row_number().over(w) - 1, "before": F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))})
    fault = (
        F.when(F.col("sequence") != F.col("ordinal"), "sequence").when(F.col("previous") != F.col("before"), "link")
        .when(F.col("hash") != record_hash(F.col("sequence"), F.col("previous"), F.col("payload")), "hash")
    )
    return checked.withColumn("fault", fault).where("fault is not null").select(ledger, "sequence", "fault")


def cumulative_hits(attempts: DataFrame, ledger: str, order: str, case: str, hit: str) -> DataFrame:
    """``ledger``, ``order``, ``case``, ``scored``, ``hits``: running counts over each case's first attempt."""
    first = attempts.groupBy(ledger, case).agg(F.min(F.struct(order, hit)).alias("f")).select(ledger, case, f"f.{order}", f"f.{hit}")
    w = Window.partitionBy(ledger).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return first.select(ledger, order, case, F.count("*").over(w).alias("scored"), F.sum(F.col(hit).cast("bigint")).over(w).alias("hits"))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def class_bce(scores: DataFrame, case: str, score: str, root: str) -> DataFrame:
    """``case``, ``loss``: mean softplus over roots and over the others, averaged over the classes that are there."""
    s = F.col(score)
    parts = scores.groupBy(case).agg(F.avg(F.when(F.col(root), softplus(-s))).alias("a"), F.avg(F.when(~F.col(root), softplus(s))).alias("b"))
    there = F.when(F.col("a").isNull(), 0).otherwise(1) + F.when(F.col("b").isNull(), 0).otherwise(1)
    return parts.select(case, ((F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) / F.nullif(there, F.lit(0))).alias("loss"))


def hierarchical_huber(entries: DataFrame, levels: list[str], error: Column) -> DataFrame:
    """One row ``loss``: Huber loss (delta 1) averaged level by level from the last of ``levels`` up; missing errors don't count."""
    out = entries.withColumn("loss", F.when(F.abs(error) <= 1, 0.5 * error * error).otherwise(F.abs(error) - 0.5))
    for k in range(len(levels), -1, -1):
        out = out.groupBy(*levels[:k]).agg(F.avg("loss").alias("loss"))
    return out


def soft_source_loss(candidates: DataFrame, case: str, logit: str, energy: str, size: str, penalty: float = 0.5, temperature: float = 1.0) -> DataFrame:
    """``case``, ``loss``: -T logsumexp(log_softmax(logit - penalty size) - energy / T)."""
    a = F.col(logit) - F.lit(penalty) * F.col(size)
    w = Window.partitionBy(case)
    rows = candidates.withColumn("a", a).withColumn("top", F.max("a").over(w))
    rows = rows.withColumn("b", F.col("a") - F.col("top") - F.log(F.sum(F.exp(F.col("a") - F.col("top"))).over(w)) - F.col(energy) / temperature)
    rows = rows.withColumn("peak", F.max("b").over(w))
    return rows.groupBy(case).agg((-(F.log(F.sum(F.exp(F.col("b") - F.col("peak")))) + F.max("peak")) * temperature).alias("loss"))


def representation_change(pairs: DataFrame, before: str, after: str, affected: str) -> DataFrame:
    """``affected``, ``n``, ``l2``, ``relative``: mean distance of vectors, and relative to the length before (1e-12 at least)."""
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    moved = length(F.zip_with(before, after, lambda a, b: b.cast("double") - a.cast("double")))
    size = F.greatest(length(F.transform(before, lambda x: x.cast("double"))), F.lit(1e-12))
    return pairs.groupBy(affected).agg(F.count("*").alias("n"), F.avg(moved).alias("l2"), F.avg(moved / size).alias("relative"))


def completion_gap(masks: DataFrame, case: str, mask: str, error: str, true: str) -> DataFrame:
    """``case``, ``gap``: mean over masks of the wrong sources' mean error minus the true source's; masks that lack either don't count."""
    e = F.col(error)
    each = masks.groupBy(case, mask).agg((F.avg(F.when(~F.col(true), e)) - F.avg(F.when(F.col(true), e))).alias("g"))
    return each.where("g is not null").groupBy(case).agg(F.avg("g").alias("gap"))


def eligible_mean(losses: DataFrame, groups: list[str], loss: str) -> DataFrame:
    """``groups``, ``loss``: the mean of the losses that are there; null where none is."""
    return losses.groupBy(*groups).agg(F.avg(loss).alias("loss"))


def observation_loss(parts: DataFrame, local: str = "local_recovery", process: str = "process_recovery", invariance: str = "invariance") -> DataFrame:
    """Adds ``observation``: a third of the sum of the three losses, missing ones counting 0; null where all are missing."""
    names = (local, process, invariance)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in names), F.lit(0.0)) / 3
    return parts.withColumn("observation", F.when(F.coalesce(*names).isNotNull(), total))


def labeled_source_loss(errors: DataFrame, case: str, error: str, true: str) -> DataFrame:
    """``case``, ``loss``: the error of the true source set plus the mean softplus of its lead over each wrong one (0 without
    wrong ones). A case needs exactly one true set."""
    e = F.col(error)
    best = errors.groupBy(case).agg(F.max(F.when(F.col(true), e)).alias("own"), F.count_if(F.col(true)).alias("__true"))
    one = F.when(F.col("__true") == 1, F.col("own")).otherwise(F.raise_error(F.lit("a case needs one true source set")).cast("double"))
    joined = errors.join(best.select(case, one.alias("own")), case)
    return joined.groupBy(case).agg((F.max("own") + F.coalesce(F.avg(F.when(~F.col(true), softplus(F.col("own") - e))), F.lit(0.0))).alias("loss"))


def epoch_report(losses: DataFrame, epoch: str, component: str, loss: str) -> DataFrame:
    """``epoch``, ``component``, ``cases``, ``eligible`` (those with a loss) and the ``mean`` over these."""
    return losses.groupBy(epoch, component).agg(F.count("*").alias("cases"), F.count(loss).alias("eligible"), F.avg(loss).alias("mean"))


def repeated_ids(pairs: DataFrame, id: str) -> DataFrame:  # noqa: A002
    """``id``, ``count`` of ids that occur more than once, which a comparison of representations must not have."""
    return pairs.groupBy(id).count().where("count > 1")


def completion_summary(masks: DataFrame, case: str, mask: str, error: str, true: str) -> DataFrame:
    """One row: ``cases`` with an eligible mask, their mean ``gap``, the share of ``positive`` gaps, and ``ineligible`` (sorted ids
    of the cases that have no mask with both a true and a wrong source; bounded by the evaluated pool)."""
    gaps = completion_gap(masks, case, mask, error, true)
    every = masks.select(case).distinct().join(gaps, case, "left")
    return every.agg(
        F.count("gap").alias("cases"), F.avg("gap").alias("gap"), F.avg(F.when(F.col("gap").isNotNull(), (F.col("gap") > 0).cast("double"))).alias("positive"),
        F.array_sort(F.collect_list(F.when(F.col("gap").isNull(), F.col(case)))).alias("ineligible"),
    )
