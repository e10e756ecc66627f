"""Rules of a search over a frozen order of cases, and of the plans of its queries, as queries for violations.

An attempt is one row: ``ledger``, ``attempt`` (1, 2, ...), ``case_id``, ``stage`` (search, raw_retry, export_replay), ``status``
(scored, error), ``repeat_of``, ``started``, ``finished``, ``hit`` (of the first rank; null for errors), ``reason``. A decision is
``ledger``, ``attempt`` (the last attempt before it), ``number``, ``case_id``, ``event`` (selected, rejected), ``reason``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages of attempts.
STAGES = ("search", "raw_retry", "export_replay")


def _faults(df: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    found = F.explode(F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), text) for bad, text in checks))))
    return df.select("ledger", "attempt", found.alias("fault"))


def attempt_faults(attempts: DataFrame, order: DataFrame) -> DataFrame:
    """``ledger``, ``attempt``, ``fault`` of every attempt that breaks a rule.

    ``order``: ``ledger``, ``case_id``, ``place`` (1, 2, ...), the frozen order. A search takes the next case of the order
    and no case twice; a retry links the latest failed attempt of its case, which must be its last; times run forward;
    errors have a reason and no score, scores no reason.
    """
    mine = Window.partitionBy("ledger").orderBy("attempt")
    case = Window.partitionBy("ledger", "case_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    raw = F.col("stage") != "export_replay"
    rows = attempts.join(order.select("ledger", "case_id", "place"), ["ledger", "case_id"], "left").withColumns({
        "ordinal": F.row_number().over(mine),
        "searched": F.sum((F.col("stage") == "search").cast("int")).over(mine),
        "before": F.max(F.when(raw, F.struct("attempt", "status"))).over(case),
    })
    search, retry, replay = (F.col("stage") == s for s in STAGES)
    linked = attempts.select("ledger", F.col("attempt").alias("repeat_of"), F.col("case_id").alias("linked"))
    rows = rows.join(linked, ["ledger", "repeat_of"], "left")
    scored, error = F.col("status") == "scored", F.col("status") == "error"
    blank = F.coalesce(F.trim("reason") == "", F.lit(True))
    return _faults(rows, [
        (F.col("attempt") != F.col("ordinal"), "attempts are not numbered in order"),
        (F.col("place").isNull(), "a case outside the frozen order"),
        (~F.col("stage").isin(*STAGES) | ~(scored | error), "an unknown stage or status"),
        (F.col("finished") < F.col("started"), "an attempt that ends before it starts"),
        (search & (F.col("before").isNotNull() | F.col("repeat_of").isNotNull()), "a repeated case needs a retry"),
        (search & F.col("before").isNull() & (F.col("place") != F.col("searched")), "the search leaves the frozen order"),
        (~search & (F.col("linked").isNull() | (F.col("repeat_of") >= F.col("attempt"))), "a repeat links no earlier attempt"),
        (~search & (F.col("linked") != F.col("case_id")), "a repeat links another case"),
        (retry & (F.col("linked") == F.col("case_id")) & ~F.coalesce((F.col("before.attempt") == F.col("repeat_of")) & (F.col("before.status") == "error"), F.lit(False)), "a retry must link the latest failed attempt"),
        (scored & ~blank, "a score with a reason for failure"),
        (scored & F.col("hit").isNull(), "a score without a result"),
        (error & blank, "an error without a reason"),
        (error & F.col("hit").isNotNull(), "an error with a score"),
    ])


def decision_faults(decisions: DataFrame, attempts: DataFrame) -> DataFrame:
    """``ledger``, ``attempt``, ``fault`` of every decision that breaks a rule.

    A decision needs a reason and an earlier first-rank hit of its case; a rejected case stays rejected; only one case is
    selected at a time; and before a case is selected, all cases with earlier hits must have been rejected.
    """
    hits = attempts.where((F.col("status") == "scored") & F.col("hit") & (F.col("stage") != "export_replay"))
    first = hits.groupBy("ledger", "case_id").agg(F.min("attempt").alias("hit_at"))
    order = Window.partitionBy("ledger").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    mine = Window.partitionBy("ledger", "case_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    rejected = F.col("event") == "rejected"
    rows = decisions.join(first, ["ledger", "case_id"], "left").withColumns({
        "was_rejected": F.coalesce(F.max(rejected).over(mine), F.lit(False)),
        "sel": F.max(F.when(F.col("event") == "selected", F.struct("number", "case_id"))).over(order),
    })
    # the selected case stays so until it is rejected itself
    dropped = decisions.where(rejected).groupBy(F.col("ledger").alias("d_ledger"), F.col("case_id").alias("gone")).agg(F.min("number").alias("gone_at"))
    rows = rows.join(dropped, (F.col("ledger") == F.col("d_ledger")) & (F.col("sel.case_id") == F.col("gone")), "left")
    open_ = F.col("sel").isNotNull() & (F.col("gone_at").isNull() | (F.col("gone_at") > F.col("number")))
    # earlier hits that no earlier decision rejects
    others = first.select(F.col("ledger").alias("o_ledger"), F.col("case_id").alias("other"), F.col("hit_at").alias("other_at"))
    others = others.join(dropped.select(F.col("d_ledger").alias("o_ledger"), F.col("gone").alias("other"), F.col("gone_at").alias("other_gone")), ["o_ledger", "other"], "left")
    chosen = decisions.where("event = 'selected'").join(first, ["ledger", "case_id"]).select("ledger", "number", "hit_at")
    passed_over = (F.col("other_at") < F.col("hit_at")) & (F.col("other_gone").isNull() | (F.col("other_gone") > F.col("number")))
    earlier = chosen.join(others, F.col("ledger") == F.col("o_ledger")).where(passed_over).select("ledger", "number", F.lit(True).alias("skips")).distinct()
    rows = rows.join(earlier, ["ledger", "number"], "left")
    return _faults(rows, [
        (F.coalesce(F.trim("reason") == "", F.lit(True)), "a decision without a reason"),
        (F.col("hit_at").isNull() | (F.col("hit_at") > F.col("attempt")), "a decision without a first-rank hit"),
        (F.col("was_rejected"), "a rejected case stays rejected"),
        ((F.col("event") == "selected") & open_, "another case is selected"),
        (F.col("skips"), "an earlier hit was not rejected"),
    ])


def query_order(rounds: DataFrame) -> DataFrame:
    """``place``, ``case_id``: the answered cases of all rounds in the order in which they were asked.

    ``rounds``: ``round``, ``completed`` (array). A round is a batch of the label budget, so its array is short."""
    each = rounds.select("round", F.posexplode("completed").alias("at", "case_id"))
    return each.select(F.row_number().over(Window.orderBy("round", "at")).alias("place"), "case_id")  # at most the label budget


def trace_faults(rounds: DataFrame, pool: DataFrame, sizes: list[int], budget: int) -> DataFrame:
    """``round``, ``fault`` of a trace of planned queries.

    ``rounds``: ``round`` (0, 1, ...), ``labeled``, ``selected``, ``accessed``, ``completed`` (arrays), ``spent``, ``remaining``. A round
    selects as many cases as ``sizes`` says, all different, of the pool and not asked before; what was accessed is a prefix
    of what was selected, what was completed a prefix of that with at most one missing; only the last round may be open.
    """
    asked = rounds.select("round", F.posexplode("selected").alias("at", "case_id"))
    strange = asked.join(pool.select("case_id"), "case_id", "left_anti").select("round", F.lit("a case outside the pool").alias("fault"))
    again = asked.groupBy("case_id").agg(F.min("round").alias("first"), F.max("round").alias("round")).where(F.col("round") > F.col("first")).select("round", F.lit("a case was asked before").alias("fault"))
    order = Window.orderBy("round")  # at most the label budget
    rows = rounds.withColumns({
        "ordinal": F.row_number().over(order) - 1, "last": F.lead("round").over(order).isNull(),
        "earlier": F.coalesce(F.flatten(F.collect_list("completed").over(order.rowsBetween(Window.unboundedPreceding, -1))), F.array().cast("array<string>")),
        "due": F.try_element_at(F.array(*(F.lit(s) for s in sizes)), (F.col("round") + 1).cast("int")),
    })
    prefix = lambda a, b: F.slice(F.col(b), 1, F.size(a)) == F.col(a)
    checks = [
        (F.col("round") != F.col("ordinal"), "rounds are not numbered in order"),
        (F.col("due").isNull() | (F.size("selected") != F.col("due")), "another number of cases than planned"),
        (F.size(F.array_distinct("selected")) != F.size("selected"), "a case twice in a round"),
        (F.array_sort("labeled") != F.array_sort("earlier"), "other labels than the rounds before gave"),
        ((F.col("spent") != F.size("earlier")) | (F.col("remaining") != F.lit(budget) - F.size("earlier")), "another budget than the rounds before left"),
        (~prefix("accessed", "selected") | ~prefix("completed", "accessed") | (F.size("accessed") - F.size("completed") > 1), "the order of answers is broken"),
        (~F.col("last") & (F.size("completed") != F.size("selected")), "an open round before the last"),
    ]
    found = F.explode(F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), text) for bad, text in checks))))
    return reduce(DataFrame.unionByName, [rows.select("round", found.alias("fault")), strange.distinct(), again.distinct()])
