"""The closed loop: rounds of queries that a cover selects, answers that the budget pays for, and a trainer that is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolith.operators.labels import Reservations
from tremolith.operators.schedule import Schedule, query_count
from tremolith.operators.selection import case_maxima, greedy_cover, occurrence_weights
from tremolith.runtime import materialize


def propose(tokens: DataFrame, priority: DataFrame, labeled: list[str], count: int, reference: DataFrame | None = None) -> list[str]:
    """The next cases to ask for, by the weighted coverage of ``tokens`` (case_id, token, family, vec) beyond the labeled ones.

    ``reference`` are the tokens whose coverage counts (a stated query set; all tokens if it isn't given)."""
    spark = tokens.sparkSession
    weights = occurrence_weights(tokens)
    asked = weights if reference is None else weights.join(reference.select("token"), "token", "left_semi")
    asked = materialize(asked.withColumnRenamed("token", "occurrence"), "occurrences")
    maxima = materialize(case_maxima(asked, tokens), "maxima")
    picked = greedy_cover(spark, maxima, asked.select("occurrence", "weight"), priority, count, labeled)
    return [r["case_id"] for r in picked.orderBy("step").collect()]  # at most the batch


def run(
    schedule: Schedule, book: Reservations, candidates: DataFrame, priority: DataFrame, tokens: Callable[[int], DataFrame], train: Callable[[int, str, int, DataFrame], None]
) -> DataFrame:
    """Query, pay, reveal and train until the schedule ends: ``round``, ``completed`` (the cases of each round in order).

    ``tokens(round)`` gives the present representations of all cases, ``train(round, stage, epochs, labels)`` does the epochs of
    one stage. Cases are reserved and settled one by one, so an interrupted run goes on with the answers it has paid for.
    """
    spark, rounds = candidates.sparkSession, []
    stages = schedule.stages()
    for number, batch in enumerate(schedule.batches()):
        known = [r["case_id"] for r in book.revealed().select("case_id").collect()]  # within the budget
        left = priority.where(~F.col("case_id").isin(*known)).count()
        chosen = propose(tokens(number), priority, known, query_count(batch, book.budget - len(known), left))
        for case in chosen:
            book.reserve(spark.createDataFrame([(case,)], "case_id string"))
            book.settle(candidates)
        rounds.append((number, chosen))
        train(number, *stages[number], book.revealed())
    train(len(rounds), *stages[-1], book.revealed())
    return spark.createDataFrame(rounds, "round int, completed array<string>")
