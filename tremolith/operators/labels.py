"""The label budget as a table of reservations: an answer is paid for before it is seen.

Every change is one numbered step, a small table of (case, state) rows that is published under its number or not at all,
so of two writers with the same view one fails. States of a case are ``reserved``, then ``revealed`` or ``refused``. The
present state is a query over all steps; nothing else is kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "step bigint, case_id string, state string, reason string, identity string"


class Reservations:
    """Reservations at a path for labels (``case_id``, ``roots`` array), within a budget of cases.

    At most ``open_cases`` reservations await their answer at a time. A refused answer (no roots, roots that aren't among
    the case's candidates, or more than ``largest``) has been paid for and closes the table for good.
    """

    def __init__(self, spark: SparkSession, path: str, labels: DataFrame, budget: int, largest: int | None = None, open_cases: int = 1):
        if budget < 0 or open_cases < 1 or (largest is not None and largest < 1):
            raise ValueError("a budget isn't negative, and limits are one or more")
        self.spark, self.path, self.labels, self.budget, self.largest, self.open_cases = spark, path.rstrip("/"), labels, budget, largest, open_cases
        # a digest of all labels and limits that doesn't depend on their order
        row = F.xxhash64("case_id", F.array_join(F.array_sort("roots"), "\x1f"))
        found = labels.agg(F.bit_xor(row).alias("x"), F.count("*").alias("n")).first()
        self.identity = f"{found['x']}:{found['n']}:{budget}:{largest}"

    def steps(self) -> DataFrame:
        """All rows of all steps."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], STEP)
        return self.spark.read.schema(STEP).option("recursiveFileLookup", True).parquet(self.path)

    def states(self) -> DataFrame:
        """``case_id``, ``state``, ``reason`` of every case that was ever reserved."""
        return self.steps().groupBy("case_id").agg(F.max_by(F.struct("state", "reason"), "step").alias("s")).select("case_id", "s.*")

    def summary(self) -> dict:
        """Counts by state, the next step, and whether all steps are of these labels and limits."""
        of = lambda s: F.count_if(F.col("state") == s).alias(s)
        out = self.states().agg(of("reserved"), of("revealed"), of("refused")).first().asDict()
        every = self.steps().agg(F.coalesce(F.max("step") + 1, F.lit(0)).alias("next"), F.count_if(F.col("identity") != self.identity).alias("foreign")).first()
        if every["foreign"]:
            raise ValueError("the table is of other labels or limits")
        return out | {"next": every["next"], "spent": out["reserved"] + out["revealed"] + out["refused"]}

    def _publish(self, rows: DataFrame, step: int) -> None:
        jvm = self.spark.sparkContext._jvm
        at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        staged, target = f"{self.path}-staged-{uuid.uuid4().hex}", f"{self.path}/step={step:012d}"
        rows.select(F.lit(step).cast("bigint").alias("step"), "case_id", "state", "reason", F.lit(self.identity).alias("identity")).coalesce(1).write.parquet(staged)
        fs = at(staged).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at(self.path))
        if fs.exists(at(target)) or not fs.rename(at(staged), at(target)):
            fs.delete(at(staged), True)
            raise ValueError("another writer published this step first")

    def reserve(self, cases: DataFrame, step: int | None = None) -> None:
        """Pay for the cases of ``cases`` (``case_id``) that aren't reserved yet; all of them or none.

        ``step`` is the step that the caller has seen last plus one; an older view fails."""
        now = self.summary()
        new = cases.select("case_id").distinct().join(self.states(), "case_id", "left_anti")
        labelled = new.join(self.labels.select("case_id"), "case_id", "left_semi")
        wanted, known = new.count(), labelled.count()
        if now["refused"]:
            raise ValueError("the table is closed by a refused answer")
        if wanted != known:
            raise ValueError("a case has no label")
        if not wanted:
            return
        if now["reserved"] + wanted > self.open_cases:
            raise ValueError("other reservations are open")
        if now["spent"] + wanted > self.budget:
            raise ValueError("the budget is spent")
        self._publish(labelled.select("case_id", F.lit("reserved").alias("state"), F.lit(None).cast("string").alias("reason")), now["next"] if step is None else step)

    def settle(self, candidates: DataFrame) -> DataFrame:
        """``case_id``, ``roots`` of the open reservations, judged against ``candidates`` (``case_id``, ``entity``) and then revealed."""
        now = self.summary()
        mine = self.states().where("state = 'reserved'").select("case_id").join(self.labels.select("case_id", F.array_distinct("roots").alias("roots")), "case_id")
        offered = candidates.groupBy("case_id").agg(F.collect_set("entity").alias("known"))
        judged = mine.join(offered, "case_id", "left")
        strange = F.size(F.array_except("roots", F.coalesce("known", F.array().cast("array<string>")))) > 0
        reason = F.when(F.coalesce(F.size("roots"), F.lit(0)) < 1, "no roots").when(strange, "roots outside the candidates")
        if self.largest is not None:
            reason = reason.when(F.size("roots") > self.largest, "more roots than declared")
        settled = judged.select("case_id", "roots", reason.alias("reason")).withColumn("state", F.when(F.col("reason").isNull(), "revealed").otherwise("refused"))
        if now["reserved"]:
            self._publish(settled, now["next"])
        if self.summary()["refused"]:
            raise ValueError("an answer was refused: " + "; ".join(r["reason"] for r in self.states().where("state = 'refused'").select("reason").distinct().collect()))
        return self.revealed()

    def revealed(self) -> DataFrame:
        """``case_id``, ``roots`` of all cases whose answer was accepted."""
        return self.labels.join(self.states().where("state = 'revealed'").select("case_id"), "case_id", "left_semi").select("case_id", "roots")
