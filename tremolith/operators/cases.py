"""Cases, labels and ledgers as tables: pairing, cardinalities, partitions, retries, masks, candidate sets, motifs, medoids."""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremolith.runtime import greatest_before, numbered_within


def paired_windows(windows: DataFrame, day: str, kind: str) -> DataFrame:
    """Every fault window with the one normal window of its day; a day with none or several is an error."""
    normal = windows.where(F.col(kind) == "normal").groupBy(day).agg(F.count("*").alias("__n"), F.first("start").alias("normal_start"), F.first("end").alias("normal_end"))
    joined = windows.where(F.col(kind) == "fault").join(normal, day, "left")
    one = F.when(F.col("__n") == 1, F.col("normal_start")).otherwise(F.raise_error(F.lit("a day needs exactly one normal window")).cast("double"))
    return joined.withColumn("normal_start", one).drop("__n")


def label_windows(windows: DataFrame, labels: DataFrame, key: Sequence[str]) -> DataFrame:
    """Windows with their labels by source identity; adds ``labelled``."""
    marked = labels.withColumn("__l", F.lit(True))
    return windows.join(marked, list(key), "left").withColumn("labelled", F.coalesce("__l", F.lit(False))).drop("__l")


def root_cardinality(labels: DataFrame, kind: str, roots: str) -> DataFrame:
    """``kind`` (null for all), ``cardinality``, ``cases``: sizes of root sets, over all and by fault type, in one pass."""
    sized = labels.select(F.col(kind).alias("kind"), F.size(F.array_distinct(roots)).alias("cardinality"))
    return sized.groupingSets([["cardinality"], ["kind", "cardinality"]], "kind", "cardinality").agg(F.count("*").alias("cases"), F.grouping("kind").alias("__all")).select(
        F.when(F.col("__all") == 1, F.lit(None)).otherwise(F.col("kind")).alias("kind"), "cardinality", "cases"
    )


def partition_faults(pool: DataFrame, labelled: DataFrame, unlabelled: DataFrame, id: str = "case_id") -> DataFrame:  # noqa: A002
    """``id``, ``fault``: ids in both parts, in neither, or outside the pool; empty for a sound partition."""
    sides = [df.select(F.col(id), F.lit(name).alias("s")).distinct() for df, name in ((pool, "p"), (labelled, "l"), (unlabelled, "u"))]
    sets = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy(id).agg(F.array_sort(F.collect_set("s")).alias("s"))
    has = lambda c: F.array_contains("s", c)
    fault = F.when(~has("p"), "outside").when(has("l") & has("u"), "both").when(~has("l") & ~has("u"), "neither")
    return sets.select(id, fault.alias("fault")).where("fault is not null")


def first_by_priority(pool: DataFrame, labelled: DataFrame, count: int, id: str = "case_id", priority: str = "priority") -> DataFrame:  # noqa: A002
    """The first ``count`` cases that have no label yet."""
    return pool.join(labelled.select(id), id, "left_anti").orderBy(priority, id).limit(count)


def _columns(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def retry_links(attempts: DataFrame, ledger: str | Sequence[str], order: str, case: str, failed: str) -> DataFrame:
    """Adds ``retry_of``: the latest failed attempt at the same case before this one."""
    return greatest_before(attempts, [*_columns(ledger), case], [order], F.when(F.col(failed), F.col(order)), "retry_of")


def ledger_summary(attempts: DataFrame, ledger: str | Sequence[str], order: str, case: str, failed: str, hit: str) -> DataFrame:
    """``ledger``, attempts, cases, errors, retries and the first attempt that hit."""
    return retry_links(attempts, ledger, order, case, failed).groupBy(*_columns(ledger)).agg(
        F.count("*").alias("attempts"), F.countDistinct(case).alias("cases"), F.count_if(failed).alias("errors"), F.count("retry_of").alias("retries"), F.min(F.when(F.col(hit), F.col(order))).alias("first_hit")
    )


def mask_blocks(blocks: DataFrame, case: str, block: Sequence[str], z: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """The blocks to hide: a share of each case's blocks (none of fewer than two), half of them uniform, the rest from those
    with |z| > 1 as far as there are any, by an order that SHA-256 fixes."""
    key = F.concat_ws("|", F.lit(str(seed)), case, *(F.col(b).cast("string") for b in block))
    sizes = blocks.groupBy(case).agg(F.count("*").alias("__n")).where("__n >= 2").withColumn("__take", F.ceil(F.col("__n") * share))
    marked = blocks.select(case, *block, (F.abs(z) > 1).alias("__far"), F.sha2(key, 256).alias("__o")).join(sizes, case)
    first = numbered_within(marked, [case], ["__o"], "__r").withColumn("__u", F.col("__r") <= F.floor(F.col("__take") / 2))
    # uniform ones, then those far off, then the others
    turn = F.when(F.col("__u"), 0).when(F.col("__far"), 1).otherwise(2)
    later = numbered_within(first.withColumn("__turn", turn), [case], ["__turn", "__o"], "__rest").where(F.col("__rest") <= F.col("__take"))
    return later.select(case, *block, F.when(F.col("__u"), "uniform").when(F.col("__far"), "response").otherwise("fill").alias("reason"))


#: Draws of random source sets of a case; repeated ones are passed over.
DRAWS = 512


def _drawn(key: Column, names: Column, size: Column) -> Column:
    """The ``size`` names of least hash in a draw, sorted."""
    ordered = F.array_sort(F.transform(names, lambda e: F.struct(F.md5(F.concat_ws("|", key, e)).alias("h"), e.alias("e"))))
    return F.array_sort(F.transform(F.slice(ordered, 1, size), lambda s: s["e"]))


def _subsets(names: Column, least: Column, most: Column) -> Column:
    """All subsets of a short array with ``least`` to ``most`` members, sorted."""
    masks = F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2.0), F.least(F.size(names), F.lit(16))).cast("bigint") - 1)
    chosen = lambda m: F.filter(names, lambda e, i: F.floor(m / F.pow(F.lit(2.0), i)) % 2 == 1)
    return F.filter(F.transform(masks, chosen), lambda s: (F.size(s) >= least) & (F.size(s) <= most))


def _combinations(n: Column, k: Column) -> Column:
    """Number of subsets of size k, as a double."""
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda c, i: c * (n - k + i) / i)


def source_sets(ranked: DataFrame, seed: int = 42, epoch: int = 0, largest: int | None = None, extras: int = 16, prefixes: int = 8) -> DataFrame:
    """``case_id``, ``sources`` (sorted array): candidate root sets of cases without labels.

    ``ranked``: case_id, entity, rank. Every single candidate is a set; so are the best 2 to 9 together (at most
    ``prefixes`` sets), and random sets until there are ``extras`` besides the singles, or all sets up to ``largest``. A
    random set has a uniform size and is uniform among those of its size; draws are hashes of seed, epoch, case and their
    number, and a draw that repeats a set is passed over. A case's candidates are one row, bounded by its catalog.
    """
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda s: s["entity"])
    cases = ranked.groupBy("case_id").agg(order.alias("o")).withColumns({"names": F.array_sort("o"), "n": F.size("o")})
    cases = cases.withColumn("cap", F.least("n", F.lit(largest)) if largest is not None else F.col("n"))
    sizes = F.when(F.col("cap") >= 2, F.sequence(F.lit(2), F.col("cap"))).otherwise(F.array().cast("array<int>"))
    many = F.aggregate(sizes, F.lit(0.0), lambda t, k: t + _combinations(F.col("n"), k))
    top = F.least(F.lit(9), F.lit(prefixes + 1), F.lit(extras + 1), F.col("cap"))
    heads = F.transform(F.when(top >= 2, F.sequence(F.lit(2), top)).otherwise(F.array().cast("array<int>")), lambda k: F.array_sort(F.slice("o", 1, k)))
    key = lambda i: F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), "case_id", i.cast("string"))
    size = lambda i: (F.lit(2) + F.conv(F.substring(F.md5(key(i)), 1, 8), 16, 10).cast("bigint") % (F.col("cap") - 1)).cast("int")
    draws = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda i: _drawn(key(i), F.col("names"), size(i)))
    # few sets are listed, many are drawn
    more = F.when(F.col("cap") < 2, F.array().cast("array<array<string>>")).when(many <= extras, _subsets(F.col("names"), F.lit(2), F.col("cap"))).otherwise(F.slice(F.array_distinct(F.concat(heads, draws)), 1, extras))
    singles = F.transform("names", lambda e: F.array(e))
    return cases.select("case_id", F.explode(F.concat(singles, more)).alias("sources"))


def labeled_source_sets(candidates: DataFrame, seed: int = 42, epoch: int = 0, largest: int | None = None, wrong: int = 16) -> DataFrame:
    """``case_id``, ``sources`` (sorted array), ``true``: the root set of each case of ``candidates`` (case_id, entity, is_root),
    and at most ``wrong`` other random sets of its size. A case without roots, or with more than ``largest``, is an error."""
    roots = F.array_sort(F.collect_set(F.when(F.col("is_root"), F.col("entity"))))
    cases = candidates.groupBy("case_id").agg(F.array_sort(F.collect_set("entity")).alias("names"), roots.alias("roots")).withColumn("k", F.size("roots"))
    bad = (F.col("k") < 1) | ((F.col("k") > largest) if largest is not None else F.lit(False))
    cases = cases.withColumn("roots", F.when(bad, F.raise_error(F.lit("a case needs roots, and no more than the largest set allowed")).cast("array<string>")).otherwise(F.col("roots")))
    key = lambda i: F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), "case_id", F.lit("true"), i.cast("string"))
    draws = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda i: _drawn(key(i), F.col("names"), F.col("k")))
    few_ = _combinations(F.size("names"), F.col("k")) <= wrong + 1
    # all sets of the size come from the short list of all subsets only where the catalog is short, else from one swap
    listed = F.when(F.size("names") <= 12, _subsets(F.col("names"), F.col("k"), F.col("k"))).otherwise(_swaps(F.col("names"), F.col("roots")))
    others = F.array_except(F.when(few_, listed).otherwise(draws), F.array("roots"))
    every = F.concat(F.array(F.struct(F.col("roots").alias("sources"), F.lit(True).alias("true"))), F.transform(F.slice(others, 1, wrong), lambda s: F.struct(s.alias("sources"), F.lit(False).alias("true"))))
    return cases.select("case_id", F.explode(every).alias("s")).select("case_id", "s.*")


def _swaps(names: Column, roots: Column) -> Column:
    """The sets that have one member exchanged: all others of their size, where they are 1 or all but 1 of the names."""
    rest = F.array_except(names, roots)
    return F.flatten(F.transform(roots, lambda r: F.transform(rest, lambda e: F.array_sort(F.concat(F.filter(roots, lambda x: x != r), F.array(e))))))


def source_membership(sets: DataFrame, candidates: DataFrame) -> DataFrame:
    """``case_id``, ``sources``, ``mask``: for every set, whether each of its case's candidates (in order of name) is in it. A
    set with a member outside the candidates is an error."""
    names = candidates.groupBy("case_id").agg(F.array_sort(F.collect_set("entity")).alias("names"))
    joined = sets.join(names, "case_id")
    strange = F.size(F.array_except("sources", "names")) > 0
    mask = F.transform("names", lambda e: F.array_contains("sources", e))
    return joined.select("case_id", "sources", F.when(strange, F.raise_error(F.lit("a source outside the candidates")).cast("array<boolean>")).otherwise(mask).alias("mask"))


def motif_code(nodes: Sequence[Sequence], edges: Sequence[Sequence], same: Sequence[Sequence[bool]], before: Sequence[Sequence[str]]) -> str:
    """Canonical text of a small attributed graph; see :func:`_motif_code`. Graphs recur, so codes are kept."""
    fixed = lambda rows: tuple(tuple(r) for r in rows)
    return _motif_code(fixed(nodes), fixed(edges), fixed(same), fixed(before))


@lru_cache(maxsize=1 << 16)
def _motif_code(nodes: tuple, edges: tuple, same: tuple, before: tuple) -> str:
    """Canonical text of a small attributed graph: the least over all orders of its (at most four) vertices.

    ``nodes`` are attribute tuples, ``edges`` (source, target, attributes...) by position, ``same`` and ``before``
    matrices of equality of entities and of order in time. The nodes come first in the text, so only the orders whose
    nodes' text is least are written out.
    """
    n = len(nodes)
    if not n:
        return "[]"
    one = [json.dumps(list(v), separators=(",", ":")) for v in nodes]
    heads: dict[str, list] = {}
    for order in itertools.permutations(range(n)):
        heads.setdefault("[" + ",".join(one[v] for v in order) + "]", []).append(order)
    head = min(heads, key=lambda h: h + ",")
    best = None
    for order in heads[head]:
        place = {v: i for i, v in enumerate(order)}
        text = json.dumps([
            [[bool(same[a][b]) for b in order] for a in order], [[before[a][b] for b in order] for a in order],
            sorted([place[e[0]], place[e[1]], *e[2:]] for e in edges),
        ], separators=(",", ":"))
        best = text if best is None or text < best else best
    return f"[{head},{best[1:]}"


#: Cases of a selection pool whose distances one matrix holds (128 MB).
POOL = 4_000


def medoids(distance: np.ndarray, count: int, locked: Sequence[int] = (), rounds: int = 100) -> tuple[list[int], float]:
    """Centers by greedy choice and best-improvement swaps over a square matrix; earlier rows win ties, locked ones stay.

    The matrix is of cases in one selection pool of at most ``POOL`` cases; distances come from Spark. A larger pool is an
    error.
    """
    n = len(distance)
    if n > POOL:
        raise ValueError(f"a selection pool has at most {POOL} cases")
    base = distance[list(locked)].min(axis=0) if len(locked) else np.ones(n)
    cost = lambda cs: float(np.minimum(base, distance[cs].min(axis=0) if cs else np.ones(n)).mean()) if n else 0.0
    chosen: list[int] = []
    for _ in range(min(count, n - len(locked))):
        open_ = [i for i in range(n) if i not in chosen and i not in locked]
        chosen.append(min(open_, key=lambda i: (round(cost([*chosen, i]), 12), i)))
    for _ in range(rounds):
        now = cost(chosen)
        swaps = [(cost([*(c for c in chosen if c != out), new]), out, new) for out in chosen for new in range(n) if new not in chosen and new not in locked]
        best = min(swaps, key=lambda s: s[0], default=None)
        if best is None or best[0] >= now - 1e-12:
            break
        chosen = [best[2] if c == best[1] else c for c in chosen]
    return chosen, cost(chosen)


def pooled_medoids(vectors: DataFrame, count: int, priority: str = "priority", locked: Sequence[str] = ()) -> DataFrame:
    """``place``, ``case_id``, ``cost``: centers of a selection pool by greedy choice and swaps, with the mean distance that is left.

    ``vectors``: case_id, vec (unit length; null for none) and a priority that breaks ties. The pool is one of label
    selection, at most ``POOL`` cases; cases without a vector are neither centers nor targets.
    """
    spark = vectors.sparkSession
    pool = vectors.where("vec is not null").select("case_id", "vec", F.col(priority).alias("p")).orderBy("p", "case_id").limit(POOL + 1).collect()
    if len(pool) > POOL:
        raise ValueError(f"a selection pool has at most {POOL} cases")
    names = [r["case_id"] for r in pool]
    x = np.array([r["vec"] for r in pool], float).reshape(len(pool), -1)
    chosen, cost = medoids(np.clip((1 - x @ x.T) / 2, 0, 1), count, [names.index(c) for c in locked if c in names])
    return spark.createDataFrame([(i, names[c], cost) for i, c in enumerate(chosen)], "place int, case_id string, cost double")


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    """Named arrays as a table that must not be there yet."""
    rows = [(k, [int(s) for s in v.shape], [float(x) for x in v.ravel()]) for k, v in sorted(weights.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, cells array<double>").coalesce(1).write.mode("errorifexists").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The inverse of :func:`save_weights`."""
    return {r.name: np.array(r.cells).reshape(r.shape) for r in spark.read.parquet(path).collect()}


#: What the members of fragments need for :func:`motif_codes`, besides ends and entities.
MOTIF = ("source_bin", "target_bin", "source_state", "target_state", "state")


def motif_codes(fragments: DataFrame, schema: str = "case_id string, code string") -> DataFrame:
    """``case_id``, ``code`` of fragments whose ``members`` have source, target, their entities and the columns of ``MOTIF``;
    batches in Arrow.

    A node is its state (category, bands); an edge its ends and state (relation, response, delay, bands); the order of two
    events is that of their bins: before or after with a bin between them, else unknown, as adjacent events touch.
    """

    def run(batches):
        for frame in batches:
            out = []
            for members in frame["members"]:
                node = {}
                for e in members:
                    for side in ("source", "target"):
                        node[e[side]] = (e[f"{side}_entity"], e[f"{side}_bin"], e[f"{side}_state"])
                vertices = sorted(node)
                at = {v: i for i, v in enumerate(vertices)}
                entity, bins, state = zip(*(node[v] for v in vertices))
                same = [[a == b for b in entity] for a in entity]
                order = [["before" if a + 1 < b else "after" if b + 1 < a else "unknown" for b in bins] for a in bins]
                out.append(motif_code([(x,) for x in state], [(at[e["source"]], at[e["target"]], e["state"]) for e in members], same, order))
            yield pd.DataFrame({"case_id": frame["case_id"], "code": out})

    return fragments.select("case_id", "members").mapInPandas(run, schema)
