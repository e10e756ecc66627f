"""Temporal event graphs and their small connected fragments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolith.operators.observations import is_active

#: Structural families in order of precedence.
FAMILIES = ("revisit", "mixed_branch_convergence", "branch", "convergence", "chain")
BAND, HORIZON = 9, 8.0


def event_links(events: DataFrame, relations: DataFrame, band: int = BAND) -> DataFrame:
    """Pairs of different events along relations that are active over both, at most ``band`` bins apart.

    ``events``: case_id, event (id), entity, bin, start, end. ``relations``: case_id, id, source, target, owner, response,
    start_time, end_time, active_intervals. The join keys are entities and blocks of ``band`` bins (a target's block and
    its two neighbours), so it stays an equi-join whose output is near its candidates.
    """
    side = lambda p: events.select(*(F.col(c).alias(f"{p}_{c}") for c in ("case_id", "event", "entity", "bin", "start", "end")))
    block = lambda c: F.floor(F.col(c) / (band + 1))
    sources = side("s").withColumn("block", F.explode(F.array(block("s_bin") - 1, block("s_bin"), block("s_bin") + 1)))
    targets = side("t").withColumn("t_block", block("t_bin"))
    r = relations.select(F.col("case_id").alias("r_case"), "id", "source", "target", "owner", "response", "start_time", "end_time", "active_intervals")
    out = r.join(sources, (r.r_case == sources.s_case_id) & (r.source == sources.s_entity))
    both = out.join(targets, (F.col("r_case") == F.col("t_case_id")) & (F.col("target") == F.col("t_entity")) & (F.col("block") == F.col("t_block")))
    active = is_active(F.col("active_intervals"), F.col("start_time"), F.col("end_time"), F.least("s_start", "t_start"), F.greatest("s_end", "t_end"))
    return both.where((F.col("s_event") != F.col("t_event")) & (F.abs(F.col("s_bin") - F.col("t_bin")) <= band) & active).select(
        F.col("r_case").alias("case_id"), F.col("id").alias("relation"), F.coalesce("owner", "id").alias("owner"), "response",
        F.col("s_event").alias("source"), F.col("t_event").alias("target"),
        F.col("s_entity").alias("source_entity"), F.col("t_entity").alias("target_entity"),
        F.col("s_start").alias("source_start"), F.col("s_end").alias("source_end"), F.col("t_start").alias("target_start"), F.col("t_end").alias("target_end"),
    )


def eligible_links(links: DataFrame, delta: float, horizon: float = HORIZON) -> DataFrame:
    """Links whose target doesn't end before the source starts and starts at most ``horizon`` intervals after its end; one per key."""
    late = F.col("target_start") - F.col("source_end") > horizon * delta
    return links.where(~(F.col("target_end") < F.col("source_start")) & ~late).dropDuplicates(["case_id", "source", "target", "relation", "owner", "response"])


def family(edges: Column) -> Column:
    """Structural family of an array of struct(source, target, source_entity, target_entity)."""
    events = F.array_distinct(F.concat(F.transform(edges, lambda e: F.struct(e["source"].alias("v"), e["source_entity"].alias("n"))), F.transform(edges, lambda e: F.struct(e["target"].alias("v"), e["target_entity"].alias("n")))))
    again = F.size(F.array_distinct(F.transform(events, lambda v: v["n"]))) < F.size(events)
    forks = lambda one, other: F.exists(edges, lambda e: F.exists(edges, lambda f: (e[one] == f[one]) & (e[other] != f[other])))
    out, back = forks("source", "target"), forks("target", "source")
    return F.when(again, FAMILIES[0]).when(out & back, FAMILIES[1]).when(out, FAMILIES[2]).when(back, FAMILIES[3]).otherwise(FAMILIES[4])


def fragments(links: DataFrame, largest: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """All connected sets of one to ``largest`` (at most 3) edges of each case: ``case_id``, ``edges`` (sorted array), ``size``, ``family``, ``members``.

    ``links`` has a unique ``edge`` (bigint) per case. Self-joins run on (case, event), so a case is spread over its
    events. Every set is met once, without a distinct: a pair at the least event that its edges share; a triple from the
    least pair of it that is connected, at the least event that the third edge shares with that pair. ``carry`` names
    further columns of the links that the members keep.
    """
    link = links.select("case_id", F.struct("edge", "source", "target", "source_entity", "target_entity", *carry).alias("e"))
    events = lambda e: F.array(e["source"], e["target"])
    # the joins multiply their rows, so their partitions must not be merged for being small before
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = link.select("case_id", "e", F.explode(F.array_distinct(events(F.col("e")))).alias("event")).repartition(parts, "case_id", "event")
    levels = [link.select("case_id", F.array("e").alias("es"))]
    x, y, z = F.col("ex"), F.col("ey"), F.col("ez")
    least_shared = lambda p, q: F.array_min(F.array_intersect(p, q))
    if largest >= 2:
        side = lambda name: ends.select("case_id", "event", F.col("e").alias(name))
        pairs = side("ex").join(side("ey"), ["case_id", "event"]).where((x["edge"] < y["edge"]) & (F.col("event") == least_shared(events(x), events(y)))).select("case_id", "ex", "ey")
        levels.append(pairs.select("case_id", F.array("ex", "ey").alias("es")))
    if largest >= 3:
        touched = F.array_distinct(F.concat(events(x), events(y)))
        grown = pairs.withColumn("touched", touched).select("*", F.explode("touched").alias("event")).repartition(parts, "case_id", "event").join(side("ez"), ["case_id", "event"])
        apart = F.size(F.array_intersect(events(x), events(z))) == 0
        first = (z["edge"] > x["edge"]) & (z["edge"] != y["edge"]) & ((z["edge"] > y["edge"]) | apart) & (F.col("event") == least_shared(F.col("touched"), events(z)))
        levels.append(grown.where(first).select("case_id", F.array_sort(F.array("ex", "ey", "ez")).alias("es")))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.select("case_id", F.transform("es", lambda e: e["edge"]).alias("edges"), F.size("es").alias("size"), family(F.col("es")).alias("family"), F.col("es").alias("members"))


def anchor_counts(found: DataFrame) -> DataFrame:
    """``case_id``, ``anchor``, ``family``, ``fragments``: a fragment counts once for each of its entities."""
    entities = F.array_distinct(F.flatten(F.transform("members", lambda e: F.array(e["source_entity"], e["target_entity"]))))
    return found.select("case_id", "family", F.explode(entities).alias("anchor")).groupBy("case_id", "anchor", "family").agg(F.count("*").alias("fragments"))


def anchor_sample(found: DataFrame, cap: int = 8, seed: int = 0) -> DataFrame:
    """``case_id``, ``edges``, ``family`` of the fragments that any of their entities keeps: each entity of a case at most
    ``cap``, from the families in turn, in an order fixed by SHA-256 of the seed, the entity and the edges."""
    anchors = F.array_distinct(F.flatten(F.transform("members", lambda e: F.array(e["source_entity"], e["target_entity"]))))
    rows = found.select("case_id", "edges", "family", F.concat_ws(",", F.transform("edges", lambda e: e.cast("string"))).alias("key"), F.explode(anchors).alias("anchor"))
    order = lambda *cs: F.sha2(F.concat_ws("|", F.lit(str(seed)), "case_id", "anchor", *cs), 256)
    turn = F.row_number().over(Window.partitionBy("case_id", "anchor", "family").orderBy("order", "key"))
    ranked = rows.withColumn("order", order("key")).withColumn("turn", turn).where(F.col("turn") <= cap)
    place = F.row_number().over(Window.partitionBy("case_id", "anchor").orderBy("turn", order(F.col("turn").cast("string"), "family"), "family"))
    return ranked.withColumn("place", place).where(F.col("place") <= cap).select("case_id", "edges", "family").distinct()


def balanced_sample(found: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` fragments per case, taken from the families in turn, in an order fixed by SHA-256 of the seed and
    the edges. Ranks within a family come first, so the second window sees at most ``cap`` of each of five families."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("case_id"), F.lit(":"), F.concat_ws(",", F.transform("edges", lambda e: e.cast("string")))), 256)
    turn = F.row_number().over(Window.partitionBy("case_id", "family").orderBy("order", "key"))
    ranked = found.withColumns({"order": order, "key": F.concat_ws(",", F.transform("edges", lambda e: e.cast("string")))}).withColumn("turn", turn).where(F.col("turn") <= cap)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy("turn", "family"))).where(F.col("place") <= cap).select("case_id", "edges", "family", "turn", "place")


def sample_audit(links: DataFrame, sampled: DataFrame, counts: DataFrame) -> DataFrame:
    """``case_id``, ``family``, ``population``, ``taken``, ``inventory``, ``sample``: what a sample was drawn from and what it is.

    ``counts`` are those of :func:`tremolith.operators.fragment_index.counts` for the same links, ``sampled`` the fragments
    kept (case_id, edges, family). ``inventory`` is a digest of all links of the case that doesn't depend on their order,
    ``sample`` the SHA-256 of the kept fragments' edges, which the cap of the sample bounds.
    """
    whole = counts.where("anchor is null").groupBy("case_id", "family").agg(F.sum("fragments").alias("population"))
    taken = sampled.groupBy("case_id", "family").agg(F.count("*").alias("taken"))
    key = F.concat_ws(",", F.transform("edges", lambda e: e.cast("string")))
    digest = sampled.groupBy("case_id").agg(F.sha2(F.concat_ws(";", F.array_sort(F.collect_list(key))), 256).alias("sample"))
    inventory = links.groupBy("case_id").agg(F.bit_xor(F.xxhash64("edge", "source", "target", "source_entity", "target_entity")).alias("inventory"))
    out = whole.join(taken, ["case_id", "family"], "left").join(digest, "case_id", "left").join(inventory, "case_id")
    return out.select("case_id", "family", "population", F.coalesce("taken", F.lit(0)).alias("taken"), "inventory", "sample")


def replay_faults(audit: DataFrame, again: DataFrame) -> DataFrame:
    """``case_id``, ``fault`` where a sample that was drawn again differs from its audit: other links, numbers or fragments."""
    side = lambda df, p: df.select("case_id", "family", *(F.col(c).alias(f"{p}_{c}") for c in ("population", "taken", "inventory", "sample")))
    both = side(audit, "a").join(side(again, "b"), ["case_id", "family"], "full_outer")
    differs = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    fault = F.when(differs("inventory"), "other links").when(differs("population") | differs("taken"), "other numbers").when(differs("sample"), "other fragments")
    return both.select("case_id", fault.alias("fault")).where("fault is not null").distinct()
