"""Frozen populations, manifests, snapshots and run records: small documents beside the tables, checked when they are read.

Documents are as long as a data set's list of cases; what is compared with tables is compared by joins.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolith.operators.relations import clipped_references, population_difference
from tremolith.sources.files import atomic_json, content_hashes, strict_csv, strict_json

SCHEMA = "tremolith/manifest/1"


def digest(value) -> str:
    """SHA-256 of a value's canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def checked_bytes(path: str, sha256: str) -> bytes:
    """The content of a small file whose hash is known; another content is an error."""
    with open(path, "rb") as f:
        content = f.read()
    if hashlib.sha256(content).hexdigest() != sha256:
        raise ValueError(f"the content of {path} has changed")
    return content


@dataclass(frozen=True)
class Split:
    """The frozen training and test cases of a data set."""

    dataset: str
    train: tuple[str, ...]
    test: tuple[str, ...]
    sha256: str

    def __post_init__(self):
        for ids in (self.train, self.test):
            if not ids or len(set(ids)) != len(ids) or not all(isinstance(i, str) and i for i in ids):
                raise ValueError("a split has cases on both sides, each once")
        if set(self.train) & set(self.test):
            raise ValueError("training and test cases overlap")


def frozen_split(path: str, sha256: str, counts: tuple[int, int]) -> Split:
    """The split in a JSON document of a known hash, with the known numbers of cases."""
    document = strict_json(checked_bytes(path, sha256).decode("utf-8"))
    if set(document) != {"dataset", "outer_train_case_ids", "outer_test_case_ids"}:
        raise ValueError("a split has other fields")
    split = Split(document["dataset"], tuple(document["outer_train_case_ids"]), tuple(document["outer_test_case_ids"]), sha256)
    if (len(split.train), len(split.test)) != counts:
        raise ValueError("a split has another number of cases")
    return split


def frozen_windows(spark: SparkSession, path: str, sha256: str, count: int, lookback: float | None = None) -> DataFrame:
    """Windows of a CSV file of a known hash: ``case_id``, ``source_id``, ``day``, the bounds, ``evidence``.

    Rows are of ``window_kind`` fault or normal. With ``lookback`` the reference is that many seconds before the fault, up to
    the end of earlier faults of its day; without, it is the one normal window of the day. Another number of faults than
    ``count`` is an error.
    """
    checked_bytes(path, sha256)
    rows = strict_csv_any(spark, path, ("window_id", "source_id", "window_kind", "day", "start_ts", "end_ts"))
    rows = rows.select("window_id", "source_id", "window_kind", "day", F.col("start_ts").cast("double").alias("start"), F.col("end_ts").cast("double").alias("end"))
    kind = F.when(F.col("window_kind").isin("fault", "normal"), F.col("window_kind")).otherwise(F.raise_error(F.lit("an unknown kind of window")))
    rows = rows.withColumn("window_kind", kind)
    faults = rows.where("window_kind = 'fault'").withColumnRenamed("window_id", "case_id").drop("window_kind")
    sizes = faults.agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("d")).first()
    if sizes["n"] != count or sizes["d"] != count:
        raise ValueError("another population of windows")
    if lookback is not None:
        placed = clipped_references(faults, "day", "start", "end", "case_id", lookback).withColumn("reference_end", F.col("start"))
    else:
        normal = rows.where("window_kind = 'normal'").groupBy("day").agg(F.count("*").alias("k"), F.first("start").alias("reference_start"), F.first("end").alias("reference_end"))
        one = F.when(F.col("k") == 1, F.col("reference_start")).otherwise(F.raise_error(F.lit("a day needs exactly one normal window")).cast("double"))
        placed = faults.join(normal, "day", "left").withColumns({"reference_start": one, "evidence": F.lit("paired")})
    return placed.select("case_id", "source_id", "day", "reference_start", "reference_end", F.col("start").alias("incident_start"), F.col("end").alias("incident_end"), "evidence")


def strict_csv_any(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """As ``strict_csv``, but label-bearing columns are dropped unread instead of refused; for curators."""
    return strict_csv(spark, path, required, keep=required)


@dataclass(frozen=True)
class Manifest:
    """What a data set is frozen to: its split, its catalog (id and category, in order), its windows' digest, and counts."""

    split: Split
    catalog: tuple[tuple[str, str], ...]
    windows_sha256: str
    audit: Mapping

    def to_dict(self) -> dict:
        body = {"schema": SCHEMA, "split": asdict(self.split), "catalog": [list(c) for c in self.catalog], "windows_sha256": self.windows_sha256, "audit": dict(self.audit)}
        body = json.loads(json.dumps(body))
        return {**body, "sha256": digest(body)}

    @classmethod
    def from_dict(cls, document: Mapping) -> Manifest:
        """The inverse of :meth:`to_dict`; other fields, or a digest that doesn't fit, are an error."""
        body = {k: v for k, v in document.items() if k != "sha256"}
        if set(body) != {"schema", "split", "catalog", "windows_sha256", "audit"} or body["schema"] != SCHEMA or set(body["split"]) != {f.name for f in fields(Split)}:
            raise ValueError("no manifest of this schema")
        if digest(body) != document.get("sha256"):
            raise ValueError("the manifest has changed")
        s = body["split"]
        return cls(Split(s["dataset"], tuple(s["train"]), tuple(s["test"]), s["sha256"]), tuple((i, c) for i, c in body["catalog"]), body["windows_sha256"], body["audit"])


def windows_digest(windows: DataFrame) -> str:
    """A digest of all windows that doesn't depend on their order or partitions."""
    text = F.to_json(F.struct(*sorted(windows.columns)))
    half = lambda a, b: F.sum(F.conv(F.substring(F.sha2(text, 256), a, b), 16, 10).cast("decimal(20,0)"))
    found = windows.agg(F.count("*").alias("n"), *(half(1 + 8 * i, 8).alias(f"h{i}") for i in range(8))).first()
    return digest([str(v) for v in found])


def build_manifest(split: Split, windows: DataFrame, entities: DataFrame, counts: Mapping[str, int]) -> Manifest:
    """A manifest whose parts fit: the windows are those of all cases of the split, the catalog (``id``, ``category``) has one
    category per id and the known ``counts`` by category."""
    spark = windows.sparkSession
    ids = spark.createDataFrame([(c,) for c in (*split.train, *split.test)], "case_id string")
    if not population_difference(windows, ids, "case_id").isEmpty():
        raise ValueError("the windows are of other cases than the split")
    # a data set's catalog is a document of its own: tens of entities
    catalog = entities.select("id", "category").distinct().orderBy("id").collect()
    if len({r["id"] for r in catalog}) != len(catalog):
        raise ValueError("an entity has two categories")
    found: dict[str, int] = {}
    for r in catalog:
        found[r["category"]] = found.get(r["category"], 0) + 1
    if found != dict(counts):
        raise ValueError("another population of entities")
    evidence = {r["evidence"]: r["count"] for r in windows.groupBy("evidence").count().collect()} if "evidence" in windows.columns else {}
    return Manifest(split, tuple((r["id"], r["category"]) for r in catalog), windows_digest(windows), {"train": len(split.train), "test": len(split.test), "entities": found, "references": evidence})


class Repository:
    """The tables of a data set, bound to a manifest: only its cases are seen, and files may not change in between.

    ``tables`` are Parquet tables below ``root`` with a ``case_id``. Their content is pinned when the repository is opened."""

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest, tables: Sequence[str]):
        self.spark, self.root, self.manifest = spark, os.path.realpath(root), manifest
        self.tables = tuple(tables)
        self.pinned = {t: self._inventory(t) for t in self.tables}

    def _inventory(self, table: str) -> tuple:
        path = os.path.realpath(os.path.join(self.root, table))
        if os.path.commonpath([path, self.root]) != self.root:
            raise ValueError("a table outside the repository")
        found = content_hashes(self.spark, path).where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[._]"))
        return tuple(sorted((r["path"], r["length"], r["sha256"]) for r in found.collect()))  # a name and a hash per file

    def table(self, name: str, part: str | None = None) -> DataFrame:
        """The rows of a table that belong to the manifest's cases, or to those of its ``train`` or ``test`` part."""
        if self._inventory(name) != self.pinned[name]:
            raise ValueError(f"{name} has changed since it was pinned")
        split = self.manifest.split
        ids = {"train": split.train, "test": split.test, None: (*split.train, *split.test)}[part]
        mine = self.spark.createDataFrame([(c,) for c in ids], "case_id string")
        return self.spark.read.parquet(os.path.join(self.root, name)).join(mine, "case_id", "left_semi")

    def smoke_case(self, case: str | None = None) -> str:
        """The named training case, or the first of all."""
        if case is not None and case not in self.manifest.split.train:
            raise ValueError("no training case")
        return case if case is not None else min(self.manifest.split.train)


def snapshot_faults(inventory: DataFrame, cases: DataFrame, least: int = 30) -> DataFrame:
    """``case_id``, ``side`` where a frozen inventory of cached cases and the expected cases differ; empty if they agree.

    ``inventory``: case_id and sha256. A case with two contents, or no more than ``least`` cases, is an error."""
    counted = inventory.groupBy("case_id").agg(F.countDistinct("sha256").alias("k")).agg(F.max("k").alias("most"), F.count("*").alias("n")).first()
    if (counted["most"] or 0) > 1:
        raise ValueError("a cached case has two contents")
    if counted["n"] <= least:
        raise ValueError(f"a snapshot needs more than {least} cases")
    return population_difference(inventory, cases, "case_id")


def sealed_output(folder: str, public: Mapping, labels: DataFrame, summary: Mapping) -> None:
    """A new folder with the public manifest, the sealed labels (Parquet) and a summary; an existing folder is an error, and
    nothing is left behind if a part fails."""
    import shutil

    os.makedirs(folder)  # fails if it is there
    try:
        atomic_json(os.path.join(folder, "public.json"), dict(public), replace=False)
        labels.write.mode("errorifexists").parquet(os.path.join(folder, "sealed"))
        atomic_json(os.path.join(folder, "summary.json"), {**summary, "public_sha256": digest(dict(public))}, replace=False)
    except BaseException:
        shutil.rmtree(folder, ignore_errors=True)
        raise


class Progress:
    """Events of a run: appended to ``events.jsonl``, the last one published as ``status.json``."""

    def __init__(self, folder: str):
        self.events, self.status = os.path.join(folder, "events.jsonl"), os.path.join(folder, "status.json")
        os.makedirs(folder, exist_ok=True)

    def update(self, **event) -> None:
        line = json.dumps(event, sort_keys=True, separators=(",", ":"), allow_nan=False)
        with open(self.events, "a", encoding="utf-8") as f:
            f.write(line + "\n")
            f.flush()
            os.fsync(f.fileno())
        atomic_json(self.status, event)


def bound_search(manifest: Manifest, partition: Sequence[Mapping], seed: int) -> dict:
    """The identity that a search ledger is bound to: the frozen order of eligible cases and what it was drawn from.

    ``partition``: case_id, role, place as ``demo_partition`` gives them."""
    order = [r["case_id"] for r in sorted((r for r in partition if r["role"] == "search"), key=lambda r: r["place"])]
    held = sorted(r["case_id"] for r in partition if r["role"] == "demo")
    if set(order) & set(held) or set(order) | set(held) != {*manifest.split.train, *manifest.split.test} or len(set(order)) != len(order):
        raise ValueError("the partition is of other cases than the manifest")
    return {"manifest_sha256": manifest.to_dict()["sha256"], "eligible": order, "excluded_sha256": digest(held), "candidates": [i for i, _ in manifest.catalog], "seed": seed}


def run_identity(spark: SparkSession, names: Sequence[str] = ("spark.sql.ansi.enabled", "spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")) -> dict:
    """The settings that results may depend on; compared before and after a run."""
    return {n: spark.conf.get(n, None) for n in names} | {"version": spark.version}


def code_identity() -> str:
    """SHA-256 over the names and contents of this package's modules, which a run records."""
    import tremolith

    root = os.path.dirname(os.path.abspath(tremolith.__file__))
    found = sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".py"))
    return digest([[os.path.relpath(f, root), hashlib.sha256(open(f, "rb").read()).hexdigest()] for f in found])
