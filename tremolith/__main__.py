"""Command line: list the queries, run one to a table, or check a session and one data folder.

    python -m tremolith list
    python -m tremolith run NAME --data DIR --out DIR
    python -m tremolith smoke --data DIR
"""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import json
import sys

from tremolith.plans import governance, graphs, reference, series
from tremolith.runtime import release, session


def queries() -> dict:
    """All queries by name: those of the project's entry module, run from its folder, or else those of the core."""
    if importlib.util.find_spec("__spark_entry__") is not None:
        return importlib.import_module("__spark_entry__").queries()
    return {name: q for m in (series, reference, graphs, governance) for name, q in m.QUERIES.items()}


def smoke(spark, data: str) -> dict:
    """One pass from readings to ranked candidates: counts that must not be empty, and whether ranks are complete."""
    ranked = graphs.candidate_ranking(spark, data)
    found = ranked.groupBy("case_id").agg({"rank": "max", "entity": "count"}).collect()
    complete = all(r["max(rank)"] == r["count(entity)"] for r in found)
    return {"cases": len(found), "candidates": sum(r["count(entity)"] for r in found), "complete": complete, "ok": bool(found) and complete}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tremolith")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name")
    run.add_argument("--data", required=True)
    run.add_argument("--out", required=True)
    check = commands.add_parser("smoke")
    check.add_argument("--data", required=True)
    given = parser.parse_args(arguments)
    every = queries()
    if given.command == "list":
        print("\n".join(sorted(every)))
        return 0
    if given.command == "run" and given.name not in every:
        parser.error(f"no query {given.name}")
    spark = session()
    try:
        if given.command == "run":
            every[given.name](spark, given.data).write.mode("errorifexists").parquet(given.out)
            return 0
        found = smoke(spark, given.data)
        print(json.dumps(found))
        return 0 if found["ok"] else 1
    finally:
        release(spark)


if __name__ == "__main__":
    sys.exit(main())
