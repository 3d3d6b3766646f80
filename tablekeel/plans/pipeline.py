"""Declarative pipelines: a spec of sources and steps becomes one chain of lazy DataFrames."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.core import Refused, Result, require
from tablekeel.operators.groups import aggregate, deduplicate, pivot, unpivot
from tablekeel.operators.joins import join
from tablekeel.operators.rows import cast, derive, select_filter
from tablekeel.operators.text_clean import text_clean
from tablekeel.plans.checks import report, validate_schema
from tablekeel.sources.tables import load_stage, save_stage

OPERATIONS = {
    ("select_filter", 1): select_filter, ("cast", 1): cast, ("derive", 1): derive, ("join", 1): join, ("aggregate", 1): aggregate, ("deduplicate", 1): deduplicate,
    ("pivot", 1): pivot, ("unpivot", 1): unpivot, ("text_clean", 1): text_clean, ("validate_schema", 1): validate_schema,
}
BINARY = ("join",)
EVIDENCE = "run string, step string, op string, status string, rows_in long, rows_out long, evidence string"


def lookup(op: str):  # noqa: ANN201
    """``id`` or ``id@version``; the highest version if none is named."""
    name, _, version = op.partition("@")
    found = [v for n, v in OPERATIONS if n == name and (not version or str(v) == version)]
    if not found:
        raise Refused("NO_SAFE_OPERATION", f"no operation {op!r}")
    return OPERATIONS[name, max(found)]


def check_spec(spec: dict[str, Any]) -> list[dict[str, Any]]:
    """Refuse repeated ids, unknown inputs, cycles and wrong numbers of inputs; return the steps in an order that can run."""
    steps, problems = spec["steps"], []
    ids = [s["id"] for s in steps]
    known = {f"source:{n}" for n in spec["sources"]} | set(ids)
    problems += [f"step {i!r} is defined twice" for i in {i for i in ids if ids.count(i) > 1}]
    for s in steps:
        problems += [f"step {s['id']!r} reads unknown {x!r}" for x in s["inputs"] if x not in known]
        if len(s["inputs"]) != (2 if s["op"].split("@")[0] in BINARY else 1):
            problems.append(f"step {s['id']!r} has the wrong number of inputs")
    require(problems)
    done, ordered = {f"source:{n}" for n in spec["sources"]}, []
    while len(ordered) < len(steps):
        ready = [s for s in steps if s not in ordered and all(x in done for x in s["inputs"])]
        require([] if ready else ["the steps form a cycle"])
        ordered += ready
        done |= {s["id"] for s in ready}
    return ordered


def run_pipeline(spec: dict[str, Any], sources: dict[str, DataFrame], run: str = "run", guard: bool = True, root: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables by step id, and evidence as a table. The first step that refuses or fails ends the chain; later ones are not run.

    With ``root`` each step's table is written below it and read again, so that the guards of later
    steps don't compute it anew, and each step's evidence is written as soon as it is there
    (``stored_evidence``). Without, tables stay lazy.
    """
    ordered = check_spec(spec)
    require([f"source {n!r} is not given" for n in spec["sources"] if n not in sources])
    for s in ordered:
        lookup(s["op"])
    spark = next(iter(sources.values())).sparkSession
    tables = {f"source:{n}": sources[n] for n in spec["sources"]}
    rows: list[tuple] = []

    def note(*row: Any) -> None:
        rows.append((run, *row))
        if root:
            spark.createDataFrame(rows[-1:], EVIDENCE).write.mode("append").parquet(f"{root}/run={run}/evidence")

    stopped = False
    for s in ordered:
        if stopped:
            note(s["id"], s["op"], "NOT_RUN", None, None, "{}")
            continue
        extra = {} if guard or s["op"].startswith("validate_schema") else {"guard": False}
        try:
            out: Result = lookup(s["op"])(*(tables[x] for x in s["inputs"]), **s.get("params", {}), **extra)
            if root:
                save_stage(out.output, root, run, s["id"])
                out.output = load_stage(spark, root, run, s["id"])
        except Refused as e:
            note(s["id"], s["op"], f"REFUSED:{e.code}", None, None, json.dumps({"reason": e.reason}, default=str))
            stopped = True
            continue
        except Exception as e:  # noqa: BLE001 - whatever goes wrong in a step, the evidence of the others stays
            note(s["id"], s["op"], f"FAILED:{type(e).__name__}", None, None, json.dumps({"reason": str(e)[:1000]}))
            stopped = True
            continue
        tables[s["id"]] = out.output
        shown = {k: v for k, v in out.evidence.items() if not isinstance(v, DataFrame)}
        note(s["id"], s["op"], "COMPLETED", out.rows_in, out.rows_out, json.dumps(shown, default=str))
    return {k: v for k, v in tables.items() if not k.startswith("source:")}, spark.createDataFrame(rows, EVIDENCE)


def stored_evidence(spark: SparkSession, root: str, run: str) -> DataFrame:
    return spark.read.schema(EVIDENCE).parquet(f"{root}/run={run}/evidence")


def release(results: DataFrame, reconciliation: DataFrame) -> DataFrame:
    """One row ``decision``: RELEASED if no blocking check failed and reconciliation passed, else QUARANTINED."""
    return report(results).crossJoin(reconciliation).select(F.when(F.col("passed") & (F.col("status") == "PASS"), "RELEASED").otherwise("QUARANTINED").alias("decision"))


def publish(output: DataFrame, decision: DataFrame, root: str, name: str) -> str:
    """Write the table below ``released`` or ``quarantine`` and return the path."""
    path = f"{root}/{'released' if decision.first()[0] == 'RELEASED' else 'quarantine'}/{name}"
    output.write.mode("overwrite").parquet(path)
    return path
