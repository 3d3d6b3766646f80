"""Projection, filters, casts and derived columns."""

from __future__ import annotations

import uuid
from collections.abc import Collection
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablekeel.core import SAMPLE, Refused, Result, missing, one_pass, quoted, require, sample, spark_type

COMPARE = {
    "==": lambda c, v: c == F.lit(v), "!=": lambda c, v: c != F.lit(v), "<": lambda c, v: c < F.lit(v), "<=": lambda c, v: c <= F.lit(v), ">": lambda c, v: c > F.lit(v), ">=": lambda c, v: c >= F.lit(v),
    "in": lambda c, v: c.isin(list(v)), "not_in": lambda c, v: ~c.isin(list(v)), "is_null": lambda c, _: c.isNull(), "is_not_null": lambda c, _: c.isNotNull(),
}
NULLARY = ("is_null", "is_not_null")
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _fits(value: Any, kind: str) -> bool:
    """Whether a literal can be compared with a column of this type; types other than these are left to Spark."""
    if kind.startswith(NUMBERS):
        return isinstance(value, int | float | Decimal) and not isinstance(value, bool)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        if isinstance(value, str):
            try:
                datetime.fromisoformat(value)
            except ValueError:
                return False
            return True
        return isinstance(value, date)
    return isinstance(value, {"string": str, "boolean": bool}.get(kind, object))


def _value_problems(f: dict[str, Any], kinds: dict[str, str]) -> list[str]:
    op, value, kind = f["op"], f.get("value"), kinds.get(f["column"])
    if op not in COMPARE:
        return [f"unknown operator {op!r}"]
    if op in NULLARY or kind is None:
        return []
    if value is None:
        return [f"operator {op!r} needs a value"]
    if op in ("in", "not_in"):
        if isinstance(value, str | bytes) or not isinstance(value, Collection):
            return [f"operator {op!r} needs a list, not {value!r}"]
        if any(v is None for v in value):
            return [f"the list of {op!r} holds a null"]
    odd = [v for v in (value if op in ("in", "not_in") else [value]) if not _fits(v, kind)]
    return [f"{f['column']!r} is {kind}, {odd[0]!r} is not"] if odd else []


def condition(filters: list[dict[str, Any]]) -> Column:
    """All conditions together; a comparison with null keeps nothing."""
    return reduce(and_, (COMPARE[f["op"]](quoted(f["column"]), f.get("value")) for f in filters), F.lit(True))


def watched(df: DataFrame, watch: str | None, *metrics: Column) -> tuple[DataFrame, Observation | None]:
    """``df`` that counts ``metrics`` while it is read: for a batch, as an observation, for a stream under the name ``watch``, in its progress."""
    if df.isStreaming:
        return df.observe(watch, *metrics), None
    seen = Observation(f"{watch}-{uuid.uuid4().hex}")
    return df.observe(seen, *metrics), seen


def _streams(df: DataFrame, sink: str | None) -> None:
    require(["a stream is written by its own query, not to a sink"] if df.isStreaming and sink else [])


def select_filter(df: DataFrame, columns: list[str] | None = None, filters: list[dict[str, Any]] | None = None, guard: bool = True, sink: str | None = None) -> Result:
    """Keep the rows that meet all ``filters`` (``{column, op, value}``), then the ``columns``.

    With ``sink`` the result is written there and its evidence is counted on the way, in one scan.
    The result of a stream counts in its progress, see ``streaming.guarded.progress_evidence``.
    """
    filters = filters or []
    kinds = dict(df.dtypes)
    require(missing(df, [*(columns or []), *(f["column"] for f in filters)]) + [p for f in filters for p in _value_problems(f, kinds)])
    _streams(df, sink)

    def plan(df: DataFrame) -> DataFrame:
        output = df.filter(condition(filters)) if filters else df
        return output.select(*map(quoted, columns)) if columns else output

    if not guard:
        return Result(plan(df))
    wanted = F.count(F.lit(1)).alias("rows_in"), F.count_if(condition(filters)).alias("rows_out")

    def found(n: int, kept: int) -> Result:
        return Result(plan(df), {"rows_filtered_out": n - kept, "value_mutation": False}, n, kept)

    if df.isStreaming:
        return Result(plan(watched(df, "select_filter", *wanted)[0]))
    if not sink:
        return found(*df.agg(*wanted).first())
    counted, seen = watched(df, "select_filter", *wanted)
    return one_pass(df.sparkSession, sink, plan(counted), lambda: found(seen.get["rows_in"], seen.get["rows_out"]))


#: Formats a text must have before a lenient cast may read it.
FORMATS = {
    "bigint": r"^[+-]?[0-9]+$", "int": r"^[+-]?[0-9]+$", "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|NaN)$", "float": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|NaN)$",
    "boolean": "^(true|false)$", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "timestamp_ntz": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$",
}
CASTS = ("bigint", "int", "double", "float", "string", "boolean", "date", "timestamp_ntz")


def strict_cast(df: DataFrame, column: str, to: str) -> Column:
    """The column cast to ``to``, null where its text is not in the type's format."""
    c = quoted(column)
    if dict(df.dtypes)[column] == "string" and to in FORMATS:
        return F.when(c.rlike(FORMATS[to]), c.try_cast(to))
    return c.try_cast(to)


def cast(df: DataFrame, casts: list[dict[str, Any]], guard: bool = True, sink: str | None = None) -> Result:
    """Cast columns (``{column, target_type, parseability_threshold=1.0}``); refuse where too few values parse.

    With ``sink`` the result is written there and its evidence is counted on the way, in one scan;
    values that don't parse are looked for in a second one, if there are any. The result of a
    stream counts in its progress.
    """
    problems = missing(df, [x["column"] for x in casts])
    for x in casts:
        if spark_type(x["target_type"]) not in CASTS:
            problems.append(f"unknown target type {x['target_type']!r}")
        if not 0 <= x.get("parseability_threshold", 1.0) <= 1:
            problems.append("a threshold lies outside 0 to 1")
    names = [x["column"] for x in casts]
    require(problems + [f"column {c!r} is cast twice" for c in dict.fromkeys(names) if names.count(c) > 1])
    _streams(df, sink)
    to = {x["column"]: strict_cast(df, x["column"], spark_type(x["target_type"])) for x in casts}

    def plan(df: DataFrame) -> DataFrame:
        return df.select(*[to[c].alias(c) if c in to else quoted(c) for c in df.columns])

    if not guard:
        return Result(plan(df))
    wanted = [F.count(F.lit(1)).alias("rows_in"), *[x for i, (c, e) in enumerate(to.items()) for x in (F.count(quoted(c)).alias(f"filled{i}"), F.count_if(quoted(c).isNotNull() & e.isNull()).alias(f"failed{i}"))]]

    def found(n: dict[str, int]) -> Result:
        evidence: dict[str, Any] = {}
        for i, x in enumerate(casts):
            filled, failed, c = n[f"filled{i}"], n[f"failed{i}"], x["column"]
            rate = 1 - failed / filled if filled else 1.0
            evidence[c] = e = {"from_type": dict(df.dtypes)[c], "to_type": spark_type(x["target_type"]), "failed": failed, "parse_rate": rate, "failed_sample": []}
            if failed:
                e["failed_sample"] = [r[0] for r in df.filter(quoted(c).isNotNull() & to[c].isNull()).select(quoted(c)).limit(SAMPLE).collect()]
            if rate < x.get("parseability_threshold", 1.0):
                raise Refused("DATA_QUALITY_BLOCK", f"{failed} of {filled} values of {c!r} do not parse as {x['target_type']}", evidence)
        return Result(plan(df), evidence, n["rows_in"], n["rows_in"])

    if df.isStreaming:
        return Result(plan(watched(df, "cast", *wanted)[0]))
    if not sink:
        return found(df.agg(*wanted).first().asDict())
    counted, seen = watched(df, "cast", *wanted)
    return one_pass(df.sparkSession, sink, plan(counted), lambda: found(seen.get))


def divide(a: Column, b: Column) -> Column:
    """True division; by zero it is infinite, and 0/0 is not a number."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


#: Whole numbers that overflow become null, which ``derive`` counts.
DERIVE = {"add": F.try_add, "subtract": F.try_subtract, "multiply": F.try_multiply, "divide": divide}


def derived(spec: dict[str, Any]) -> Column:
    inputs = [quoted(c) for c in spec["inputs"]]
    if spec["op"] in DERIVE:
        return DERIVE[spec["op"]](*inputs)
    return F.concat(*[c.cast("string") for c in inputs]) if spec["op"] == "concat" else F.coalesce(*inputs)


def _spec_problems(spec: dict[str, Any], kinds: dict[str, str]) -> list[str]:
    op, inputs, problems = spec["op"], spec["inputs"], []
    types = {c: kinds[c] for c in inputs if c in kinds}
    if op not in (*DERIVE, "concat", "coalesce"):
        problems.append(f"unknown operation {op!r}")
    if op in DERIVE and len(inputs) != 2 or not inputs:
        problems.append(f"{op!r} has the wrong number of inputs")
    if op in DERIVE:
        problems += [f"{op!r} needs numbers, {c!r} is {t}" for c, t in types.items() if not t.startswith(NUMBERS)]
    if op == "coalesce" and len(set(types.values())) > 1 and not all(t.startswith(NUMBERS) for t in types.values()):
        problems.append(f"'coalesce' has inputs of several types: {', '.join(types.values())}")
    if spec["output_column"] in kinds:
        problems.append(f"column {spec['output_column']!r} exists already")
    return problems


def derive(df: DataFrame, specs: list[dict[str, Any]], guard: bool = True, sink: str | None = None) -> Result:
    """Add columns (``{output_column, op, inputs, null_policy="error"}``); refuse null inputs unless they may propagate, and whole numbers that overflow.

    With ``sink`` the result is written there and its evidence is counted on the way, in one scan.
    The result of a stream counts in its progress.
    """
    made = [s["output_column"] for s in specs]
    problems = missing(df, [c for s in specs for c in s["inputs"]]) + [p for s in specs for p in _spec_problems(s, dict(df.dtypes))]
    require(problems + [f"column {c!r} is derived twice" for c in dict.fromkeys(made) if made.count(c) > 1])
    _streams(df, sink)
    output = df.select("*", *[derived(s).alias(s["output_column"]) for s in specs])
    if not guard:
        return Result(output)
    empty = [reduce(or_, [quoted(c).isNull() for c in s["inputs"]]) for s in specs]
    gates = [e if s.get("null_policy", "error") == "error" else F.lit(False) for s, e in zip(specs, empty, strict=True)]
    spilt = [~e & quoted(s["output_column"]).isNull() if s["op"] in DERIVE else F.lit(False) for s, e in zip(specs, empty, strict=True)]
    wanted = [F.count(F.lit(1)).alias("rows_in")]
    for i, s in enumerate(specs):
        c = quoted(s["output_column"])
        wanted += [x.alias(f"{k}{i}") for k, x in (("null_inputs", F.count_if(gates[i])), ("nulls", F.count_if(c.isNull())), ("min", F.min(c)), ("max", F.max(c)), ("overflows", F.count_if(spilt[i])))]

    def found(n: dict[str, Any]) -> Result:
        evidence = {s["output_column"]: {k: n[f"{k}{i}"] for k in ("null_inputs", "nulls", "min", "max", "overflows")} for i, s in enumerate(specs)}
        for i, s in enumerate(specs):
            # nulls that the declaration forbids are an invalid request, values that don't fit are bad data
            for what, gate, code in (("null_inputs", gates[i], "VALIDATION_FAIL"), ("overflows", spilt[i], "DATA_QUALITY_BLOCK")):
                if lost := evidence[s["output_column"]][what]:
                    evidence["sample"] = sample(output.filter(gate))
                    raise Refused(code, f"{lost} rows have {what.replace('_', ' ')} of {s['output_column']!r}", evidence)
        return Result(output, evidence, n["rows_in"], n["rows_in"])

    if df.isStreaming:
        return Result(watched(output, "derive", *wanted)[0])
    if not sink:
        return found(output.agg(*wanted).first().asDict())
    counted, seen = watched(output, "derive", *wanted)
    return one_pass(df.sparkSession, sink, counted, lambda: found(seen.get))
