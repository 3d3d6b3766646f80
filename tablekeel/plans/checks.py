"""Checks whose results are rows: ``check_id, observed, expected, tolerance, passed, severity``.

A check is an aggregate expression and how to judge it, so that all checks on a table share one
pass over it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeel.core import Refused, Result, digest, exact_sum, missing, quoted, require, spark_type
from tablekeel.operators.joins import join_evidence

RESULT = "check_id string, observed double, expected double, tolerance double, passed boolean, severity string"


@dataclass(frozen=True)
class Check:
    """``observed`` is an aggregate; ``passed`` gets it as a column. ``columns`` must exist."""

    check_id: str
    observed: Column
    expected: float
    passed: Callable[[Column, Column], Column]
    columns: tuple[str, ...] = ()
    tolerance: float = 0.0
    severity: str = "BLOCKING"


AT_MOST = lambda observed, expected: observed <= expected


def null_rate(column: str, max_rate: float, severity: str = "BLOCKING") -> Check:
    return Check(f"null_rate:{column}", F.coalesce(F.avg(quoted(column).isNull().cast("double")), F.lit(0.0)), max_rate, AT_MOST, (column,), 0.0, severity)


def value_range(column: str, low: Any = None, high: Any = None, severity: str = "BLOCKING") -> Check:
    outside = F.lit(False)
    for bound, test in ((low, lambda: quoted(column) < low), (high, lambda: quoted(column) > high)):
        outside = outside | test() if bound is not None else outside
    return Check(f"range:{column}", F.count_if(outside), 0, AT_MOST, (column,), 0.0, severity)


def allowed_values(column: str, allowed: list[Any], severity: str = "BLOCKING") -> Check:
    return Check(f"allowed_values:{column}", F.count_if(quoted(column).isNotNull() & ~quoted(column).isin(allowed)), 0, AT_MOST, (column,), 0.0, severity)


#: Values of a list that is sent to every task; a longer one is joined by a shuffle.
MOST_ALLOWED = 1_000_000


def allowed_in(df: DataFrame, column: str, allowed: DataFrame, severity: str = "BLOCKING", most: int = MOST_ALLOWED) -> DataFrame:
    """Values of ``column`` that are not in the one column of the table ``allowed``, nulls ignored; the list may be of any size.

    The values are counted first, so that a frequent one is a row, and the list is sent to all
    tasks if it has at most ``most`` values.
    """
    require(missing(df, [column]) + [f"the list has {len(allowed.columns)} columns"] * (len(allowed.columns) != 1))
    listed = allowed.toDF("_allowed").where("_allowed IS NOT NULL").distinct()
    if listed.limit(most + 1).count() <= most:
        listed = F.broadcast(listed)  # of the size just counted
    n = df.where(quoted(column).isNotNull()).groupBy(quoted(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    lost = n.join(listed, F.col("_value") == F.col("_allowed"), "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("o"))
    return _result(lost, f"allowed_values:{column}", F.col("o"), F.lit(0), 0, F.col("o") == 0, severity)


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Results of checks on one table, from one aggregate. A check whose columns are missing is a failed result."""
    ready = [c for c in checks if all(x in df.columns for x in c.columns)]
    rows = [F.struct(F.lit(c.check_id).alias("check_id"), c.observed.cast("double").alias("observed"), F.lit(float(c.expected)).alias("expected"), F.lit(float(c.tolerance)).alias("tolerance"), F.lit(c.severity).alias("severity"), F.lit(i).alias("n")) for i, c in enumerate(ready)]
    lost = [(c.check_id, None, float(c.expected), float(c.tolerance), False, c.severity) for c in checks if c not in ready]
    failed = df.sparkSession.createDataFrame(lost, RESULT)
    if not ready:
        return failed
    out = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    passed = F.lit(None).cast("boolean")
    for i, c in enumerate(ready):
        passed = F.when(F.col("n") == i, c.passed(F.col("observed"), F.col("expected"))).otherwise(passed)
    done = out.select("check_id", "observed", "expected", "tolerance", F.coalesce(passed, F.lit(False)).alias("passed"), "severity")
    return done.unionByName(failed) if lost else done


def _result(df: DataFrame, check_id: str, observed: Column, expected: Column, tolerance: float, passed: Column, severity: str = "BLOCKING") -> DataFrame:
    return df.select(F.lit(check_id).alias("check_id"), observed.cast("double").alias("observed"), expected.cast("double").alias("expected"), F.lit(float(tolerance)).alias("tolerance"), F.coalesce(passed, F.lit(False)).alias("passed"), F.lit(severity).alias("severity"))


def no_duplicate_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Observed are all rows that have an equal; a null equals a null. Only 128 hashed bits of each row are shuffled."""
    keys = subset or df.columns
    require(missing(df, keys))
    kinds = dict(df.dtypes)
    n = df.select(*digest([(k, kinds[k]) for k in keys])).toDF("one", "two").groupBy("one", "two").agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("o"))
    return _result(n, f"unique:{','.join(keys)}", F.col("o"), F.lit(0), 0, F.col("o") == 0)


TOTALS = {"sum": exact_sum, "count": lambda c: F.count(quoted(c)), "mean": lambda c: F.coalesce(exact_sum(c).cast("double") / F.nullif(F.count(quoted(c)), F.lit(0)), F.lit(0.0))}


def _compare(a: DataFrame, b: DataFrame, check_id: str, tolerance: float, relative: float = 0.0) -> DataFrame:
    """Compare one-row tables with columns ``a`` and ``b``."""
    allowed = F.greatest(F.lit(float(tolerance)), F.abs("a") * relative)
    return _result(a.crossJoin(b), check_id, F.col("b"), F.col("a"), tolerance, F.abs(F.col("a") - F.col("b")) <= allowed)


def conservation(before: DataFrame, after: DataFrame, column: str, agg: str = "sum", tolerance: float = 0.0, relative: float = 0.0) -> DataFrame:
    """The total before against the total after, both exact, so that no tolerance is needed."""
    a, b = (df.agg(TOTALS[agg](column).cast("double").alias(n)) for df, n in ((before, "a"), (after, "b")))
    return _compare(a, b, f"conservation:{agg}({column})", tolerance, relative)


def row_conservation(before: DataFrame, after: DataFrame, allow_decrease: bool = False) -> DataFrame:
    """More rows than before pass: only losses count."""
    both = before.agg(F.count(F.lit(1)).alias("a")).crossJoin(after.agg(F.count(F.lit(1)).alias("b")))
    return _result(both, "row_conservation", F.col("b"), F.col("a"), 0, F.lit(True) if allow_decrease else F.col("b") >= F.col("a"))


def match_rate(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], least: float) -> DataFrame:
    e = join_evidence(left, right, left_keys, right_keys)
    return _result(e, f"match_rate:{','.join(left_keys)}", F.col("match_rate_left"), F.lit(least), 0, F.col("match_rate_left") >= least)


def multiplication(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], most: float, how: str = "inner") -> DataFrame:
    e = join_evidence(left, right, left_keys, right_keys, how)
    return _result(e, f"multiplication:{','.join(left_keys)}", F.col("multiplication"), F.lit(most), 0, F.col("multiplication") <= most)


def reconciliation(observed: DataFrame, expected: DataFrame, tolerance: float = 0.01, relative: float = 0.0) -> DataFrame:
    """Two one-row, one-column totals."""
    return _compare(expected.toDF("a"), observed.toDF("b"), "reconciliation", tolerance, relative)


def dual_computation(df: DataFrame, column: str, agg: str = "sum", tolerance: float = 0.01, relative: float = 1e-9) -> DataFrame:
    """The same total in doubles and, on another plan, in decimals; nulls count in neither.

    ``relative`` allows for what doubles lose while large totals are added up.
    """
    value = quoted(column).cast("double")
    plain = {"sum": F.coalesce(F.sum(value), F.lit(0.0)), "count": F.count(quoted(column)).cast("double"), "mean": F.coalesce(F.avg(value), F.lit(0.0))}
    exact = df.where(quoted(column).isNotNull()).agg(TOTALS[agg](column).cast("double").alias("b"))
    return _compare(df.agg(plain[agg].alias("a")), exact, f"dual:{agg}({column})", tolerance, relative)


def schema_checks(df: DataFrame, required_columns: list[str] | None = None, dtypes: dict[str, str] | None = None, null_policy: dict[str, float] | None = None, unique_keys: list[str] | None = None) -> DataFrame:
    """All results at once: required columns, types, null rates and unique keys.

    Rules that name missing columns, and rates outside 0 to 1, are refused before any job runs.
    """
    kinds = dict(df.dtypes)
    problems = missing(df, [*(dtypes or {}), *(null_policy or {}), *(unique_keys or [])])
    require(problems + [f"the null rate of {c!r} lies outside 0 to 1" for c, r in (null_policy or {}).items() if not 0 <= r <= 1])
    fixed = [(f"required_column:{c}", float(c in kinds), 1.0, 0.0, c in kinds, "BLOCKING") for c in required_columns or []]
    fixed += [(f"dtype:{c}", float(kinds.get(c) == spark_type(t)), 1.0, 0.0, kinds.get(c) == spark_type(t), "BLOCKING") for c, t in (dtypes or {}).items()]
    out = df.sparkSession.createDataFrame(fixed, RESULT)
    if null_policy:
        out = out.unionByName(run_checks(df, [null_rate(c, r) for c, r in null_policy.items()]))
    if unique_keys:
        out = out.unionByName(no_duplicate_rows(df, unique_keys))
    return out


def validate_schema(df: DataFrame, **rules: Any) -> Result:
    """Pass the table through unchanged, or refuse with all check results."""
    results = [r.asDict() for r in schema_checks(df, **rules).collect()]
    if any(not r["passed"] for r in results):
        raise Refused("VALIDATION_FAIL", "; ".join(r["check_id"] for r in results if not r["passed"]), {"results": results})
    return Result(df, {"results": results})


def _lost(c: Check) -> tuple:
    return (c.check_id, None, float(c.expected), float(c.tolerance), False, c.severity)


def _attempt(run: Callable[[], DataFrame]) -> list[tuple] | None:
    """Rows of a result, a row a check; None if it can't be planned or fails while it runs."""
    try:
        return [tuple(r) for r in run().select("check_id", "observed", "expected", "tolerance", "passed", "severity").collect()]
    except Exception:  # noqa: BLE001 - whatever goes wrong in a check, it has failed and the others stay
        return None


def run_suite(stages: dict[str, DataFrame], suite: list[dict[str, Any]]) -> DataFrame:
    """Run check specs over named tables: ``{stage, check}`` with a ``Check``, or ``{stages: (before, after), run}`` for two tables.

    Checks of one stage share a pass; if that pass fails, they run one by one. A stage that is
    missing, and a check that can't be planned or fails while it runs, is a failed result. The
    results are there when this returns.
    """
    spark = next(iter(stages.values())).sparkSession
    rows: list[tuple] = []
    for stage in dict.fromkeys(s["stage"] for s in suite if "check" in s):
        checks = [s["check"] for s in suite if s.get("stage") == stage and "check" in s]
        table = stages.get(stage)
        together = _attempt(lambda t=table, cs=checks: run_checks(t, cs)) if table is not None else [_lost(c) for c in checks]
        rows += together if together is not None else [r for c in checks for r in _attempt(lambda t=table, c=c: run_checks(t, [c])) or [_lost(c)]]
    for s in suite:
        if "run" in s:
            found = _attempt(lambda s=s: s["run"](*(stages[x] for x in s["stages"])))
            rows += found if found is not None else [(s.get("check_id", "check"), None, None, None, False, "BLOCKING")]
    return spark.createDataFrame(rows, RESULT)


def report(results: DataFrame) -> DataFrame:
    """One row: passed overall, and numbers of passed checks, warnings and blocking failures."""
    failed = ~F.col("passed")
    return results.agg(F.coalesce(F.bool_and(F.col("passed") | (F.col("severity") != "BLOCKING")), F.lit(True)).alias("passed"), F.count_if("passed").alias("passed_checks"), F.count_if(failed & (F.col("severity") != "BLOCKING")).alias("warnings"), F.count_if(failed & (F.col("severity") == "BLOCKING")).alias("blocking_failures"))


def scorecard(results: DataFrame) -> DataFrame:
    """One row: share of passed checks overall and among those on data quality; 1 if there are none."""
    quality = F.col("check_id").rlike("^(null_rate|unique|required_column):")
    share = lambda when: F.coalesce(F.avg(F.when(when, F.col("passed").cast("double"))), F.lit(1.0))
    return results.agg(share(F.lit(True)).alias("validation_score"), share(quality).alias("data_quality_score"))


REASON = "metric string, reason string"


def reconcile_stages(rows: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Status of reconciliation from test rows: FAIL if one failed, UNAVAILABLE if a metric has a ``reason`` why it could not be tested, else PASS."""
    failed = rows.agg(F.count_if(~F.col("passed")).alias("failed"))
    if reasons is None:
        return failed.select(F.when(F.col("failed") > 0, "FAIL").otherwise("PASS").alias("status"))
    both = failed.crossJoin(reasons.agg(F.count(F.lit(1)).alias("blocked")))  # one row each
    return both.select(F.when(F.col("failed") > 0, "FAIL").when(F.col("blocked") > 0, "UNAVAILABLE").otherwise("PASS").alias("status"))


#: Operations whose output must have all rows of their input.
ROW_CONSERVING = ("cast", "derive", "export")


def _is_sum(metric: dict[str, Any]) -> bool:
    return (metric.get("formula") or "").strip().lower().startswith("sum(")


def _covering(steps: list[dict[str, Any]], metric: str) -> dict[str, Any] | None:
    return next((s for s in reversed(steps) if metric in s.get("covers", [])), None)


def _metric_spec(step: dict[str, Any], metric: str) -> dict[str, Any] | None:
    return next((m for m in step.get("params", {}).get("metrics", []) if m["name"] == metric), None)


def reconcile_workflow(steps: list[dict[str, Any]], metrics: list[dict[str, Any]], tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Tests of a workflow as rows, and ``metric, reason`` for what can't be tested; ``reconcile_stages`` makes the status of both.

    ``tables`` are by step id and ``source:name``. Steps that conserve rows are tested for it. Every
    ``sum(`` metric that an aggregate step ``covers`` is tested by its groups' subtotals against
    the step's input; one without groups, or whose tables are missing, has no anchor.
    """
    spark = next(iter(tables.values())).sparkSession
    tests = [row_conservation(tables[s["inputs"][0]], tables[s["id"]]) for s in steps if s["op"].split("@")[0] in ROW_CONSERVING and s["id"] in tables and s["inputs"][0] in tables]
    reasons = []
    for m in metrics:
        step = _covering(steps, m["name"])
        if not _is_sum(m) or step is None or step["op"].split("@")[0] != "aggregate":
            continue
        spec = _metric_spec(step, m["name"])
        if not step.get("params", {}).get("group_by"):
            reasons.append((m["name"], "no independent anchor: there are no groups to add up"))
        elif spec is None or step["id"] not in tables or step["inputs"][0] not in tables:
            reasons.append((m["name"], "the data to reconcile is not there"))
        else:
            tests.append(subtotals(tables[step["id"]], m["name"], tables[step["inputs"][0]], spec["column"]))
    out = spark.createDataFrame([], RESULT)
    for t in tests:
        out = out.unionByName(t)
    return out, spark.createDataFrame(reasons, REASON)


def derive_suite(contract: dict[str, Any], steps: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Check specs for ``run_suite`` that follow from a contract and its workflow.

    ``contract`` may have ``null_policy`` (column -> policy; only ``error`` is a check), ``stage``
    (the table it speaks of), ``metrics`` (``name, formula``) and ``tolerances``. A ``sum(`` metric
    is computed twice over the input of the aggregate step that covers it. Joins are checked for
    their declared cardinality, schema steps for columns, keys and null rates.
    """
    suite: list[dict[str, Any]] = []
    for column, policy in contract.get("null_policy", {}).items():
        if policy == "error":
            suite.append({"stage": contract["stage"], "check": null_rate(column, 0.0)})
    for m in contract.get("metrics", []):
        step = _covering(steps, m["name"])
        spec = _metric_spec(step, m["name"]) if step else None
        if _is_sum(m) and spec and len(step["inputs"]) == 1:
            column, tolerance = spec["column"], contract.get("tolerances", {}).get(m["name"], 0.01)
            suite.append({"check_id": f"reconciliation:{m['name']}", "stages": (step["inputs"][0],), "run": lambda df, c=column, t=tolerance: dual_computation(df, c, "sum", t)})
    for s in steps:
        op, params = s["op"].split("@")[0], s.get("params", {})
        if op == "join":
            suite.append({"check_id": f"join_cardinality:{s['id']}", "stages": tuple(s["inputs"]), "run": lambda a, b, p=params: join_cardinality(a, b, p["left_keys"], p["right_keys"], p["expected_cardinality"])})
        if op == "validate_schema":
            source = s["inputs"][0]
            suite += [{"check_id": f"required_column:{c}", "stages": (source,), "run": lambda df, c=c: schema_checks(df, required_columns=[c])} for c in params.get("required_columns", [])]
            suite += [{"stage": source, "check": null_rate(c, r)} for c, r in (params.get("null_policy") or {}).items()]
            if keys := params.get("unique_keys"):
                suite.append({"check_id": f"unique:{','.join(keys)}", "stages": (source,), "run": lambda df, k=keys: no_duplicate_rows(df, k)})
    return suite


def join_cardinality(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], cardinality: str) -> DataFrame:
    """Keys that repeat on a side that the declared cardinality has unique."""
    e = join_evidence(left, right, left_keys, right_keys)
    repeated = sum((F.col(f"duplicate_keys_{side}") for side, held in (("left", ("one_to_one", "one_to_many")), ("right", ("one_to_one", "many_to_one"))) if cardinality in held), F.lit(0))
    return _result(e, f"join_cardinality:{cardinality}", repeated, F.lit(0), 0, repeated == 0)


def subtotals(grouped: DataFrame, metric: str, source: DataFrame, column: str, tolerance: float = 0.01, relative: float = 1e-12) -> DataFrame:
    """The groups' subtotals against the total of the ungrouped input."""
    a, b = source.agg(exact_sum(column).cast("double").alias("a")), grouped.agg(exact_sum(metric).cast("double").alias("b"))
    return _compare(a, b, f"subtotals:{metric}", tolerance, relative)
