"""Aggregation, duplicates, pivot and unpivot."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeel.core import Refused, Result, digest, distinct_with_null, exact_sum, missing, quoted, require, sample, stored


def _comparable(df: DataFrame, c: str) -> Column:
    """Not-a-number counts neither as smallest nor as largest."""
    return F.when(~F.isnan(quoted(c)), quoted(c)) if dict(df.dtypes)[c] in ("double", "float") else quoted(c)


METRICS = {
    "sum": lambda df, c: F.coalesce(F.sum(quoted(c)), F.lit(0)), "mean": lambda df, c: F.avg(quoted(c)), "count": lambda df, c: F.count(quoted(c)),
    "min": lambda df, c: F.min(_comparable(df, c)), "max": lambda df, c: F.max(_comparable(df, c)), "n_unique": lambda df, c: distinct_with_null(quoted(c)),
}


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def agree(a: float | None, b: float | None, tolerance: float, relative: float = 0.0) -> bool:
    """Whether two totals agree; what is missing or not a number agrees with nothing."""
    return a is not None and b is not None and abs(a - b) <= max(tolerance, relative * abs(b))


def aggregate_plan(df: DataFrame, group_by: list[str], metrics: list[dict[str, str]]) -> DataFrame:
    made = [METRICS[m["fn"]](df, m["column"]).alias(m["name"]) for m in metrics]
    return df.groupBy(*map(quoted, group_by)).agg(*made) if group_by else df.agg(*made)


def control_totals(df: DataFrame, output: DataFrame, metrics: list[dict[str, str]]) -> DataFrame:
    """For each ``sum`` metric its total over the groups and, on another plan and in decimals, over the input."""
    sums = [m for m in metrics if m["fn"] == "sum"]
    a = output.agg(*[F.coalesce(F.sum(quoted(m["name"])), F.lit(0)).cast("double").alias(f"a{i}") for i, m in enumerate(sums)])
    b = df.agg(*[exact_sum(m["column"]).cast("double").alias(f"b{i}") for i, m in enumerate(sums)])
    rows = F.array(*[F.struct(F.lit(m["name"]).alias("metric"), F.col(f"a{i}").alias("grouped_total"), F.col(f"b{i}").alias("input_total")) for i, m in enumerate(sums)])
    return a.crossJoin(b).select(F.explode(rows).alias("t")).select("t.*")  # one row each


def _aggregate_problems(df: DataFrame, group_by: list[str], metrics: list[dict[str, str]]) -> list[str]:
    kinds, names = dict(df.dtypes), [*group_by, *(m["name"] for m in metrics)]
    problems = missing(df, [*group_by, *(m["column"] for m in metrics)]) + [f"unknown function {m['fn']!r}" for m in metrics if m["fn"] not in METRICS] + ["there are no metrics"] * (not metrics)
    problems += [f"{m['fn']} needs numbers, {m['column']!r} is {kinds[m['column']]}" for m in metrics if m["fn"] in ("sum", "mean") and m["column"] in kinds and not kinds[m["column"]].startswith(NUMBERS)]
    return problems + [f"the result would have two columns {n!r}" for n in dict.fromkeys(names) if names.count(n) > 1]


def aggregate(
    df: DataFrame, group_by: list[str], metrics: list[dict[str, str]], reconcile_tolerance: float = 0.01, reconcile_to: float | DataFrame | None = None, relative: float = 0.0, guard: bool = True
) -> Result:
    """Group and aggregate; every ``sum`` is computed a second time and must agree, also with a given control total.

    A control total, for the first ``sum``, is a number or a table of one row and one column. Totals
    that are not numbers, or too large to be added up exactly, do not agree with anything.
    ``relative`` allows for rounding of large totals.
    """
    controlled = isinstance(reconcile_to, DataFrame)
    problems = ["a control total needs a sum metric"] * (reconcile_to is not None and all(m["fn"] != "sum" for m in metrics))
    require(_aggregate_problems(df, group_by, metrics) + problems + ["a control table has one column"] * (controlled and len(reconcile_to.columns) != 1))
    output = aggregate_plan(df, group_by, metrics)
    if not guard:
        return Result(output)
    totals, rows = [], None
    if any(m["fn"] == "sum" for m in metrics):
        found = control_totals(df, output, metrics)
        if controlled:
            control = reconcile_to.toDF("c").agg(F.count(F.lit(1)).alias("control_rows"), F.max(F.col("c").try_cast("double")).alias("control_total"))
            found = found.crossJoin(control)  # a row a metric, and one row
        totals = [t.asDict() for t in found.collect()]
        if controlled:
            reconcile_to, rows = totals[0]["control_total"], totals[0]["control_rows"]
            require([f"the control table has {rows} rows"] if rows != 1 else [])
    evidence: dict[str, Any] = {"totals": [{k: t[k] for k in ("metric", "grouped_total", "input_total")} for t in totals]} | ({"control_total": reconcile_to} if reconcile_to is not None or rows else {})
    for t in totals:
        if not agree(t["grouped_total"], t["input_total"], reconcile_tolerance, relative):
            raise Refused("RECONCILIATION_FAIL", f"totals of {t['metric']!r} differ", evidence)
    if (reconcile_to is not None or rows) and not agree(totals[0]["grouped_total"], reconcile_to, reconcile_tolerance, relative):
        raise Refused("RECONCILIATION_FAIL", f"the total of {totals[0]['metric']!r} is not the control total", evidence)
    evidence |= coverage(df, group_by).first().asDict()
    return Result(output, evidence, evidence["rows_covered"], evidence["group_count"])


def coverage(df: DataFrame, group_by: list[str]) -> DataFrame:
    """One row: number of groups and rows covered; without keys there is one group."""
    if not group_by:
        return df.agg(F.lit(1).cast("long").alias("group_count"), F.count(F.lit(1)).alias("rows_covered"))
    n = df.groupBy(*map(quoted, group_by)).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("group_count"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rows_covered"))


#: Copies of a row that one array numbers, when a row that goes several times is written out again.
COPIES = 100_000
#: Digests of repeated rows that are sent to every task: 16 bytes each, so some tens of MB.
MOST_REPEATED = 1_000_000


def kept_rows(df: DataFrame, keys: list[str], keep: str = "first", order_by: list[str] | None = None) -> DataFrame:
    """The row of each key that stays. All columns break ties, so the choice never depends on the plan.

    It is the smallest or largest of the key's rows, found by partial aggregates before the
    shuffle: a key that all rows share is one row a task when it is shuffled.
    """
    by = [*(order_by or []), *[c for c in df.columns if c not in keys and c not in (order_by or [])]]
    rest = [c for c in by if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    best = (F.max if keep == "last" else F.min)(F.struct(*[quoted(c) for c in rest]))
    one = df.groupBy(*[quoted(k) for k in keys]).agg(best.alias("_kept"))
    return one.select(*[quoted(c) if c in keys else F.col("_kept").getField(c).alias(c) for c in df.columns])


def removed_rows(df: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``df`` without one of each of ``kept``, by 128 hashed bits of the whole row: equal rows are counted, and written out as often as they go. No key is brought into one task."""
    one, two = digest(df.dtypes)
    rows = df.select(one.alias("_one"), two.alias("_two"), F.struct(*[quoted(c) for c in df.columns]).alias("_row")).groupBy("_one", "_two").agg(F.first("_row").alias("_row"), F.count(F.lit(1)).alias("_n"))
    one, two = digest(kept.dtypes)
    stay = kept.select(one.alias("_one"), two.alias("_two"), F.lit(1).alias("_stays"))
    gone = rows.join(stay, ["_one", "_two"], "left").withColumn("_n", F.col("_n") - F.coalesce("_stays", F.lit(0))).where("_n > 0")
    blocks = gone.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES))))
    return blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("_n") - F.col("_block") * COPIES)))).select("_row.*")


def distinct_rows(df: DataFrame, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """Each row once. Digests are counted first, and only rows whose digest repeats are shuffled whole.

    The repeated digests are stored, and sent to all tasks if there are at most ``most_repeated``;
    if there are more, all rows are shuffled, since many of them would be anyway.
    """
    one, two = digest(df.dtypes)
    marked = df.select(one.alias("_one"), two.alias("_two"), F.struct(*[quoted(c) for c in df.columns]).alias("_row"))
    repeated = stored(marked.groupBy("_one", "_two").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_one", "_two"), "repeated")
    found = repeated.limit(most_repeated + 1).count()
    if found > most_repeated:
        return df.dropDuplicates()
    if not found:
        return df
    again = F.broadcast(repeated)  # of the size just counted
    single = marked.join(again, ["_one", "_two"], "left_anti")
    copies = marked.join(again, ["_one", "_two"], "left_semi").dropDuplicates(["_one", "_two"])
    return single.unionByName(copies).select("_row.*")


def deduplicate(df: DataFrame, keys: list[str], keep: str = "first", order_by: list[str] | None = None, guard: bool = True) -> Result:
    """Keep the first or last row of each key; evidence has the duplicate groups, and ``removed`` is a DataFrame."""
    require(missing(df, [*keys, *(order_by or [])]) + ["keep must be first or last"] * (keep not in ("first", "last")) + ["no keys"] * (not keys))
    whole = set(keys) == set(df.columns)
    output = distinct_rows(df) if whole else kept_rows(df, keys, keep, order_by)
    removed = removed_rows(df, df.dropDuplicates() if whole else output)
    if not guard:
        return Result(output, {"removed": removed})
    n, groups, kept = df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count_if(F.col("_n") > 1), F.count(F.lit(1))).first()
    evidence = {"duplicate_groups": groups, "removed": removed, "rows_removed": n - kept, "removed_sample": sample(removed, 50) if n > kept else []}
    return Result(output, evidence, n, kept)


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


PIVOTS = {
    "min": lambda v, o: F.min(v), "max": lambda v, o: F.max(v), "sum": lambda v, o: F.sum(v), "mean": lambda v, o: F.avg(v), "median": lambda v, o: F.median(v),
    "len": lambda v, o: F.count(F.lit(1)), "first": lambda v, o: F.min_by(v, F.struct(*o)), "last": lambda v, o: F.max_by(v, F.struct(*o)), None: lambda v, o: F.any_value(v),
}


#: Columns that a pivot may make.
MOST_COLUMNS = 10_000


def pivot(df: DataFrame, index: list[str], on: str, values: str, aggregate_function: str | None = None, order_by: list[str] | None = None, on_values: list[Any] | None = None, guard: bool = True) -> Result:
    """Long to wide. Without an aggregate each cell must have one row; ``first`` and ``last`` need an order."""
    require(missing(df, [*index, on, values, *(order_by or [])]) + [f"unknown function {aggregate_function!r}"] * (aggregate_function not in PIVOTS) + ["first and last need order_by"] * (aggregate_function in ("first", "last") and not order_by))
    if on_values is None:  # as many as columns of the result
        found = df.select(on).distinct().limit(MOST_COLUMNS + 1).collect()
        require([f"{on!r} has more than {MOST_COLUMNS} values"] if len(found) > MOST_COLUMNS else [])
        on_values = sorted((r[0] for r in found), key=lambda v: (v is None, v))
    if guard and aggregate_function is None:
        clashes = duplicate_groups(df, [*index, on])
        if found := sample(clashes):
            raise Refused("DATA_QUALITY_BLOCK", "several rows fall in one cell", {"duplicates": found})
    order = [F.col(c) for c in order_by or []]
    return Result(df.groupBy(*index).pivot(on, on_values).agg(PIVOTS[aggregate_function](F.col(values), order)))


def unpivot(df: DataFrame, index: list[str], on: list[str], variable_name: str = "variable", value_name: str = "value") -> Result:
    """Wide to long; columns of different families become text."""
    require(missing(df, [*index, *on]) + [f"column {c!r} exists already" for c in (variable_name, value_name) if c in index] + ["the new columns have one name"] * (variable_name == value_name))
    kinds = {t for c, t in df.dtypes if c in on}
    numeric = kinds <= {"tinyint", "smallint", "int", "bigint", "float", "double"}
    wide = df if len(kinds) == 1 or numeric else df.withColumns({c: F.col(c).cast("string") for c in on})
    return Result(wide.unpivot(index, on, variable_name, value_name))
