"""Profiles of tables, one row a column, and drift between two of them.

A profile starts as *states*: counts, smallest and largest values, and for each column a sketch of
its distinct values. States come from one scan without a shuffle of values, are stored as they are
(sketches are binary columns), and those of parts of a table merge to those of the whole.
Where distinct values have to be exact, 128 hashed bits of each value are grouped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeel.core import digest, hashable, quoted
from tablekeel.functions.text import trim

ORDERED = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")
#: Bits of a sketch's registers: 2 ** 13 of them, 1.2 % standard error, 8 kB a column.
SKETCH_BITS = 13
#: Estimates from this share of the rows on may belong to a key, and are counted exactly: five standard errors off.
NEAR_ROWS = 0.94


def _ordered(t: str) -> bool:
    return t in ORDERED or t.startswith("decimal")


def _value(c: str, t: str) -> Column:
    return F.when(~F.isnan(quoted(c)), quoted(c)) if t in ("double", "float") else quoted(c)


def _folded(c: str) -> Column:
    return F.lower(trim(quoted(c)))


def _sketch(value: Column) -> Column:
    return F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), SKETCH_BITS)


def states(df: DataFrame, sketches: bool = True) -> DataFrame:
    """One row a column: dtype, rows, nulls, smallest and largest value as text, and sketches of the distinct values, as they are and without case and blanks.

    One aggregate over one scan, whatever the number of columns.
    """
    cells = []
    for at, (c, t) in enumerate(df.dtypes):
        low, high = (f(_value(c, t)).cast("string") if _ordered(t) else F.lit(None).cast("string") for f in (F.min, F.max))
        none = F.lit(None).cast("binary")
        values = _sketch(hashable(c, t)) if sketches else none
        cells.append(F.struct(
            F.lit(at).alias("at"), F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.count(F.lit(1)).alias("rows"), F.count_if(quoted(c).isNull()).alias("nulls"), low.alias("min_value"), high.alias("max_value"),
            values.alias("values_sketch"), (_sketch(_folded(c)) if sketches and t == "string" else none).alias("folded_sketch"),
        ))
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def merged(*parts: DataFrame) -> DataFrame:
    """The states of a table out of the states of its parts. A column that has several types stays several rows."""
    both = reduce(DataFrame.unionByName, parts)

    def pick(f, c: str) -> Column:  # noqa: ANN001
        number = F.col(c).try_cast("double"), F.col(c).try_cast("decimal(38,18)")  # whole numbers beyond a double's digits are told apart as decimals
        return f(c, F.when(F.col(c).isNotNull(), F.struct(*number, F.col(c)))).alias(c)

    return both.groupBy("column", "dtype").agg(
        F.min("at").alias("at"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), pick(F.min_by, "min_value"), pick(F.max_by, "max_value"),
        F.hll_union_agg("values_sketch").alias("values_sketch"), F.hll_union_agg("folded_sketch").alias("folded_sketch"),
    )


def estimated(parts: DataFrame) -> DataFrame:
    """A profile out of states alone: distinct values are estimates, and ``is_key`` is null where they leave it open."""
    some = F.when(F.col("nulls") > 0, 1).otherwise(0)
    n, folded = (F.hll_sketch_estimate(f"{c}_sketch") + some for c in ("values", "folded"))
    out = parts.withColumns({"distinct_values": n, "folded_values": F.when(F.col("dtype") == "string", folded), "distinct_exact": F.lit(False)})
    open_ = (F.col("rows") > 0) & (F.col("nulls") == 0) & (n >= NEAR_ROWS * F.col("rows"))
    return out.withColumns({"null_rate": _rate(), "is_key": F.when(~open_, False)}).select(*PROFILE)


PROFILE = ["column", "dtype", "rows", "nulls", "distinct_values", "min_value", "max_value", "folded_values", "distinct_exact", "null_rate", "is_key"]


def _rate() -> Column:
    return F.when(F.col("rows") == 0, 0.0).otherwise(F.col("nulls") / F.col("rows"))


def distinct_counts(df: DataFrame, columns: list[str], folded: bool = True) -> DataFrame:
    """``column, kind`` (values or folded), ``n``: exact distinct values, null being one. Each row is turned into narrow digests, grouped before they are shuffled."""
    kinds = dict(df.dtypes)
    wanted = [w for c in columns for w in [(c, "values", hashable(c, kinds[c])), *([(c, "folded", _folded(c))] if folded and kinds[c] == "string" else [])]]
    cells = [F.struct(F.xxhash64(v.isNull(), v).alias("one"), F.xxhash64(F.lit("second"), v).alias("two")) for _, _, v in wanted]
    n = df.select(F.posexplode(F.array(*cells)).alias("k", "h")).select("k", "h.one", "h.two").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind")) for c, k, _ in wanted])
    return n.select(F.element_at(names, F.col("k") + 1).alias("w"), "n").select("w.column", "w.kind", "n")


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row a column: dtype, rows, nulls, null rate, distinct values (null is one), key, min and max as text, distinct values without case and blanks.

    ``exact=False`` estimates distinct values from sketches in a single scan, and counts exactly
    only the columns whose estimate is so near to the number of rows that they may be keys; for
    this it runs at once. ``is_key`` is exact either way, and ``distinct_exact`` says which counts are.
    """
    if exact:
        parts, guess, columns = states(df, sketches=False), None, df.columns
    else:
        spark, kept = df.sparkSession, states(df)
        parts = spark.createDataFrame(kept.collect(), kept.schema)  # a row a column
        guess = estimated(parts)
        columns = [r[0] for r in guess.where(F.col("is_key").isNull()).select("column").collect()]
    base = (guess if guess is not None else parts.withColumns({"distinct_values": F.lit(None).cast("long"), "folded_values": F.lit(None).cast("long"), "distinct_exact": F.lit(False), "null_rate": _rate(), "is_key": F.lit(None).cast("boolean")})).select(*PROFILE)
    if not columns:
        return base
    n = distinct_counts(df, columns, folded=exact).groupBy(F.col("column").alias("_c")).agg(F.max(F.when(F.col("kind") == "values", F.col("n"))).alias("_n"), F.max(F.when(F.col("kind") == "folded", F.col("n"))).alias("_f"))
    counted = base.join(n, F.col("column") == F.col("_c"), "left")
    known = F.col("column").isin(columns)
    values = F.when(known, F.coalesce("_n", F.lit(0).cast("long"))).otherwise(F.col("distinct_values"))
    text = F.when(F.lit(exact) & (F.col("dtype") == "string"), F.coalesce("_f", F.lit(0).cast("long"))).otherwise(F.col("folded_values"))
    key = (F.col("rows") > 0) & (F.col("nulls") == 0) & (F.col("distinct_values") == F.col("rows"))
    out = counted.withColumns({"distinct_values": values, "folded_values": text, "distinct_exact": known})
    return out.withColumn("is_key", F.when(F.col("distinct_exact"), key).otherwise(F.col("is_key"))).select(*PROFILE)


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, and rows beyond the first of equal ones. Rows are told apart by 128 hashed bits, which alone are shuffled."""
    n = df.select(*digest(df.dtypes)).toDF("one", "two").groupBy("one", "two").agg(F.count(F.lit(1)).alias("_n"))
    return n.agg(F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0).cast("long")).alias("duplicate_rows"))


#: How much worse a column or table may get before it counts as drift.
NULL_RATE_STEP, ROW_SHIFT = 0.05, 0.5
ACTIONS = {"NONE": "CONTINUE", "COMPATIBLE": "CONTINUE", "REVIEW_REQUIRED": "QUARANTINE", "BREAKING": "STOP"}
RANK = {"NONE": 0, "COMPATIBLE": 1, "REVIEW_REQUIRED": 2, "BREAKING": 3}


def _issue(when: Column, kind: str, severity: str) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))


def drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Changes between two profiles as rows ``column, kind, severity``; a renamed column is one removed and one added."""
    b, c = baseline.alias("b"), current.alias("c")
    both = b.join(c, F.col("b.column") == F.col("c.column"), "full")
    temporal = F.col("b.dtype").isin("date", "timestamp", "timestamp_ntz")
    later = F.try_to_timestamp(F.col("b.max_value")) > F.try_to_timestamp(F.col("c.max_value"))
    here = F.col("b.column").isNotNull() & F.col("c.column").isNotNull()
    kinds = F.array_compact(F.array(
        _issue(F.col("c.column").isNull(), "column_removed", "BREAKING"),
        _issue(F.col("b.column").isNull(), "column_added", "COMPATIBLE"),
        _issue(here & (F.col("b.dtype") != F.col("c.dtype")), "dtype_changed", "BREAKING"),
        _issue(here & F.col("b.is_key") & ~F.col("c.is_key"), "key_uniqueness_lost", "BREAKING"),
        _issue(here & (F.col("c.null_rate") - F.col("b.null_rate") > NULL_RATE_STEP), "null_rate_increased", "REVIEW_REQUIRED"),
        _issue(here & temporal & later, "date_coverage_regressed", "REVIEW_REQUIRED"),
    ))
    columns = both.select(F.coalesce("b.column", "c.column").alias("column"), F.explode(kinds).alias("i")).select("column", "i.*")
    rows = baseline.agg(F.max("rows").alias("b")).crossJoin(current.agg(F.max("rows").alias("c")))  # one row each
    shift = F.when(F.col("b") > 0, F.abs(F.coalesce("c", F.lit(0)) - F.col("b")) / F.col("b")).otherwise(0.0)  # against nothing there is no share
    return columns.unionByName(rows.where(shift > ROW_SHIFT).select(F.lit(None).cast("string").alias("column"), F.lit("row_count_shift").alias("kind"), F.lit("REVIEW_REQUIRED").alias("severity")))


def drift_metrics(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Changes between metric tables (``semantic_id, version, formula``) as rows ``column, kind, severity``."""
    b, c = baseline.alias("b"), current.alias("c")
    both = b.join(c, F.col("b.semantic_id") == F.col("c.semantic_id"), "full")
    changed = F.col("c.semantic_id").isNotNull() & F.col("b.semantic_id").isNotNull() & ((F.col("b.version") != F.col("c.version")) | (F.col("b.formula") != F.col("c.formula")))
    kinds = F.array_compact(F.array(_issue(F.col("c.semantic_id").isNull(), "metric_removed", "BREAKING"), _issue(changed, "metric_changed", "REVIEW_REQUIRED")))
    return both.select(F.coalesce("b.semantic_id", "c.semantic_id").alias("column"), F.explode(kinds).alias("i")).select("column", "i.*")


def drift_calendar(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """A row if two one-row calendar tables differ in any column."""
    same = [F.col(f"b.{x}").eqNullSafe(F.col(f"c.{x}")) for x in baseline.columns]
    changed = ~same[0]
    for s in same[1:]:
        changed |= ~s
    return baseline.alias("b").crossJoin(current.alias("c")).where(changed).select(F.lit("calendar").alias("column"), F.lit("calendar_policy_changed").alias("kind"), F.lit("REVIEW_REQUIRED").alias("severity"))


def drift_status(changes: DataFrame) -> DataFrame:
    """One row: the worst severity and what to do about it."""
    rank = F.coalesce(F.max(F.element_at(F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (k, v)]), F.col("severity"))), F.lit(0))
    status = changes.agg(F.element_at(F.array(*map(F.lit, RANK)), rank + 1).alias("status"))
    return status.withColumn("action", F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("status")))
