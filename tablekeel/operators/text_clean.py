"""Cleaning of text columns, refused where it would make different values equal."""

from __future__ import annotations

import re
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.core import Refused, Result, distinct_with_null, missing, require, sample
from tablekeel.functions.text import STEPS, extract, normalise


def collapses(df: DataFrame, column: str, steps: list[str]) -> DataFrame:
    """Cleaned values that several different values become: ``cleaned, values`` (how many)."""
    pairs = df.select(normalise(F.col(column), steps).alias("cleaned"), F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return pairs.groupBy("cleaned").agg(F.count(F.lit(1)).alias("values")).where("values > 1")


def pattern_problems(spark: SparkSession, pattern: str) -> list[str]:
    """What Python's or Java's patterns have against this one; it has to mean something in both."""
    try:
        re.compile(pattern)
    except re.error as e:
        return [f"pattern {pattern!r}: {e}"]
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException) as e:
        return [f"pattern {pattern!r}: {str(e).splitlines()[0]}"]
    return []


def text_clean(df: DataFrame, normalize: list[dict[str, Any]] | None = None, regex_extract: list[dict[str, Any]] | None = None, regex_replace: list[dict[str, Any]] | None = None, allow_identity_collapse: bool = False, guard: bool = True) -> Result:
    """Normalise columns by steps in order, extract groups into new columns, replace in place."""
    normalize, regex_extract, regex_replace = normalize or [], regex_extract or [], regex_replace or []
    problems = missing(df, [x["column"] for x in [*normalize, *regex_extract, *regex_replace]])
    problems += [f"unknown step {s!r}" for x in normalize for s in x["steps"] if s not in STEPS]
    problems += [f"column {x['output_column']!r} exists already" for x in regex_extract if x["output_column"] in df.columns]
    problems += [p for x in [*regex_extract, *regex_replace] for p in pattern_problems(df.sparkSession, x["pattern"])]
    require(problems)
    # one chain of steps; what a step met on its way is kept beside it for the evidence
    chain, cleaned = df, list(dict.fromkeys(x["column"] for x in normalize))
    for i, c in enumerate(cleaned):
        chain = chain.withColumn(f"_raw{i}", F.col(c))
    for x in normalize:
        chain = chain.withColumn(x["column"], normalise(F.col(x["column"]), x["steps"]))
    for i, c in enumerate(cleaned):
        chain = chain.withColumn(f"_clean{i}", F.col(c))
    for x in regex_extract:
        chain = chain.withColumn(x["output_column"], extract(F.col(x["column"]), x["pattern"], x.get("group", 1)))
    for i, x in enumerate(regex_replace):
        chain = chain.withColumn(f"_old{i}", F.col(x["column"])).withColumn(x["column"], F.regexp_replace(x["column"], x["pattern"], x["replacement"])).withColumn(f"_new{i}", F.col(x["column"]))
    output = chain.select(*df.columns, *dict.fromkeys(x["output_column"] for x in regex_extract))
    if not guard:
        return Result(output)
    wanted = [F.count(F.lit(1)).alias("rows")]
    for i, _ in enumerate(cleaned):
        wanted += [distinct_with_null(F.col(f"_raw{i}")).alias(f"before{i}"), distinct_with_null(F.col(f"_clean{i}")).alias(f"after{i}")]
    for i, x in enumerate(regex_extract):
        wanted.append(F.count(x["output_column"]).alias(f"match{i}"))
    for i, _ in enumerate(regex_replace):
        wanted.append(F.count_if(F.col(f"_old{i}") != F.col(f"_new{i}")).alias(f"changed{i}"))
    found = chain.agg(*wanted).first()
    evidence: dict[str, Any] = {c: {"distinct_before": found[f"before{i}"], "distinct_after": found[f"after{i}"]} for i, c in enumerate(cleaned)}
    evidence |= {x["output_column"]: {"match_count": found[f"match{i}"]} for i, x in enumerate(regex_extract)}
    evidence |= {f"{x['column']} replaced": {"changed_count": found[f"changed{i}"]} for i, x in enumerate(regex_replace)}
    for i, c in enumerate(cleaned):
        if found[f"after{i}"] < found[f"before{i}"] and not allow_identity_collapse:
            evidence["collapsed"] = sample(collapses(df, c, [step for x in normalize if x["column"] == c for step in x["steps"]]))
            raise Refused("DATA_QUALITY_BLOCK", f"different values of {c!r} become equal", evidence)
    return Result(output, evidence, found["rows"], found["rows"])
