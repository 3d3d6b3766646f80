"""A history of profiles: every run of a table adds its profile and how it was judged, and is compared with the last accepted one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.core import exists, require
from tablekeel.plans.profile import drift, drift_status, profile

#: What becomes of a run, by what its drift asks for.
STATUS = {"CONTINUE": "ACCEPTED", "QUARANTINE": "QUARANTINED", "STOP": "STOPPED"}
JUDGED = "number long, run string, status string, baseline string, changes array<struct<column: string, kind: string, severity: string>>"


def judged(spark: SparkSession, root: str) -> DataFrame:
    """``number, run, status, baseline, changes``: a row a run, in the order of ``number``."""
    if not exists(spark, f"{root}/runs"):
        return spark.createDataFrame([], JUDGED)
    return spark.read.schema(JUDGED).parquet(f"{root}/runs")


def profiles(spark: SparkSession, root: str) -> DataFrame:
    """The profiles of all runs: a row a run and column."""
    return spark.read.parquet(f"{root}/profiles")


def baseline_run(runs: DataFrame) -> str | None:
    """The last accepted run."""
    return runs.where("status = 'ACCEPTED'").agg(F.max_by("run", "number")).first()[0]


def baseline(spark: SparkSession, root: str) -> DataFrame | None:
    """The profile of the last accepted run, None if there is none."""
    run = baseline_run(judged(spark, root))
    return None if run is None else profiles(spark, root).where(F.col("run") == run)


def judge_run(df: DataFrame, root: str, run: str, ignore: tuple[str, ...] = (), exact: bool = False) -> str:
    """Profile ``df`` in one scan, compare it with the last accepted run, and add both to the history; returns the status.

    The first run is accepted. Nothing is ever overwritten: a run that is judged again is refused.
    The profile is written before the verdict, so that a run which broke off in between can be
    repeated: only runs with a verdict count, and of their profiles the last one written.
    """
    spark = df.sparkSession
    runs = judged(spark, root)
    known = runs.agg(F.coalesce(F.max("number"), F.lit(0)).alias("n"), F.count_if(F.col("run") == run).alias("again")).first()
    require([f"run {run!r} was judged already"] if known["again"] else [])
    before = baseline_run(runs)
    rows = profile(df, exact).collect()  # a row a column
    now = spark.createDataFrame(rows, profile_schema(df, exact)) if rows else profile(df, exact)
    now.withColumn("run", F.lit(run)).coalesce(1).write.mode("append").parquet(f"{root}/profiles")
    changes, action = [], "CONTINUE"
    if before is not None:
        found = drift(profiles(spark, root).where(F.col("run") == before).dropDuplicates(["column"]), now).where(~F.col("kind").isin(*ignore) if ignore else F.lit(True))
        changes = [tuple(r) for r in found.select("column", "kind", "severity").collect()]  # a few rows a column
        action = drift_status(spark.createDataFrame(changes, "column string, kind string, severity string")).first()["action"]
    spark.createDataFrame([(known["n"] + 1, run, STATUS[action], before, changes)], JUDGED).coalesce(1).write.mode("append").parquet(f"{root}/runs")
    return STATUS[action]


def profile_schema(df: DataFrame, exact: bool):  # noqa: ANN201
    return profile(df.limit(0), exact).schema
