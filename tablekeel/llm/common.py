"""What several corpus operators share: the shared folder, settled tables and ranks within a key."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablekeel.core import scratch

#: Rows that Python gets at once, unless the session says otherwise: ten thousand long texts would not fit.
BATCH_ROWS = 1000
#: Parts that one hot key's rows are split into when they are numbered: so many at least, and no larger than this.
SALTS, SALTED_ROWS = 64, 100_000


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)  # the shared folder may be on any file system that Spark knows
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def prepare_python(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package (on a cluster it is installed or sent with --py-files), and bound their batches."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":  # Spark's own default
        spark.conf.set(rows, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_python(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the cheaper built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def salts_for(most: int) -> int:
    """Salts for ``rank_within`` where the largest part has ``most`` rows."""
    return max(SALTS, -(-most // SALTED_ROWS))


def rank_within(df: DataFrame, part: str, order: list[str], ties: list[str], out: str = "rank", salts: int = SALTS) -> DataFrame:
    """Number the rows of each ``part`` from 0, ordered by ``order``, without bringing a part into one task.

    Rows are dealt by (part, order, salt of the tie columns); only the counts of these cells are
    summed up along a part. A value of ``order`` that holds a third of all rows is spread over
    ``salts`` tasks, and ``part`` itself may be hot as long as its cells are few or its ``order``
    values are many small ones.
    """
    cell = [part, *order, "_salt"]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*ties), F.lit(salts)).cast("int"))
    before = Window.partitionBy(part).orderBy(*order, "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*cell).orderBy(*ties)
    return salted.join(starts, cell).withColumn(out, F.col("_start") + F.row_number().over(within) - 1).drop("_salt", "_start")
