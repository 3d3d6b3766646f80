"""What all operators share: results with evidence, typed refusals, type names and samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that evidence shows of what was refused or lost.
SAMPLE = 20
#: Codes a refusal can carry.
CODES = ("VALIDATION_FAIL", "DATA_QUALITY_BLOCK", "RECONCILIATION_FAIL", "POLICY_DENIED", "NO_SAFE_OPERATION", "INTEGRITY_FAIL", "DRIFT_BLOCK")
#: Names of types that callers may use for Spark's own.
TYPES = {"Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "Float32": "float", "Float64": "double", "Utf8": "string", "String": "string", "Boolean": "boolean", "Date": "date", "Datetime": "timestamp_ntz"}


class Refused(Exception):
    """An operator declined to lose, null, collapse or multiply rows silently."""

    def __init__(self, code: str, reason: str, evidence: dict[str, Any] | None = None) -> None:
        if code not in CODES:
            raise ValueError(f"unknown code {code}")
        super().__init__(f"{code}: {reason}")
        self.code, self.reason, self.evidence = code, reason, evidence or {}


@dataclass
class Result:
    """Output of an operator, with what it found out on the way; counts are None where guards were off."""

    output: DataFrame
    evidence: dict[str, Any] = field(default_factory=dict)
    rows_in: int | None = None
    rows_out: int | None = None

    @property
    def rows_rejected(self) -> int | None:
        return None if self.rows_in is None or self.rows_out is None else max(0, self.rows_in - self.rows_out)

    @property
    def is_lossy(self) -> bool:
        return bool(self.rows_rejected)


def spark_type(name: str) -> str:
    return TYPES.get(name, name)


def types_of(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def require(problems: list[str]) -> None:
    """Refuse with all problems at once, before any job starts."""
    if problems:
        raise Refused("VALIDATION_FAIL", "; ".join(problems), {"problems": problems})


def missing(df: DataFrame, columns: list[str]) -> list[str]:
    return [f"column {c!r} does not exist" for c in dict.fromkeys(columns) if c not in df.columns]


def sample(df: DataFrame, n: int = SAMPLE) -> list[dict[str, Any]]:
    return [r.asDict() for r in df.limit(n).collect()]


def name(c: str) -> str:
    """A column's name as Spark takes it, dots and all."""
    return "`" + c.replace("`", "``") + "`"


def quoted(c: str) -> Column:
    """The column of exactly this name."""
    return F.col(name(c))


def hashable(c: str, t: str) -> Column:
    return F.to_json(F.struct(quoted(c))) if "map<" in t else quoted(c)


def digest(columns: list[tuple[str, str]]) -> list[Column]:
    """128 hashed bits of several columns, in two halves; nulls count by their place."""
    cells = [x for c, t in columns for x in (quoted(c).isNull(), hashable(c, t))]
    return [F.xxhash64(*cells), F.xxhash64(F.lit("second"), *cells)]


def null_count(c: str):  # noqa: ANN201
    return F.count_if(quoted(c).isNull())


def distinct_with_null(c):  # noqa: ANN001, ANN201
    """Distinct values where null counts as one of them."""
    return F.count_distinct(c) + F.coalesce(F.max(F.isnull(c).cast("int")), F.lit(0))


def exact_sum(c):  # noqa: ANN001, ANN201
    """A sum that does not depend on the order of the rows; of nothing it is 0, and beyond 32 digits it is null. Not-a-number counts as null."""
    value = (quoted(c) if isinstance(c, str) else c).try_cast("decimal(38,6)")
    return F.when(F.count(value) == 0, F.lit(0).cast("decimal(38,6)")).otherwise(F.try_sum(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in local mode a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tablekeel-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder and read back, so that what follows doesn't compute it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark._jvm.org.apache.hadoop.fs.Path(path)  # any file system that Spark knows
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _file(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    files, where = _file(spark, path)
    files.delete(where, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    files, where = _file(spark, new)
    files.mkdirs(where.getParent())
    if not files.rename(_file(spark, old)[1], where):
        raise Refused("INTEGRITY_FAIL", f"{new!r} could not be put in its place")


def put(spark: SparkSession, path: str, write: Callable[[str], Any], replace: bool = False) -> Any:
    """Let ``write`` fill a folder beside ``path``, and move it there when it is whole; nothing appears there before, or if it fails.

    A path that exists is refused, unless it is to be replaced.
    """
    require([f"{path!r} exists already"] if not replace and exists(spark, path) else [])
    pending = f"{path.rstrip('/')}.pending-{uuid.uuid4().hex}"
    try:
        got = write(pending)
        if replace:
            remove(spark, path)
        move(spark, pending, path)
    finally:
        remove(spark, pending)
    return got


def one_pass(spark: SparkSession, sink: str, plan: DataFrame, check: Callable[[], Result]) -> Result:
    """Write ``plan``, whose observations ``check`` turns into evidence, to ``sink``; what is refused never appears there."""

    def write(pending: str) -> Result:
        plan.write.parquet(pending)
        return check()

    got = put(spark, sink, write)
    got.output = spark.read.schema(got.output.schema).parquet(sink)
    return got
