"""Scans, manifests, snapshots, exports and what verifies them."""

from __future__ import annotations

import hashlib
import re
import uuid
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from tablekeel.core import SAMPLE, Refused, exists, hashable, missing, move, put, quoted, remove, require
from tablekeel.functions.guards import defuse

CORRUPT = "_corrupt"
PROMOTED = {"bigint": r"^[+-]?[0-9]+$", "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", "boolean": "^(true|false)$"}


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names in the first line of a CSV, read as Spark's own reader does; an empty file has none. Names that repeat are refused, whatever their case."""
    first = spark.read.option("header", False).option("inferSchema", False).csv(path).first()
    names = [c.removeprefix("\ufeff").lower() for c in first or () if c is not None]
    require([f"column {c!r} occurs twice in the header" for c in dict.fromkeys(names) if names.count(c) > 1])
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return [c.removeprefix("\ufeff") for c in rows.columns]


def raw_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """Text columns, and ``CORRUPT`` with the line of each malformed row. A byte-order mark and blank lines pass."""
    schema = StructType([StructField(c, StringType()) for c in [*columns, CORRUPT]])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multi_line).option("columnPruning", False).csv(path)  # with columns pruned, the parser would not count fields


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, mode: str = "strict", multi_line: bool = False, quarantine: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text columns of a CSV, its report (one row) and its malformed rows. Without ``columns`` the header of the file holds.

    A row with more or fewer fields than the header is malformed: ``strict`` refuses the file,
    ``permissive`` leaves such rows out and reports them. With ``quarantine`` the file is scanned
    once: good and malformed rows are written to two partitions of a table there, counted on the
    way, and what is returned reads that table. An empty file gives a table without columns.
    """
    columns = columns if columns is not None else csv_header(spark, path)
    if not columns:
        empty = spark.createDataFrame([], StructType())
        return empty, spark.createDataFrame([(0, 0, 0, False)], REPORT), spark.createDataFrame([], f"{CORRUPT} string")
    raw = raw_csv(spark, path, columns, multi_line)
    bad = F.col(CORRUPT).isNotNull()
    read = F.length(F.coalesce(quoted(columns[0]), F.lit(""))) >= 0  # always so; a scan of the corrupt column alone is not allowed
    if quarantine:
        good, report, rejected = _set_apart(raw, columns, quarantine)
    else:
        good, rejected = raw.where(~bad & read).drop(CORRUPT), raw.where(bad & read).select(CORRUPT, *map(quoted, columns))
        report = parse_report(raw, columns)
    if mode == "strict" and (lost := rejected.limit(SAMPLE).collect()):
        open_ = not multi_line and any((r[0] or "").count('"') % 2 for r in lost)
        hint = "; some have an open quote, multi_line=True reads line breaks inside quotes" if open_ else ""
        raise Refused("DATA_QUALITY_BLOCK", f"the file has malformed rows{hint}", {"sample": [r[0] for r in lost]})
    return good, report, rejected


REPORT = "rows_seen long, rows_parsed long, rows_rejected long, is_partial boolean"
KIND = "_kind"


def _set_apart(raw: DataFrame, columns: list[str], path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the rows of a CSV once, malformed ones to the partition ``rejected``, others to ``parsed``; return both and the report."""
    spark, seen = raw.sparkSession, Observation(f"csv-{uuid.uuid4().hex}")
    bad = F.col(CORRUPT).isNotNull()
    counted = raw.observe(seen, F.count(F.lit(1)).alias("seen"), F.count_if(bad).alias("rejected"))
    with_kind = counted.withColumn(KIND, F.when(bad, "rejected").otherwise("parsed"))
    put(spark, path, lambda pending: with_kind.write.partitionBy(KIND).parquet(pending))
    stored = spark.read.schema(with_kind.schema).parquet(path)
    n, rejected = seen.get["seen"], seen.get["rejected"]
    report = spark.createDataFrame([(n, n - rejected, rejected, rejected > 0)], REPORT)
    return stored.where(F.col(KIND) == "parsed").select(*map(quoted, columns)), report, stored.where(F.col(KIND) == "rejected").select(CORRUPT, *map(quoted, columns))


def parse_report(raw: DataFrame, columns: list[str]) -> DataFrame:
    seen = F.count(quoted(columns[0])) + F.count_if(quoted(columns[0]).isNull())
    n = raw.agg(seen.alias("rows_seen"), F.count_if(F.col(CORRUPT).isNotNull()).alias("rows_rejected"))
    return n.select("rows_seen", (F.col("rows_seen") - F.col("rows_rejected")).alias("rows_parsed"), "rows_rejected", (F.col("rows_rejected") > 0).alias("is_partial"))


def promote(df: DataFrame) -> DataFrame:
    """Text columns become bigint, double or boolean where all their values have that format; dates stay text."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    tests = [[F.count_if(quoted(c).isNotNull() & ~(quoted(c).rlike(p) & quoted(c).try_cast(t).isNotNull())) for t, p in PROMOTED.items()] for c in texts]
    found = iter(df.agg(*[x for c, fails in zip(texts, tests, strict=True) for x in (F.count(quoted(c)), *fails)]).first())
    to = {}
    for c in texts:
        filled, fails = next(found), {t: next(found) for t in PROMOTED}
        to[c] = next((t for t in PROMOTED if filled and not fails[t]), None)
    return df.select(*[quoted(c).try_cast(to[c]).alias(c) if to.get(c) else quoted(c) for c in df.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Bytes of a file that one row can hold, that are read at a time, and that a task digests before the next file goes to another.
LARGEST_ROW, BLOCK, TASK = 2**31 - 1, 4 * 2**20, 128 * 2**20
DIGESTS = "file_digests"


def digest_source() -> type[DataSource]:
    """A data source of files: ``name, sha256, size``. Tasks stream their files block by block, so a file may have any size.

    It reads what pyarrow can open (local and mounted folders, and the object stores it knows).
    Files whose name starts with ``_`` or ``.`` are no data, as everywhere in Spark.
    """

    class Files(InputPartition):
        def __init__(self, paths: list[str]) -> None:
            self.paths = paths

    class Digests(DataSourceReader):
        def __init__(self, path: str) -> None:
            self.path = path

        def partitions(self) -> list[Files]:
            from pyarrow import fs

            system, root = fs.FileSystem.from_uri(self.path)
            top = system.get_file_info(root)
            found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
            shown = [f for f in found if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(root) :].strip("/").split("/") if p)]
            tasks, held = [], 0
            for f in shown:
                if not tasks or held + f.size > TASK:  # a large file is alone
                    tasks.append([])
                    held = 0
                tasks[-1].append(f.path)
                held += f.size
            return [Files(t) for t in tasks]

        def read(self, partition: Files):  # noqa: ANN202
            import hashlib

            from pyarrow import fs

            system, _ = fs.FileSystem.from_uri(self.path)
            for path in partition.paths if partition else []:
                digest, size = hashlib.sha256(), 0
                with system.open_input_stream(path) as file:
                    while block := file.read(BLOCK):
                        digest.update(block)
                        size += len(block)
                yield path.rsplit("/", 1)[-1], digest.hexdigest(), size

    class FileDigests(DataSource):
        @classmethod
        def name(cls) -> str:
            return DIGESTS

        def schema(self) -> str:
            return "name string, sha256 string, size long"

        def reader(self, schema: StructType) -> Digests:
            return Digests(self.options["path"])

    return FileDigests


def _opens(path: str) -> bool:
    from pyarrow import ArrowException, fs

    try:
        fs.FileSystem.from_uri(path)
    except (ArrowException, ValueError, OSError):
        return False
    return not set(path) & set("*?[{")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: ``name, sha256, size``; equal bytes have equal ids, as ``sha256sum`` gives them.

    Files are streamed, see ``digest_source``. In a store that only Spark can read, a file has to
    fit into a row; one of 2 GB or more is refused there.
    """
    if _opens(path):
        spark.dataSource.register(digest_source())
        return spark.read.format(DIGESTS).option("path", path).load()
    files = spark.read.format("binaryFile").load(path)
    if large := [r[0] for r in files.where(F.col("length") > LARGEST_ROW).select("path").limit(SAMPLE).collect()]:  # contents are not read for this
        raise Refused("VALIDATION_FAIL", "files are too large for a digest in this store", {"files": large})
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def _content(df: DataFrame) -> list[Column]:
    cells = [x for c, t in df.dtypes for x in (quoted(c).isNull(), hashable(c, t))]
    one, two = F.xxhash64(*cells), F.xxhash64(F.lit("second"), *cells)
    sums = [F.count(F.lit(1)), *[F.sum(h.cast("decimal(38,0)")) for h in (one, two)], F.bit_xor(F.xxhash64(one, two))]
    return [s.cast("string").alias(f"s{i}") for i, s in enumerate(sums)]


def _content_id(df: DataFrame, sums: dict[str, str | None]) -> str:
    return hashlib.sha256(",".join([str(df.dtypes), *(s for s in sums.values() if s is not None)]).encode()).hexdigest()


def content_id(df: DataFrame) -> DataFrame:
    """One row: a digest of names, types and rows that does not depend on the rows' order. Nulls count by their place."""
    sums = df.agg(*_content(df))
    return sums.select(F.sha2(F.concat_ws(",", F.lit(str(df.dtypes)), *sums.columns), 256).alias("snapshot_id"))


def snapshot(df: DataFrame, root: str, snapshot_id: str | None = None) -> str:
    """Store a table once under its content's id; storing it again changes nothing. What is stored is read again and compared.

    The id is found while the table is written beside its place, so the table is read once; a
    write that breaks off leaves nothing in that place.
    """
    require([] if snapshot_id is None or re.fullmatch("[0-9a-f]{8,64}", snapshot_id) else ["a snapshot id is a hexadecimal digest"])
    spark, seen = df.sparkSession, Observation(f"snapshot-{uuid.uuid4().hex}")
    pending = f"{root}/_pending-{uuid.uuid4().hex}"
    try:
        df.observe(seen, *_content(df)).write.parquet(pending)
        own = _content_id(df, seen.get)
        path = f"{root}/snapshot_id={snapshot_id or own}"
        if not exists(spark, path):
            move(spark, pending, path)
        stored = spark.read.parquet(path)
        if stored.columns != df.columns or content_id(stored).first()[0] != own:
            raise Refused("INTEGRITY_FAIL", f"another table is stored under {snapshot_id or own}")
    finally:
        remove(spark, pending)
    return path


def page(df: DataFrame, order_by: list[str], limit: int, offset: int = 0) -> DataFrame:
    require(missing(df, order_by))
    return df.orderBy(*order_by).offset(offset).limit(limit)


FORMATS = ("csv", "parquet", "json")


def export(df: DataFrame, fmt: str, destination: str, safe_for_spreadsheets: bool = True, schemes: tuple[str, ...] = ("file",)) -> dict[str, Any]:
    """Write a table and return its manifest: checksum of all part files, row count, types.

    Only local targets are allowed; on a cluster ``schemes`` names the shared stores that may be
    written to as well. Whatever can be refused is refused before anything is written. Parts and
    their digests (the table ``_parts``) are written beside the destination and put in its place
    when they are whole; what was there before is replaced then.
    """
    if fmt not in FORMATS:
        raise Refused("POLICY_DENIED", f"format {fmt!r} is not allowed")
    if ".." in destination.split("/"):
        raise Refused("POLICY_DENIED", "the destination climbs out of its folder")
    scheme = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):", destination)
    if scheme and scheme[1].lower() not in schemes:
        raise Refused("POLICY_DENIED", f"scheme {scheme[1]!r} is not allowed")
    require([f"column {c!r} occurs twice" for c in dict.fromkeys(df.columns) if df.columns.count(c) > 1])
    spark, seen = df.sparkSession, Observation(f"export-{uuid.uuid4().hex}")
    out = (defuse(df) if fmt == "csv" and safe_for_spreadsheets else df).observe(seen, F.count(F.lit(1)).alias("rows"))

    def write(pending: str) -> None:
        writer = out.write
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(pending)
        manifest(spark, pending).write.parquet(f"{pending}/_parts")

    put(spark, destination, write, replace=True)
    parts = f"{destination}/_parts"
    return {"checksum": checksum(spark.read.parquet(parts)).first()[0], "row_count": seen.get["rows"], "column_types": dict(df.dtypes), "format": fmt, "path": destination, "parts": parts}


def checksum(parts: DataFrame) -> DataFrame:
    return parts.agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("sha256"))), 256).alias("checksum"))  # a digest a file


def verify(spark: SparkSession, made: dict[str, Any]) -> DataFrame:
    """Read an export again and compare: rows ``part, status`` for parts and the row count; all OK if nothing changed.

    Rows are counted in the files as they are now; where one can't be read any more, the row count
    is UNREADABLE.
    """
    stored = spark.read.parquet(made["parts"]).select("name", F.col("sha256").alias("stored"))
    now = manifest(spark, made["path"])
    both = stored.join(now.select("name", "sha256"), "name", "full")
    status = F.when(F.col("stored").isNull(), "ADDED").when(F.col("sha256").isNull(), "MISSING").when(F.col("stored") != F.col("sha256"), "CHANGED").otherwise("OK")
    reader = spark.read.option("header", True) if made["format"] == "csv" else spark.read
    try:
        n = reader.format(made["format"]).load(made["path"]).count()
        counted = "OK" if n == made["row_count"] else "CHANGED"
    except PySparkException:
        counted = "UNREADABLE"
    return both.select(F.col("name").alias("part"), status.alias("status")).unionByName(spark.createDataFrame([("row_count", counted)], "part string, status string"))


def save_stage(df: DataFrame, root: str, run: str, step: str) -> dict[str, Any]:
    """Materialise a pipeline step under (run, step); returns its manifest row."""
    made = export(df, "parquet", f"{root}/run={run}/step={step}")
    return made | {"run": run, "step": step}


def load_stage(spark: SparkSession, root: str, run: str, step: str) -> DataFrame:
    return spark.read.parquet(f"{root}/run={run}/step={step}")
