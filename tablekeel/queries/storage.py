"""Queries that write to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablekeel.core import move, remove, scratch
from tablekeel.operators.groups import aggregate
from tablekeel.operators.rows import cast, select_filter
from tablekeel.plans.checks import null_rate, run_checks, value_range
from tablekeel.plans.profile import profile
from tablekeel.queries.registry import Registry, one_row, refusal
from tablekeel.sources import tables

REGISTRY = query = Registry()
COLUMNS = ["c_custkey", "c_name", "c_mktsegment"]


def _ragged(t) -> str:
    """Customers as a CSV with a header; every tenth has a field too many, every eleventh one too few."""
    path, c = scratch(t.spark, "csv"), F.col("c_custkey")
    line = F.when(c % 10 == 0, F.concat_ws(",", *COLUMNS, F.lit("more"))).when(c % 11 == 0, F.concat_ws(",", *COLUMNS[:2])).otherwise(F.concat_ws(",", *COLUMNS))
    t.customer.select(line.alias(",".join(COLUMNS))).write.option("header", True).option("sep", "|").csv(path)  # one column to the writer, three to a reader
    return path


WHOLE = "c_custkey % 10 <> 0 AND c_custkey % 11 <> 0"


@query("src_01_csv_permissive", f"SELECT cast(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer WHERE {WHOLE}")
def _(t):
    return tables.read_csv(t.spark, _ragged(t), mode="permissive")[0]


@query("src_01_refusal", f"SELECT 'DATA_QUALITY_BLOCK' AS code FROM customer HAVING count(*) FILTER (NOT ({WHOLE})) > 0")
def _(t):
    return one_row(t, "code string", refusal(tables.read_csv, t.spark, _ragged(t)).code)


@query("src_01_csv_strict", "SELECT cast(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def _(t):
    path = scratch(t.spark, "csv")
    t.customer.select(*COLUMNS).write.option("header", True).csv(path)
    return tables.read_csv(t.spark, path)[0]


@query("src_02_parse_report", f"SELECT count(*) AS rows_seen, count(*) FILTER ({WHOLE}) AS rows_parsed, count(*) FILTER (NOT ({WHOLE})) AS rows_rejected, bool_or(NOT ({WHOLE})) AS is_partial FROM customer")
def _(t):
    return tables.read_csv(t.spark, _ragged(t), mode="permissive")[1]


@query("src_02_quarantine", f"SELECT 'parsed' AS kind, count(*) AS rows, NULL::VARCHAR AS line FROM customer WHERE {WHOLE} UNION ALL SELECT 'rejected', 1, CASE WHEN c_custkey % 10 = 0 THEN concat_ws(',', c_custkey, c_name, c_mktsegment, 'more') ELSE concat_ws(',', c_custkey, c_name) END FROM customer WHERE NOT ({WHOLE}) UNION ALL SELECT 'report', count(*), count(*) FILTER (NOT ({WHOLE})) || ' of ' || count(*) FROM customer")
def _(t):
    """One scan sets malformed lines apart as a table; later steps read it as data."""
    good, report, rejected = tables.read_csv(t.spark, _ragged(t), mode="permissive", quarantine=scratch(t.spark, "quarantine"))
    parsed = good.agg(F.lit("parsed").alias("kind"), F.count(F.lit(1)).alias("rows"), F.lit(None).cast("string").alias("line"))
    lines = rejected.select(F.lit("rejected").alias("kind"), F.lit(1).cast("long").alias("rows"), F.col(tables.CORRUPT).alias("line"))
    told = report.select(F.lit("report").alias("kind"), F.col("rows_seen").alias("rows"), F.concat_ws(" of ", "rows_rejected", "rows_seen").alias("line"))
    return parsed.unionByName(lines).unionByName(told)


def _netted(t) -> str:
    """Orders as a CSV whose header has a dot in a name."""
    path = scratch(t.spark, "csv")
    t.orders.select(F.col("o_orderkey").alias("order key"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice").cast("decimal(12,2)")).alias("net.amount")).write.option("header", True).csv(path)
    return path


@query("src_01_dotted_names", "SELECT o_orderstatus AS status, count(*) AS orders, round(sum(n), 2)::DOUBLE AS total, max(c) AS nulls, max(d) AS distinct_values FROM (SELECT o_orderstatus, n, count(*) FILTER (n IS NULL) OVER () AS c, (SELECT count(DISTINCT o_totalprice::DECIMAL(12, 2)) + 1 FROM orders WHERE o_orderkey % 7 > 0) AS d FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice::DECIMAL(12, 2) END AS n FROM orders)) GROUP BY ALL")
def _(t):
    """A column named ``net.amount`` goes through scan, promotion, cast, filter, checks, profile and aggregate."""
    made = tables.promote(tables.read_csv(t.spark, _netted(t))[0])
    made = cast(made, [{"column": "net.amount", "target_type": "Float64"}]).output
    made = select_filter(made, ["status", "net.amount"], [{"column": "order key", "op": ">", "value": -1}]).output
    failed = run_checks(made, [null_rate("net.amount", 1.0), value_range("net.amount", 0, 1e12)]).where("NOT passed").count()
    p = next(r for r in profile(made).collect() if r["column"] == "net.amount")
    out = aggregate(made, ["status"], [{"name": "orders", "fn": "count", "column": "status"}, {"name": "total", "fn": "sum", "column": "net.amount"}], relative=1e-12).output
    return out.select("status", "orders", F.round("total", 2).alias("total"), F.lit(p["nulls"] + failed).alias("nulls"), F.lit(p["distinct_values"]).alias("distinct_values"))


@query("src_01_repeated_header", "SELECT 'VALIDATION_FAIL' AS code FROM region HAVING count(*) > 0")
def _(t):
    path = scratch(t.spark, "csv")
    t.region.select(F.concat_ws(",", "r_regionkey", "r_name").alias("name,Name")).write.option("header", True).option("sep", "|").csv(path)
    return one_row(t, "code string", refusal(tables.read_csv, t.spark, path).code)


@query("src_03_parquet_scan", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    return tables.read_parquet(t.spark, f"{t.dir}/orders.parquet").select("o_orderkey", "o_orderstatus")


@query("src_04_promotion", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_suppkey % 2 = 0 AS even, '2024-01-05' AS day FROM supplier")
def _(t):
    texts = t.supplier.select(F.col("s_suppkey").cast("string").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("string").alias("s_nationkey"), (F.col("s_suppkey") % 2 == 0).cast("string").alias("even"), F.lit("2024-01-05").alias("day"))
    return tables.promote(texts)


@query("src_05_file_manifest", "SELECT 'orders.parquet' AS name, true AS has_digest, true AS has_size")
def _(t):
    found = tables.manifest(t.spark, f"{t.dir}/orders.parquet")
    return found.agg(F.lit("orders.parquet").alias("name"), F.bool_and(F.length("sha256") == 64).alias("has_digest"), F.bool_and(F.col("size") > 0).alias("has_size"))


@query("src_05_digests", "SELECT 2 * count(DISTINCT o_orderkey % 3) AS files, count(DISTINCT o_orderkey % 3) AS digests, true AS equal_bytes, true AS same_as_whole_files FROM orders")
def _(t):
    """Three tables stored twice: digests are those of the whole files' bytes, and equal bytes have equal ones."""
    root = scratch(t.spark, "files")
    for copy in range(2):
        for part in range(3):
            t.orders.where(F.col("o_orderkey") % 3 == part).orderBy("o_orderkey").coalesce(1).write.option("header", True).csv(f"{root}/copy={copy}/part={part}")
    found = tables.manifest(t.spark, root)
    whole = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("whole"))
    both = found.join(whole, "name", "full").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("sha256").eqNullSafe(F.col("whole"))).alias("same"))
    return both.agg(F.sum("n").cast("int").alias("files"), F.count(F.lit(1)).cast("int").alias("digests"), F.bool_and(F.col("n") == 2).alias("equal_bytes"), F.bool_and("same").alias("same_as_whole_files"))


@query("src_06_snapshot", "SELECT * FROM orders")
def _(t):
    root = scratch(t.spark, "snapshots")
    paths = {tables.snapshot(df, root) for df in (t.orders, t.orders.orderBy(F.desc("o_orderkey")))}  # the second does nothing
    return tables.read_parquet(t.spark, paths.pop())


@query("src_06_integrity", "SELECT 'INTEGRITY_FAIL' AS code, count(*) > 0 AS has_rows FROM orders")
def _(t):
    """Another table under the same id is refused, and so is the same one with its columns renamed."""
    root, stored = scratch(t.spark, "snapshots"), t.orders
    name = tables.content_id(stored).first()[0]
    tables.snapshot(stored, root, name)
    found = {refusal(tables.snapshot, df, root, name).code for df in (stored.where("o_orderkey > 1"), stored.withColumnRenamed("o_custkey", "custkey"))}
    return t.orders.agg(F.lit("+".join(found)).alias("code"), (F.count(F.lit(1)) > 0).alias("has_rows"))


@query("src_07_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey NULLS FIRST LIMIT 50 OFFSET 100")
def _(t):
    return tables.page(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 50, 100)


for _fmt in tables.FORMATS:

    @query(f"snk_01_export_{_fmt}", "SELECT cast(n_nationkey AS VARCHAR) AS n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '{}=' ELSE '' END || n_name AS n_name FROM nation".format("''" if _fmt == "csv" else ""))
    def _(t, fmt=_fmt):
        rows = t.nation.select("n_nationkey", F.expr("CASE WHEN n_nationkey % 2 = 0 THEN '=' ELSE '' END || n_name").alias("n_name"))
        made = tables.export(rows, fmt, scratch(t.spark, "export"))
        return t.spark.read.option("header", True).format(fmt).load(made["path"]).select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name")


@query("snk_02_export_manifest", "SELECT count(*) AS row_count, 64 AS digits, 'o_custkey,o_orderdate,o_orderkey,o_orderpriority,o_orderstatus,o_totalprice' AS columns FROM orders")
def _(t):
    made = tables.export(t.orders, "parquet", scratch(t.spark, "export"))
    one = t.spark.range(1)
    return one.select(F.lit(made["row_count"]).cast("long").alias("row_count"), F.lit(len(made["checksum"])).alias("digits"), F.lit(",".join(sorted(made["column_types"]))).alias("columns"))


@query("snk_03_verification", "SELECT 'OK' AS status")
def _(t):
    return tables.verify(t.spark, tables.export(t.orders, "parquet", scratch(t.spark, "export"))).select("status").distinct()


@query("snk_03_tampering", "SELECT 'ADDED' AS status UNION ALL SELECT 'CHANGED' FROM orders HAVING count(*) > 0")
def _(t):
    """An export that somebody appends to: its row count changed, and a part is new."""
    made = tables.export(t.orders, "parquet", scratch(t.spark, "export"))
    t.orders.where("o_orderkey = 1").coalesce(1).write.mode("append").parquet(made["path"])
    return tables.verify(t.spark, made).where("status <> 'OK'").select("status").distinct()


@query("snk_03_missing_and_changed", "SELECT 'part' AS part, 'MISSING' AS status, 1 AS n FROM orders HAVING count(*) > 0 UNION ALL SELECT 'part', 'CHANGED', 1 UNION ALL SELECT 'part', 'OK', 2 UNION ALL SELECT 'row_count', 'CHANGED', 1")
def _(t):
    """Of four parts of an export one is deleted and one is written anew with other rows."""
    made = tables.export(t.orders.repartition(4, "o_orderkey"), "parquet", scratch(t.spark, "export"))
    first, second = sorted(r[0] for r in t.spark.read.parquet(made["parts"]).select("name").collect())[:2]  # four names
    remove(t.spark, f"{made['path']}/{first}")
    other = scratch(t.spark, "other")
    t.orders.where("o_orderkey < 100").coalesce(1).write.parquet(other)
    remove(t.spark, f"{made['path']}/{second}")
    move(t.spark, next(p for p in t.spark.read.parquet(other).inputFiles()), f"{made['path']}/{second}")
    found = tables.verify(t.spark, made)
    return found.groupBy(F.when(F.col("part") == "row_count", "row_count").otherwise("part").alias("part"), "status").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("snk_04_stage_materialisation", "SELECT o_custkey, count(*) AS orders FROM orders GROUP BY o_custkey")
def _(t):
    root = scratch(t.spark, "stages")
    tables.save_stage(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders")), root, "r1", "per_customer")
    return tables.load_stage(t.spark, root, "r1", "per_customer")
