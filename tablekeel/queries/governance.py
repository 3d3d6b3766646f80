"""Queries of mapping, fitness, cleaning, metrics, readiness, analysis and pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeel.core import scratch
from tablekeel.operators.rows import cast, select_filter
from tablekeel.plans import checks, govern, history, pipeline, profile
from tablekeel.queries.registry import Registry, one_row, refusal
from tablekeel.streaming.guarded import judge_batch, progress_evidence, run_guarded

REGISTRY = query = Registry()


def _catalog(t) -> tuple[DataFrame, DataFrame]:
    """Profiles and dataset profiles of orders and customers, with nulls, text variants and repeated rows."""
    orders = t.orders.select("o_orderkey", F.expr("nullif(o_custkey, 8)").alias("custkey"), "o_totalprice", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END").alias("o_orderpriority"), "o_orderdate")
    customers = t.customer.select(F.col("c_custkey").cast("string").alias("custkey"), "c_mktsegment", F.col("c_name").alias("balance_text"))
    segments = t.customer.select("c_mktsegment", "c_nationkey")
    tables = {"orders": orders, "customer": customers, "segments": segments}
    p = [profile.profile(df).withColumn("dataset", F.lit(n)) for n, df in tables.items()]
    d = [profile.dataset_profile(df).withColumn("dataset", F.lit(n)) for n, df in tables.items()]
    return p[0].unionByName(p[1]).unionByName(p[2]), d[0].unionByName(d[1]).unionByName(d[2])


CONCEPTS = ("orders.o_totalprice", "o_orderdate", "custkey", "revenue_total", "priority", "balance_text", "customer.custkey", "orders.custkey", "price level", "orders.gone", "nowhere.custkey")


def _mapping(t, profiles: DataFrame) -> DataFrame:
    spark = t.spark
    concepts = spark.createDataFrame([(c,) for c in CONCEPTS], "concept string")
    dimensions = spark.createDataFrame([("d1", "Priority", ["priority", "urgency"], "orders.o_orderpriority"), ("d2", "Price level", ["level"], "orders.o_totalprice")], "semantic_id string, name string, aliases array<string>, source_field string")
    return govern.map_concepts(concepts, profiles, dimensions)


def _catalog_sql() -> str:
    made = {
        "orders": ("orders", {"o_orderkey": "o_orderkey", "custkey": "nullif(o_custkey, 8)", "o_totalprice": "o_totalprice", "o_orderpriority": "o_orderpriority", "o_orderdate": "o_orderdate"}),
        "customer": ("customer", {"custkey": "cast(c_custkey AS VARCHAR)", "c_mktsegment": "c_mktsegment", "balance_text": "c_name"}),
        "segments": ("customer", {"c_mktsegment": "c_mktsegment", "c_nationkey": "c_nationkey"}),
    }
    return " UNION ALL ".join(f"SELECT '{d}' AS dataset, '{c}' AS col, typeof(any_value({e})) AS dtype, count(*) FILTER ({e} IS NULL) AS nulls FROM {t}" for d, (t, cs) in made.items() for c, e in cs.items())


MAPPED = f"""cat AS ({_catalog_sql()}),
dims AS (SELECT * FROM (VALUES ('priority', 'orders.o_orderpriority'), ('urgency', 'orders.o_orderpriority'), ('price level', 'orders.o_totalprice'), ('level', 'orders.o_totalprice')) v(alias, f)),
terms AS (SELECT concept, coalesce(f, concept) AS term, f IS NOT NULL AS governed FROM (SELECT unnest([{", ".join(repr(c) for c in CONCEPTS)}]) AS concept) LEFT JOIN dims ON regexp_replace(lower(trim(concept)), '[\\s_-]+', ' ', 'g') = alias),
hits AS (SELECT concept, any_value(term) AS term, bool_or(governed OR contains(term, '.')) AS sure, count(col) AS n, min(dataset) AS dataset, min(col) AS col, min(dtype) AS dtype FROM terms LEFT JOIN cat ON term = CASE WHEN contains(term, '.') THEN dataset || '.' || col ELSE col END GROUP BY concept),
judged AS (SELECT *, n = 1 AS found, regexp_matches(concept, 'revenue|amount|sales|price|cost|total|balance', 'i') AND dtype NOT IN ('BIGINT', 'INTEGER', 'DOUBLE') AS no_money FROM hits),
m AS (SELECT concept, CASE WHEN found THEN dataset WHEN contains(term, '.') THEN split_part(term, '.', 1) END AS dataset, CASE WHEN found THEN col ELSE regexp_replace(term, '^[^.]*[.]', '') END AS "column",
  CASE WHEN n = 0 THEN 'MISSING' WHEN n > 1 THEN 'AMBIGUOUS' WHEN no_money THEN 'MISSING' ELSE 'MAPPED' END AS status, CASE WHEN NOT found OR no_money THEN 'LOW' WHEN sure THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
  CASE WHEN found AND regexp_matches(dtype, '^(DATE|TIMESTAMP)') AND regexp_matches(col, 'order_?date') THEN 'time_role=event_time' END AS note FROM judged)"""
for _name, _columns in (("map_01_resolution", ("concept", "dataset", "column", "status")), ("map_02_dimensions", ("concept", "confidence")), ("map_03_shapes", ("concept", "status", "confidence", "note"))):

    @query(_name, f"WITH {MAPPED} SELECT {', '.join(chr(34) + c + chr(34) for c in _columns)} FROM m")
    def _(t, columns=_columns):
        return _mapping(t, _catalog(t)[0]).select(*columns)


@query("map_04_blocking_items", f"WITH {MAPPED} SELECT concept AS item, status AS reason FROM m WHERE status <> 'MAPPED' UNION ALL SELECT dataset || '.' || \"column\", 'SHARED_COLUMN' FROM m WHERE status = 'MAPPED' GROUP BY dataset, \"column\" HAVING count(*) > 1")
def _(t):
    return govern.blocking_items(_mapping(t, _catalog(t)[0]))


def _issues(t) -> DataFrame:
    profiles, datasets = _catalog(t)
    return govern.assess(_mapping(t, profiles), profiles, datasets, None, True)


DUPLICATES = "(SELECT count(*) - count(DISTINCT (c_mktsegment, c_nationkey)) AS d, count(*) AS n FROM customer)"
ISSUES = {
    "dq_01_completeness": ("completeness", "SELECT 'completeness:orders.custkey' AS rule, CASE WHEN avg((o_custkey = 8)::INT) > 0.5 THEN 'BLOCKING' ELSE 'REQUIRES_RULE' END AS severity FROM orders HAVING count(*) FILTER (o_custkey = 8) > 0"),
    "dq_02_text_variants": ("text_formatting", "SELECT 'text_formatting:orders.o_orderpriority' AS rule, 'REQUIRES_RULE' AS severity FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS p FROM orders) HAVING count(DISTINCT lower(trim(p))) < count(DISTINCT p)"),
    "dq_03_candidate_key": ("uniqueness", "SELECT 'uniqueness:segments' AS rule, 'WARNING' AS severity FROM customer HAVING count(DISTINCT c_mktsegment) < count(*) AND count(DISTINCT c_nationkey) < count(*)"),
    "dq_04_duplicates": ("duplicates", f"SELECT 'duplicates:segments' AS rule, CASE WHEN d / n > 0.5 THEN 'BLOCKING' ELSE 'REQUIRES_RULE' END AS severity FROM {DUPLICATES} WHERE d > 0"),
    "dq_05_type_conflict": ("cross_source_dtype", f"WITH cat AS ({_catalog_sql()}) SELECT 'cross_source_dtype:' || col AS rule, 'WARNING' AS severity FROM cat GROUP BY col HAVING count(DISTINCT dtype) > 1"),
    "dq_06_currency": ("currency_policy", f"WITH {MAPPED} SELECT 'currency_policy:' || concept AS rule, 'REQUIRES_RULE' AS severity FROM m WHERE status = 'MAPPED' AND regexp_matches(concept, 'amount|price|balance|total', 'i')"),
}
for _name, (_kind, _sql) in ISSUES.items():

    @query(_name, _sql)
    def _(t, kind=_kind):
        return _issues(t).where(F.col("rule").startswith(f"{kind}:"))


@query("dq_03_empty_dataset", "SELECT 'uniqueness:segments' AS rule, 'WARNING' AS severity FROM customer HAVING count(DISTINCT c_mktsegment) < count(*) AND count(DISTINCT c_nationkey) < count(*)")
def _(t):
    """Of a table without rows nothing is asked."""
    profiles, datasets = _catalog(t)
    nothing = t.customer.where("c_custkey IS NULL").select("c_mktsegment")
    more = profile.profile(nothing).withColumn("dataset", F.lit("nothing")), profile.dataset_profile(nothing).withColumn("dataset", F.lit("nothing"))
    return govern.assess(_mapping(t, profiles), profiles.unionByName(more[0]), datasets.unionByName(more[1]), "EUR").where("rule LIKE 'uniqueness:%'")


@query("dq_07_time_coverage", "SELECT 'time_coverage:all' AS rule, 'BLOCKING' AS severity")
def _(t):
    profiles, datasets = _catalog(t)
    undated = profiles.where("dataset <> 'orders'")
    return govern.assess(_mapping(t, profiles), undated, datasets.where("dataset <> 'orders'"), "EUR", True).where("rule LIKE 'time_coverage:%'")


@query("dq_08_fitness", f"SELECT CASE WHEN d / n > 0.5 THEN 'FAIL' ELSE 'CONDITIONAL' END AS fitness FROM {DUPLICATES}")
def _(t):
    return govern.fitness(_issues(t))


PROPOSED = """SELECT * FROM (VALUES ('null:o_totalprice', 'error', false), ('null:note', 'blocked', false), ('currency_policy:orders.o_totalprice', 'blocked', false), ('currency_policy:price level', 'blocked', false)) v(rule_id, operation, needs_approval)
UNION ALL SELECT 'text_clean:orders.o_orderpriority', 'text_clean', true FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS p FROM orders) HAVING count(DISTINCT lower(trim(p))) < count(DISTINCT p)
UNION ALL SELECT 'dedup:segments', 'dedup', true FROM {duplicates} WHERE d > 0"""
for _name, _governed, _sql in (
    ("cln_01_proposals", True, "SELECT 'null:custkey', 'fill:0', true"),
    ("cln_01_without_policy", False, "SELECT 'completeness:orders.custkey', 'blocked', false FROM orders HAVING count(*) FILTER (o_custkey = 8) > 0"),
):

    @query(_name, PROPOSED.format(duplicates=DUPLICATES) + " UNION ALL " + _sql)
    def _(t, governed=_governed):
        policies = [("o_totalprice", "error"), ("note", "guess"), *[("custkey", "fill:0")] * governed]
        return govern.propose_cleaning(_issues(t), t.spark.createDataFrame(policies, "column string, policy string"))


@query("cln_02_applied", "SELECT DISTINCT lower(trim(c_mktsegment)) AS c_mktsegment, c_nationkey FROM customer")
def _(t):
    tables = {"segments": t.customer.select(F.concat(F.lit(" "), "c_mktsegment").alias("c_mktsegment"), "c_nationkey")}
    return govern.apply_cleaning(tables, ["dedup:segments", "text_clean:segments.c_mktsegment"])["segments"]


def _training(t) -> DataFrame:
    data = t.labels.join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id")
    return data.withColumn("age", F.lit(1)).withColumn("rare", F.expr("CASE WHEN doc_id % 40 = 0 THEN 1 WHEN doc_id % 40 > 2 THEN 0 END")).withColumn("day", F.lit("2024-01-05"))


TRAINING = "d AS (SELECT *, CASE WHEN doc_id % 40 = 0 THEN 1 WHEN doc_id % 40 > 2 THEN 0 END AS rare FROM labels JOIN documents USING (doc_id))"
LIMITED = """SELECT 'some_target_nulls' AS finding, 'LIMITED' AS verdict FROM d HAVING count(rare) < count(*) AND avg((rare IS NULL)::INT) <= 0.2
UNION ALL SELECT 'target_nulls', 'REJECT' FROM d HAVING avg((rare IS NULL)::INT) > 0.2 UNION ALL SELECT 'too_few_rows', 'REJECT' FROM d HAVING count(*) < 100"""


@query("mls_01_readiness", f"WITH {TRAINING} SELECT * FROM (VALUES ('feature_missing:income', 'REJECT'), ('target_among_features', 'REJECT'), ('time_column_undated:day', 'REJECT'), ('protected:age', 'LIMITED')) v(finding, verdict) UNION ALL {LIMITED}")
def _(t):
    data = _training(t)
    return govern.readiness(data, profile.profile(data), "rare", ["n_chars", "age", "rare", "income"], "forecasting", "day")


IMBALANCE = f"{LIMITED} UNION ALL SELECT 'class_imbalance', 'LIMITED' FROM d HAVING count(*) >= 100 AND least(avg(rare), 1 - avg(rare)) < 0.05"
for _task, _sql in (("classification", IMBALANCE), ("regression", LIMITED)):

    @query(f"mls_02_{_task}", f"WITH {TRAINING} {_sql}")
    def _(t, task=_task):
        data = _training(t)
        return govern.readiness(data, profile.profile(data), "rare", ["n_chars"], task)


@query("mls_03_protected_and_verdict", f"WITH {TRAINING}, f AS ({IMBALANCE} UNION ALL SELECT 'protected:age', 'LIMITED') SELECT 'protected:age' AS finding, CASE WHEN count(*) FILTER (verdict = 'REJECT') > 0 THEN 'REJECT' ELSE 'LIMITED' END AS verdict FROM f")
def _(t):
    data = _training(t)
    found = govern.readiness(data, profile.profile(data), "rare", ["n_chars", "age"])
    return found.where("finding LIKE 'protected:%'").select("finding").crossJoin(govern.verdict(found))  # one row each


@query("mls_03_proceed", "SELECT CASE WHEN count(*) < 100 THEN 'REJECT' ELSE 'PROCEED' END AS verdict FROM orders")
def _(t):
    return govern.verdict(govern.readiness(t.orders, profile.profile(t.orders), "o_totalprice", ["o_orderstatus"], "forecasting", "o_orderdate"))


def _metrics(t) -> DataFrame:
    rows = [("m1", "Revenue", ["sales", "turnover"], "sum(orders.o_totalprice)", 1), ("m2", "Net revenue", ["revenue"], "sum(orders.o_totalprice)", 1), ("m3", "Order count", ["orders"], "count(orders.o_orderkey)", 1)]
    return t.spark.createDataFrame(rows, "semantic_id string, name string, aliases array<string>, formula string, version int")


@query("sem_01_terms", "SELECT p_type AS term, 'UNGOVERNED' AS status, NULL::VARCHAR AS semantic_id FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT * FROM (VALUES ('revenue', 'AMBIGUOUS', NULL), ('ORDERS ', 'GOVERNED', 'm3'), ('turn-over', 'UNGOVERNED', NULL), ('net_revenue', 'GOVERNED', 'm2'))")
def _(t):
    terms = t.spark.createDataFrame([("revenue",), ("ORDERS ",), ("turn-over",), ("net_revenue",)], "term string").unionByName(t.part.select(F.col("p_type").alias("term")).distinct())
    return govern.resolve_terms(terms, _metrics(t))


@query("sem_02_metric", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY o_orderstatus")
def _(t):
    return govern.evaluate_metric("sum(orders.o_totalprice)", {"orders": t.orders}, ["o_orderstatus"]).withColumn("value", F.round("value", 2))


def _dictionary(t) -> govern.Dictionary:
    """Definitions that follow from the tables: a metric a market segment, and dimensions, entities and a calendar."""
    spark = t.spark
    metrics = t.customer.select("c_mktsegment").distinct().select(F.lower("c_mktsegment").alias("semantic_id"), F.col("c_mktsegment").alias("name"), F.array(F.concat(F.col("c_mktsegment"), F.lit(" revenue"))).alias("aliases"), F.lit("sum(orders.o_totalprice)").alias("formula"), F.lit(1).alias("version"))
    for column in govern.METRIC.split(", "):
        name, kind = column.split()
        metrics = metrics if name in metrics.columns else metrics.withColumn(name, F.lit(None).cast(kind))
    dimensions = spark.createDataFrame([("d1", "Segment", ["market segment"], "customer.c_mktsegment", None, ["customer.c_nationkey"])], govern.DIMENSION)
    entities = spark.createDataFrame([("e1", "Customer", ["c_custkey"], ["client"])], govern.ENTITY)
    return govern.Dictionary(metrics, dimensions, entities, spark.createDataFrame([("UTC", "Monday", 4)], govern.CALENDAR))


@query("sem_03_dictionary", "SELECT DISTINCT lower(c_mktsegment) AS semantic_id, c_mktsegment || ' revenue' AS alias, 1 AS version, 4 AS fiscal_year_start_month FROM customer UNION ALL SELECT 'new_metric', NULL, 7, 4")
def _(t):
    path, known = scratch(t.spark, "dictionary"), _dictionary(t)
    govern.save_dictionary(known, path)
    stored = govern.load_dictionary(t.spark, path)
    new = stored.metrics.limit(1).withColumns({"semantic_id": F.lit("new_metric"), "aliases": F.array().cast("array<string>"), "version": F.lit(7)})
    made = govern.add_metrics(stored.metrics, new).select("semantic_id", F.get("aliases", F.lit(0)).alias("alias"), "version")
    return made.crossJoin(stored.calendar.select("fiscal_year_start_month"))  # one row


@query("sem_03_conflict", "SELECT 'VALIDATION_FAIL' AS code, count(DISTINCT c_mktsegment) AS conflicts FROM customer HAVING count(*) > 0")
def _(t):
    metrics = _dictionary(t).metrics
    found = refusal(govern.add_metrics, metrics, metrics)
    return one_row(t, "code string, conflicts long", found.code, len(found.evidence["semantic_ids"]))


PRICE = {"name": "price", "column": "o_totalprice", "fn": "sum"}


@query("anl_01_descriptive", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY o_orderpriority")
def _(t):
    return govern.descriptive(t.orders, ["o_orderpriority"], PRICE, guard=False).output.withColumn("price", F.round("price", 2))


PERIODS = "SELECT o_orderpriority, coalesce(count(*) FILTER (year(o_orderdate) = 1996), 0) AS before, coalesce(count(*) FILTER (year(o_orderdate) = 1997), 0) AS after FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY o_orderpriority"
COUNT = {"name": "n", "column": "o_orderkey", "fn": "count"}


@query("anl_02_comparative", f"SELECT *, after - before AS difference, CASE WHEN before <> 0 THEN 100 * (after - before) / before END AS percent_change FROM ({PERIODS})")
def _(t):
    return govern.comparative(t.orders, ["o_orderpriority"], COUNT, F.year("o_orderdate") == 1996, F.year("o_orderdate") == 1997)


@query("anl_03_segmentation", "SELECT c_mktsegment, count(*) AS customers, (SELECT count(*) FROM customer) AS total FROM customer GROUP BY c_mktsegment")
def _(t):
    parts = govern.descriptive(t.customer, ["c_mktsegment"], {"name": "customers", "column": "c_custkey", "fn": "count"}, guard=False).output
    return parts.crossJoin(parts.agg(F.sum("customers").alias("total")))  # one row


@query("anl_04_contributions", f"WITH p AS ({PERIODS}) SELECT *, after - before AS difference, (sum(after - before) OVER ())::BIGINT AS total_change, (after - before) / nullif(sum(after - before) OVER (), 0) AS share FROM p")
def _(t):
    return govern.contributions(t.orders, "o_orderpriority", COUNT, F.year("o_orderdate") == 1996, F.year("o_orderdate") == 1997).drop("percent_change")


INTENT = " ".join(f"WHEN regexp_matches(x, '(?i){p}') THEN '{k}'" for k, p in govern.INTENTS)
ASKED = "CASE conv_id % 6 WHEN 0 THEN 'Why did it fall? ' WHEN 1 THEN 'Compare it with ' WHEN 2 THEN 'Forecast the ' WHEN 3 THEN 'Which outliers are in ' ELSE '' END || text"


@query("anl_05_intents", f"SELECT conv_id, turn, CASE {INTENT} WHEN trim(x) <> '' THEN 'DESCRIPTIVE' ELSE 'UNCLASSIFIED' END AS intent FROM (SELECT conv_id, turn, {ASKED} AS x FROM conversations)")
def _(t):
    return t.conversations.select("conv_id", "turn", govern.tag_intent(F.expr(ASKED)).alias("intent"))


def _spec() -> dict:
    """Finished orders by market segment."""
    return {
        "sources": ["orders", "customer"],
        "steps": [
            {"id": "finished", "op": "select_filter", "inputs": ["source:orders"], "params": {"filters": [{"column": "o_orderstatus", "op": "==", "value": "F"}]}},
            {"id": "joined", "op": "join", "inputs": ["finished", "source:customer"], "params": {"left_keys": ["o_custkey"], "right_keys": ["c_custkey"], "how": "inner", "expected_cardinality": "many_to_one"}},
            {"id": "totals", "op": "aggregate@1", "inputs": ["joined"], "params": {"group_by": ["c_mktsegment"], "metrics": [{"name": "price", "column": "o_totalprice", "fn": "sum"}], "relative": 1e-9}},
        ],
    }


FLAGSHIP = "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment"


def flagship(t) -> DataFrame:
    """Select, guarded join, reconciled totals: the guards run, and the result stays lazy."""
    out, _ = pipeline.run_pipeline(_spec(), {"orders": t.orders, "customer": t.customer})
    return out["totals"].withColumn("price", F.round("price", 2))


query("pip_01_pipeline", FLAGSHIP)(flagship)


@query("pip_02_evidence", "SELECT 'finished' AS step, 'COMPLETED' AS status, count(*) AS rows_in, count(*) FILTER (o_orderstatus = 'F') AS rows_out FROM orders UNION ALL SELECT 'joined', 'REFUSED:DATA_QUALITY_BLOCK', NULL, NULL UNION ALL SELECT 'totals', 'NOT_RUN', NULL, NULL")
def _(t):
    spec, root = _spec(), scratch(t.spark, "runs")
    spec["steps"][1]["params"]["expected_cardinality"] = "one_to_one"
    pipeline.run_pipeline(spec, {"orders": t.orders, "customer": t.customer}, "r1", root=root)
    return pipeline.stored_evidence(t.spark, root, "r1").select("step", "status", "rows_in", "rows_out")


@query("pip_02_materialised", FLAGSHIP)
def _(t):
    out, _ = pipeline.run_pipeline(_spec(), {"orders": t.orders, "customer": t.customer}, "r1", root=scratch(t.spark, "runs"))
    return out["totals"].withColumn("price", F.round("price", 2))


@query("pip_03_drift_guarded_batches", "SELECT event_id, user_id, event_type FROM events WHERE event_id % 4 < 2")
def _(t):
    """Two batches of events: one like the baseline passes, one whose type changed is stopped."""
    events = t.events.select("event_id", "user_id", "event_type")
    baseline = profile.profile(events)
    good = events.where("event_id % 4 < 2")
    bad = events.where("event_id % 4 >= 2").withColumn("user_id", F.col("user_id").cast("string"))
    passed = [b for b in (good, bad) if judge_batch(b, baseline).first()["action"] == "CONTINUE"]
    return passed[0].select("event_id", "user_id", "event_type")


@query("pip_03_guarded_stream", "SELECT 'good' AS place, event_id, user_id, event_type FROM events UNION ALL SELECT 'quarantine', event_id, CASE WHEN event_id % 2 = 0 THEN user_id END, event_type FROM events")
def _(t):
    """The same as a stream: a micro-batch like the baseline goes to the good folder, one that lost half of its users to quarantine."""
    root = scratch(t.spark, "stream")
    events = t.events.select("event_id", "user_id", "event_type")
    holed = events.withColumn("user_id", F.expr("CASE WHEN event_id % 2 = 0 THEN user_id END"))
    for batch in (events, holed):  # the stream reads what is new since its checkpoint
        batch.write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(events.schema).parquet(f"{root}/in")
        run_guarded(stream, profile.profile(events), f"{root}/good", f"{root}/quarantine", f"{root}/checkpoint").awaitTermination()
    places = [t.spark.read.parquet(f"{root}/{p}").select(F.lit(p).alias("place"), "event_id", "user_id", "event_type") for p in ("good", "quarantine")]
    return places[0].unionByName(places[1])


@query("pip_03_baseline_history", "SELECT 'r1' AS run, 'ACCEPTED' AS status, NULL::VARCHAR AS baseline, NULL::VARCHAR AS kind UNION ALL SELECT 'r2', 'QUARANTINED', 'r1', 'null_rate_increased' FROM orders HAVING avg((o_orderkey % 2 = 0)::INT) > 0.05 UNION ALL SELECT 'r3', 'ACCEPTED', 'r1', 'column_added' UNION ALL SELECT 'r4', 'STOPPED', 'r3', 'column_removed'")
def _(t):
    """The third run is compared with the first, since the second was quarantined, and the fourth with the third."""
    root = scratch(t.spark, "history")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    runs = {"r1": orders, "r2": orders.withColumn("o_custkey", F.expr("CASE WHEN o_orderkey % 2 > 0 THEN o_custkey END")), "r3": orders.withColumn("year", F.year("o_orderdate")), "r4": orders}
    for run, df in runs.items():
        history.judge_run(df, root, run)
    told = history.judged(t.spark, root)
    return told.select("run", "status", "baseline", F.explode_outer("changes").alias("c")).select("run", "status", "baseline", F.col("c.kind").alias("kind"))


@query("pip_03_stream_evidence", "SELECT operator, metric, sum(value)::BIGINT AS value FROM (SELECT unnest(['select_filter', 'select_filter', 'cast', 'cast', 'cast']) AS operator, unnest(['rows_in', 'rows_out', 'rows_in', 'filled0', 'failed0']) AS metric, unnest([count(*), count(*) FILTER (event_id % 3 > 0), count(*) FILTER (event_id % 3 > 0), count(*) FILTER (event_id % 3 > 0), count(*) FILTER (event_id % 3 > 0 AND event_id % 5 = 0)]) AS value FROM events) GROUP BY ALL")
def _(t):
    """Guarded operators on a stream count while it runs; nothing is read twice."""
    root = scratch(t.spark, "stream")
    raw = t.events.select("event_id", F.col("event_id") % 3, F.expr("CASE WHEN event_id % 5 = 0 THEN 'x' || event_id ELSE cast(event_id AS string) END")).toDF("event_id", "third", "raw")
    raw.repartition(3).write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    kept = select_filter(stream, ["event_id", "raw"], [{"column": "third", "op": ">", "value": 0}]).output
    run = cast(kept, [{"column": "raw", "target_type": "Int64"}]).output.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return progress_evidence(run).groupBy("operator", "metric").agg(F.sum(F.col("value").cast("long")).alias("value"))


@query("pip_04_release", "SELECT 'RELEASED' AS decision")
def _(t):
    totals = flagship(t)
    joined = t.orders.where("o_orderstatus = 'F'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    results = checks.run_checks(joined, [checks.null_rate("o_totalprice", 0.0), checks.value_range("o_totalprice", 0)])
    reconciled = checks.reconcile_stages(checks.subtotals(totals, "price", joined, "o_totalprice", tolerance=0.1))
    return pipeline.release(results, reconciled)
