"""Mapping of concepts to columns, fitness of data, cleaning rules, a metric layer and training readiness.

All of it works on profile tables (one row a column, from ``profile`` with a ``dataset`` column),
so the tables themselves are scanned once, on executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.core import SAMPLE, Refused, Result, require
from tablekeel.functions.guards import by_name
from tablekeel.functions.text import trim
from tablekeel.operators.groups import aggregate, aggregate_plan
from tablekeel.operators.text_clean import text_clean

# Words that tell of money, suffixes of identifiers, and roles of time columns in order.
MONEY = "revenue|amount|sales|price|cost|total|balance|payment|spend|margin|profit"
IDENTIFIER = "(^id$|_id$)"
TIME_ROLES = (("created_time", "created|create[_-]?date"), ("updated_time", "updated|modified"), ("posting_time", "posting|posted|book(ing)?[_-]?date"), ("effective_time", "effective"), ("event_time", "event|order[_-]?date|ship[_-]?date|transaction[_-]?date|occurred"))
# Names of protected attributes.
PROTECTED = r"gender|\bsex\b|race|ethnicit|religio|disabilit|marital|pregnan|sexual[_-]?orientation|\bage\b"
NUMERIC = "^(tinyint|smallint|int|bigint|float|double|decimal)"
DATED = "^(date|timestamp)"
#: Shares beyond which data are not fit, and least rows to train on.
MOSTLY_NULL, MOSTLY_DUPLICATE, TARGET_NULLS, LEAST_ROWS, MINORITY = 0.5, 0.5, 0.2, 100, 0.05


def normal_term(c: Column) -> Column:
    return F.regexp_replace(F.lower(trim(c)), r"[\s_-]+", " ")


def map_concepts(concepts: DataFrame, profiles: DataFrame, dimensions: DataFrame | None = None) -> DataFrame:
    """Map ``concept`` (``dataset.column``, a dimension's alias or a bare column) to columns.

    Rows ``concept, dataset, column, dtype, nulls, rows, status, confidence, note``: MAPPED with HIGH
    confidence if qualified or by alias, MEDIUM if bare and unique; AMBIGUOUS with several hits,
    MISSING with none or where a monetary concept meets a column that is not numeric. What is not
    mapped has LOW confidence and names the dataset and column that were asked for; several
    dimensions of an alias name none.
    """
    asked = concepts.select("concept").withColumn("term", F.col("concept")).withColumn("governed", F.lit(False))
    if dimensions is not None:
        aliases = dimensions.select(F.explode(F.array_append("aliases", F.col("name"))).alias("alias"), "source_field").withColumn("alias", normal_term(F.col("alias"))).distinct()
        asked = asked.join(aliases, normal_term(F.col("concept")) == F.col("alias"), "left").select("concept", F.coalesce("source_field", "term").alias("term"), F.col("source_field").isNotNull().alias("governed"))
    p = profiles.select("dataset", "column", "dtype", "nulls", "rows")
    qualified = asked.where(F.col("term").contains(".")).join(p, F.col("term") == F.concat_ws(".", "dataset", "column"), "left").withColumn("sure", F.lit("HIGH"))
    bare = asked.where(~F.col("term").contains(".")).join(p, F.col("term") == F.col("column"), "left").withColumn("sure", F.when(F.col("governed"), "HIGH").otherwise("MEDIUM"))
    hits = qualified.unionByName(bare)
    one = hits.groupBy("concept").agg(
        F.count("column").alias("hits"), F.count_distinct("term").alias("terms"), *[F.min(c).alias(c) for c in ("term", "dataset", "column", "dtype", "nulls", "rows", "sure")]
    )
    money = F.col("concept").rlike(f"(?i){MONEY}") & ~F.col("dtype").rlike(NUMERIC)
    found = F.col("hits") == 1
    role = F.lit(None).cast("string")
    for name, pattern in reversed(TIME_ROLES):
        role = F.when(F.col("column").rlike(f"(?i){pattern}"), f"time_role={name}").otherwise(role)
    note = F.when(found & (F.col("concept").rlike(f"(?i){IDENTIFIER}") | F.col("column").rlike(f"(?i){IDENTIFIER}")) & (F.col("nulls") > 0), "identifier with nulls").when(found & F.col("dtype").rlike(DATED), role)
    status = F.when(F.col("hits") == 0, "MISSING").when(F.col("hits") > 1, "AMBIGUOUS").when(money, "MISSING").otherwise("MAPPED")
    term, named = F.col("term"), F.col("terms") == 1
    dataset = F.when(found, F.col("dataset")).when(named & term.contains("."), F.substring_index(term, ".", 1))
    column = F.when(found, F.col("column")).when(named, F.regexp_replace(term, r"^[^.]*\.", ""))
    kept = lambda c: F.when(found, F.col(c)).alias(c)
    sure = F.when(found & ~money, F.col("sure")).otherwise("LOW")
    return one.select("concept", dataset.alias("dataset"), column.alias("column"), *map(kept, ("dtype", "nulls", "rows")), status.alias("status"), sure.alias("confidence"), note.alias("note"))


def blocking_items(mapping: DataFrame) -> DataFrame:
    """Rows ``item, reason`` that keep a request from going on."""
    lost = mapping.where("status <> 'MAPPED'").select(F.col("concept").alias("item"), F.col("status").alias("reason"))
    shared = mapping.where("status = 'MAPPED'").groupBy("dataset", "column").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return lost.unionByName(shared.select(F.concat_ws(".", "dataset", "column").alias("item"), F.lit("SHARED_COLUMN").alias("reason")))


def assess(mapping: DataFrame, profiles: DataFrame, datasets: DataFrame, currency: str | None = None, needs_time: bool = False) -> DataFrame:
    """Issues ``rule, severity`` of mapped fields and their tables; ``datasets`` has ``dataset, rows, duplicate_rows``. A table without rows needs no key."""
    mapped = mapping.where("status = 'MAPPED'").select("concept", "dataset", "column").join(profiles, ["dataset", "column"])
    field = F.concat_ws(".", "dataset", "column")

    def issues(df: DataFrame, kind: str, name: Column, severity: Column) -> DataFrame:
        return df.select(F.concat(F.lit(f"{kind}:"), name).alias("rule"), severity.alias("severity"))

    rate = F.col("nulls") / F.col("rows")
    parts = [
        issues(mapped.where("nulls > 0"), "completeness", field, F.when(rate > MOSTLY_NULL, "BLOCKING").otherwise("REQUIRES_RULE")),
        issues(mapped.where("folded_values < distinct_values"), "text_formatting", field, F.lit("REQUIRES_RULE")),
        issues(profiles.groupBy("dataset").agg(F.bool_or("is_key").alias("k"), F.max("rows").alias("n")).where("n > 0 AND NOT k"), "uniqueness", F.col("dataset"), F.lit("WARNING")),
        issues(datasets.where("duplicate_rows > 0"), "duplicates", F.col("dataset"), F.when(F.col("duplicate_rows") / F.col("rows") > MOSTLY_DUPLICATE, "BLOCKING").otherwise("REQUIRES_RULE")),
        issues(profiles.groupBy("column").agg(F.count_distinct("dtype").alias("n")).where("n > 1"), "cross_source_dtype", F.col("column"), F.lit("WARNING")),
    ]
    if currency is None:
        parts.append(issues(mapped.where(F.col("concept").rlike(f"(?i){MONEY}")), "currency_policy", F.col("concept"), F.lit("REQUIRES_RULE")))
    if needs_time:
        parts.append(issues(profiles.agg(F.bool_or(F.col("dtype").rlike(DATED)).alias("t")).where("NOT coalesce(t, false)"), "time_coverage", F.lit("all"), F.lit("BLOCKING")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fitness(issues: DataFrame) -> DataFrame:
    return issues.agg(F.when(F.count_if(F.col("severity") == "BLOCKING") > 0, "FAIL").when(F.count_if(F.col("severity") == "REQUIRES_RULE") > 0, "CONDITIONAL").otherwise("PASS").alias("fitness"))


def propose_cleaning(issues: DataFrame, null_policy: DataFrame) -> DataFrame:
    """Rules from null policies (``column, policy``) and issues: ``rule_id, operation, needs_approval``. A fill value is never made up.

    ``error`` and ``ignore`` need nothing; ``fill:<v>`` and rules that change or drop rows need
    approval; what no rule can settle comes with operation ``blocked``. Nulls of a column that has
    a policy are settled by it.
    """
    policy = F.col("policy")
    from_policy = null_policy.select(F.concat(F.lit("null:"), "column").alias("rule_id"), F.when(policy.isin("error", "ignore"), policy).when(policy.startswith("fill:"), policy).otherwise("blocked").alias("operation"), policy.startswith("fill:").alias("needs_approval"))
    column = F.when(F.col("rule").startswith("completeness:"), F.substring_index("rule", ".", -1))
    open_ = issues.where(F.col("severity").isin("REQUIRES_RULE", "BLOCKING")).join(null_policy.select(F.col("column").alias("_governed")).distinct(), column == F.col("_governed"), "left_anti")
    from_issues = open_.select(
        F.when(F.col("rule").startswith("duplicates:"), F.regexp_replace("rule", "^duplicates:", "dedup:")).when(F.col("rule").startswith("text_formatting:"), F.regexp_replace("rule", "^text_formatting:", "text_clean:")).otherwise(F.col("rule")).alias("rule_id"),
        F.when(F.col("rule").startswith("duplicates:"), "dedup").when(F.col("rule").startswith("text_formatting:"), "text_clean").otherwise("blocked").alias("operation"),
        F.col("rule").rlike("^(duplicates|text_formatting):").alias("needs_approval"),
    )
    return from_policy.unionByName(from_issues)


def apply_cleaning(tables: dict[str, DataFrame], approved: list[str]) -> dict[str, DataFrame]:
    """Tables after approved rules ``text_clean:<table>.<column>`` and ``dedup:<table>``; any other rule is refused."""
    out = dict(tables)
    for rule in sorted(approved, key=lambda r: r.startswith("dedup:")):
        kind, _, target = rule.partition(":")
        name, _, column = target.partition(".")
        if kind == "text_clean" and name in out and column in out[name].columns:
            out[name] = text_clean(out[name], [{"column": column, "steps": ["trim", "lower"]}], allow_identity_collapse=True, guard=False).output
        elif kind == "dedup" and name in out:
            out[name] = out[name].dropDuplicates()
        else:
            raise Refused("NO_SAFE_OPERATION", f"no operation applies the rule {rule!r}")
    return out


def resolve_terms(terms: DataFrame, metrics: DataFrame) -> DataFrame:
    """``term`` -> GOVERNED with its metric, AMBIGUOUS or UNGOVERNED; never picked among several."""
    names = metrics.select("semantic_id", F.explode(F.array_append("aliases", F.col("name"))).alias("alias")).select("semantic_id", normal_term(F.col("alias")).alias("alias")).distinct()
    hits = terms.join(names, normal_term(F.col("term")) == F.col("alias"), "left").groupBy("term").agg(F.count_distinct("semantic_id").alias("n"), F.min("semantic_id").alias("semantic_id"))
    status = F.when(F.col("n") == 1, "GOVERNED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("UNGOVERNED")
    return hits.select("term", status.alias("status"), F.when(F.col("n") == 1, F.col("semantic_id")).alias("semantic_id"))


FORMULA = re.compile(r"^\s*(sum|count|mean|min|max|n_unique)\(\s*(\w+)\.(\w+)\s*\)\s*$")


def evaluate_metric(formula: str, tables: dict[str, DataFrame], group_by: list[str], name: str = "value") -> DataFrame:
    """Evaluate ``fn(table.column)`` by groups; compound formulas are refused."""
    m = FORMULA.match(formula)
    require([] if m and m[2] in tables else [f"formula {formula!r} can't be evaluated"])
    return aggregate_plan(tables[m[2]], group_by, [{"name": name, "column": m[3], "fn": m[1]}])


METRIC = "semantic_id string, name string, aliases array<string>, formula string, grain string, filters array<string>, source_fields array<string>, currency string, rounding string, owner string, version int, effective_from string"
DIMENSION = "semantic_id string, name string, aliases array<string>, source_field string, allowed_values array<string>, hierarchy array<string>"
ENTITY = "semantic_id string, name string, key_fields array<string>, aliases array<string>"
CALENDAR = "timezone string, week_start string, fiscal_year_start_month int"


@dataclass
class Dictionary:
    """Governed definitions as tables with a row a definition; ``calendar`` has one row or none."""

    metrics: DataFrame
    dimensions: DataFrame
    entities: DataFrame
    calendar: DataFrame


def load_dictionary(spark: SparkSession, path: str) -> Dictionary:
    """Read a JSON document ``{metrics: {id: {...}}, dimensions: {...}, entities: {...}, calendar: {...}}``; parts that are missing are empty."""
    text = spark.read.text(path, wholetext=True)
    shape = f"metrics map<string, struct<{_fields(METRIC)}>>, dimensions map<string, struct<{_fields(DIMENSION)}>>, entities map<string, struct<{_fields(ENTITY)}>>, calendar struct<{_fields(CALENDAR)}>"
    whole = text.select(F.from_json("value", shape, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    tables = []
    for part in ("metrics", "dimensions", "entities"):
        rows = whole.select(F.explode(part).alias("key", "v"))
        tables.append(rows.select(F.coalesce("v.semantic_id", "key").alias("semantic_id"), *[f"v.{c}" for c in rows.schema["v"].dataType.names if c != "semantic_id"]))
    metrics = tables[0].withColumns({"aliases": F.coalesce("aliases", F.array().cast("array<string>")), "version": F.coalesce("version", F.lit(1))})
    return Dictionary(metrics, tables[1].withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))), tables[2], whole.where("calendar IS NOT NULL").select("calendar.*"))


def _fields(shape: str) -> str:
    return re.sub(r"(\w+) (\S+)", r"\1: \2", shape)


def save_dictionary(known: Dictionary, path: str) -> None:
    """Write the document that ``load_dictionary`` reads. A dictionary is a small file: one row, one task."""

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("semantic_id").alias("key"), F.struct(*df.columns).alias("value"))))).alias(name))

    whole = part(known.metrics, "metrics").crossJoin(part(known.dimensions, "dimensions")).crossJoin(part(known.entities, "entities"))  # one row each
    whole = whole.crossJoin(known.calendar.agg(F.first(F.struct(*known.calendar.columns)).alias("calendar")))
    whole.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def add_metrics(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known metrics and new ones. An id that is governed already, or comes twice, is refused: definitions are never overwritten."""
    taken = new.join(known, "semantic_id", "left_semi").select("semantic_id").unionByName(new.groupBy("semantic_id").count().where("count > 1").select("semantic_id"))
    if clashes := [r[0] for r in taken.distinct().limit(SAMPLE).collect()]:
        raise Refused("VALIDATION_FAIL", f"already governed: {sorted(clashes)}", {"semantic_ids": sorted(clashes)})
    return known.unionByName(new.select(*known.columns))


TASKS = ("classification", "regression", "forecasting")


def readiness(df: DataFrame, profiles: DataFrame, target: str, features: list[str], task: str = "classification", time_column: str | None = None) -> DataFrame:
    """Findings ``finding, verdict`` on whether ``df`` can train a model of ``target``; no rows: PROCEED.

    Forecasting needs a ``time_column`` of dates. Classes are weighed only for classification, and
    only if nothing else rejects the table.
    """
    require([f"unknown task {task!r}"] * (task not in TASKS))
    kinds, fixed = dict(df.dtypes), []
    if target not in kinds:
        fixed.append(("target_missing", "REJECT"))
    fixed += [(f"feature_missing:{f}", "REJECT") for f in features if f not in kinds]
    if target in features:
        fixed.append(("target_among_features", "REJECT"))
    if task == "forecasting":
        if not time_column:
            fixed.append(("no_time_column", "REJECT"))
        elif time_column not in kinds:
            fixed.append((f"time_column_missing:{time_column}", "REJECT"))
        elif not re.match(DATED, kinds[time_column]):
            fixed.append((f"time_column_undated:{time_column}", "REJECT"))
    spark = df.sparkSession
    named = spark.createDataFrame([(f,) for f in features], "f string").where(F.col("f").rlike(by_name(PROTECTED))).select(F.concat(F.lit("protected:"), "f").alias("finding"), F.lit("LIMITED").alias("verdict"))
    out = spark.createDataFrame(fixed, "finding string, verdict string").unionByName(named)
    p = profiles.where(F.col("column") == target)
    rate = F.col("null_rate")
    out = out.unionByName(p.where(rate > 0).select(F.when(rate > TARGET_NULLS, "target_nulls").otherwise("some_target_nulls").alias("finding"), F.when(rate > TARGET_NULLS, "REJECT").otherwise("LIMITED").alias("verdict")))
    out = out.unionByName(profiles.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows")).where(F.col("rows") < LEAST_ROWS).select(F.lit("too_few_rows").alias("finding"), F.lit("REJECT").alias("verdict")))
    if task == "classification" and target in kinds:
        n = df.where(F.col(target).isNotNull()).groupBy(target).count().agg((F.min("count") / F.sum("count")).alias("least"))
        sound = out.agg((F.count_if(F.col("verdict") == "REJECT") == 0).alias("sound"))
        out = out.unionByName(n.where(F.col("least") < MINORITY).crossJoin(sound).where("sound").select(F.lit("class_imbalance").alias("finding"), F.lit("LIMITED").alias("verdict")))  # one row each
    return out


def verdict(findings: DataFrame) -> DataFrame:
    return findings.agg(F.when(F.count_if(F.col("verdict") == "REJECT") > 0, "REJECT").when(F.count_if(F.col("verdict") == "LIMITED") > 0, "LIMITED").otherwise("PROCEED").alias("verdict"))


# Kinds of analysis that a text asks for, in the order in which they are tried.
INTENTS = (
    ("CAUSAL", r"\bcaus(e|es|ed|ing|al)\b|\bimpact of\b|\beffect of\b"),
    ("FORECASTING", r"\bforecast|\bproject(ion)?\b|\bnext (week|month|quarter|year)\b|\bfuture\b"),
    ("PREDICTIVE", r"\bpredict|\blikelihood\b|\bprobability\b|\bwill (churn|convert|buy)\b|\bclassify\b"),
    ("ANOMALY_DETECTION", r"\banomal|\boutlier|\bunusual\b|\bunexpected(ly)?\b|\bspike\b"),
    ("PRESCRIPTIVE", r"\bshould we\b|\brecommend|\bwhat should\b|\boptimi[sz]e\b|\bbest action\b"),
    ("COMPARATIVE", r"\bcompar|\bversus\b|\bvs\.?\b|\bcompared to\b|\bchange from\b"),
    ("SEGMENTATION", r"\bsegment|\bcohort|\bcluster"),
    ("DIAGNOSTIC", r"\bwhy\b|\bdriver|\broot cause\b|\bcontribut"),
)


def tag_intent(text: Column) -> Column:
    out = F.when(trim(F.coalesce(text, F.lit(""))) != "", "DESCRIPTIVE").otherwise("UNCLASSIFIED")
    for kind, pattern in reversed(INTENTS):
        out = F.when(text.rlike(f"(?i){pattern}"), kind).otherwise(out)
    return out


def descriptive(df: DataFrame, group_by: list[str], metric: dict[str, str], guard: bool = True) -> Result:
    return aggregate(df, group_by, [metric], guard=guard)


def comparative(df: DataFrame, dims: list[str], metric: dict[str, str], before: Column, after: Column) -> DataFrame:
    """The metric in two periods, its difference and its change in percent, for each combination of ``dims``."""
    sides = [aggregate_plan(df.where(w), dims, [metric | {"name": n}]).select(*[F.col(d).alias(f"{d}_{n}") for d in dims], n) for w, n in ((before, "before"), (after, "after"))]
    joined = sides[0].join(sides[1], [sides[0][f"{d}_before"].eqNullSafe(sides[1][f"{d}_after"]) for d in dims], "full")
    out = joined.select(*[F.coalesce(f"{d}_before", f"{d}_after").alias(d) for d in dims], F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    out = out.withColumn("difference", F.col("after") - F.col("before"))
    return out.withColumn("percent_change", F.when(F.col("before") != 0, 100 * F.col("difference") / F.col("before")))


def contributions(df: DataFrame, dim: str, metric: dict[str, str], before: Column, after: Column) -> DataFrame:
    """What each segment adds to the total change, and its share; shares add up to 1."""
    parts = comparative(df, [dim], metric, before, after)
    total = parts.agg(F.sum("difference").alias("total_change"))
    return parts.crossJoin(total).withColumn("share", F.when(F.col("total_change") != 0, F.col("difference") / F.col("total_change")))  # one row
