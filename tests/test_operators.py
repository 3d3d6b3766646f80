"""Operators on small literal tables: values, evidence and refusals."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablekeel.core import Refused
from tablekeel.operators.groups import aggregate, deduplicate, pivot, unpivot
from tablekeel.operators.joins import decision, join, review, review_profiles
from tablekeel.operators.rows import cast, derive, select_filter
from tablekeel.operators.text_clean import text_clean


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def refused(code, f, *args, **kwargs):
    with pytest.raises(Refused) as e:
        f(*args, **kwargs)
    assert e.value.code == code
    return e.value


def test_filter_counts_what_it_drops_and_refuses_unknown_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, x string")
    got = select_filter(df, ["id"], [{"column": "x", "op": "!=", "value": "a"}])
    assert rows(got.output) == [(3,)] and got.evidence["rows_filtered_out"] == 2 and got.is_lossy
    assert rows(select_filter(df, ["id"], [{"column": "x", "op": "is_null"}]).output) == [(2,)]
    refused("VALIDATION_FAIL", select_filter, df, ["y"])
    refused("VALIDATION_FAIL", select_filter, df, None, [{"column": "x", "op": "not_in", "value": ["a", None]}])
    refused("VALIDATION_FAIL", select_filter, df, None, [{"column": "x", "op": "<"}])


def test_cast_refuses_below_the_threshold_and_keeps_a_sample(spark):
    df = spark.createDataFrame([("1",), ("2",), ("not_a_number",), ("4",), (None,)], "mixed string")
    assert refused("DATA_QUALITY_BLOCK", cast, df, [{"column": "mixed", "target_type": "Int64"}]).evidence["mixed"]["failed"] == 1
    got = cast(df, [{"column": "mixed", "target_type": "Int64", "parseability_threshold": 0.5}])
    assert got.evidence["mixed"]["failed_sample"] == ["not_a_number"] and rows(got.output) == [(1,), (2,), (4,), (None,), (None,)]
    lenient = spark.createDataFrame([(" 1 ",), ("1.5",)], "x string")
    assert rows(cast(lenient, [{"column": "x", "target_type": "Int64"}], guard=False).output) == [(None,), (None,)]
    assert rows(cast(spark.createDataFrame([("2024-1-5",), ("2024",)], "x string"), [{"column": "x", "target_type": "Date"}], guard=False).output) == [(None,), (None,)]
    refused("VALIDATION_FAIL", cast, df, [{"column": "mixed", "target_type": "Duration"}])


def test_derive_divides_by_zero_and_gates_nulls(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "a double, b double")
    got = [r[0] for r in derive(df, [{"output_column": "c", "op": "divide", "inputs": ["a", "b"]}]).output.select("c").collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3] == 0.5
    holes = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    refused("VALIDATION_FAIL", derive, holes, [{"output_column": "c", "op": "coalesce", "inputs": ["a", "b"]}])
    assert rows(derive(holes, [{"output_column": "c", "op": "add", "inputs": ["a", "b"], "null_policy": "propagate"}]).output) == [(1, None, None), (2, 3, 5)]
    refused("VALIDATION_FAIL", derive, df, [{"output_column": "a", "op": "add", "inputs": ["a", "b"]}])
    refused("VALIDATION_FAIL", derive, df, [{"output_column": "c", "op": "add", "inputs": ["a"]}])


def test_join_evidence_and_refusals(spark):
    left = spark.createDataFrame([(1, "E"), (2, "W"), (3, "N")], "order_id long, region string")
    right = spark.createDataFrame([(1, "Ann"), (2, "Bo")], "order_id long, region string")
    got = join(left, right, ["order_id"], ["order_id"], "left", "one_to_one")
    assert (got.evidence["matched"], got.evidence["unmatched_left"], got.evidence["multiplication"]) == (2, 1, 1.0)
    assert got.output.columns == ["order_id", "region", "region_right"]
    twice = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    refused("VALIDATION_FAIL", join, twice, twice, ["id"], ["id"], "inner", "many_to_many")
    assert join(twice, twice, ["id"], ["id"], "inner", "many_to_many", True).output.count() == 5
    assert refused("DATA_QUALITY_BLOCK", join, twice, twice, ["id"], ["id"], "inner", "one_to_one").evidence["duplicates"]
    refused("VALIDATION_FAIL", join, left, spark.createDataFrame([("1",)], "order_id string"), ["order_id"], ["order_id"], "inner", "one_to_one")


def test_join_review(spark):
    once, twice = (spark.createDataFrame([(k,) for k in ks], "id long") for ks in ([1, 2, 3], [1, 1, 2]))
    kinds = lambda *a, **k: rows(review(*a, **k))
    assert kinds(once, twice, ["id"], ["id"], "left", "GOVERNED_MAPPING", "one_to_one") == [("DUPLICATE_KEY", "BLOCKING")]  # one repeated side is enough
    assert kinds(once, twice, ["id"], ["id"], "left", "GOVERNED_MAPPING", "one_to_many") == []
    far = spark.createDataFrame([(k,) for k in (1, 8, 9)], "id long")
    low = review(far, once, ["id"], ["id"], "left", "GOVERNED_MAPPING", "one_to_one")
    assert rows(low) == [("LOW_MATCH_RATE", "WARNING")] and rows(decision(low)) == [("APPROVE",)]  # warnings approve
    many = spark.createDataFrame([(1,)] * 9, "id long")
    assert kinds(once, many, ["id"], ["id"], "left", "GOVERNED_MAPPING", "one_to_many", match_rate=0.0) == [("AMPLIFICATION_RISK", "WARNING")]
    assert kinds(once, once, ["id"], ["id"], "left", "NAME_SIMILARITY_ONLY", "one_to_one") == [("NAME_SIMILARITY_ONLY", "BLOCKING")]
    assert kinds(once, once, ["id"], ["no"], "left", "GOVERNED_MAPPING") == [("CARDINALITY_UNDECLARED", "NEEDS_CLARIFICATION"), ("KEY_MISSING", "BLOCKING")]
    assert kinds(once, once, [], [], "left", "GOVERNED_MAPPING", "one_to_one") == [("NO_JOIN_KEYS", "BLOCKING")]
    assert kinds(once, once, ["id"], ["id"], "left", "GOVERNED_MAPPING", "many_to_many") == [("UNAPPROVED_MANY_TO_MANY", "BLOCKING")]
    assert rows(decision(review(once, once, ["id"], ["id"], "left", "GOVERNED_MAPPING", "one_to_one", ambiguous=["a", "b"]))) == [("CLARIFY",)]
    key = {"column": "id", "dtype": "bigint", "is_key": True}
    assert review_profiles([key], [key], ["id"], ["id"], "GOVERNED_MAPPING", "one_to_one") == []
    assert review_profiles([key], [key | {"is_key": False}], ["id"], ["id"], "GOVERNED_MAPPING", "one_to_one") == [("UNIQUENESS_UNVERIFIED", "NEEDS_CLARIFICATION")]
    assert review_profiles([key], [key | {"dtype": "string"}], ["id"], ["id"], "GOVERNED_MAPPING", "one_to_one") == [("KEY_DTYPE_MISMATCH", "BLOCKING")]


def test_overflow_is_refused(spark):
    df = spark.createDataFrame([(2**62, 4), (1, 1)], "a long, b long")
    assert refused("DATA_QUALITY_BLOCK", derive, df, [{"output_column": "c", "op": "multiply", "inputs": ["a", "b"]}]).evidence["c"]["overflows"] == 1
    assert rows(derive(df, [{"output_column": "c", "op": "multiply", "inputs": ["a", "b"]}], guard=False).output) == [(1, 1, 1), (2**62, 4, None)]


def test_totals_that_are_no_numbers_agree_with_nothing(spark):
    metric = [{"name": "s", "column": "x", "fn": "sum"}]
    for bad in (math.nan, math.inf, 1e35):
        refused("RECONCILIATION_FAIL", aggregate, spark.createDataFrame([("a", bad), ("b", 1.0)], "k string, x double"), ["k"], metric)
    refused("VALIDATION_FAIL", aggregate, spark.createDataFrame([("a", "1")], "k string, x string"), ["k"], metric)
    big = spark.createDataFrame([("a", 1e23), ("b", 1.0)], "k string, x double")
    assert aggregate(big, ["k"], metric, relative=1e-9).evidence["group_count"] == 2


def test_evidence_of_cleaning_follows_the_chain(spark):
    df = spark.createDataFrame([(" item-12 ",), ("ITEM-13",)], "sku string")
    got = text_clean(df, [{"column": "sku", "steps": ["trim"]}, {"column": "sku", "steps": ["upper"]}], [{"column": "sku", "pattern": r"^ITEM-(\d+)$", "output_column": "n"}], [{"column": "sku", "pattern": "ITEM", "replacement": "I"}])
    assert rows(got.output) == [("I-12", "12"), ("I-13", "13")]
    assert got.evidence["n"]["match_count"] == 2 and got.evidence["sku replaced"]["changed_count"] == 2
    both = spark.createDataFrame([(" a",), ("A",)], "x string")  # neither step alone makes them equal
    refused("DATA_QUALITY_BLOCK", text_clean, both, [{"column": "x", "steps": ["trim"]}, {"column": "x", "steps": ["lower"]}])


keys = st.lists(st.one_of(st.none(), st.integers(0, 4)), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys, keys)
def test_key_counts_give_what_joins_give(spark, a, b):
    left, right = (spark.createDataFrame([(k,) for k in x], "k int") for x in (a, b))
    for how in ("inner", "left", "right", "outer"):
        got = join(left, right, ["k"], ["k"], how, "many_to_many", True)
        assert got.evidence["rows_out"] == got.output.count()


def test_aggregate_reconciles(spark):
    df = spark.createDataFrame([("E", 10.0), ("E", None), (None, 5.5)], "region string, amount double")
    got = aggregate(df, ["region"], [{"name": "s", "column": "amount", "fn": "sum"}, {"name": "u", "column": "amount", "fn": "n_unique"}], reconcile_to=15.5)
    assert rows(got.output) == [("E", 10.0, 2), (None, 5.5, 1)] and got.evidence["group_count"] == 2
    refused("RECONCILIATION_FAIL", aggregate, df, ["region"], [{"name": "s", "column": "amount", "fn": "sum"}], reconcile_to=99.0)
    refused("VALIDATION_FAIL", aggregate, df, [], [{"name": "c", "column": "amount", "fn": "count"}], reconcile_to=1.0)
    empty = df.where("false")
    assert rows(aggregate(empty, [], [{"name": "s", "column": "amount", "fn": "sum"}]).output) == [(0.0,)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 2))), max_size=10))
def test_kept_and_removed_rows_make_up_the_input(spark, data):
    df = spark.createDataFrame(data, "k int, v int")
    for keep in ("first", "last"):
        got = deduplicate(df, ["k"], keep, ["v"])
        assert rows(got.output.unionAll(got.evidence["removed"])) == rows(df)
        assert got.output.count() == len({k for k, _ in data})


def test_pivot_and_unpivot(spark):
    df = spark.createDataFrame([("Ann", "maths", 90), ("Ann", "physics", 80), ("Bo", "maths", 70)], "student string, subject string, score long")
    wide = pivot(df, ["student"], "subject", "score")
    assert rows(wide.output) == [("Ann", 90, 80), ("Bo", 70, None)]
    long = unpivot(wide.output, ["student"], ["maths", "physics"], "subject", "score").output.where("score IS NOT NULL")
    assert rows(long) == rows(df)
    twice = df.unionAll(df.limit(1))
    assert refused("DATA_QUALITY_BLOCK", pivot, twice, ["student"], "subject", "score").evidence["duplicates"]
    assert rows(pivot(df.unionAll(df), ["student"], "subject", "score", "sum").output)[0] == ("Ann", 180, 160)
    refused("VALIDATION_FAIL", pivot, df, ["student"], "subject", "score", "first")
    refused("VALIDATION_FAIL", unpivot, wide.output, ["student"], ["maths"], "student", "v")


def test_text_clean_refuses_to_merge_values(spark):
    df = spark.createDataFrame([("ABC",), ("abc",), (None,)], "code string")
    refused("DATA_QUALITY_BLOCK", text_clean, df, [{"column": "code", "steps": ["lower"]}])
    assert rows(text_clean(df, [{"column": "code", "steps": ["lower"]}], allow_identity_collapse=True).output) == [("abc",), ("abc",), (None,)]
    name = spark.createDataFrame([("  o'neil-smith \t jones ",)], "name string")
    assert rows(text_clean(name, [{"column": "name", "steps": ["collapse_whitespace", "title"]}]).output) == [("O'Neil-Smith Jones",)]
    sku = spark.createDataFrame([("ITEM-1234-x",), ("none",)], "sku string")
    got = text_clean(sku, regex_extract=[{"column": "sku", "pattern": r"ITEM-(\d+)-", "output_column": "n"}], regex_replace=[{"column": "sku", "pattern": r"[^\d]", "replacement": ""}])
    assert rows(got.output) == [("", None), ("1234", "1234")] and got.evidence["n"]["match_count"] == 1 and got.evidence["sku replaced"]["changed_count"] == 2
    refused("VALIDATION_FAIL", text_clean, sku, regex_replace=[{"column": "sku", "pattern": "(", "replacement": ""}])


def test_row_local_operators_give_the_same_on_a_stream(spark, tmp_path):
    df = spark.range(20).select("id", F.concat(F.lit(" X"), "id").alias("x"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    steps = lambda d: text_clean(select_filter(d, None, [{"column": "id", "op": ">", "value": 5}], guard=False).output, [{"column": "x", "steps": ["trim", "lower"]}], guard=False).output
    steps(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(steps(df))
