"""Equi-joins with evidence taken from key counts: only the join asked for runs on whole rows."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeel.core import Refused, Result, hashable, missing, name, quoted, require, sample, stored

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}
CARDINALITY = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")


#: Rows of a key on one side from which on they are split over several tasks, and how many keys are split at most, the largest first.
HOT_ROWS, MOST_HOT = 1_000_000, 10_000


def _right_names(left: DataFrame, right: DataFrame) -> dict[str, str]:
    taken = set(left.columns)
    return {c: c if c not in taken else f"{c}_right" for c in right.columns}


def _check(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str | None = None) -> None:
    problems = missing(left, left_keys) + missing(right, right_keys)
    problems += [f"column {c!r} occurs twice" for df in (left, right) for c in dict.fromkeys(df.columns) if df.columns.count(c) > 1]
    if not left_keys or len(left_keys) != len(right_keys):
        problems.append("the key lists are empty or differ in length")
    if not problems:
        lt, rt = dict(left.dtypes), dict(right.dtypes)
        problems += [f"key types differ: {a} {lt[a]}, {b} {rt[b]}" for a, b in zip(left_keys, right_keys, strict=True) if lt[a] != rt[b]]
    if how:
        made = [*left.columns, *(n for c, n in _right_names(left, right).items() if how == "outer" or c not in right_keys)]
        problems += [f"the join would have two columns {c!r}" for c in dict.fromkeys(made) if made.count(c) > 1]
    require(problems)


def _on(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> Column:
    return reduce(and_, (left[name(a)] == right[name(b)] for a, b in zip(left_keys, right_keys, strict=True)))


def plain_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str, kind: str | None = None) -> DataFrame:
    """Keys are merged but for ``outer``; other right columns that clash get ``_right``. Null keys match nothing. ``kind`` joins otherwise than ``how``, whose columns it has."""
    names = _right_names(left, right)
    renamed = right.select(*[right[name(c)].alias(f"_r_{c}") for c in right.columns])
    other = {c: renamed[name(f"_r_{c}")] for c in right.columns}
    joined = left.join(renamed, reduce(and_, (left[name(a)] == other[b] for a, b in zip(left_keys, right_keys, strict=True))), HOW[kind or how])
    of = dict(zip(left_keys, right_keys, strict=True))
    own = [F.coalesce(left[name(c)], other[of[c]]).alias(c) if how == "right" and c in of else left[name(c)] for c in left.columns]
    rest = [other[c].alias(names[c]) for c in right.columns if how == "outer" or c not in right_keys]
    return joined.select(*own, *rest)


def hot_keys(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``k0, k1, ..., lc, rc``: keys that both sides have and one of them in at least ``hot_rows`` rows, the ``MOST_HOT`` most frequent ones."""
    l, r = key_counts(left, left_keys, "lc"), key_counts(right, right_keys, "rc")
    both = l.join(r, [f"k{i}" for i in range(len(left_keys))])
    return both.where(F.greatest("lc", "rc") >= hot_rows).orderBy(F.desc(F.greatest("lc", "rc"))).limit(MOST_HOT)


def split_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str, hot: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same rows as ``plain_join``, with the rows of ``hot`` keys (see ``hot_keys``; the number of its rows is bounded) spread.

    The side that has more rows of a hot key is dealt to as many salts as it takes for ``hot_rows``
    each, the rows of the other side go to every salt. Both sides have these keys, so all their
    rows match and only the other keys need the outer kinds of join.
    """
    marks = [f"_k{i}" for i in range(len(left_keys))]
    salts, left_is_split = F.ceil(F.greatest("lc", "rc") / hot_rows).cast("int").alias("_salts"), (F.col("lc") >= F.col("rc")).alias("_left")
    found = F.broadcast(stored(hot.select(*[F.col(f"k{i}").alias(m) for i, m in enumerate(marks)], salts, left_is_split), "hot"))

    def dealt(df: DataFrame, keys: list[str], is_left: bool) -> tuple[DataFrame, DataFrame]:
        on = reduce(and_, (df[name(k)] == found[m] for k, m in zip(keys, marks, strict=True)))
        # by the row and where it lies: equal rows are spread too, and a repeated task salts as before
        one = F.array(F.pmod(F.xxhash64(F.spark_partition_id(), *[hashable(c, t) for c, t in df.dtypes]), F.col("_salts")).cast("int"))
        every = F.sequence(F.lit(0), F.col("_salts") - 1)
        salted = df.join(found, on).withColumn("_salt", F.explode(F.when(F.col("_left") == is_left, one).otherwise(every)))
        return df.join(found, on, "left_anti"), salted.select(*map(quoted, df.columns), "_salt")

    (cold_l, hot_l), (cold_r, hot_r) = dealt(left, left_keys, True), dealt(right, right_keys, False)
    spread = plain_join(hot_l, hot_r, [*left_keys, "_salt"], [*right_keys, "_salt"], how, "inner").drop("_salt", "_salt_right")
    return plain_join(cold_l, cold_r, left_keys, right_keys, how).unionByName(spread)


def unmatched(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """Left rows without a partner; rows with a null key are among them. Of the right side only distinct keys are shuffled."""
    keys = right.select(*[right[name(k)].alias(f"_r_{k}") for k in right_keys]).distinct()
    return left.join(keys, reduce(and_, (left[name(a)] == keys[name(f"_r_{b}")] for a, b in zip(left_keys, right_keys, strict=True))), "left_anti")


def key_counts(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    return df.groupBy(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias(n))


def join_evidence(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str = "inner") -> DataFrame:
    """One row: rows and unmatched rows of each side, matched pairs, match rates, rows out and how often left rows multiply."""
    return _evidence(left, right, left_keys, right_keys, how).drop("hottest")


def _evidence(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str) -> DataFrame:
    l, r = key_counts(left, left_keys, "lc"), key_counts(right, right_keys, "rc")
    pairs = l.join(r, [l[f"k{i}"] == r[f"k{i}"] for i in range(len(left_keys))], "full")
    zero = F.lit(0).cast("long")
    sums = pairs.agg(
        F.coalesce(F.sum("lc"), zero).alias("rows_left"), F.coalesce(F.sum("rc"), zero).alias("rows_right"),
        F.coalesce(F.sum(F.col("lc") * F.col("rc")), zero).alias("matched"),
        F.coalesce(F.sum(F.when(F.col("rc").isNull(), F.col("lc"))), zero).alias("unmatched_left"),
        F.coalesce(F.sum(F.when(F.col("lc").isNull(), F.col("rc"))), zero).alias("unmatched_right"),
        F.coalesce(F.sum(F.when(F.col("lc") > 1, F.lit(1)).otherwise(0)), zero).alias("duplicate_keys_left"),
        F.coalesce(F.sum(F.when(F.col("rc") > 1, F.lit(1)).otherwise(0)), zero).alias("duplicate_keys_right"),
        F.coalesce(F.max(F.when(F.col("lc").isNotNull() & F.col("rc").isNotNull(), F.greatest("lc", "rc"))), zero).alias("hottest"),
    )
    out = F.col("matched") + (F.col("unmatched_left") if how in ("left", "outer") else 0) + (F.col("unmatched_right") if how in ("right", "outer") else 0)

    def rate(lost: str, all_: str) -> Column:
        return F.when(F.col(all_) == 0, 1.0).otherwise(1 - F.col(lost) / F.col(all_))

    rates = sums.withColumns({"match_rate_left": rate("unmatched_left", "rows_left"), "match_rate_right": rate("unmatched_right", "rows_right"), "rows_out": out})
    return rates.withColumn("multiplication", F.when(F.col("rows_left") == 0, 1.0).otherwise(F.col("rows_out") / F.col("rows_left")))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("count")).filter("count > 1")


def join(
    left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str, expected_cardinality: str, allow_many_to_many: bool = False, guard: bool = True, hot_rows: int = HOT_ROWS
) -> Result:
    """Join after checking that keys are as unique as ``expected_cardinality`` says; several null keys count as a duplicate.

    The key counts of the guard also tell whether a key that both sides have is hot; such keys are
    joined apart, see ``split_join``. ``hot_keys`` in the evidence is their number.
    """
    problems = [f"unknown join {how!r}"] * (how not in HOW) + [f"unknown cardinality {expected_cardinality!r}"] * (expected_cardinality not in CARDINALITY)
    require(problems + ["many_to_many must be allowed explicitly"] * (expected_cardinality == "many_to_many" and not allow_many_to_many))
    _check(left, right, left_keys, right_keys, how)
    if not guard:
        return Result(plain_join(left, right, left_keys, right_keys, how))
    evidence = _evidence(left, right, left_keys, right_keys, how).first().asDict()
    for side, df, keys, unique in (("left", left, left_keys, ("one_to_one", "one_to_many")), ("right", right, right_keys, ("one_to_one", "many_to_one"))):
        if expected_cardinality in unique and evidence[f"duplicate_keys_{side}"]:
            evidence["duplicates"] = sample(duplicate_keys(df, keys))
            raise Refused("DATA_QUALITY_BLOCK", f"{evidence[f'duplicate_keys_{side}']} keys of the {side} side repeat, {expected_cardinality} was declared", evidence)
    if evidence.pop("hottest") < hot_rows:
        return Result(plain_join(left, right, left_keys, right_keys, how), evidence | {"hot_keys": 0}, evidence["rows_left"], evidence["rows_out"])
    hot = stored(hot_keys(left, right, left_keys, right_keys, hot_rows), "hot")
    return Result(split_join(left, right, left_keys, right_keys, how, hot, hot_rows), evidence | {"hot_keys": hot.count()}, evidence["rows_left"], evidence["rows_out"])


# Least share of left rows that should match, and how often left rows may multiply.
MATCH_RATE, MULTIPLICATION = 0.5, 2.0
ISSUE = "issue string, severity string"
# How the keys of a join were found.
KEY_EVIDENCE = ("GOVERNED_MAPPING", "EXPLICIT_USER_MAPPING", "NAME_SIMILARITY_ONLY")


def _must_be_unique(cardinality: str | None) -> tuple[bool, bool]:
    return cardinality in ("one_to_one", "one_to_many"), cardinality in ("one_to_one", "many_to_one")


def declared_issues(left: dict[str, str], right: dict[str, str], left_keys: list[str], right_keys: list[str], key_evidence: str, cardinality: str | None, allow_many_to_many: bool = False, ambiguous: list[str] | None = None) -> list[tuple[str, str]]:
    """What is wrong with a join as it is declared, from the columns' types (name -> type) alone; each issue once."""
    require([f"unknown key evidence {key_evidence!r}"] * (key_evidence not in KEY_EVIDENCE) + [f"unknown cardinality {cardinality!r}"] * (cardinality not in (None, *CARDINALITY)))
    found = []
    if not left_keys or not right_keys:
        found.append(("NO_JOIN_KEYS", "BLOCKING"))
    elif len(left_keys) != len(right_keys):
        found.append(("KEY_COUNT_MISMATCH", "BLOCKING"))
    if any(k not in left for k in left_keys) or any(k not in right for k in right_keys):
        found.append(("KEY_MISSING", "BLOCKING"))
    if key_evidence == "NAME_SIMILARITY_ONLY":
        found.append(("NAME_SIMILARITY_ONLY", "BLOCKING"))
    if not found or found == [("NAME_SIMILARITY_ONLY", "BLOCKING")]:
        found += [("KEY_DTYPE_MISMATCH", "BLOCKING")] * any(left[a] != right[b] for a, b in zip(left_keys, right_keys, strict=True))
    if ambiguous:
        found.append(("AMBIGUOUS_KEY_CANDIDATES", "NEEDS_CLARIFICATION"))
    if cardinality is None:
        found.append(("CARDINALITY_UNDECLARED", "NEEDS_CLARIFICATION"))
    elif cardinality == "many_to_many" and not allow_many_to_many:
        found.append(("UNAPPROVED_MANY_TO_MANY", "BLOCKING"))
    return found


def _resolved(issues: list[tuple[str, str]]) -> bool:
    return not {"NO_JOIN_KEYS", "KEY_COUNT_MISMATCH", "KEY_MISSING"} & {i for i, _ in issues}


def data_issues(evidence: DataFrame, cardinality: str | None, match_rate: float = MATCH_RATE, multiplication: float = MULTIPLICATION) -> DataFrame:
    """Issues that ``join_evidence`` shows: repeated keys where the cardinality has none block, the others only warn."""
    left, right = _must_be_unique(cardinality)
    repeated = (F.lit(left) & (F.col("duplicate_keys_left") > 0)) | (F.lit(right) & (F.col("duplicate_keys_right") > 0))

    def issue(when: Column, name: str, severity: str) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity")))

    issues = F.array(
        issue(repeated, "DUPLICATE_KEY", "BLOCKING"),
        issue(F.col("match_rate_left") < match_rate, "LOW_MATCH_RATE", "WARNING"),
        issue(F.col("multiplication") > multiplication, "AMPLIFICATION_RISK", "WARNING"),
    )
    return evidence.select(F.explode(F.array_compact(issues)).alias("i")).select("i.*")


def review(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str, key_evidence: str, cardinality: str | None = None, allow_many_to_many: bool = False, ambiguous: list[str] | None = None, match_rate: float = MATCH_RATE, multiplication: float = MULTIPLICATION) -> DataFrame:
    """Issues of a join as rows ``issue, severity``, from its declaration and, if its keys exist, from the data."""
    declared = declared_issues(dict(left.dtypes), dict(right.dtypes), left_keys, right_keys, key_evidence, cardinality, allow_many_to_many, ambiguous)
    out = left.sparkSession.createDataFrame(declared, ISSUE)
    if not _resolved(declared) or ("KEY_DTYPE_MISMATCH", "BLOCKING") in declared:
        return out
    return out.unionByName(data_issues(join_evidence(left, right, left_keys, right_keys, how), cardinality, match_rate, multiplication))


def review_profiles(left: list[dict[str, Any]], right: list[dict[str, Any]], left_keys: list[str], right_keys: list[str], key_evidence: str, cardinality: str | None = None, allow_many_to_many: bool = False, ambiguous: list[str] | None = None) -> list[tuple[str, str]]:
    """Issues from stored profiles (rows of ``column, dtype, is_key``) without the data: uniqueness holds only for a single key column that is a candidate key."""
    sides = [{p["column"]: p for p in side} for side in (left, right)]
    types = [{c: p["dtype"] for c, p in side.items()} for side in sides]
    issues = declared_issues(*types, left_keys, right_keys, key_evidence, cardinality, allow_many_to_many, ambiguous)
    if _resolved(issues):
        for side, keys, unique in zip(sides, (left_keys, right_keys), _must_be_unique(cardinality), strict=True):
            if unique and not (len(keys) == 1 and side[keys[0]]["is_key"]):
                issues.append(("UNIQUENESS_UNVERIFIED", "NEEDS_CLARIFICATION"))
    return issues


def decision(issues: DataFrame) -> DataFrame:
    """One row ``decision``: REJECT if anything blocks, CLARIFY if anything has to be asked, else APPROVE. Warnings approve."""
    blocks, asks = (F.count_if(F.col("severity") == s) > 0 for s in ("BLOCKING", "NEEDS_CLARIFICATION"))
    return issues.agg(F.when(blocks, "REJECT").when(asks, "CLARIFY").otherwise("APPROVE").alias("decision"))
