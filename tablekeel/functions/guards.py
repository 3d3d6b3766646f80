"""Personal data and injected content: patterns, scans, masks and defusal, all as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeel.core import quoted

# Column names that tell of personal data, in the order in which they are tried.
NAMES = (
    ("authentication_secret", r"password|passwd|secret|api[_-]?key|access[_-]?token|auth[_-]?token|credential"),
    ("government_identifier", r"\bssn\b|social[_-]?security|passport|national[_-]?id|tax[_-]?id|\bein\b"),
    ("payment_data", r"credit[_-]?card|card[_-]?number|\bcvv\b|\bcvc\b|card[_-]?holder"),
    ("financial_account_data", r"account[_-]?number|\biban\b|routing[_-]?number|bank[_-]?account|\bswift\b"),
    ("health_data", r"diagnosis|icd[_-]?code|medical|health[_-]?record|prescription"),
    ("precise_location", r"latitude|longitude|\bgps\b|geo[_-]?location|precise[_-]?location"),
    ("contact_data", r"e[-_]?mail|phone|mobile|street[_-]?address|zip[_-]?code|postal[_-]?code"),
    ("employee_data", r"employee|\bstaff\b|hire[_-]?date|salary|payroll"),
    ("personal_identifier", r"full[_-]?name|first[_-]?name|last[_-]?name|customer[_-]?name|date[_-]?of[_-]?birth|\bdob\b|birth[_-]?date"),
)
#: Where a short word begins or ends: an underscore counts as a boundary too, so that customer_ssn is found.
EDGE = "(?:(?<![a-z0-9])(?=[a-z0-9])|(?<=[a-z0-9])(?![a-z0-9]))"


def by_name(pattern: str) -> str:
    """The pattern for column names, whatever their case."""
    return "(?i)" + pattern.replace(r"\b", EDGE)


# Shapes of e-mail addresses, social security numbers and card numbers.
VALUES = (("contact_data", r"^[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}$"), ("government_identifier", r"^\d{3}-\d{2}-\d{4}$"), ("payment_data", r"^(?:\d[ -]?){13,19}$"))
# What a reader may see of each kind.
ACCESS = {"authentication_secret": "DENY", "government_identifier": "DENY", "payment_data": "DENY", "financial_account_data": "MASK", "health_data": "MASK", "precise_location": "MASK", "contact_data": "MASK", "employee_data": "MASK", "personal_identifier": "MASK", "public_non_sensitive": "ALLOW"}
# First characters of formulas, phrases that address a model, and dangerous payloads.
FORMULA = ("=", "+", "-", "@", "\t", "\r")
PROMPTS = (
    r"ignore (all |any )?(the )?(previous|prior|above) instructions", r"disregard (all |any )?(the )?(above|previous|prior)( instructions)?", r"reveal (your |the )?(system prompt|hidden prompt|instructions)",
    r"you are now (a|an|the)\b", r"act as (an?|the) (admin|root|system) (user|account)?", r"\bnew instructions?\s*:", r"\bsystem prompt\b",
)
PAYLOADS = (r";\s*drop\s+table\b", r"\bunion\s+select\b", r"\$\([^)]*\)", r"`[^`]+`", r"<script[\s>]", r"\bos\.system\(", r"\bexec\(", r"\beval\(")
#: What every match of these patterns holds, in small letters: only cells that hold one are looked at by pattern.
PROMPT_WORDS = ("ignore ", "disregard ", "reveal ", "you are now ", "act as ", "new instruction", "system prompt")
PAYLOAD_WORDS = ("drop", "union", "$(", "`", "<script", "os.system(", "exec(", "eval(")
# Fixed value: what stands for a masked cell.
MASK = "***MASKED***"


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def value_rates(df: DataFrame) -> DataFrame:
    """Rows ``column, kind, rate``: the share of a text column's non-empty values that have each shape, over the whole column."""
    cells = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.coalesce(F.count_if(quoted(c).rlike(p)) / F.nullif(F.count_if(quoted(c) != ""), F.lit(0)), F.lit(0.0)).alias("rate")) for c in text_columns(df) for k, p in VALUES]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def classify_fields(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows ``column, classification, access, confidence`` for every column, from names and shapes.

    Both agree: HIGH; they differ: the stricter one, MEDIUM; only the name: MEDIUM; only the
    shape: LOW; neither: public, MEDIUM.
    """
    spark = df.sparkSession
    name = F.lit(None).cast("string")
    for kind, pattern in reversed(NAMES):
        name = F.when(F.col("column").rlike(by_name(pattern)), kind).otherwise(name)
    named = spark.createDataFrame([(c,) for c in df.columns], "column string").withColumn("by_name", name)
    found = value_rates(df).where(F.col("rate") >= least).withColumn("n", F.element_at(F.create_map(*[F.lit(x) for i, (k, _) in enumerate(VALUES) for x in (k, i)]), F.col("kind"))) if text_columns(df) else None
    shaped = found.groupBy("column").agg(F.min_by("kind", "n").alias("by_value")) if found is not None else spark.createDataFrame([], "column string, by_value string")
    access = F.create_map(*[F.lit(x) for kv in ACCESS.items() for x in kv])
    strict = F.create_map(F.lit("DENY"), F.lit(2), F.lit("MASK"), F.lit(1), F.lit("ALLOW"), F.lit(0))
    n, v = F.col("by_name"), F.col("by_value")
    stricter = F.when(strict[access[v]] > strict[access[n]], v).otherwise(n)
    joined = named.join(F.broadcast(shaped), "column", "left")  # a row a column
    kind = F.when(n.isNotNull() & v.isNotNull(), stricter).otherwise(F.coalesce(n, v, F.lit("public_non_sensitive")))
    sure = F.when(n.isNotNull() & v.isNotNull() & (n == v), "HIGH").when(n.isNull() & v.isNotNull(), "LOW").otherwise("MEDIUM")
    return joined.select("column", kind.alias("classification"), sure.alias("confidence")).withColumn("access", access[F.col("classification")])


def mask(df: DataFrame, access: dict[str, str]) -> DataFrame:
    """Drop columns whose access is DENY and replace those to MASK; works on streams."""
    return df.select(*[F.lit(MASK).alias(c) if access.get(c) == "MASK" else quoted(c) for c in df.columns if access.get(c) != "DENY"])


def is_formula(c: Column) -> Column:
    return F.substring(c, 1, 1).isin(*FORMULA)


def any_of(c: Column, patterns: tuple[str, ...], words: tuple[str, ...], low: Column | None = None) -> Column:
    """Whether a cell matches any of the patterns, whatever its case: one pattern for all, on cells that hold one of the ``words``; ``low`` is the cell in small letters."""
    low = F.lower(c) if low is None else low
    return F.when(reduce(or_, (F.contains(low, F.lit(w)) for w in words)), c.rlike(f"(?i)(?:{'|'.join(patterns)})")).otherwise(c.isNotNull() & F.lit(False))


#: kind -> (test of a cell and of the cell in small letters, severity, action)
SCANS = {
    "formula_injection": (lambda c, low=None: is_formula(c), "HIGH", "SANITIZE"),
    "prompt_injection": (lambda c, low=None: any_of(c, PROMPTS, PROMPT_WORDS, low), "MEDIUM", "SANITIZE"),
    "dangerous_payload": (lambda c, low=None: any_of(c, PAYLOADS, PAYLOAD_WORDS, low), "HIGH", "SANITIZE"),
}


def scan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows ``column, kind, cells, severity, action`` for text columns with flagged cells, from one aggregate over one scan."""
    wanted = columns or text_columns(df)
    both = df.select(*[x for i, c in enumerate(wanted) for x in (quoted(c).alias(f"c{i}"), F.lower(quoted(c)).alias(f"l{i}"))])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.count_if(test(F.col(f"c{i}"), F.col(f"l{i}"))).alias("cells"), F.lit(s).alias("severity"), F.lit(a).alias("action")) for i, c in enumerate(wanted) for k, (test, s, a) in SCANS.items()]
    return both.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*").where("cells > 0")


def decision(flags: DataFrame) -> DataFrame:
    """One row: BLOCK, SANITIZE or ALLOW. Cells never block a table by themselves; a caller's own flags may."""
    return flags.agg(F.when(F.count_if(F.col("action") == "BLOCK") > 0, "BLOCK").when(F.count_if(F.col("action") == "SANITIZE") > 0, "SANITIZE").otherwise("ALLOW").alias("decision"))


def defuse(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Put an apostrophe before cells that a spreadsheet would take for formulas."""
    changed = set(columns or text_columns(df))
    return df.select(*[F.when(is_formula(quoted(c)), F.concat(F.lit("'"), quoted(c))).otherwise(quoted(c)).alias(c) if c in changed else quoted(c) for c in df.columns])


def wrap_untrusted(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.concat(F.lit("[UNTRUSTED_DATA]"), quoted(c), F.lit("[/UNTRUSTED_DATA]")).alias(c) if c in columns else quoted(c) for c in df.columns])


def safe_sample(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first ``n`` rows as a reader may see them: classified, masked, scanned, and wrapped where flagged."""
    few = df.orderBy(*order_by).limit(n)
    access = {r["column"]: r["access"] for r in classify_fields(few).collect()}  # a row a column
    seen = mask(few, access)
    flagged = sorted({r["column"] for r in scan(seen).collect()}) if text_columns(seen) else []
    return wrap_untrusted(seen, flagged)
