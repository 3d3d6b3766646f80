"""Line dedup [native]: lines that several documents share stay in the smallest document alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.llm.common import ascii_lower, settle, table

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: A null id sorts after all others; all rows without an id count as one document.
NO_ID = 2**63 - 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Return per row ``doc_id, text`` (kept lines joined by newline), ``n_lines, n_dropped``, and a struct ``rest`` of the columns ``keep``.

    A line's key is the line without blanks at its ends and with A-Z lower-cased. Keys of at least
    ``min_chars`` code points that ``min_docs`` or more documents hold lose all their lines except
    in the smallest document holding them. Keys are told apart by 128 hashed bits.

    Null or empty text is one empty line. Rows that repeat an id count as one document, each keeps
    its own lines. Other columns are ignored. An empty table gives an empty table.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.lit(True).alias("_"), *keep).alias("rest"))
    base = base.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("row", F.xxhash64("text"))
    lines = base.select("id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    # one row a line from here on: no text is shuffled to find what is shared
    keyed = lines.where(F.char_length("key") >= min_chars).select("id", "row", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(min_chars), "key").alias("k2"))
    held = keyed.groupBy("k1", "k2")
    if min_docs == 2:  # two different documents hold it if the smallest and the largest differ: summed before the shuffle
        shared = held.agg(F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper < last")
    else:
        shared = keyed.groupBy("k1", "k2", "id").agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.min("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    shared = settle(shared.select("k1", "k2", "keeper"), "shared-lines")  # so that the join has shuffles of its own, and Spark may split a line that very many documents hold
    dropped = keyed.join(shared, ["k1", "k2"]).where(F.col("id") != F.col("keeper"))
    dropped = dropped.groupBy("id", "row").agg(F.collect_set("pos").alias("dropped"))
    whole = base.join(dropped, ["id", "row"], "left").withColumn("line", F.split("text", "\n", -1))
    whole = whole.withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("line") - 1), F.coalesce("dropped", F.array().cast("array<int>"))))
    return whole.select(
        "doc_id",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform("stay", lambda i: F.get("line", i)), "\n")).alias("text"),
        F.size("line").cast("long").alias("n_lines"),
        (F.size("line") - F.size("stay")).cast("long").alias("n_dropped"),
        *[F.col("rest").dropFields("_").alias("rest") for _ in keep[:1]],
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents; nulls, repeats, long texts and empty tables go as in ``dedup_lines``."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM docs),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
