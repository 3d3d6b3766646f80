"""A corpus pipeline over ``documents``: language, lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again for
the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.llm.common import prepare_python, settle, table
from tablekeel.llm.decontaminate import remove_leaks
from tablekeel.llm.language_id import keep_identified, learn_from_folds
from tablekeel.llm.line_dedup import dedup_lines
from tablekeel.llm.near_copies import keep_one
from tablekeel.llm.packing import pack_documents



def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected.

    Null and empty texts and texts without a letter have no language and go. Rows that repeat an
    id or a text are judged each by itself, long texts whole. An empty table gives an empty one.
    """
    prepare_python(spark)
    return keep_identified(docs, learn_from_folds(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller document holds; every row stays.

    Null text becomes empty. A line of a row without an id goes if any other row holds it. Of rows
    that repeat an id each keeps its own lines. ``n_chars`` follows the text. An empty table gives
    an empty one.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = dedup_lines(docs, keep=others)
    return done.select(*[c if c in ("doc_id", "text") else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("rest")[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash candidates whose five-word shingles agree to 0.8 or more.

    The smallest id of a group stays, and of rows that repeat it one. Null, empty and blank texts
    are copies of each other. Long texts are compared whole. An empty table gives an empty one.
    """
    prepare_python(spark)
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; those that are mostly such passages go.

    Null and empty texts stay as they are, and so do rows that repeat an id. Items that are null or
    without words, and an empty ``benchmark``, take nothing away. An empty table gives an empty one.
    """
    done = remove_leaks(docs, table(spark, sf_dir, "benchmark"))
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4096 tokens.

    Null and empty texts are one token, rows that repeat an id are packed each by itself, and only
    texts of more than 4096 tokens are cut. An empty table gives an empty one.
    """
    prepare_python(spark)
    return pack_documents(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("packing", packing)]
#: SQL can express neither compression nor the packing program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
