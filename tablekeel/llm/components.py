"""Connected components by alternating large-star and small-star steps, each step settled in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablekeel.core import scratch
from tablekeel.llm.common import discard


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, component): the smallest node reachable, for every node that has an edge.

    A node's neighbours are never gathered: each step takes the smallest one by a partial sum and
    joins it back. The number of edges does not grow, and steps end after about log² of the size.
    A step's table is summed up as it is written, which tells whether anything changed, and deleted
    once the next one is written; only the last one stays.
    """
    spark, written, sums = edges.sparkSession, [], {}

    def step(df: DataFrame) -> DataFrame:
        path, seen = scratch(spark, "edges"), Observation(f"edges-{uuid.uuid4().hex}")
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(2**31))).alias("s")).write.parquet(path)
        sums.update(seen.get)
        for old in written:
            discard(spark, old)
        written[:] = [path]
        return spark.read.schema(df.schema).parquet(path)

    edges = step(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = dict(sums)
        if now == state or not now["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = step(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        down = edges.join(least, "a")
        edges = step(down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct())
