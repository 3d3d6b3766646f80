"""SimHash near-dedup: segment-popcount embedding, grid range join under Manhattan distance, exact check.

A fingerprint of 64 bits is cut into 32 segments of two bits. Their bit counts are a point in 32
dimensions, and the Manhattan distance of two points is never more than the Hamming distance of
the fingerprints. A point is held in 64 bits with each count in unary, so that the Manhattan
distance of two points is again the number of differing bits.

The dimensions are dealt into ``distance + a`` groups. Two points within ``distance`` of each
other agree in at least ``a`` groups, so they share a cell in at least one of the grids that
``a`` groups span. Points that share a cell are compared, and the fingerprints verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb, log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.llm.common import settle, table
from tablekeel.llm.components import components

SEGMENTS = 32
LOW_BITS = 0x5555555555555555


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; a text of fewer words has one shingle, one without words none."""
    ws = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII blanks only
    if not ws:
        return np.zeros(0, np.uint64)
    joined = b" ".join(ws)
    if len(ws) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(ws) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each row of ``hashes`` (unsigned, 64 bits) the bits set in more than half of them, as a signed integer; of none: 0."""
    rows, n = hashes.shape
    ones = np.zeros((rows, 8, 8), np.int64)
    for at in range(0, n, 255):  # every eighth bit, added up in the bytes of a word
        part = hashes[:, at : at + 255]
        for k in range(8):
            ones[:, k] += np.add.reduce((part >> np.uint64(k)) & np.uint64(0x0101010101010101), axis=1).astype("<u8").view(np.uint8).reshape(rows, 8)
    bits = 2 * ones.transpose(0, 2, 1).reshape(rows, 64) > n
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(rows).astype(np.int64)


def text_id(text: str) -> list[Column]:
    """128 hashed bits that tell texts apart, in two halves ``row`` and ``row2``."""
    return [F.xxhash64(text).alias("row"), F.xxhash64(F.lit("second"), text).alias("row2")]


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return per row ``doc_id, row, row2`` (see ``text_id``) and ``fp``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "row": b.row, "row2": b.row2, "fp": np.array([majority(shingle_hashes(t, shingle)[None])[0] for t in b.text], np.int64)})

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), *text_id(text_col), F.col(text_col).alias("text"))
    return rows.mapInPandas(work, "doc_id string, row long, row2 long, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def _signed(bits: int) -> int:
    return bits - 2**64 if bits >= 2**63 else bits


def embed(fp: Column) -> Column:
    """Bit counts of the two-bit segments, each in unary: 00, 01 or 11."""
    low, half = F.lit(LOW_BITS), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


#: Bits of information in a two-bit segment's count; what a pair compared costs against a row dealt to a cell.
SEGMENT_BITS, PAIR_COST = log2(8 / 3), 0.2
#: A cell of more nodes than this, and than four times as many as chance puts there, is crowded; nodes in a block of it. Orders by which cells choose their centres.
CROWD, BLOCK, ORDERS = 16, 1000, 16


def grids(groups: int, agree: int) -> list[int]:
    """Bit masks of the grids over ``groups`` groups of segments: one for each choice of ``agree`` of them."""
    masks = [sum(3 << (2 * s) for s in range(SEGMENTS) if s % groups == g) for g in range(groups)]
    return [_signed(sum(c)) for c in combinations(masks, agree)]


def grids_within(distance: int, nodes: int) -> list[int]:
    """Grids of which any two points within ``distance`` share a cell: ``distance + a`` groups, of which at least ``a`` agree.

    More groups mean finer cells but more of them for a node. ``a`` is what makes the fewest rows
    and pairs for so many nodes; every choice finds the same pairs.
    """

    def work(a: int) -> float:
        return comb(distance + a, a) * (1 + PAIR_COST * nodes / 2 ** (SEGMENTS * SEGMENT_BITS * a / (distance + a)))

    a = min(range(3, 10), key=work)
    return grids(distance + a, a)


def place(nodes: DataFrame, fps: list[str], masks: list[int], *keep: str) -> DataFrame:
    """A row for each node and cell: ``cell, node, fp`` (the fingerprint of that grid), and ``keep``.

    Spark sizes these rows as if a node had one and may take them for a small table, so no join may
    be free to broadcast them: they are the left side of a semi or anti join, or of a merge.
    """
    named = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("fp")) for f in fps])
    points = nodes.select("node", *keep, F.explode(named).alias("f")).select("node", *keep, "f.fp", "f.name", embed(F.col("f.fp")).alias("point"))
    grids_ = points.select("*", F.posexplode(F.array(*map(F.lit, masks))).alias("grid", "mask"))  # one after the other, so that the plan doesn't grow with their number
    return grids_.select(F.xxhash64("name", "grid", F.col("point").bitwiseAND(F.col("mask"))).alias("cell"), "node", "fp", *keep)


def far(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


@dataclass(frozen=True)
class Bound:
    """What rules a pair out before it is verified: columns of the nodes, and a condition on their names with a suffix for each side."""

    columns: tuple[str, ...]
    holds: Callable[[str, str], Column]


def link_components(nodes: DataFrame, fps: list[str], masks: list[int], within: int, verify: Callable[[DataFrame], DataFrame] | None = None, bound: Bound | None = None) -> DataFrame:
    """``nodes`` (``node`` and fingerprints: longs) -> (node, component) for every node that has a link.

    Nodes that share a cell of one of the grids ``masks`` of a fingerprint, and there lie within
    ``within`` bits, are linked if ``verify`` leaves their pair (``a, b``) in.

    Each cell first links its members to one of them, its centre, which joins most of a group of
    near copies with a few links a member; cells choose by ``ORDERS`` different orders, so that a
    group has several centres. Pairs are then looked for only between nodes that this left in
    different components. Crowded cells that hold a single component are passed over, and others
    are paired in blocks, under ``bound``, so no cell has to fit into a task.
    """
    check = verify or (lambda pairs: pairs)
    chance = nodes.count() / 2 ** (SEGMENT_BITS * min(m.bit_count() if m >= 0 else (m + 2**64).bit_count() for m in masks) / 2)
    crowd = max(CROWD, int(4 * chance))
    spots = place(nodes, fps, masks)
    first_in_order = F.min(F.struct(F.xxhash64("node", F.pmod("cell", F.lit(ORDERS))).alias("at"), "node", "fp"))
    centres = settle(spots.groupBy("cell").agg(first_in_order.alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").select("cell", F.col("c.node").alias("centre"), F.col("c.fp").alias("centre_fp"), "n"), "centres")
    stars = spots.hint("merge").join(centres.drop("n"), "cell").where((F.col("node") != F.col("centre")) & (far("fp", "centre_fp") <= within))
    stars = stars.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()
    first = settle(components(check(stars)), "stars")

    labelled = settle(nodes.select("node", *fps).join(first, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "nodes")
    spots = place(labelled, fps, masks, "label")
    crowded = centres.where(F.col("n") > crowd).select("cell")
    mixed = spots.join(crowded, "cell", "left_semi").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = settle(mixed.where("low < high").select("cell", F.ceil(F.col("n") / max(BLOCK, crowd)).cast("int").alias("blocks")), "mixed")

    def meet(left: DataFrame, right: DataFrame, keys: list[str], bound: Bound | None = None) -> DataFrame:
        columns = ("node", "fp", "label", *(bound.columns if bound else ()))
        a, b = (df.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in columns)) for s, df in (("a", left), ("b", right)))
        points = F.bit_count(embed(F.col("fp_a")).bitwiseXOR(embed(F.col("fp_b"))))  # the Manhattan distance of the embeddings bounds that of the fingerprints
        apart = (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & (points <= within) & (far("fp_a", "fp_b") <= within)
        return a.hint("merge").join(b, keys).where(apart & bound.holds("a", "b") if bound else apart).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    loose = spots.join(crowded, "cell", "left_anti")
    dense = spots.join(mixed.select("cell"), "cell", "left_semi").hint("merge").join(mixed, "cell")  # only what is left is shuffled
    if bound:
        dense = dense.join(nodes.select("node", *bound.columns), "node")
    dealt = dense.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = meet(loose, loose, ["cell"]).unionByName(meet(dealt, dense.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), ["cell", "block"], bound))
    return components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(check(pairs.distinct())))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return per row ``doc_id, row, row2, fp, component, component_id``: the smallest id among rows that links within ``distance`` bits reach, itself included.

    Texts without words have fingerprint zero and link like any other. Rows that repeat an id are
    fingerprinted each by itself; a null id is never the smallest unless it is alone, and its
    component is then null. Other columns are ignored. An empty table gives an empty table.
    """
    rows = settle(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = link_components(nodes.select("fp", F.col("fp").alias("node")), ["fp"], grids_within(distance, nodes.count()), distance)
    named = nodes.join(settle(linked.withColumnRenamed("node", "fp"), "linked"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(ids, "component").select("fp", "component", "component_id"), "fp").select("doc_id", "row", "row2", "fp", "component", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id, and of rows that repeat it one.

    Rows without an id stay only where their component has no id at all.
    """
    found = near_duplicates(docs, shingle, distance, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = found.groupBy("component").agg(F.min("doc_id").alias("_id"), F.min(F.struct("row", "row2")).alias("s"))
    return stay_in(docs, stay.select("_id", F.col("s.row").alias("_row"), F.col("s.row2").alias("_row2")), id_col, text_col)


def stay_in(docs: DataFrame, stay: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id and text are in ``stay`` (_id, and _row, _row2: see ``text_id``), one of each."""
    row, row2 = text_id(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), row.alias("_row"), row2.alias("_row2"), F.struct("*").alias("_all"))
    same = rows["_id"].eqNullSafe(stay["_id"]) & (rows["_row"] == stay["_row"]) & (rows["_row2"] == stay["_row2"])
    return rows.join(stay, same, "left_semi").dropDuplicates(["_id", "_row", "_row2"]).select("_all.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; nulls, repeats, long texts and empty tables go as in ``near_duplicates``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
