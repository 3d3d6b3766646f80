"""SimHash near copies for whole corpora: several fingerprints find candidates, exact five-word Jaccard similarity decides.

A text gets ``FINGERPRINTS`` SimHash fingerprints of its two-word shingles, from as many families
of hashes. Two texts are candidates if their segment-popcount points share a cell of a grid over
two of five groups of segments, for at least one fingerprint, and if their Manhattan distance over
all fingerprints is small enough (see ``simhash``). Every candidate pair is then verified by the
five-word shingles of both whole texts before it links anything. Shingles are told apart by 64
hashed bits.

Fingerprints of five-word shingles lie further apart than those of two-word shingles, since an
edited word changes five of them; that is why the shorter ones find the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeel.llm.common import ascii_lower, settle
from tablekeel.llm.simhash import Bound, embed, grids, link_components, majority, stay_in, text_id

SHINGLE = 5
#: Similarity of near copies, as a fraction: 0.8.
LIKE, OF = 4, 5
#: Fingerprints of a text, words of their shingles, and the grids of each: groups of segments, and how many span a grid.
FINGERPRINTS, WORDS, GROUPS, AGREE = 8, 2, 5, 2
#: Bits that candidates may lie apart in the fingerprint whose cell they share, and in all fingerprints on average.
#: A pair of similarity 0.8 lies 6 bits apart on average if single words differ, 10 if one passage does.
WITHIN, ON_AVERAGE = 16, 14
#: 64-bit words of a text's parities.
PARITIES = 8
#: Odd factors: one for each place in a shingle, and one for each fingerprint's family of hashes.
PLACES, FAMILIES = (np.random.default_rng(n).integers(0, 2**64, k, np.uint64) | np.uint64(1) for n, k in ((1, SHINGLE), (2, FINGERPRINTS)))


def mixed(hashes: np.ndarray) -> np.ndarray:
    return hashes ^ (hashes >> np.uint64(32))


def shingled(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all shingles of ``size`` words from the words' hashes; fewer words make one shingle, none make the empty one."""
    n = max(1, len(words) - size + 1)
    return mixed(sum((words[i : i + n] * PLACES[i] for i in range(min(size, len(words)))), np.zeros(n, np.uint64)))


def sketch(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of distinct five-word shingles, the fingerprints, and for each of 512 buckets whether its number of shingles is odd."""
    ws = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII blanks only
    words = np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))
    fps = majority(mixed(shingled(words, WORDS) * FAMILIES[:, None]))
    distinct = np.unique(shingled(words, SHINGLE))
    odd = np.bincount((distinct % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) % 2
    return len(distinct), fps, np.packbits(odd.astype(bool)).view(np.int64)


FPS = [f"f{i}" for i in range(FINGERPRINTS)]
ODD = [f"p{i}" for i in range(PARITIES)]


def sketches(texts: DataFrame) -> DataFrame:
    """For rows ``row, row2, text``: ``row, row2, n``, the fingerprints ``f0, f1, ...`` and the parities ``p0, p1, ...``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, fps, odd = zip(*map(sketch, b.text), strict=True) if len(b) else ((), (), ())
            fps, odd = np.array(fps, np.int64).reshape(-1, FINGERPRINTS), np.array(odd, np.int64).reshape(-1, PARITIES)
            yield pd.DataFrame({"row": b.row, "row2": b.row2, "n": np.array(n, np.int64)} | {f: fps[:, i] for i, f in enumerate(FPS)} | {p: odd[:, i] for i, p in enumerate(ODD)})

    return texts.mapInPandas(work, ", ".join(f"{c} long" for c in ("row", "row2", "n", *FPS, *ODD)))


def may_be_alike(a: str, b: str) -> Column:
    """Whether sizes and parities allow a similarity of 0.8: no near copy is ruled out."""
    apart = sum((F.bit_count(F.col(f"{p}_{a}").bitwiseXOR(F.col(f"{p}_{b}"))) for p in ODD), F.lit(0))  # no more than there are shingles in one text only
    n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
    return (OF * F.least(n, m) >= LIKE * F.greatest(n, m)) & ((OF + LIKE) * apart <= (OF - LIKE) * (n + m))


BOUND = Bound(("n", *ODD), may_be_alike)


def close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that bounds on similarity and distance leave over."""
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", *FPS, *ODD)]), side)
    points = sum((F.bit_count(embed(F.col(f"{f}_a")).bitwiseXOR(embed(F.col(f"{f}_b")))) for f in FPS), F.lit(0))  # Manhattan distance
    return pairs.where(may_be_alike("a", "b") & (points <= ON_AVERAGE * FINGERPRINTS)).select("a", "b")


def shingle_set(text: Column) -> Column:
    """Distinct 64-bit hashes of the five-word shingles of a whole text; a text of fewer words is one shingle, and one without words the empty one."""
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    made = F.transform(F.array(words), lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - SHINGLE + 1)), lambda i: F.xxhash64(F.slice(ws, i, SHINGLE))))
    return F.array_distinct(made[0])


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of ``nodes`` (node, row, row2) whose ``texts`` (row, row2, text; rows may repeat) are near copies. Only texts that a pair names are looked at."""
    pairs = settle(pairs, "candidates")
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.select("node", "row", "row2").join(named, "node", "left_semi")
    once = texts.groupBy("row", "row2").agg(F.first("text").alias("text"))  # copies are dropped before the shuffle as well
    held = settle(once.join(wanted, ["row", "row2"]).select("node", shingle_set(F.col("text")).alias("held")), "shingles")
    for side in "ab":
        pairs = pairs.join(held.select(F.col("node").alias(side), F.col("held").alias(f"held_{side}")), side)
    both = F.size(F.array_intersect("held_a", "held_b"))
    return settle(pairs.where(OF * both >= LIKE * (F.size("held_a") + F.size("held_b") - both)).select("a", "b"), "verified")


def near_copies(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``texts`` (row, row2: what tells texts apart, see ``text_id``; text) the distinct ones as ``node, row, row2``, and (node, component) for all that have a near copy."""
    # copies are dropped before the shuffle as well, so none is hot
    nodes = settle(sketches(texts).dropDuplicates(["row", "row2"]).withColumn("node", F.monotonically_increasing_id()), "sketches")
    return nodes.select("node", "row", "row2"), link_components(nodes, FPS, grids(GROUPS, AGREE), WITHIN, lambda pairs: verified(close(pairs, nodes), nodes, texts), BOUND)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, with all its columns: the one with the smallest id, and of rows that repeat it one.

    Texts without words are near copies of each other; null text counts as one. Rows without an id
    stay only where their component has no id at all. Long texts are compared whole. An empty table
    gives an empty table; columns with clashing names are carried along.
    """
    nodes, linked = near_copies(docs.select(*text_id(text_col), F.col(text_col).alias("text")))
    linked = settle(linked, "linked")
    least = docs.groupBy(*text_id(text_col)).agg(F.min(F.col(id_col).cast("long")).alias("id"))
    named = least.join(nodes, ["row", "row2"]).join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    stay = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "row2")).alias("s"))
    return stay_in(docs, stay.select(F.col("s.id").alias("_id"), F.col("s.row").alias("_row"), F.col("s.row2").alias("_row2")), id_col, text_col)
