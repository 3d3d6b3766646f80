"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Keys sit on a ring by the hash of their text, shards by the hashes of their virtual nodes. A key
belongs to the next node clockwise; what overflows a full shard continues clockwise. With
``headroom=0`` every shard ends exactly full, so row counts differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.llm.common import rank_within, salts_for, settle, table


def ring(shards: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions (signed 64 bits) of all virtual nodes and the shard of each."""
    at = np.array([xxhash.xxh64_intdigest(f"shard {s} node {v}") for s in range(shards) for v in range(nodes)], dtype=np.uint64).view(np.int64)
    by = np.argsort(at, kind="stable")
    return at[by], (np.arange(shards * nodes) // nodes)[by]


def allot(counts: np.ndarray, owner: np.ndarray, caps: np.ndarray) -> list[tuple[int, int, int]]:
    """Split each arc's rows among shards: (first rank along the ring, shard, first slot).

    Only counts by arc come in, so the work is bounded by the nodes of the ring, not by the rows.
    A shard first takes the rows of its own arcs, in ring order; what it can't hold goes on
    clockwise to the next node whose shard has room.
    """
    room = caps.astype(np.int64).copy()
    own = np.zeros(len(counts), np.int64)
    for arc, shard in enumerate(owner):
        own[arc] = min(counts[arc], room[shard])
        room[shard] -= own[arc]
    filled, parts, first = np.zeros(len(caps), np.int64), [], 0
    for arc, n in enumerate(counts):
        at, left, node = first, int(n), arc
        take = int(own[arc])
        while left:
            if take:
                parts.append((at, int(owner[node]), int(filled[owner[node]])))
                filled[owner[node]] += take
                at, left = at + take, left - take
            if left:
                node = (node + 1) % len(counts)
                if not room.any():
                    raise ValueError("the shards' capacities are below the number of rows")
                take = int(min(left, room[owner[node]]))
                room[owner[node]] -= take
        first += int(n)
    return parts


def shard_rows(docs: DataFrame, shards: int = 40, nodes: int = 64, headroom: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return per row ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16. A shard holds at most
    ``(1 + headroom) * rows / shards``, rounded so that the sum fits; slots are gapless from 0 in
    each shard. Equal texts are neighbours on the ring and share a shard until it is full. Rows
    that repeat an id are separate rows; null text counts as empty. An empty table gives none.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select("doc_id", (F.octet_length("t") + 16).cast("long").alias("size"), F.crc32(F.col("t").cast("binary")).alias("text_crc32"), F.xxhash64("t").alias("pos"))
    at, owner = ring(shards, nodes)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(arc=(np.searchsorted(at, b.pos.to_numpy(np.int64)) % len(at)).astype(np.int32))

    keyed = keyed.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make a column with nulls inexact
    placed = settle(keyed.mapInPandas(place, "doc_id string, size long, text_crc32 long, pos long, arc int"), "shard-rows")
    counts = np.zeros(len(at), np.int64)
    for r in placed.groupBy("arc").count().collect():  # as many rows as the ring has nodes
        counts[r["arc"]] = r["count"]
    total = int(counts.sum())
    most = max(-(-total // shards), int((1 + headroom) * total / shards))
    caps = np.full(shards, most)
    if headroom == 0:
        caps = np.array([total // shards + (s < total % shards) for s in range(shards)])
    parts = allot(counts, owner, caps)
    starts, to, slots = (np.array([p[i] for p in parts], np.int64) for i in range(3))
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = before[b.arc.to_numpy()] + b["rank"].to_numpy(np.int64)
            part = np.searchsorted(starts, rank, side="right") - 1
            yield pd.DataFrame({"doc_id": b.doc_id, "size": b["size"], "text_crc32": b.text_crc32, "shard": to[part].astype(np.int32), "slot": slots[part] + rank - starts[part]})

    ranked = rank_within(placed, "arc", ["pos"], ["doc_id", "size", "text_crc32"], salts=salts_for(int(counts.max(initial=0))))
    out = ranked.select("doc_id", "size", "text_crc32", "arc", "rank").mapInPandas(assign, "doc_id string, size long, text_crc32 long, shard int, slot long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law ``rows``; nulls, repeats, long texts and empty tables go as in ``shard_rows``."""
    return shard_rows(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
