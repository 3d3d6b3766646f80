"""Vector code compression: product quantisation in whole numbers, its codebooks refined by active-entry Lloyd rounds.

A vector is cut into equal parts, and each part is coded by the nearest entry of its place's
codebook. A round assigns all parts and moves each entry to the mean of its parts. A part keeps
its entry and the exact distance to it. If that entry did not move, only entries that did move can
have come closer, and only they are compared with the stored distance; parts whose entry moved
are compared with the whole codebook. Both ways find the same entry, ties going to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.core import SAMPLE, Refused
from tablekeel.llm.common import settle, table

#: Parts of a vector, entries of a codebook, rounds, and whole numbers for a component's unit.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Distances up to here are exact in doubles.
EXACT = 2**53


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]``, and which entries the last round moved. Its size is fixed by the parameters and the vectors' length."""

    entries: np.ndarray
    moved: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def refined(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Each entry at the mean of its parts, rounded down; entries without parts stay."""
        new = self.entries.copy()
        for (part, entry), (n, total) in sums.items():
            new[part, entry] = [int(t) // n for t in total]
        return Codebooks(new, (new != self.entries).any(axis=2))


def distances(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of ``vectors`` (rows, width) to ``entries`` (entries, width), whole numbers all."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, vectors.shape[1]) < EXACT:  # then every term is exact in doubles, and the product is a fast one
        v, e = vectors.astype(np.float64), entries.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ e.T) + (e * e).sum(1)).astype(np.int64)
    return np.stack([((vectors - e) ** 2).sum(1) for e in entries], axis=1)


def assign(vectors: np.ndarray, books: Codebooks, codes: np.ndarray | None, held: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and exact distances (rows, parts) of ``vectors`` (rows, length), from those of the round before, if there was one."""
    parts, _, width = books.entries.shape
    cut = vectors.reshape(len(vectors), parts, width)
    new, dist = np.zeros((len(vectors), parts), np.int64), np.zeros((len(vectors), parts), np.int64)
    for p in range(parts):
        moved = np.flatnonzero(books.moved[p])
        stale = np.ones(len(vectors), bool) if codes is None else books.moved[p][codes[:, p]]
        d = distances(cut[stale, p], books.entries[p])
        new[stale, p] = d.argmin(axis=1)  # the first of equal ones
        dist[stale, p] = d.min(axis=1)
        if codes is None or stale.all():
            continue
        fixed = ~stale
        at, best = codes[fixed, p], held[fixed, p]
        if len(moved):
            d = distances(cut[fixed, p], books.entries[p][moved])
            near = d.argmin(axis=1)
            who, by = moved[near], d.min(axis=1)
            closer = (by < best) | ((by == best) & (who < at))
            at, best = np.where(closer, who, at), np.where(closer, by, best)
        new[fixed, p], dist[fixed, p] = at, best
    return new, dist


def _stack(column: pd.Series, width: int, kind: type = np.int64) -> np.ndarray:
    return np.array(column.tolist(), kind).reshape(len(column), width)


def assigned(state: DataFrame, books: Codebooks) -> DataFrame:
    """``state`` (ints, codes, dists, and other columns) with codes and distances under ``books``; codes are null before the first round."""
    parts, _, width = books.entries.shape

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                first = b["codes"].iloc[0] is None  # all rows are in the same round
                old = (None, None) if first else (_stack(b["codes"], parts), _stack(b["dists"], parts))
                codes, dists = assign(_stack(b["ints"], parts * width), books, *old)
                b["codes"], b["dists"] = list(codes.astype(np.int32)), list(dists)
            yield b

    return state.mapInPandas(work, state.schema)


def sums_of(state: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Number and sums of the parts of each entry. A task adds up its own rows, so that a row an entry leaves it; as many reach the driver."""
    parts, entries, width = books.entries.shape
    far = [f"s{i}" for i in range(width)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in batches:
            if len(b):
                at = (_stack(b["codes"], parts) + np.arange(parts) * entries).ravel()
                n += np.bincount(at, minlength=len(n))
                np.add.at(total, at, _stack(b["ints"], parts * width).reshape(-1, width))
        used = np.flatnonzero(n)
        yield pd.DataFrame({"part": used // entries, "entry": used % entries, "n": n[used]} | {c: total[used, i] for i, c in enumerate(far)})

    found = state.select("ints", "codes").mapInPandas(work, ", ".join(f"{c} long" for c in ("part", "entry", "n", *far)))
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in far])
    return {(r["part"], r["entry"]): (r["n"], [int(r[c]) for c in far]) for r in found.collect()}


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def sound(vector: Column) -> Column:
    """Whether a vector has components, all of them finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] | None = None) -> tuple[DataFrame, Codebooks | None]:
    """``id, kept, codes, dists`` (``kept``: a struct of the columns ``keep``) of each vector, and the codebooks; without a vector there are none.

    Vectors that are null or empty, or hold null or non-finite components, are dropped. All
    vectors have the length of the one with the smallest id, which ``parts`` must divide; a table
    of several lengths, or with numbers whose distances don't fit in 64 bits, is refused. The
    codebooks start as the vectors of the ``entries`` smallest ids (fewer if there are fewer);
    rows that repeat an id follow each other by their numbers, rows without one come last.
    """
    rows = vectors.where(sound(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.struct(*(keep or [F.lit(None).alias("none")])).alias("kept"), whole_numbers(F.col(vector_col)).alias("ints"))
    first = rows.orderBy(F.asc_nulls_last("id"), "ints").select("ints").limit(entries).collect()
    empty = F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("array<long>").alias("dists")
    rows = rows.select("*", *empty)
    if not first:
        return rows.drop("ints"), None
    length = len(first[0][0])
    limit = int((2**62 / length) ** 0.5) // 2
    odd = rows.where((F.size("ints") != length) | (F.array_max("ints") > limit) | (F.array_min("ints") < -limit)).select("id").limit(SAMPLE).collect()
    if odd or length % parts:
        raise Refused("VALIDATION_FAIL", f"vectors must have one length that {parts} divides, and components within {limit // SCALE}", {"length": length, "ids": [r[0] for r in odd]})
    start = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy()
    books = Codebooks(start, np.ones(start.shape[:2], bool))
    state = rows
    for _ in range(rounds):
        state = settle(assigned(state, books), "codes")
        books = books.refined(sums_of(state, books))
    return assigned(state, books).drop("ints"), books


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``id`` and the whole numbers that the codes of ``encode`` stand for."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes = _stack(b["codes"], len(books.entries))
            yield pd.DataFrame({"id": b["id"], "ints": list(books.entries[np.arange(len(books.entries)), codes].reshape(len(b), -1))})

    return coded.select("id", "codes").mapInPandas(work, "id long, ints array<long>")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings; see ``encode`` for what is dropped, refused and how repeated ids go. An empty table gives an empty one."""
    coded, books = encode(table(spark, sf_dir, "embeddings"), keep=["label"])
    hexes = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    error = F.aggregate("dists", F.lit(0).cast("long"), lambda a, d: a + d)
    rows = settle(coded.select(F.col("id").alias("vec_id"), F.col("kept.label").alias("label"), hexes.alias("code"), error.alias("error")), "coded")
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    digest = F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256")
    return rows.join(by_label, rows["label"].eqNullSafe(by_label["_label"])).select("vec_id", "code", "error", "label_error", digest)


def _round_sql(k: int) -> str:
    """Assignment ``a{k}`` under the codebook ``c{k}``, and the codebook that follows it."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT row, p, min(struct_pack(d := d, e := e)) AS s
  FROM (SELECT row, p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN c{k} USING (p)) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c FROM c{k} LEFT JOIN (
    SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS m FROM (
      SELECT p, a{k}.s.e AS e, i, CAST(sum(v[i]) AS DOUBLE) AS s, count(*) AS n FROM a{k} JOIN parts USING (row, p), range(1, len(v) + 1) r(i) GROUP BY ALL) GROUP BY ALL) USING (p, e)),"""


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS row, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT row, p, v[p * w + 1:p * w + w] AS v FROM (SELECT row, v, len(v) // 16 AS w FROM kept), range(16) r(p)),
c0 AS MATERIALIZED (SELECT p, row - 1 AS e, v AS c FROM parts WHERE row <= 64),
{"".join(_round_sql(k) for k in range(ROUNDS))}
{_round_sql(ROUNDS).split(f"c{ROUNDS + 1} AS")[0]}
done AS (SELECT row, string_agg(printf('%02x', s.e), '' ORDER BY p) AS code, CAST(sum(s.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM kept JOIN done USING (row)
"""
