"""Filter interaction audit: what each of several filters removes in every order in which they can be applied.

A document fails some set of the filters, its mask; documents are counted by part and mask, and
the rest works on these counts alone. The subsets of filters are walked in Gray code, so that one
filter is switched on or off at a time: every mask keeps the number of active filters that it
fails, and the running survivors change only by the masks whose number leaves or reaches zero.
The survivors of all subsets are kept, and a step of an order is the difference of two of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.llm.common import settle, table

#: Filters by letter; each letter's place is its bit in a mask.
LETTERS = "ABCDE"
#: Fixed values of the conditions: least number of words, least percentage of distinct words, largest percentage of capitals, marks that no text may hold.
WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 3, b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Filters of which all orders are listed: more would make over 40,000 rows a part.
MOST_FILTERS = 7


def text_mask(text: str | None) -> int:
    """Bits of the filters A to D that a text fails; null counts as empty."""
    text = text or ""
    raw = text.encode(errors="surrogatepass")
    words = raw.split()  # bytes: splits at ASCII blanks only
    fails = (
        len(words) < WORDS,
        100 * len(set(words)) < DISTINCT * len(words),
        100 * (len(raw) - len(raw.translate(None, UPPER))) > CAPITALS * len(text),
        len(raw.translate(None, MARKS)) < len(raw),
    )
    return sum(1 << i for i, f in enumerate(fails) if f)


def masked(docs: DataFrame, mask: Callable[[str | None], int] = text_mask, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id, part, mask, one, two`` a row: the mask of the whole text, and 128 hashed bits that tell texts apart."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["mask"] = np.fromiter(map(mask, b.pop("text")), np.int32, len(b))
            yield b

    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.coalesce(part_col, F.lit("")).alias("part"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit("second"), text).alias("two"), text.alias("text"))
    return rows.mapInPandas(work, "id string, part string, one long, two long, mask int").withColumn("id", F.col("id").cast("long"))  # pandas would make null ids floats


def repeats(rows: DataFrame, bit: int) -> DataFrame:
    """Set ``bit`` in the mask of every row whose text a smaller id has.

    Only the smallest id of each text is looked for, with partial minima before the shuffle; rows
    are then matched by text and id together, so a text that a third of all rows share is spread.
    """
    rows = settle(rows, "masks")
    least = rows.groupBy(F.col("one").alias("_one"), F.col("two").alias("_two")).agg(F.min("id").alias("_id"))
    found = rows.join(least, (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    return found.withColumn("mask", F.col("mask").bitwiseOR(F.when(F.col("_one").isNull(), 1 << bit).otherwise(0))).select(*rows.columns)


def cells(rows: DataFrame, labels: DataFrame, marks: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """``part, mask, n`` and a count of the rows that each of ``marks`` (conditions on ``labels``) holds for; several labels of an id count once."""
    known = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(*[F.coalesce(F.max(c), F.lit(False)).alias(m) for m, c in marks.items()])
    return rows.select("id", "part", "mask").join(known, "id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(m, F.lit(False))).alias(m) for m in marks])


def survivors(masks: np.ndarray, counts: np.ndarray, filters: int) -> np.ndarray:
    """For every subset of the filters the counts (a row a mask, any number of columns) of what none of them fails."""
    failing, alive = np.zeros(len(masks), np.int64), counts.sum(axis=0)
    states = np.zeros((1 << filters, counts.shape[1]), np.int64)
    states[0], subset = alive, 0
    for step in range(1, 1 << filters):
        bit = (step & -step).bit_length() - 1  # Gray code: the lowest bit set in the step's number
        subset ^= 1 << bit
        hit = (masks >> bit & 1).astype(bool)
        if subset >> bit & 1:
            alive = alive - counts[hit & (failing == 0)].sum(axis=0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            alive = alive + counts[hit & (failing == 0)].sum(axis=0)
        states[subset] = alive
    return states


def steps(masks: np.ndarray, counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """``filter_order, step, kept, removed, redundant, unique_fails, lost..., shapley`` for every order of ``letters``; the first column of ``counts`` counts rows, the others what else is lost."""
    bits = {f: 1 << i for i, f in enumerate(letters)}
    states = survivors(masks, counts, len(letters))
    fails = {f: int(counts[(masks & b) > 0, 0].sum()) for f, b in bits.items()}
    alone = {f: int(counts[masks == b, 0].sum()) for f, b in bits.items()}
    rows, shapley = [], dict.fromkeys(letters, 0)
    for order in permutations(letters):
        done = 0
        for i, f in enumerate(order):
            lost = states[done] - states[done | bits[f]]
            done |= bits[f]
            shapley[f] += int(lost[0])
            rows.append((f, "".join(order), i + 1, int(states[done, 0]), int(lost[0]), fails[f] - int(lost[0]), alone[f], *map(int, lost[1:])))
    for f, *row in rows:
        yield (*row, shapley[f])


def audit(cells: DataFrame, letters: str = LETTERS, lost: tuple[str, ...] = ()) -> DataFrame:
    """Every step of every order of the filters ``letters``, for each part of ``cells`` (part, mask, n, and the columns ``lost``).

    ``kept``, ``removed`` and ``redundant`` rows of the step, ``unique_fails`` (rows that fail its
    filter alone), what of each of ``lost`` goes with it, and ``shapley``: what its filter removes,
    summed over all orders; divided by ``orders(letters)`` it is the filter's Shapley value. A part
    is at most ``2 ** len(letters)`` rows of counts, however many documents it has.
    """
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"the orders of more than {MOST_FILTERS} filters are not listed")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    types = {"part": "string", "filter_order": "string", "step": "int"}

    def work(part: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        found = steps(cells["mask"].to_numpy(), cells[["n", *lost]].to_numpy(np.int64), letters)
        return pd.DataFrame([(part[0], *r) for r in found], columns=names)

    return cells.groupBy("part").applyInPandas(work, ", ".join(f"{c} {types.get(c, 'long')}" for c in names))


def orders(letters: str = LETTERS) -> int:
    return factorial(len(letters))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of all orders of the five filters on whole texts, by language.

    Null text is empty, null ``lang`` the part ''. A row without an id comes after all ids: it
    repeats any text that a row with an id has. Rows that repeat an id and its text do not repeat
    each other. Long texts are looked at whole. An empty table gives an empty one; labels without a
    document count nothing.
    """
    rows = repeats(masked(table(spark, sf_dir, "documents")), LETTERS.index("E"))
    marks = {"good_lost": F.col("quality") == 1, "toxic_lost": F.col("toxic") == 1}
    return audit(cells(rows, table(spark, sf_dir, "labels"), marks), lost=tuple(marks))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
known AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels GROUP BY doc_id),
m AS (
  SELECT part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
    + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(doc_id > least AS INT) AS mask,
    coalesce(good, false) AS good, coalesce(bad, false) AS bad
  FROM w LEFT JOIN known USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count_if(good) AS g, count_if(bad) AS b FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, i AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INT) AS before FROM o, range(1, 6) r(i)),
r AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, bit,
    CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(g) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(b) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS toxic_lost
  FROM cells, s GROUP BY ALL)
SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
