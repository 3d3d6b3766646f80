"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel. Each partition sums its part of the normal equations;
the sums are added up row by row, in two levels, and solved on the driver, whose work depends on
the number of features alone.

A statistic that lies over six standard deviations from the labelled texts' mean counts as lying
six off, so texts beyond that are scored alike in it. In ``sf0.1`` that is 2.1 % of the documents,
mostly for repeated lines, capitals and digits; no document is left out for it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.llm.common import settle, table
from tablekeel.llm.language_id import fold

STATS = ["log_chars", "log_words", "word_chars", "upper", "digits", "marks", "odd_marks", "blanks", "beyond_ascii", "distinct", "top_word", "marked_words", "upper_words", "repeated_lines", "squeezed"]
UPPER, DIGITS, BLANK = (bytes(range(*r)) for r in ((65, 91), (48, 58), (9, 14)))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
ODD = bytes(b for b in MARKS if chr(b) not in ".,;:'\"()-?")
END = re.compile(r"[.,;:?)'\"]*$")


def statistics(text: str | None) -> list[float]:
    """``STATS`` of a whole text; null or empty: zeros."""
    if not text:
        return [0.0] * len(STATS)
    raw, ws, lines = text.encode(), text.split(), text.split("\n")
    n, k = len(raw), max(1, len(ws))
    share = lambda bytes_: (n - len(raw.translate(None, bytes_))) / n
    found = Counter(ws)
    return [
        np.log1p(len(text)), np.log1p(len(ws)), sum(map(len, ws)) / k, share(UPPER), share(DIGITS), share(MARKS), share(ODD), share(BLANK + b" "), (n - len(text)) / n,
        len(found) / k, max(found.values(), default=0) / k, sum(not w[-1].isalnum() and w[-1] not in ".,;:?)'\"" for w in ws) / k, sum(map(str.isupper, ws)) / k,
        1 - len(set(lines)) / len(lines), len(zlib.compress(raw, 1)) / n,
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return per row ``doc_id`` and ``stats`` (array of doubles, in the order of ``STATS``), of whole texts.

    Null and empty texts have zeros, rows that repeat an id are measured each by itself, other
    columns are ignored, and an empty table gives an empty one.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "stats": [statistics(t) for t in b.text]})

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(work, "doc_id string, stats array<double>").withColumn("doc_id", F.col("doc_id").cast("long"))


@dataclass
class Model:
    """``score`` maps rows of statistics to calibrated scores."""

    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    bins: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        waves = np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.bins, self.levels)


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), len(STATS))


def rising(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic regression of means ``values`` with weights ``counts``: pools of adjacent violators."""
    pools: list[list[float]] = []
    for v, n in zip(values, counts, strict=True):
        pools.append([v, n, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(p[2]), p[0]) for p in pools])


def fit(labelled: DataFrame, features: int = 192, width: float = 4.0, ridge: float = 1e-3, seed: int = 7, bins: int = 400, groups: int = 256) -> Model | None:
    """Fit on rows of ``stats, label`` (0 or 1) and ``calibrate`` (boolean): such rows calibrate, the others fit.

    All labelled rows count. ``width`` is that of the Gaussian kernel in standard deviations. The
    driver gets one row a feature and one a bin of raw scores. Partial sums are added up in
    ``groups`` groups of partitions first. None if no row is labelled.
    """
    each = [F.col("stats")[i] for i in range(len(STATS))]
    sums = labelled.agg(F.count(F.lit(1)), F.count_if(~F.col("calibrate")), F.count_if("calibrate"), *[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    if not sums[0]:
        return None
    mean, spread = np.array(sums[3 : 3 + len(STATS)]), np.array(sums[3 + len(STATS) :])
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), rng.normal(size=(len(STATS), features)) / width, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.zeros(1))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((features + 1, features + 2))
        for b in batches:
            z = model.features(matrix(b.stats))
            total += z.T @ np.hstack([z, b.label.to_numpy(float)[:, None]])
        yield pd.DataFrame({"row": range(features + 1), "part": TaskContext.get().partitionId() % groups, "sums": list(total)})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": rows.row[:1], "part": rows.part[:1], "sums": [np.sum(rows.sums.tolist(), axis=0)]})

    to_fit = (labelled.where(~F.col("calibrate")) if sums[1] else labelled).select("stats", "label")
    shape = "row int, part int, sums array<double>"
    parts = to_fit.mapInPandas(add_up, shape).groupBy("row", "part").applyInPandas(merge, shape)
    equations = np.array([r["sums"] for r in sorted(parts.groupBy("row").applyInPandas(merge, shape).collect(), key=lambda r: r["row"])])
    gram, right = equations[:, :-1], equations[:, -1]
    model.weights = np.linalg.solve(gram + ridge * max(1.0, gram[-1, -1]) * np.eye(features + 1) / features, right)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"bin": np.clip((model.raw(matrix(b.stats)) + 0.5) / 2 * bins, 0, bins - 1).astype(int), "label": b.label})

    to_set = labelled.where("calibrate") if sums[2] else labelled
    found = sorted(tuple(r) for r in to_set.select("stats", "label").mapInPandas(binned, "bin int, label double").groupBy("bin").agg(F.avg("label"), F.count(F.lit(1))).collect())
    at, level, n = (np.array([r[i] for r in found], float) for i in range(3))
    model.bins, model.levels = (at + 0.5) / bins * 2 - 0.5, rising(level, n)
    return model


def rate(measured: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """Return per row of ``doc_id, stats``: ``doc_id, score, predicted``. Without a model every score is 0.5; an empty table gives an empty one."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "score": model.score(matrix(b.stats)) if model else 0.5})

    rows = measured.withColumn("doc_id", F.col("doc_id").cast("string")).select("doc_id", "stats").mapInPandas(work, "doc_id string, score double")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics are taken once, from whole texts, and settled; labels of the held-out quarter are never read into the fit.

    Rows that repeat an id are scored each by itself and count in the fit as often as they are
    labelled; labels without quality, and null ids, are passed over there. Null and empty texts
    have statistics of zero. An empty table of documents gives an empty table, and without labels
    every score is 0.5. Other columns are ignored.
    """
    measured = settle(measure(table(spark, sf_dir, "documents")), "stats")
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("label"))
    labels = labels.where(fold("doc_id", 4) != 2).withColumn("calibrate", fold("doc_id", 4) == 3)
    return rate(measured, fit(settle(measured.join(labels, "doc_id").select("stats", "label", "calibrate"), "labelled"))).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
