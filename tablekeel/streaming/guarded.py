"""Recurring runs: each batch is profiled and passes only if it does not drift from the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeel.core import Refused
from tablekeel.plans.profile import drift, drift_status, profile


def judge_batch(batch: DataFrame, baseline: DataFrame | None, ignore: tuple[str, ...] = ("row_count_shift",)) -> DataFrame:
    """One row ``status, action``. Batches differ in size, so a shift of the row count is ignored by default."""
    if baseline is None:
        raise Refused("DRIFT_BLOCK", "a recurring run needs a baseline profile")
    return drift_status(drift(baseline, profile(batch)).where(~F.col("kind").isin(*ignore)))


def run_guarded(stream: DataFrame, baseline: DataFrame, good: str, quarantine: str, checkpoint: str):  # noqa: ANN201
    """Write each micro-batch to ``good`` or ``quarantine``; the query ends when what is there has been read.

    The baseline is a profile, a row a column; it is computed once, before the first batch.
    """
    known = stream.sparkSession.createDataFrame(baseline.collect(), baseline.schema)

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            action = judge_batch(batch, known).first()["action"]
            batch.write.mode("overwrite").parquet(f"{good if action == 'CONTINUE' else quarantine}/batch={number}")  # a batch that is repeated replaces itself
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PROGRESS = "batch long, operator string, metric string, value string"


def progress_evidence(query) -> DataFrame:  # noqa: ANN001
    """Rows ``batch, operator, metric, value`` of what guarded operators counted while a streaming query ran, from the progress that Spark keeps.

    A batch that was run again after a failure appears as often as it ran; batches beyond those that
    ``spark.sql.streaming.numRecentProgressUpdates`` keeps are gone.
    """
    rows = []
    for p in query.recentProgress:
        for operator, metrics in (p.observedMetrics or {}).items():
            rows += [(p.batchId, operator, k, None if v is None else str(v)) for k, v in metrics.asDict().items()]
    return SparkSession.active().createDataFrame(rows, PROGRESS)
