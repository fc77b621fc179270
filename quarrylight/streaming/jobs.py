"""Job phases as a stream: monotone, whatever the order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight.operators.lifecycle import latest_jobs, phase_ordinal


def job_states(reports: DataFrame) -> DataFrame:
    """Streaming twin of ``latest_jobs``: an update whenever a repository's job moves on.

    State is one (job, phase) per repository; late reports of older jobs or phases change nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # seq, ordinal, smallest event first among equals
        best = state.get if state.exists else None
        before = best
        for b in batches:
            for row in b[["job_seq", "ordinal", "event_id", "phase"]].itertuples(index=False):
                seen = (int(row[0]), int(row[1]), -int(row[2]), row[3])
                if best is None or seen[:3] > tuple(best)[:3]:
                    best = seen
        if best is not None and best != before:
            state.update(best)
            yield pd.DataFrame([(key[0], best[0], best[3])], columns=["repository_id", "job_seq", "phase"])

    ranked = reports.withColumn("ordinal", phase_ordinal(F.col("phase")))
    return ranked.groupBy("repository_id").applyInPandasWithState(step, "repository_id string, job_seq long, phase string", "job_seq long, ordinal long, neg_event long, phase string", "update", GroupStateTimeout.NoTimeout)


def activity_windows(events: DataFrame, late: str = "1 day", length: str = "1 day") -> DataFrame:
    """Reports by repository and tumbling window, with late data dropped behind a watermark."""
    return events.withWatermark("reported_at", late).groupBy(F.window("reported_at", length), "repository_id").agg(F.count("*").alias("n"))


def publish_batches(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch's newest job states; a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        latest_jobs(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
