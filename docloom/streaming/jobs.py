"""Streams: the index follows new chunks, and job states follow their events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.sources.index_store import IndexStore

#: Seconds a job may run, and states that end it.
BUDGET_S, ENDED = 1500, ("succeeded", "failed", "partial")


def follow_jobs(events: DataFrame, budget_s: int = BUDGET_S) -> DataFrame:
    """job_id, status, at, ignored of a stream of events (job_id, status, ts).

    A job's first running event starts its budget in event time. When the watermark passes it, the job has
    failed; running, succeeded and partial events after an end are counted and change nothing.
    """
    schema = "job_id long, status string, at timestamp, ignored int"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, started, last, ignored = state.get if state.exists else ("queued", None, None, 0)
        if state.hasTimedOut:
            if status not in ENDED:
                status = "failed"
                last = started + budget_s * 1000
        else:
            rows = sorted((t, s) for f in frames for t, s in zip((f.ts.astype("int64") // 10**6 if str(f.ts.dtype) == "datetime64[ns]" else f.ts.astype("int64") // 10**3).tolist(), f.status.tolist(), strict=True))
            for t, s in rows:
                if status not in ENDED and started is not None and t > started + budget_s * 1000:
                    status, last = "failed", started + budget_s * 1000
                if status in ENDED:
                    ignored += 1
                    continue
                status, last = s, t
                if s == "running" and started is None:
                    started = t
        state.update((status, started, last, ignored))
        if status not in ENDED and started is not None:
            state.setTimeoutTimestamp(max(started + budget_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "at": [pd.Timestamp(last, unit="ms") if last is not None else None], "ignored": [ignored]})

    state = "status string, started long, last long, ignored int"
    timed = events.withWatermark("ts", "0 seconds")
    return timed.groupBy("job_id").applyInPandasWithState(step, schema, state, "update", GroupStateTimeout.EventTimeTimeout)


def refresh_index(chunks: DataFrame, store: IndexStore, checkpoint: str) -> StreamingQuery:
    """New and replaced chunks (kb_id, chunk_id, doc_id, text) of a stream go into the store, a batch each; a batch that is run again replaces itself.

    A batch reads the stored rows of the chunks that it replaces, and writes what changes in the statistics.
    """
    return chunks.writeStream.foreachBatch(lambda batch, epoch: store.upsert(batch, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
