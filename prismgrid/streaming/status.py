"""The status log as a stream: current states kept per job, polled until terminal."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prismgrid.storage import shared_dir

OUT = "job_id long, seq long, status string, step string, progress int"
#: (seq of the last write seen, class of the last U or C write, current state)
STATE = "seen long, last string, seq long, status string, step string, progress int"


def current_states(writes: DataFrame) -> DataFrame:
    """Each batch's changed jobs with their current state, by the batch fold's rule.

    Order holds within a batch; a write at or before the last seen one of its job is late and ignored. State is one row
    a job.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, *now = state.get if state.exists else (-1, None, None, None, None, None)
        rows = pd.concat(parts).sort_values("seq")
        for r in rows.itertuples():
            if r.seq <= seen:
                continue
            seen = int(r.seq)
            if r.cls == "G" and last == "C":
                continue
            if r.cls != "G":
                last = r.cls
            now = [int(r.seq), r.status, None if pd.isna(r.step) else r.step, None if pd.isna(r.progress) else int(r.progress)]
        state.update((seen, last, *now))
        if now[0] is not None:
            out = pd.DataFrame([(key[0], *now)], columns=["job_id", "seq", "status", "step", "progress"])
            yield out.astype({"progress": "Int32"})

    return writes.groupBy("job_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def poll(states: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 2) -> StreamingQuery:
    """Hand each change to ``put`` every few seconds."""
    return states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def run_available(states: DataFrame, label: str = "states") -> str:
    """Drain a stream of states into Parquet in the shared folder; returns its path. Each batch replaces its own
    folder, so a batch that runs again after a failure is written once."""
    base = f"{shared_dir(states.sparkSession)}/{label}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    query = states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{base}/rows"
