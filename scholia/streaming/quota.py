"""The rolling quota as a stream: each identity's granted stamps are keyed state that expires with the window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "identity long, event_id long, granted boolean, used int, retry_after_s double"


def quota_decisions(runs: DataFrame, limit: int, window_s: int = 86_400) -> DataFrame:
    """Decisions over a stream of runs (identity, ts, event_id) with a watermark on ts. Runs of a batch are taken
    in time order; a run is judged against the granted runs in the window before it."""
    window = window_s * 1_000_000

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = list(state.get[0]) if state.exists else []
        pdf = pd.concat(batches, ignore_index=True).sort_values(["ts", "event_id"])
        out = []
        for t, event in zip(pdf["ts"].astype("datetime64[us]").astype("int64"), pdf["event_id"]):
            live = [x for x in live if x > t - window]
            ok = len(live) < limit
            retry = None if ok else max(0.0, (live[0] + window - t) / 1e6)
            if ok:
                live.append(int(t))
            out.append((key[0], int(event), ok, len(live), retry))
        state.update((live,))
        if live:
            state.setTimeoutTimestamp(max(live[-1] // 1000 + window_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["identity", "event_id", "granted", "used", "retry_after_s"])

    return runs.groupBy("identity").applyInPandasWithState(judge, OUTPUT, "live array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
