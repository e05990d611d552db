"""Events of stages judged as they come: each run's stage keeps its last state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholia.operators.progress import MOVES, STAGES

OUTPUT = "run_id long, seq long, n int, stage string, state string, before string, legal boolean"


def judged_stream(events: DataFrame) -> DataFrame:
    """judged() over a stream of events (run_id, seq, n, stage, state). Events of a batch are taken in order of seq and n;
    an event that comes with a later batch than one behind it is judged against that one."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else "pending"
        pdf = pd.concat(batches, ignore_index=True).sort_values(["seq", "n"])
        before = []
        for new in pdf["state"]:
            before.append(last)
            last = new
        state.update((last,))
        legal = [key[1] in STAGES and new in MOVES.get(old, ()) for old, new in zip(before, pdf["state"])]
        yield pdf.assign(before=before, legal=legal)[[c.split()[0] for c in OUTPUT.split(", ")]]

    return events.groupBy("run_id", "stage").applyInPandasWithState(judge, OUTPUT, "last string", "append", GroupStateTimeout.NoTimeout)
