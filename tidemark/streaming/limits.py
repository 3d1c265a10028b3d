"""The rate limiter as a stream: each client's open window is the state, which outlives micro-batches and ends with a timeout."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame

OUT = "client long, event_id long, at_ms long, allowed boolean, retry_after long"


def rate_limit(visits: DataFrame, limit: int, window_ms: int = 60_000, expire: bool = True) -> DataFrame:
    """The rows of operators.state.rate_limit for a stream whose clients' events arrive in order of time. expire: drop the state of clients unseen for ten windows; a run that is to end by itself (availableNow) goes without."""

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        reset, n = state.get if state.exists else (None, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values(["at_ms", "event_id"])
        for event, at in zip(rows["event_id"].tolist(), rows["at_ms"].tolist()):
            reset, n = (at + window_ms, 1) if reset is None or reset <= at else (reset, n + 1)
            out.append((key[0], event, at, n <= limit, 0 if n <= limit else math.ceil((reset - at) / 1000)))
        state.update((reset, n))
        if expire:
            state.setTimeoutDuration(max(window_ms, 1000) * 10)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return visits.groupBy("client").applyInPandasWithState(run, OUT, "reset long, n int", "append", "ProcessingTimeTimeout" if expire else "NoTimeout")
