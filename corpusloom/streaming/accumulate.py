"""Streamed answers, accumulated with state per request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Milliseconds of event time after which a request without new chunks is forgotten.
PATIENCE = 600_000


def accumulate_stream(chunks: DataFrame, at: str | None = None, patience: int = PATIENCE) -> DataFrame:
    """request_id, response, emitted once the chunks up to the one that is done have all come.

    chunks: a stream of request_id, seq (from 0), content, done; chunks may come
    in any order over batches. State holds what has come of unfinished requests, and that a request is closed, so
    that late chunks don't open it again. With `at`, a timestamp column of chunks, it is bounded: chunks
    that are `patience` milliseconds late are dropped, and a request whose last chunk is as long before the
    watermark leaves the state, closed or not; an unfinished one then gives no row. Without it state is kept for ever.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, contents, last, closed = state.get if state.exists else ([], [], -1, False)
        newest = None
        held = dict(zip(seqs, contents, strict=True))
        for frame in frames:
            if at:
                latest = int(frame[at].max().timestamp() * 1000)
                newest = latest if newest is None else max(newest, latest)
            for seq, content, done in zip(frame["seq"], frame["content"], frame["done"], strict=True):
                held[int(seq)] = content or ""
                if done:
                    last = int(seq) if last < 0 else min(last, int(seq))
        if closed:
            state.update(([], [], last, True))
        elif last >= 0 and all(k in held for k in range(last + 1)):
            yield pd.DataFrame({"request_id": [key[0]], "response": ["".join(held[k] for k in range(last + 1))]})
            state.update(([], [], last, True))
        else:
            state.update((list(held), list(held.values()), last, False))
        if at:
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + patience)

    chunks = chunks.withWatermark(at, f"{patience} milliseconds") if at else chunks
    return chunks.groupBy("request_id").applyInPandasWithState(update, "request_id long, response string", "seqs array<long>, contents array<string>, last long, closed boolean", "append", GroupStateTimeout.EventTimeTimeout if at else GroupStateTimeout.NoTimeout)
