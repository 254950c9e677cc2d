"""Streaming forms of the learning state: reviews per key, and last-write-wins progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wordloom.functions.numbers import DAY_MS
from wordloom.operators.learning import FIRST_EASE, LEAST_EASE

OUT = "key string, reviews long, ease double, interval long, repetitions long, due_at long, updated_at long"
_STATE = "reviews long, ease double, interval long, repetitions long, due_at long, updated_at long"


def next_state(state: tuple, quality: float, now_ms: int) -> tuple:
    reviews, ease, interval, repetitions, _, _ = state
    q = max(0, min(5, int((quality + 0.5) // 1)))
    if q < 3:
        repetitions, interval = 0, 1
    else:
        repetitions += 1
        interval = 1 if repetitions == 1 else 6 if repetitions == 2 else int(interval * ease + 0.5)
        miss = 5 - q
        ease = max(LEAST_EASE, ease + (0.1 - miss * (0.08 + miss * 0.02)))
    return reviews + 1, ease, interval, repetitions, now_ms + interval * DAY_MS, now_ms


def review_stream(events: DataFrame) -> DataFrame:
    """A stream of (key, at_ms, event_id, quality) to the state of each key after every batch.

    Within a batch, reviews of a key are taken by time; the state is kept per
    key in Spark's state store, so a restart goes on where it stopped.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at_ms", "event_id"])
        state = held.get if held.exists else (0, FIRST_EASE, 0, 0, int(rows.at_ms.iloc[0]), int(rows.at_ms.iloc[0]))
        for at, quality in zip(rows.at_ms, rows.quality, strict=True):
            state = next_state(state, float(quality), int(at))
        held.update(state)
        yield pd.DataFrame([(key[0], *state)], columns=["key", "reviews", "ease", "interval", "repetitions", "due_at", "updated_at"])

    return events.groupBy("key").applyInPandasWithState(run, OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def progress_sink(path: str):
    """A foreachBatch function that appends each batch's last row of every key to a change log.

    Read it back with ``learning.latest``; a batch that is repeated after a
    failure adds rows with the same order and changes nothing.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        from wordloom.operators.learning import latest

        latest(batch, ["key"], ["updated_at"]).write.mode("append").parquet(path)

    return write
