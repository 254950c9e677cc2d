"""Learning as keyed stream state with timers: reviews that fall due, chapters that are completed once.

Both run as ``transformWithState``, whose state store is RocksDB
(``STORE`` is the setting).  State and timers survive a restart from the
checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wordloom.operators.learning import FIRST_EASE

from .reviews import next_state

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STATE = "reviews long, ease double, interval long, repetitions long, due_at long, updated_at long"
DUE = f"key string, kind string, {_STATE}"
COMPLETED = "reader string, chapter string, completed_at long"


class Reviews(StatefulProcessor):
    """A word's state after its reviews, and the word again when it falls due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at_ms", "event_id"])
        first = int(events.at_ms.iloc[0])
        state = tuple(self.state.get()) if self.state.exists() else (0, FIRST_EASE, 0, 0, first, first)
        for timer in [t for t in self.handle.listTimers()]:
            self.handle.deleteTimer(timer)  # a review puts the word off
        for at, quality in zip(events.at_ms, events.quality, strict=True):
            state = next_state(state, float(quality), int(at))
        self.state.update(state)
        self.handle.registerTimer(state[4])
        yield self._row(key, "reviewed", state)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield self._row(key, "due", tuple(self.state.get()))

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: Any, kind: str, state: tuple) -> pd.DataFrame:
        return pd.DataFrame([(key[0], kind, *state)], columns=["key", "kind", "reviews", "ease", "interval", "repetitions", "due_at", "updated_at"])


class Completions(StatefulProcessor):
    """Per reader a map from chapter to what is known of it: opened short of its end, completed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chapters = handle.getMapState("chapters", "chapter string", "short boolean, done boolean")

    def __init__(self, least: int):
        self.least = least

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events, out = pd.concat(list(rows)).sort_values(["at_ms", "event_id"]), []
        for chapter, own in events.groupby("chapter", sort=True):
            known = self.chapters.getValue((chapter,)) if self.chapters.containsKey((chapter,)) else None
            short, done = tuple(known) if known else (bool(own.percent.iloc[0] < self.least), False)
            full = own[own.percent >= self.least]
            if short and not done and len(full):
                done = True
                out.append((key[0], chapter, int(full.at_ms.iloc[0])))
            self.chapters.updateValue((chapter,), (short, done))
        yield pd.DataFrame(out, columns=["reader", "chapter", "completed_at"])

    def close(self) -> None:
        pass


def due_words(reviews: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of (key, at, at_ms, event_id, quality) to (key, kind, state): ``reviewed`` after every batch, ``due`` when the watermark passes due_at.

    ``at`` is the event time; events of a key come in order but for those of one
    batch, which are sorted.  A review before a word falls due moves its timer.
    """
    return reviews.withWatermark("at", late).groupBy("key").transformWithStateInPandas(Reviews(), DUE, "Append", "EventTime")


def completion_stream(scrolls: DataFrame, least: int = 96) -> DataFrame:
    """A stream of (reader, chapter, at_ms, event_id, percent) to each chapter's first end, once.

    A chapter whose first event is at its end already gives nothing, as in ``learning.completions``.
    """
    return scrolls.groupBy("reader").transformWithStateInPandas(Completions(least), COMPLETED, "Append", "None")
