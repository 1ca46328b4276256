"""Stateful operators over events of a key that may come out of order.

A stream's events settle once the watermark has passed them.  Until then they
wait in the key's state, at most a watermark's delay of them, and each batch adds
its own; settled events are taken in order of time (then id), once.  What a key
emits in a batch is what the settled state and the waiting events give together,
so the last row of a key holds for all its events so far, and rows marked
`settled` won't change any more.

An event-time timer wakes a key whose events settle without new ones arriving,
and another clears the state of a key that has been idle for `idle_ms`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Ordered(StatefulProcessor):
    """Folds events (at: microseconds, id, and `fields`) of a key; subclasses say how.

    state_schema / start: a flat state as a tuple.  take(state, event) gives the
    next state and the event's own result.  rows(key, state, results, settled)
    gives what is emitted.
    """

    fields: tuple[str, ...] = ()
    event_schema = "at long, id long"
    state_schema = ""
    start: tuple = ()
    idle_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)
        self.waiting = handle.getListState("waiting", self.event_schema)
        self.last = handle.getValueState("last", "at long, wake long")

    def close(self) -> None:
        pass

    def take(self, state: tuple, event: tuple) -> tuple[tuple, object]:
        raise NotImplementedError

    def rows(self, key: tuple, state: tuple, results: list, settled: bool) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["at", "id", *self.fields]
        fresh = [e for part in rows for e in zip(*(part[c].tolist() for c in names), strict=True)]
        yield from self._step(key, fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        if last is not None and self.idle_ms is not None and not self.waiting.exists() and timerValues.getCurrentWatermarkInMs() >= last[0] // 1000 + self.idle_ms:
            self.state.clear()
            self.last.clear()
            return
        yield from self._step(key, [], timerValues)

    def _step(self, key: tuple, fresh: list[tuple], timer) -> Iterator[pd.DataFrame]:
        mark = timer.getCurrentWatermarkInMs()
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        events = sorted(held + fresh, key=lambda e: e[:2])
        state = tuple(self.state.get()) if self.state.exists() else self.start
        done, n = [], 0
        # Events of the watermark's own millisecond may still come.
        while n < len(events) and events[n][0] // 1000 < mark:
            state, result = self.take(state, events[n])
            done.append(result)
            n += 1
        if n:
            self.state.update(state)
            yield from self.rows(key, state, done, True)
        waiting = events[n:]
        if waiting:
            if fresh or n:
                self.waiting.put(waiting)
            ahead, open_ = state, []
            for e in waiting:
                ahead, result = self.take(ahead, e)
                open_.append(result)
            yield from self.rows(key, ahead, open_, False)
        elif held:
            self.waiting.clear()
        if events:
            before = self.last.get() if self.last.exists() else (events[-1][0], -1)
            wake = before[1]
            # One timer at a time: for what waits longest, else for the end of an idle key.
            want = waiting[-1][0] // 1000 + 1 if waiting else max(before[0], events[-1][0]) // 1000 + self.idle_ms if self.idle_ms is not None else -1
            if want != wake:
                if wake > mark:
                    self.handle.deleteTimer(wake)
                if want > mark:
                    self.handle.registerTimer(want)
            self.last.update((max(before[0], events[-1][0]), want))
