"""State per key that rows enter in any order and leave in the order of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from mailfleet.operators.messages import reply_once

#: State variables and timers need this provider.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


class Replies(StatefulProcessor):
    """Vacation replies of one (recipient, sender): rows are (second, interval_s, ends).

    Seconds wait in a map until the watermark has passed them and are then answered in order; one
    timer per key wakes it for the first of them. ``memory`` holds the end of silence after our own
    reply, the recorded notification, the interval, and when the absence ends. It is dropped when none of
    these can silence anything: after the interval, or, with interval 0, when the absence ends.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "second bigint", "interval_s bigint, ends bigint")
        self.memory = handle.getValueState("memory", "until bigint, noted bigint, interval_s bigint, ends bigint")

    def _wake(self, second: int, now_ms: int) -> None:
        """One timer per key: the earliest that is asked for. One that is due does not count, it ends."""
        at = max(second * 1000, now_ms + 1)
        known = [t for t in self.handle.listTimers() if t > now_ms]
        if not known or at < min(known):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        noted, interval_s, ends = (int(initialState[c].iloc[0]) for c in ("noted", "interval_s", "ends"))
        self.memory.update((None, noted, interval_s, ends))
        self._wake(noted + interval_s if interval_s else ends, timerValues.getCurrentWatermarkInMs())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            for second, interval_s, ends in batch[["second", "interval_s", "ends"]].drop_duplicates().itertuples(index=False, name=None):
                self.waiting.updateValue((int(second),), (int(interval_s), int(ends)))
                first = int(second) if first is None else min(first, int(second))
        if first is not None:
            self._wake(first, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        final = now_ms // 1000
        until, noted, interval_s, ends = self.memory.get() if self.memory.exists() else (None, None, 0, 0)
        ahead, due = None, []
        for (second,), (gap, end) in list(self.waiting.iterator()):
            if second <= final:
                due.append((second, gap, end))
            else:
                ahead = second if ahead is None else min(ahead, second)
        replies = []
        for second, interval_s, ends in sorted(due):
            self.waiting.removeKey((second,))
            if noted is not None and second >= noted and (interval_s == 0 or second < noted + interval_s):
                continue
            after = reply_once(interval_s, until, second)
            if after is not None:
                until = after
                replies.append(second)
        quiet = [ends if interval_s == 0 else t for t in (
            until, None if noted is None else noted + interval_s) if t is not None]
        if quiet and max(quiet) > final:
            self.memory.update((until, noted, interval_s, ends))
            self._wake(min(ahead, max(quiet)) if ahead is not None else max(quiet), now_ms)
        else:
            self.memory.clear()
            if ahead is not None:
                self._wake(ahead, now_ms)
        if replies:
            yield pd.DataFrame({"rcpt": key[0], "sender": key[1], "second": replies})

    def close(self) -> None:
        pass


class Changes(StatefulProcessor):
    """Changes of one node's state: rows are finished clock units (unit, first, first_id, first_us, last, inner).

    A unit comes once, when the watermark has passed it, and later units come later; so the last state is all
    there is to keep.
    """

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else "ok"
        units = pd.concat(list(rows), ignore_index=True).sort_values("unit")
        out = []
        for u in units.itertuples(index=False):
            if u.first != before:
                out.append((key[0], u.first_id, u.first_us, before, u.first))
            out += [(key[0], c["sample_id"], c["us"], c["before"], c["state"]) for c in u.inner]
            before = u.last
        self.last.update((before,))
        if out:
            yield pd.DataFrame(out, columns=["node", "sample_id", "us", "before", "state"])

    def close(self) -> None:
        pass
