"""Streams with state of their own per key: stalled jobs, frames cut over chunks, snapshots with a fixed anchor, rows that
expire, inboxes.

State is one row per key (a time, a tail of text, an anchor or an inbox) or, for rows that expire, a list of the rows still
open in a state store on disk. Each function gets a stream and works off the rows of a batch in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor


def _gather(parts: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(list(order))


def stalled(events: DataFrame, minutes: int, done: str) -> DataFrame:
    """(user_id, action, ts): ``rerun`` at each news of an open job, ``failed`` once ``minutes`` of event time have
    passed without any; a job whose last state is ``done`` is closed. ``ts`` is the time of the
    news, or when the job failed. events(user_id, ts, event_id, event_type)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (millis,) = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "action": ["failed"], "ts": [pd.Timestamp(millis + minutes * 60_000, unit="ms")]})
            return
        last = _gather(parts, "ts", "event_id").iloc[-1]
        millis = int(last["ts"].timestamp() * 1000)
        if state.exists and state.get[0] > millis:
            return
        if last["event_type"] == done:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "action": ["closed"], "ts": [last["ts"]]})
            return
        state.update((millis,))
        state.setTimeoutTimestamp(max(millis + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "action": ["rerun"], "ts": [last["ts"]]})

    return events.withWatermark("ts", "0 seconds").groupBy("user_id").applyInPandasWithState(step, "user_id long, action string, ts timestamp", "millis long", "append", GroupStateTimeout.EventTimeTimeout)


def frames(chunks: DataFrame) -> DataFrame:
    """(stream_id, frame, data) of chunks(stream_id, chunk_no, chunk) as they come: the text after the last blank line
    waits for the next chunk. A frame's data lines are joined; the caller drops data that isn't JSON."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, n = state.get if state.exists else ("", 0)
        *whole, tail = (tail + "".join(_gather(parts, "chunk_no")["chunk"])).split("\n\n")
        state.update((tail, n + len(whole)))
        if not whole:
            return
        data = ["\n".join(x[5:].strip() for x in frame.split("\n") if x.startswith("data:")) for frame in whole]
        yield pd.DataFrame({"stream_id": key[0], "frame": range(n, n + len(whole)), "data": data}).astype({"stream_id": "int64", "frame": "int32"})

    return chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, frame int, data string", "tail string, n int", "append", GroupStateTimeout.NoTimeout)


def snapshots(events: DataFrame, minutes: int) -> DataFrame:
    """(user_id, anchor): one row for every new snapshot; events within ``minutes`` of its creation belong to it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, made = state.get[0] if state.exists else None, []
        for ts in _gather(parts, "ts")["ts"]:
            micros = ts.value // 1000
            if anchor is None or micros - anchor > minutes * 60_000_000:
                anchor = micros
                made.append(ts)
        state.update((anchor,))
        if made:
            yield pd.DataFrame({"user_id": pd.Series([key[0]] * len(made), dtype="int64"), "anchor": pd.Series(made, dtype="datetime64[ns]")})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, anchor timestamp", "anchor long", "append", GroupStateTimeout.NoTimeout)


_FEED = "event_id long, user_id long, action string"


def _feed(ids, user: int, action) -> pd.DataFrame:
    return pd.DataFrame({"event_id": pd.Series(ids, dtype="int64"), "user_id": user, "action": action}).astype({"user_id": "int64"})


class _Retention(StatefulProcessor):
    """A list of the rows that a guest still has; a timer for the oldest."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "event_id long, millis long")

    def _settle(self, key, held: list[tuple], now: int) -> pd.DataFrame:
        """Put back what is young enough; give out the rest as expired."""
        old = [r for r in held if r[1] + self.millis < now]
        kept = [r for r in held if r[1] + self.millis >= now]
        if kept:
            self.rows.put(kept)
            self.handle.registerTimer(max(min(r[1] for r in kept) + self.millis + 1, now + 1))
        elif held:
            self.rows.clear()
        return _feed([r[0] for r in old], key[0], "expired")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        millis = (new["ts"].astype("int64") // (10**6 if new["ts"].dtype == "datetime64[ns]" else 10**3)).tolist()
        yield _feed(new["event_id"].tolist(), key[0], "kept")
        new, millis = new[new["guest"]], [m for m, guest in zip(millis, new["guest"], strict=True) if guest]
        if not len(new):
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        yield self._settle(key, [*(tuple(r) for r in self.rows.get()), *zip(new["event_id"].tolist(), millis, strict=True)], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(key, [tuple(r) for r in self.rows.get()], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def retention(events: DataFrame, hours: int) -> DataFrame:
    """(event_id, user_id, action): ``kept`` when a row comes, ``expired`` once the newest row is more than ``hours`` younger.
    A row without ``guest`` never expires and leaves no state. Expiry goes by event time (timers), as a store's time to live
    knows the clock of the machine only. events(event_id, user_id, ts, guest)."""
    rows = events.withWatermark("ts", "0 seconds").groupBy("user_id")
    return rows.transformWithStateInPandas(_Retention(hours * 3_600_000), _FEED, "Append", "EventTime")


def inbox(rows: DataFrame) -> DataFrame:
    """(event_id, user_id, action): ``unread`` when news comes that its user hasn't read yet, ``read`` when a later reading of
    its item, or of all, covers it. rows(event_id, user_id, ts, item, what): ``news``, or a reading of ``item`` or ``all``. In
    whatever order they come, news no later than a reading counts as read.

    A user's state is one row, which comes and goes with the user's rows; asking a store for each part of it costs more than
    all else. It holds the last reading of all, later ones by item, and the news still unread."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (floor, *held) = state.get if state.exists else (None, [], [], [], [], [])
        marks, fresh = dict(zip(*held[:2], strict=True)), []
        for part in parts:
            for event, item, what, micros in zip(*(part[c].tolist() for c in ("event_id", "item", "what", "micros")), strict=True):
                if what == "news":
                    fresh.append((event, None if item != item else item, micros))
                elif what == "all":
                    floor = micros if floor is None else max(floor, micros)
                elif item == item:  # a reading of no item covers nothing
                    marks[item] = max(marks.get(item, micros), micros)
        marks = {i: m for i, m in marks.items() if floor is None or m > floor}
        before = list(zip(*held[2:], strict=True))
        covered = lambda r: (floor is not None and r[2] <= floor) or (r[1] in marks and r[2] <= marks[r[1]])
        unread, gone = [r for r in fresh if not covered(r)], [r[0] for r in before if covered(r)]
        left = [*(r for r in before if not covered(r)), *unread]
        if floor is not None or marks or left:
            state.update((floor, list(marks), list(marks.values()), *([r[i] for r in left] for i in range(3))))
        if unread or gone:
            yield _feed([*(r[0] for r in unread), *gone], key[0], ["unread"] * len(unread) + ["read"] * len(gone))

    # Without a time, news is older than any reading, and a reading covers nothing. Items are doubles, as pandas makes them where one is null.
    micros = F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62)))
    came = rows.filter("what = 'news' or ts is not null").select("event_id", "user_id", F.col("item").cast("double").alias("item"), "what", micros.alias("micros"))
    kept = "floor long, items array<double>, marks array<long>, ids array<long>, of array<double>, times array<long>"
    return came.groupBy("user_id").applyInPandasWithState(step, _FEED, kept, "append", GroupStateTimeout.NoTimeout)
