"""Streams: the player's highlight per session, and pauses as session windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

CHANGES = "session_id string, us long, t double, action string, from_idx int, to_idx int"
#: What a session's processor keeps: the word that is lit (or -1), the one before, and when it last saw an event; and events to come.
CURSOR, EVENT = "current int, previous int, seen long", "us long, t double, kind string, word_idx int"


def advance(state: tuple, event: tuple, idle: int) -> tuple[tuple, list[tuple]]:
    """The state after an event, and the changes (us, t, action, from, to) that it brings; the rules of player_changes().

    state: (current, previous, seen, t); event: (us, t, kind, word).
    """
    current, previous, seen, clock = state
    us, t, kind, word = event
    out = []
    if seen is not None and us - seen >= idle:
        out += ending(state)
        current = previous = -1
    if kind == "play" and t < 0.1:
        if max(current, previous) >= 0:
            out.append((us, t, "clear", 0, max(current, previous)))
        current = previous = -1
    elif kind == "ended" and current >= 0:
        out.append((us, t, "read", current, current))
    elif kind == "tick" and word != current:
        if word >= 0 and max(current, previous) >= 0 and word > max(current, previous) + 1:
            out.append((us, t, "read", max(current, previous) + 1, word - 1))
        if current >= 0:
            out.append((us, t, "read", current, current))
        if word >= 0:
            out.append((us, t, "active", word, word))
            if 0 <= word < current:
                out.append((us, t, "clear", word + 1, current))
        current, previous = word, current
    return (current, previous, us, t), out


def ending(state: tuple) -> list[tuple]:
    current, _, seen, t = state
    return [(seen, t, "read", current, current)] if current >= 0 else []


class Player(StatefulProcessor):
    """Keeps a session's events until the watermark has passed them, then takes them by time, so that late ones within the watermark change nothing.

    A timer stands at the first event that waits, or where none does, at the time when the session has been idle for long enough: then
    it has ended, and its state goes.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", CURSOR + ", t double")
        self.waiting = handle.getListState("waiting", EVENT)

    def wake(self, us: int) -> None:
        """A timer at a time that isn't before `us`."""
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        least = None
        for batch in rows:
            known = batch[batch["kind"].isin(["tick", "play", "ended"])]
            if len(known):
                self.waiting.appendList([(int(a), float(b), str(c), int(-1 if pd.isna(d) else d)) for a, b, c, d in zip(known["us"], known["t"], known["kind"], known["word_idx"], strict=True)])
                least = min(known["us"].min(), least or known["us"].min())
        if least is not None:
            self.wake(int(least))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: (x[0], x[1], x[2])) if self.waiting.exists() else []
        due = [x for x in waiting if x[0] <= passed]
        rest = waiting[len(due) :]
        state, out = (tuple(self.cursor.get()) if self.cursor.exists() else (-1, -1, None, None)), []
        for event in due:
            state, found = advance(state, event, self.idle)
            out += found
        if state[2] is not None and not rest and passed >= state[2] + self.idle:
            out += ending(state)
            self.cursor.clear()
            self.waiting.clear()
        else:
            if state[2] is not None:
                self.cursor.update(state)
            if due:
                self.waiting.put(rest) if rest else self.waiting.clear()
            if rest:
                self.wake(rest[0][0])
            elif state[2] is not None:
                self.wake(state[2] + self.idle)
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["session_id", "us", "t", "action", "from_idx", "to_idx"])

    def close(self) -> None:
        pass


def highlight_stream(events: DataFrame, late: str = "10 seconds", idle_seconds: float = 1800.0) -> DataFrame:
    """player_changes() of a stream (session_id, at, t, kind, word_idx): what micro-batches the events come in, and in which order, changes nothing.

    Events later than `late` are dropped. State needs the RocksDB provider (spark.sql.streaming.stateStore.providerClass); a
    session's goes when it has been idle for idle_seconds.
    """
    own = events.select("session_id", "at", F.unix_micros("at").alias("us"), "t", "kind", F.col("word_idx").cast("int").alias("word_idx")).withWatermark("at", late)
    out = own.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Player(int(idle_seconds * 1e6)), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")
    return out.select("session_id", F.timestamp_micros("us").alias("at"), "t", "action", "from_idx", "to_idx")


def pauses(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Stretches of events without a pause of `gap`, one row each (batch or stream; a stream drops events later than `late`).

    An extension of ours: the pause detection of gap_rows on an unbounded table.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if events.isStreaming else timed
    return timed.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
