"""The streaming linker on Spark's stateful processors: state by frame, and timers for videos that end without saying so."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.link import Linker
from .linker import OUT

#: The state store that stateful processors need.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class LinkProcessor(StatefulProcessor):
    """Of each video: the frames that wait, each an entry of its own, and the linker's remembered detections."""

    def __init__(self, search_range: float, memory: int, gaps: str, hold_back: int, idle_ms: int):
        self.search_range, self.memory, self.gaps, self.hold_back, self.idle_ms = search_range, memory, gaps, hold_back, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "frame int", "seq array<bigint>, y array<double>, x array<double>")
        self.clock = handle.getValueState("clock", "last int, newest int, next_id bigint")
        self.remembered = handle.getListState("remembered", "age int, particle bigint, y double, x double")

    def linker(self, next_id: int) -> Linker:
        found = [tuple(r) for r in self.remembered.get()] if self.remembered.exists() else []
        rows = lambda age: [tuple(r[1:]) for r in found if r[0] == age]
        return Linker.restored(self.search_range, self.memory, {"next_id": next_id, "previous": rows(0), "lost": [rows(k) for k in range(1, self.memory + 1)]})

    def keep(self, linker: Linker, last: int | None, newest: int) -> None:
        state = linker.state()
        rows = [(age, *map(_plain, r)) for age, own in enumerate([state["previous"], *state["lost"]]) for r in own]
        self.remembered.put(rows) if rows else self.remembered.clear()
        self.clock.update((last, newest, state["next_id"]))

    def linked(self, key: tuple, ready: int, newest: int) -> Iterator[pd.DataFrame]:
        """Links all waiting frames up to `ready`, in order; other frames' entries aren't touched."""
        last, _, next_id = self.clock.get() if self.clock.exists() else (None, None, 0)
        linker = self.linker(next_id)
        for frame in sorted(k[0] for k in self.waiting.keys()):
            if frame > ready:
                break
            seq, y, x = (np.array(c) for c in self.waiting.getValue((frame,)))
            order = np.lexsort((seq, x, y))
            for _ in range(min(frame - last - 1, self.memory + 1) if last is not None and self.gaps == "advance" else 0):
                linker.advance(np.zeros((0, 2)))
            last = frame
            ids = linker.advance(np.stack([y[order], x[order]], axis=1))
            yield pd.DataFrame({"video_id": key[0], "frame": frame, "seq": seq[order], "y": y[order], "x": x[order], "particle": ids})
            self.waiting.removeKey((frame,))
        self.keep(linker, last, newest)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, newest, _ = self.clock.get() if self.clock.exists() else (None, None, 0)
        mark = None
        for pdf in rows:
            ended = pdf["y"].isna()
            if ended.any():
                mark = max(int(pdf.loc[ended, "frame"].max()), mark if mark is not None else int(pdf.loc[ended, "frame"].max()))
            newest = max(int(pdf["frame"].max()), newest if newest is not None else int(pdf["frame"].max()))
            for frame, own in pdf[~ended].groupby("frame"):
                if last is not None and frame <= last:
                    continue  # too late
                entry = (int(frame),)
                held = self.waiting.getValue(entry) if self.waiting.containsKey(entry) else ([], [], [])
                self.waiting.updateValue(entry, tuple([*map(_plain, old), *own[c].tolist()] for c, old in zip(("seq", "y", "x"), held)))
        ready = newest - self.hold_back
        yield from self.linked(key, ready if mark is None else max(ready, mark), newest)
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A video that has been silent is over: what waits is linked, and its state goes."""
        if self.clock.exists():
            newest = self.clock.get()[1]
            yield from self.linked(key, newest, newest)
            self.remembered.clear()
            self.waiting.clear()
            self.clock.clear()

    def close(self) -> None:
        pass


def _plain(v):
    return v.item() if hasattr(v, "item") else v


def linked_by_frames(detections: DataFrame, search_range: float, memory: int = 0, gaps: str = "advance", hold_back: int = 0, idle_seconds: float = 0.0) -> DataFrame:
    """linked_stream(), with an entry of state for each waiting frame, so that a batch rewrites what it changes.

    With idle_seconds, a video that sends nothing for so long is over: frames that wait are linked and its state is dropped; frames that come
    later start a new video of that name, numbered from 0. The session needs the state store PROVIDER.
    """
    processor = LinkProcessor(search_range, memory, gaps, hold_back, int(idle_seconds * 1000))
    rows = detections.select("video_id", "frame", "seq", "y", "x")
    return rows.groupBy("video_id").transformWithStateInPandas(processor, OUT, "Append", "ProcessingTime" if idle_seconds else "None")
