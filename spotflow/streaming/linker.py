"""Linking as a stream: the fold of operators.link, with its state kept between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.link import Linker

OUT = "video_id string, frame int, seq long, y double, x double, particle long"
STATE = "linker binary, last int, held binary"
NEVER = -(1 << 31)


def linked_stream(detections: DataFrame, search_range: float, memory: int = 0, gaps: str = "advance", hold_back: int = 0) -> DataFrame:
    """detections(video_id, frame, seq, y, x) of a stream with particle.

    Frames are linked in order. The newest hold_back frames of a video wait for rows that come late; a row
    without y says that all frames up to its own have come, which lets those that wait go on, as at the end
    of a video. A frame not behind the last linked one is too late and is dropped. State is the last frame,
    the remembered ones and those that wait, of each video, however long it runs.
    """
    def advance(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        linker, last, parts = Linker(search_range, memory), NEVER, list(pdfs)
        if state.exists:
            packed, last, held = state.get
            linker = Linker.restored(search_range, memory, pickle.loads(packed))
            if (old := pickle.loads(held)) is not None:
                parts.insert(0, old)
        pdf = pd.concat(parts)
        marks = pdf["y"].isna()
        ready = int(pdf["frame"].max()) - hold_back
        if marks.any():
            ready = max(ready, int(pdf.loc[marks, "frame"].max()))
        rows = pdf[~marks].sort_values(["frame", "y", "x", "seq"])
        out = []
        for t, own in rows[rows["frame"] <= ready].groupby("frame", sort=True):
            if t <= last:
                continue
            for _ in range(min(int(t) - last - 1, memory + 1) if last != NEVER and gaps == "advance" else 0):
                linker.advance(np.zeros((0, 2)))
            last = int(t)
            out.append(own.assign(particle=linker.advance(own[["y", "x"]].to_numpy(float))))
        waiting = rows[(rows["frame"] > ready) & (rows["frame"] > last)]
        state.update((pickle.dumps(linker.state()), last, pickle.dumps(waiting if len(waiting) else None)))
        for o in out:
            yield o[["video_id", "frame", "seq", "y", "x", "particle"]]

    return detections.select("video_id", "frame", "seq", "y", "x").groupBy("video_id").applyInPandasWithState(advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
