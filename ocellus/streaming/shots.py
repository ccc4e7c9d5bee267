"""Shots of a stream of frames: each clip's last histogram is the state, frames come in time order with a watermark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "clip long, frame long, similarity double"
STATE = "frame long, hist array<double>"


def stream_boundaries(frames: DataFrame, threshold: float = 0.8, late: str = "10 minutes", clip: str = "clip", frame: str = "frame", hist: str = "hist", time: str = "ts") -> DataFrame:
    """Frames (clip, frame, hist, ts) that begin a shot, as they arrive: similarity to the frame before is below ``threshold``.

    Frames of one batch are put in order; a frame that comes after a later one of its clip was seen is
    dropped. A clip's state goes when the watermark has passed its last frame.
    """

    def update(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last, before = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(frame, kind="stable")
        out = []
        for n, h in zip(rows[frame], rows[hist]):
            if last is not None and n <= last:
                continue
            like = None if before is None else round(float(np.minimum(np.asarray(h), np.asarray(before)).sum()), 9)
            if like is None or like < threshold:
                out.append((key[0], n, like))
            last, before = n, h
        if last is not None:
            state.update((int(last), [float(x) for x in before]))
        state.setTimeoutTimestamp(max(int(rows[time].max().timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["clip", "frame", "similarity"])

    return frames.withWatermark(time, late).groupBy(clip).applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_histograms(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts of event types by user in windows of event time: (window, user_id, event_type, n), appended when a window closes."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
