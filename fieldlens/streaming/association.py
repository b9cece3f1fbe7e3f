"""Tracks from a stream of detections: the tracker's state is kept in the state store between micro-batches (ML18)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.association import SEEN_BOX, STATE, TRACK, Tracker, Tracks, by_frame

#: transformWithState keeps its state in this provider only.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = f"seq string, frame bigint, {TRACK}"
#: Rows of tracks that are handed on together.
AT_ONCE = 10_000


class Associator(StatefulProcessor):
    """A sequence's tracks as a map from identity to filter; a micro-batch writes the tracks that changed and removes those that went.

    Frames may come in any order within a micro-batch, so a sequence's detections in it are held, as six arrays of numbers; tracks are handed on as they come.
    """

    def __init__(self, settings: Tracker):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getMapState("tracks", "track_id bigint", STATE)
        self.clock = handle.getValueState("clock", "next_id bigint, frame bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: (k[0], *v) for k, v in self.tracks.iterator()} if self.tracks.exists() else {}
        next_id, frame = self.clock.get() if self.clock.exists() else (1, 0)
        tracks = Tracks(self.settings).load([(*r[:5], list(r[5])) for r in before.values()], int(next_id), int(frame))
        out: list[tuple] = []
        for f, d in by_frame(held(rows, int(frame))):
            out += [(key[0], f, *row) for row in tracks.step(f, d)]
            if len(out) >= AT_ONCE:
                yield table_of(out)
                out = []
        after = {r[0]: r for r in tracks.rows()}
        for k in before.keys() - after.keys():
            self.tracks.removeKey((k,))
        for k, r in after.items():
            self.tracks.updateValue((k,), r[1:])
        self.clock.update((tracks.next_id, tracks.frame))
        yield table_of(out)

    def close(self) -> None:
        pass


def held(rows: Iterator[pd.DataFrame], after: int) -> dict[str, np.ndarray]:
    """The numbers of whole detections of frames after this one."""
    names, kept = ("frame", *SEEN_BOX), []
    for pdf in rows:
        pdf = pdf[list(names)].dropna()
        pdf = pdf[pdf["frame"] > after]
        kept.append({c: pdf[c].to_numpy(np.int64 if c == "frame" else np.float64, copy=True) for c in names})
    return {c: np.concatenate([part.pop(c) for part in kept]) for c in names}


def table_of(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"seq": object, "frame": "int64", "track_id": "int64"})


def associate_stream(detections: DataFrame, settings: Tracker = Tracker()) -> DataFrame:
    """``associate`` over a stream of detections (seq, frame, x, y, w, h, conf) that brings each sequence's frames whole and in order; frames that are late are dropped."""
    detections.sparkSession.conf.set(*STATE_STORE)
    return detections.groupBy("seq").transformWithStateInPandas(Associator(settings), OUT, "append", "None")
