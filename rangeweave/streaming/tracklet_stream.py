"""Tracklets over a stream of column motions: a state processor per sequence.

The rows of a frame may come in several micro-batches and frames out of order. Rows wait in the state until a frame that lies
`lag` frames ahead of theirs has come; then their frame is taken, in order. A sequence that has been silent for `idle`
milliseconds has ended: a timer takes the frames that still wait, and its state goes. Rows of a frame that has been taken are late; they
are left out. The state of a sequence is one tracklet a column and the rows of the frames that wait.

Needs the RocksDB state store (see `use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rangeweave.operators.filters import TRACKLET, Followed
from rangeweave.session import ship

MOTION = "sequence bigint, frame int, i int, j int, u int, v int, valid int"
FOLLOWED = "sequence bigint, " + TRACKLET
_ROW = ("i", "j", "u", "v")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_motions(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files of motions."""
    return spark.readStream.schema(MOTION).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class _Follow(StatefulProcessor):
    def __init__(self, res: float, dims: tuple[int, int], lag: int, idle: int):
        self.res, self.dims, self.lag, self.idle = res, dims, lag, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "last int, cells binary, mu binary, sigma binary, age binary")
        self.waiting = handle.getMapState("waiting", "frame int", "rows binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def _take(self, sequence: int, upto: int | None) -> Iterator[pd.DataFrame]:
        """Takes the frames that wait, in order, up to one."""
        ready = sorted(f for (f,) in self.waiting.keys() if upto is None or f <= upto)
        if not ready:
            return
        state = Followed(self.res, self.dims)
        if self.now.exists():
            state.unpack(*self.now.get())
        for f in ready:
            rows = np.frombuffer(self.waiting.getValue((f,))[0], np.int32).reshape(-1, 4)
            out = state.step(f, *rows.T)
            self.waiting.removeKey((f,))
            if len(out["age"]):
                yield pd.DataFrame({"sequence": np.full(len(out["age"]), sequence, dtype=np.int64), **out})
        self.now.update(state.packed())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = self.now.get()[0] if self.now.exists() else None
        newest = max((f for (f,) in self.waiting.keys()), default=-1)
        for f in rows:
            newest = max(newest, int(f["frame"].max()))
            for frame, part in f[f["valid"] == 1].groupby("frame"):
                frame = int(frame)
                if taken is None or frame > taken:
                    held = self.waiting.getValue((frame,))[0] if self.waiting.containsKey((frame,)) else b""
                    self.waiting.updateValue((frame,), (held + part[list(_ROW)].to_numpy().astype(np.int32).tobytes(),))
        yield from self._take(key[0], newest - self.lag)
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.idle
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take(key[0], None)
        for state in (self.now, self.timer, self.waiting):
            state.clear()

    def close(self) -> None:
        pass


def follow_stream(motions: DataFrame, res: float, dims: tuple[int, int], lag: int = 1, idle: int = 60_000) -> DataFrame:
    """Like filters.tracklets by sequence, over a stream (append mode, processing-time timers).

    A sequence that goes on after it has ended begins anew, as after a missing frame.
    """
    ship(motions.sparkSession)
    return motions.groupBy("sequence").transformWithStateInPandas(_Follow(res, dims, lag, idle), outputStructType=FOLLOWED, outputMode="append", timeMode="processingTime")
