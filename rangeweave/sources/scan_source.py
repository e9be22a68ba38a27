"""Logs of binary scans as a data source: `spark.read.format("range_scans").load(folder)`, or a stream of it.

A folder holds logs, each a folder of files named by frame (`<log>/.../0000000012.bin`, records of four little-endian float32). As in
`scans.read_binary`, a log ends before its first missing frame, and an empty file counts as missing. Partitions are runs of
`frames` frames of one log. Conditions on log and frame are answered from the file list, so other files are not opened. As a stream, the
offset of a log is the number of frames before its first gap: files that arrive out of order wait for the ones before them.

Folders are listed and files read through pyarrow's file systems: a path that all workers reach, or a URI that pyarrow knows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from rangeweave.session import ship

SCHEMA = "log string, frame int, point_id int, x float, y float, z float, intensity smallint"
NAME = re.compile(r"(\d+)\.bin$")
RUN = 16


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def frames_of(path: str) -> dict[str, list[str]]:
    """Of every log, its files from frame 0 up to the first gap."""
    from pyarrow import fs

    system, top = _open(path)
    logs: dict[str, dict[int, str]] = {}
    for info in system.get_file_info(fs.FileSelector(top, recursive=True)):
        if info.is_file and info.size and (n := NAME.search(info.path)):
            logs.setdefault(info.path.rsplit("/", 1)[0], {})[int(n[1])] = info.path
    return {log: [files[f] for f in range(next(k for k in range(len(files) + 1) if k not in files))] for log, files in sorted(logs.items())}


@dataclass
class Run(InputPartition):
    """Files of successive frames of one log."""

    log: str
    first: int
    files: list[str]


def runs(logs: dict[str, list[str]], size: int, begin: dict[str, int] | None = None, keep=lambda log, frame: True) -> list[Run]:
    """The frames from begin (0) on that are wanted, in runs of so many."""
    out = []
    for log, files in logs.items():
        for at in range((begin or {}).get(log, 0), len(files)):
            if keep(log, at):
                if out and out[-1].log == log and len(out[-1].files) < size and out[-1].first + len(out[-1].files) == at:
                    out[-1].files.append(files[at])
                else:
                    out.append(Run(log, at, [files[at]]))
    return out


def rows_of(top: str, run: Run) -> Iterator:
    import numpy as np
    import pyarrow as pa

    system, _ = _open(top)
    for frame, path in enumerate(run.files, run.first):
        with system.open_input_stream(path) as f:
            raw = f.read()
        p = np.frombuffer(raw[: len(raw) // 16 * 16], dtype="<f4").reshape(-1, 4)
        n = len(p)
        yield pa.RecordBatch.from_arrays(
            [pa.array([run.log] * n, pa.string()), pa.array(np.full(n, frame, dtype=np.int32)), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(np.ascontiguousarray(p[:, a])) for a in range(3)), pa.array((p[:, 3] * 255).astype(np.int16))],
            ["log", "frame", "point_id", "x", "y", "z", "intensity"],
        )


#: How a pushed condition on a column is tested.
_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}


class ScanReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size, self.tests = path, size, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on log and frame, which hold for whole files; the others are left to Spark."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("log",), ("frame",)):
                self.tests.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Run]:
        keep = lambda log, frame: all(_TESTS[t]({"log": log, "frame": frame}[c], v) for t, c, v in self.tests)
        return runs(frames_of(self.path), self.size, keep=keep) or [Run("", 0, [])]

    def read(self, partition: Run) -> Iterator:
        yield from rows_of(self.path, partition)


class ScanStream(DataSourceStreamReader):
    """Offsets: a JSON text of log to number of frames."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"frames": "{}"}

    def latestOffset(self) -> dict:
        return {"frames": json.dumps({log: len(files) for log, files in frames_of(self.path).items()}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        begin, stop = (json.loads(o["frames"]) for o in (start, end))
        logs = {log: files[: stop[log]] for log, files in frames_of(self.path).items() if log in stop}
        return runs(logs, self.size, begin)

    def read(self, partition: Run) -> Iterator:
        yield from rows_of(self.path, partition)


class ScanSource(DataSource):
    """Options: path; frames, the most frames of a partition (16)."""

    @classmethod
    def name(cls) -> str:
        return "range_scans"

    def schema(self) -> str:
        return SCHEMA

    def _args(self) -> tuple[str, int]:
        return self.options["path"].rstrip("/"), int(self.options.get("frames", RUN))

    def reader(self, schema: StructType) -> ScanReader:
        return ScanReader(*self._args())

    def streamReader(self, schema: StructType) -> ScanStream:
        return ScanStream(*self._args())


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets conditions reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ScanSource)
