"""Match rows as files of fixed-length records: `df.write.format("match_rows").mode("append").save(folder)`.

A record is the first column's level probabilities (float32), its patch, the second column's, and the label (int32), all little-endian. A task
writes to a file of its own under `_writing`; files move into the folder when the whole job has succeeded, so neither a retried task
nor a failed job leaves half a file. Columns: p1, p2 (array of float), patch1, patch2 (binary), label (int).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from rangeweave.session import ship

SCHEMA = "p1 array<float>, patch1 binary, p2 array<float>, patch2 binary, label int"


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class MatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, batches: Iterator) -> Written:
        import numpy as np

        system, top = self._system()
        name, size, out = f"{top}/_writing/{self.job}/{uuid.uuid4().hex}.bin", None, None
        for b in batches:
            for r in b.to_pylist():
                raw = np.array(r["p1"], "<f4").tobytes() + r["patch1"] + np.array(r["p2"], "<f4").tobytes() + r["patch2"] + np.int32(r["label"]).astype("<i4").tobytes()
                if size is None:
                    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    size, out = len(raw), system.open_output_stream(name)
                if len(raw) != size:
                    raise ValueError(f"a record of {len(raw)} bytes among records of {size}")
                out.write(raw)
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written]) -> None:
        system, top = self._system()
        system.create_dir(top, recursive=True)
        for m in messages:
            if m is not None and m.path:
                system.move(m.path, f"{top}/{self.job[:8]}-{m.path.rsplit('/', 1)[1]}")
        self._gone(system, top)

    def abort(self, messages: list[Written]) -> None:
        self._gone(*self._system())

    def _gone(self, system, top: str) -> None:
        from pyarrow import fs

        place = f"{top}/_writing/{self.job}"
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class MatchFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "match_rows"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> MatchWriter:
        if overwrite:
            raise ValueError("match rows are added to a folder; give a new one instead of overwriting")
        return MatchWriter(self.options["path"].rstrip("/"))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(MatchFile)


def with_patches(levels: DataFrame, patches: DataFrame) -> DataFrame:
    """levels (frame, i, j, i2, j2, label, p1, p2) with the patches (frame, i, j, content) of both columns, as match_rows takes
    them; pairs with a column that has no patch are left out."""
    a = patches.select("frame", "i", "j", F.col("content").alias("patch1"))
    b = patches.select((F.col("frame") - 1).alias("frame"), F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("content").alias("patch2"))
    out = levels.join(a, ["frame", "i", "j"]).join(b, ["frame", "i2", "j2"])
    floats = lambda c: F.col(c).cast("array<float>").alias(c)
    return out.select(floats("p1"), "patch1", floats("p2"), "patch2", F.col("label").cast("int").alias("label"))
