"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = Path(__file__).resolve().parents[1]
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/rangeweave", "zip", top, "rangeweave"))


def bounded(small: DataFrame, rows: int) -> DataFrame:
    """small for a broadcast, refused if it has more rows than that: nothing is ever left out."""
    if small.count() > rows:
        raise ValueError(f"more than {rows} rows in a table that is to be broadcast")
    return F.broadcast(small)


def by_frame(df: DataFrame) -> DataFrame:
    """df dealt by frame to all shuffle partitions, whatever its size.

    What then groups or joins by frame and more needs no exchange, so rows that are made of others after this don't travel.
    A frame is one scan: its grid bounds what a task holds of it.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame")


_folders: dict[str, str] = {}


def stored_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is missing, a local session gets a folder of its own, and a cluster session is refused.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _folders.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="rangeweave-"))
    return f"{top.rstrip('/')}/rangeweave/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends there."""
    path = stored_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
