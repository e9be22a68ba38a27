"""Helpers shared by the training-data operators.

Conventions that hold for every operator here:

* Input frames are reduced to the columns an operator uses before anything else, so extra
  columns (whatever their names) are ignored.
* A null text counts as an empty text. A null ``doc_id`` is an ordinary key value.
* Rows that share a ``doc_id`` are told apart by their text; rows equal in both get equal results,
  one result row per input row.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.session import ship

_own_dirs: dict[str, str] = {}

#: Rows and bytes of an Arrow batch handed to Python; they bound a worker's memory where texts are long.
ARROW_ROWS, ARROW_BYTES = 400, 32 << 20
#: Words (or pieces) of more bytes than this are not remembered by the workers' memos, so that a
#: memo's bound on entries bounds its bytes as well.
MEMO_BYTES = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session gets a folder of its own; on a cluster there is none to choose.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="rangeweave-")
    return _own_dirs[app]


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block are removed at its end: only for work whose result is written by then."""
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get():
            remove(spark, path)
        _made.reset(token)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/rangeweave/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _made.get() is not None:
        _made.get().append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: the size of its batches, and this package for its workers.

    The size is a setting of the session, read when a job starts, so all operators use the same one.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def within(rows: DataFrame, small: DataFrame, on, how: str = "inner", bound: int = 1_000_000) -> DataFrame:
    """rows joined with small, which is broadcast only if it has at most `bound` rows."""
    return rows.join(F.broadcast(small) if small.count() <= bound else small, on, how)


def join_hot(rows: DataFrame, named: DataFrame, key: str, n: str, hot: int = 100_000) -> DataFrame:
    """rows joined with named, which has one row per key; n: its column with the number of rows of the key.

    Keys of more than `hot` rows (one in `hot` rows at most, so few) meet theirs in a broadcast: no
    task gets all rows of such a key. All others are joined by the key.
    """
    most = named.where(F.col(n) > hot)
    rest = rows.join(F.broadcast(most.select(key)), key, "left_anti").join(named.where(F.col(n) <= hot), key)
    return rows.join(F.broadcast(most), key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame) -> DataFrame:
    """doc_id and text (null: empty), nothing else."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def with_hash(df: DataFrame) -> DataFrame:
    """df with _th, the hash of its text (null: empty): with doc_id it is the key of a document."""
    return df.withColumn("_th", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def crc_mod(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n
