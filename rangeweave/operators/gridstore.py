"""Grids that grow by blocks of frames and merge without a shuffle.

A store is a table with a partition a block of frames, bucketed and sorted by cell. A block holds each cell's counts once, so what
the merge of any blocks reads is one sorted run a bucket and block, already dealt by cell: the sums need no exchange. New
frames add blocks, old ones stay as they are; `compact` makes one block of many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeweave.operators.occupancy import totals
from rangeweave.session import stored

BUCKETS, BLOCK = 64, 64


def open_store(spark: SparkSession, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Makes the table over the folder path, with the blocks that are there. The number of buckets is the store's for good."""
    spark.createDataFrame([], "key bigint, n_free bigint, n_occ bigint, block bigint").write.mode("ignore").partitionBy("block").parquet(path)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (key BIGINT, n_free BIGINT, n_occ BIGINT, block BIGINT) USING parquet OPTIONS (path '{path}', partitionOverwriteMode 'dynamic') "
        f"PARTITIONED BY (block) CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS"
    )
    spark.sql(f"MSCK REPAIR TABLE {table}")


def _buckets(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def _write(rows: DataFrame, table: str) -> None:
    """rows: block, key, n_free, n_occ, dealt by key to as many partitions as there are buckets."""
    out = rows.select("key", "n_free", "n_occ", "block").sortWithinPartitions("block", "key")
    out.write.insertInto(table, overwrite=True)


def add(grid: DataFrame, table: str, block: int = BLOCK) -> None:
    """Adds the frames of grid (frame, key, n_free, n_occ) in blocks of so many frames.

    A block is written whole and takes the place of one of its number, so adding it again changes nothing.
    """
    rows = grid.select(F.expr(f"CAST(floor(frame / {block}) AS BIGINT)").alias("block"), "key", "n_free", "n_occ")
    rows = rows.repartition(_buckets(grid.sparkSession, table), "key")
    _write(rows.groupBy("block", "key").agg(F.sum("n_free").alias("n_free"), F.sum("n_occ").alias("n_occ")), table)


def merged(spark: SparkSession, table: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """key, n_free, n_occ, val over all blocks, or those from first to last: occupancy.merge of their frames."""
    rows = spark.table(table)
    for bound, test in ((first, F.col("block") >= first), (last, F.col("block") <= last)):
        rows = rows if bound is None else rows.where(test)
    return totals(rows, "key")


def compact(spark: SparkSession, table: str, first: int, last: int) -> None:
    """Makes the blocks from first to last one block, numbered first.

    The sum is staged and written before the old blocks go. Call again if it is cut short while they are dropped: until then
    the sum and the rest of the old blocks are both there, so don't merge in between.
    """
    old = sorted(r["block"] for r in spark.table(table).where(F.col("block").between(first, last)).select("block").distinct().collect())
    if len(old) < 2:
        return
    total = stored(merged(spark, table, first, last).select(F.lit(first).cast("bigint").alias("block"), "key", "n_free", "n_occ"), "compacted")
    _write(total.repartition(_buckets(spark, table), "key"), table)
    for b in old:
        if b != first:
            spark.sql(f"ALTER TABLE {table} DROP PARTITION (block = {b})")
