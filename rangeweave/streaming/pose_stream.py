"""The pose filter over a stream: one filter state per sequence in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rangeweave.operators.filters import fold_batch
from rangeweave.session import ship

OBSERVED = "key bigint, seq bigint, x double, y double, h double, v_f double, v_h double"
FILTERED = "key bigint, seq bigint, x double, y double, h double, v double, w double"
STATE = "seq bigint, mu array<double>, sigma array<double>, x0 double, y0 double, age int"


def read_observations(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files of observations."""
    return spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def filter_stream(observed: DataFrame) -> DataFrame:
    """Like filters.filter_poses. Observations that come after a later one of their key are left out."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new, out = fold_batch(state.get if state.exists else None, batches, key[0])
        if new is not None:
            state.update(new)
        yield out

    ship(observed.sparkSession)
    return observed.groupBy("key").applyInPandasWithState(run, FILTERED, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """start, n: events per tumbling window, rows later than `late` dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
