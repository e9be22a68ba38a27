"""The bounded sample of labelled rows that the classifiers learn from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documented bound of a training sample: characters in all. The rows' bound is the classifier's.
SAMPLE_CHARS = 40_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, chars: int = SAMPLE_CHARS) -> pd.DataFrame:
    """text, label of at most `rows` documents and `chars` characters, in a fixed pseudo-random order.

    learn: condition on doc_id of the rows that may be learned from. Null labels are not labels; of
    several labels of one document the largest holds. A text that does not fit in what is left of the
    characters is left out, and the next one is tried. Only the sample comes to the driver: at most
    `chars` characters.
    """
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = labels.select("doc_id", F.col(label).alias("label")).where(learn & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("o", order).orderBy("o", "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # Which rows fit is settled on their lengths (at most `rows` of them); texts of those alone are fetched.
    keys = found.select("doc_id", "o", F.xxhash64("text").alias("h"), F.length("text").alias("n")).distinct().orderBy("o", "doc_id", "h").limit(rows)
    fit, free = [], chars
    for r in keys.collect():
        if r["n"] <= free:
            fit.append((r["doc_id"], r["h"]))
            free -= r["n"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    upto = docs.sparkSession.createDataFrame(fit, f"doc_id {kind}, h bigint")
    got = found.withColumn("h", F.xxhash64("text")).join(F.broadcast(upto), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    got = got.select("o", "doc_id", "h", "label", "text").toPandas()
    return got.sort_values(["o", "doc_id", "h"], ignore_index=True)[["text", "label"]]
