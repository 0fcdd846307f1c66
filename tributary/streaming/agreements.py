"""Streams: latest-wins merge of amendments, deduplication by hash, windowed sums and running state by key.

The batch engine has no streams of its own to match; these let the same tables be kept up to date as rows arrive.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.dedup import latest_by
from ..session import ship


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def merge_latest(stream: DataFrame, table: str, checkpoint: str, key: Sequence[str], order: Sequence[Column]) -> StreamingQuery:
    """Keep the latest row of each key in a versioned table: every batch writes table/v=<batch> from the version before.

    A batch that is replayed after a failure overwrites its own version, so the result is the same."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        before = current(spark, table, number - 1)
        rows = batch if before is None else before.unionByName(batch)
        latest_by(rows, key, order).write.mode("overwrite").parquet(f"{table}/v={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame | None:
    """The newest version of a merged table (or the newest up to a number), None if there is none yet."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    found = [v for v in found if upto is None or v <= upto]
    return spark.read.parquet(f"{table}/v={max(found)}") if found else None


def new_texts(stream: DataFrame, text: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each distinct text once within the watermark: what still has to be classified."""
    return stream.withColumn("text_hash", F.sha2(F.col(text), 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_hash"])


def windowed_sums(stream: DataFrame, time: str, value: str, by: Sequence[str], width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling (or sliding) windows; rows later than the watermark are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def session_sums(stream: DataFrame, time: str, value: str, by: Sequence[str], gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """The number and sum of values of each key so far, after every batch, by custom state."""
    ship(stream.sparkSession)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
