"""Streams over the driver's tables: files arrive one after the other, and the result is what the batch query gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch
from ..streaming import agreements
from .base import Tables, longs, query


def _arriving(df: DataFrame, t: Tables, name: str, files: int = 3) -> DataFrame:
    path = scratch(t.spark, name)
    df.repartition(files).write.parquet(path)
    return agreements.read_stream(t.spark, path, df.schema)


def _ran(out: DataFrame, t: Tables, name: str, mode: str) -> DataFrame:
    """What the stream gives in the end: every batch's rows, with its number, in a table in the shared folder."""
    path = scratch(t.spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/b={number}")

    q: StreamingQuery = out.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", scratch(t.spark, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(path).drop("b")


_EVENTS = "strftime(date_trunc('hour', ts), '%Y-%m-%d %H')"


@query(f"SELECT {_EVENTS} AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streamed_windows(t: Tables) -> DataFrame:
    events = t.events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast("double").alias("value"))
    out = _ran(agreements.windowed_sums(_arriving(events, t, "events"), "ts", "value", ["event_type"]), t, "windows", "complete")
    last = out.agg(F.max("batch")).first()[0]
    return out.where(F.col("batch") == last).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def streamed_latest(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    table = scratch(t.spark, "latest")
    agreements.merge_latest(_arriving(lines, t, "lines"), table, scratch(t.spark, "latest-state"), ["l_orderkey"], [F.desc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")]).awaitTermination()
    return longs(agreements.current(t.spark, table).select("l_orderkey", "l_linenumber", "l_partkey"), "l_linenumber")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def streamed_totals(t: Tables) -> DataFrame:
    events = t.events.select("event_type", F.col("value").cast("double").alias("value"))
    out = _ran(agreements.running_totals(_arriving(events, t, "events"), "event_type", "value"), t, "totals", "update")
    return out.groupBy("event_type").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("total", "batch"), 2).alias("total"))


@query("SELECT count(*) AS texts, count(DISTINCT text_hash) AS hashes FROM (SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL)")
def streamed_new_texts(t: Tables) -> DataFrame:
    docs = t.documents.where("text is not null").select("text", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"))
    out = _ran(agreements.new_texts(_arriving(docs, t, "texts"), "text", "at"), t, "new-texts", "append")
    return out.agg(F.count("*").alias("texts"), F.countDistinct("text_hash").alias("hashes"))
