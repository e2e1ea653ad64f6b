"""Incremental intake with Structured Streaming: windows, de-duplication, stateful lockouts, upserts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attestry.session import shared_dir, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, its time with a zone so that it can carry a watermark."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def per_window(stream: DataFrame, width: str, *by: str, delay: str = "1 hour") -> DataFrame:
    """(start, by..., n) for tumbling windows; with a watermark, rows later than ``delay`` are left out in append mode."""
    w = F.window("ts", width)
    return stream.withWatermark("ts", delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n")


def per_session(stream: DataFrame, gap: str, *by: str, delay: str = "1 hour") -> DataFrame:
    """(start, end, by..., n) for sessions that a pause of ``gap`` ends."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def first_seen(stream: DataFrame, delay: str, *keys: str) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def lockouts(stream: DataFrame, minutes: int, most: int, failure: str = "error") -> DataFrame:
    """(user_id, at): a user's lockouts: ``most`` failures within ``minutes``, after which the count begins anew."""
    span = minutes * 60.0

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        out = []
        for pdf in parts:
            for t in sorted(pdf["t"].tolist()):
                times = [x for x in times if x > t - span] + [t]
                if len(times) >= most:
                    out.append(t)
                    times = []
        state.update((times,))
        if out:
            yield pd.DataFrame({"user_id": [key[0]] * len(out), "at": out})

    timed = stream.where(F.col("event_type") == failure).select("user_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, at double", "times array<double>", "append", GroupStateTimeout.NoTimeout)


def upsert(target: str, key: str, order: str):
    """A foreachBatch function: the latest version of each key replaces the table at ``target`` (a new folder each time, then a pointer)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pointer = f"{target}/current"
        fs = spark._jvm.org.apache.hadoop.fs.Path(pointer)
        if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
            at = spark.read.text(pointer).first().value
            batch = spark.read.parquet(at).unionByName(batch)
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        place = f"{target}/version-{number}"
        newest.write.mode("overwrite").parquet(place)
        spark.createDataFrame([(place,)], "value string").coalesce(1).write.mode("overwrite").text(pointer)

    return write


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return what it wrote, as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    if mode == "append":
        query = writer.format("parquet").outputMode("append").option("path", f"{base}/out").start()
    else:  # each batch has the whole result: the last one stays
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
