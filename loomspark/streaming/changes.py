"""Structured Streaming forms: followed logs, windows over event time, rings, upserts by batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspark.operators.relational import latest


def followed(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A stream of the rows of files as they appear in a folder."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", 1).load(path)


def tumbling(events: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of value by windows of event time; rows later than `late` are left out (an addition to the reference)."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    stream = timed.withWatermark(time, late) if events.isStreaming else timed
    return stream.groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    """Runs of a key's events with no gap of that size (an addition to the reference)."""
    return events.groupBy(key, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def ring(stream: DataFrame, key: str, ident: str, time: str, keep: int) -> DataFrame:
    """The ids of a key's newest `keep` rows whenever they change; a key's state is bounded by keep."""

    def push(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[Any] = list(zip(*state.get, strict=True)) if state.exists else []
        for df in batches:
            held += zip(df[ident].tolist(), (df[time].astype("int64") // 1000).tolist(), strict=True)
        held = sorted(set(held), key=lambda x: (-x[1], -x[0]))[:keep]
        state.update(([a for a, _ in held], [b for _, b in held]))
        yield pd.DataFrame({key: [k[0]], "ids": [[a for a, _ in held]]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(push, f"{key} {kind}, ids array<long>", "ids array<long>, at array<long>", "update", GroupStateTimeout.NoTimeout)


def upsert_into(stream: DataFrame, path: str, key: list[str], seq: str, checkpoint: str) -> Any:
    """Each batch's latest rows merged into a table of numbered versions; a repeated batch writes its own version again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch, key, F.desc(seq))
        if number:
            old = spark.read.parquet(f"{path}/version={number - 1}")
            fresh = latest(old.unionByName(fresh), key, F.desc(seq))
        fresh.write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retained(log: DataFrame, seq: str, time: str, bounds: list[int | None], cutoff: str) -> DataFrame:
    """Rows a change log may not yet drop: at or above the least known bound, or newer than the cutoff."""
    known = [b for b in bounds if b is not None]
    return log.where((F.col(seq) >= min(known)) | (F.col(time) >= F.lit(cutoff).cast("timestamp"))) if known else log
