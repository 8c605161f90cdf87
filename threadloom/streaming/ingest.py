"""Resumable index scan: new lines as a stream, upserted by key into a table partitioned by group; streamed states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from threadloom.operators.posts import moved_on
from threadloom.sources.readers import article_lines
from threadloom.sources.sinks import publish, published

SAMPLES = 20


def lines_of(spark: SparkSession, folder: str, files_per_trigger: int = 100, bytes_per_trigger: str | None = None) -> DataFrame:
    """New files of a folder, oldest first; a batch is bounded by files and, if asked, by bytes, which stand for a
    number of lines."""
    reader = spark.readStream.option("latestFirst", "false")
    reader = reader.option("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder)


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, group: str, server: str = "", **batches: object) -> None:
    """Takes what came since the last run. A batch writes one folder, so a batch that is run again replaces
    itself; ``articles`` picks the newest row of each id. An error ends the run; what was done before stays, and the
    next run goes on with the batch that failed."""

    def write(batch: DataFrame, number: int) -> None:
        rows = article_lines(batch).withColumns({"group": F.lit(group), "server": F.lit(server), "batch": F.lit(number)})
        rows.write.mode("overwrite").parquet(f"{table}/group_name={group}/server_name={server or 'none'}/batch_no={number}")

    lines_of(spark, folder, **batches).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def articles(spark: SparkSession, table: str, group: str | None = None) -> DataFrame:
    """The newest row of each id; of one group only its folder is read."""
    rows = spark.read.parquet(table)
    rows = rows.filter(F.col("group_name") == group) if group is not None else rows
    w = Window.partitionBy("group", "id").orderBy(F.desc("batch"), F.desc("article_no"))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "batch")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by group and window of event time, for rows not later than ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "group").count()


def sliding_means(samples: DataFrame, count: int = SAMPLES) -> DataFrame:
    """(key, at, mean) of a stream (key string, at timestamp, value double): each sample's mean with the ``count`` - 1
    before it. State is that many numbers a key; samples of a batch are taken in order of time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values(["at", "value"])
        means = []
        for v in pdf["value"]:
            last = [*last, float(v)][-count:]
            means.append(sum(last) / len(last))
        state.update((last,))
        yield pd.DataFrame({"key": key[0], "at": pdf["at"], "mean": means})

    return samples.groupBy("key").applyInPandasWithState(run, "key string, at timestamp, mean double", "last array<double>", "append", GroupStateTimeout.NoTimeout)


def follow_states(spark: SparkSession, events: DataFrame, root: str, checkpoint: str) -> None:
    """Moves the published table of states (id, staged, posted, verified) on by a stream of events (id, kind, at). A
    batch that is run again finds its events done and changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        publish(moved_on(published(spark, root), batch), root)

    events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
