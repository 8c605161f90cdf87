"""Tables and files written so that a run can be repeated: versions behind a pointer, contents as files, schemas."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; where that is unset, a local session takes a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or 'file://' + tempfile.gettempdir()).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def publish(table: DataFrame, root: str) -> str:
    """Writes a new version below ``root`` and then the pointer to it, so readers see the old table or the new one.
    Old versions stay, as readers may hold them."""
    version = uuid.uuid4().hex
    table.write.parquet(f"{root}/version={version}")
    table.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version that the newest pointer names."""
    last = spark.read.parquet(f"{root}/pointer").agg(F.max_by("version", F.struct("at", "version")).alias("version")).first()["version"]
    return spark.read.parquet(f"{root}/version={last}")


def save_contents(contents: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, content) as files below a folder that all executors see, and returns (name, path, size).
    A file is written beside its place and moved there, so one that was begun twice is whole."""

    def run(batches):
        import os

        import pandas as pd

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                path = os.path.join(folder, os.path.basename(name))
                aside = f"{path}.{uuid.uuid4().hex}"
                with open(aside, "wb") as f:
                    f.write(content)
                os.replace(aside, path)
                rows.append((name, path, len(content)))
            yield pd.DataFrame(rows, columns=["name", "path", "size"])

    return contents.select("name", "content").mapInPandas(run, "name string, path string, size long")


#: The tables of a catalogue.
TABLES = {
    "groups": "name string, low bigint, high bigint, count bigint, flags array<string>, watch boolean",
    "aliases": "name string, group_name string",
    "settings": "`group` string, key string, value string",
    "tracks": "group_name string, server string, low bigint, high bigint, scan_pointer bigint, last_scan timestamp",
}


def create_catalogue(spark: SparkSession, database: str, reset: bool = False) -> list[str]:
    """Makes the tables that are not there; with ``reset`` they are made anew, empty. Returns the names of all."""
    if reset:
        drop_catalogue(spark, database)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return sorted(r["tableName"] for r in spark.sql(f"SHOW TABLES IN {database}").collect())


def drop_catalogue(spark: SparkSession, database: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
