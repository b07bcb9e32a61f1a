"""Session helpers: one place for the few settings the library cares about."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "cuemill", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench. On a cluster use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CUEMILL_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. A session on this machine only, as in tests, gets a
    temporary one; on a cluster without that setting there is no folder all executors see, which is an error."""
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_folder


WHOLE = "whole_items"


def deal(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows by ``key`` in ``n`` partitions, for tables whose items fit a task because each comes from a single row. The column's metadata
    say so, and derived tables keep them: scans use plain windows, and tables dealt alike meet, and are grouped and ordered, where they
    are. By default Spark would shuffle them again for a join on the item and another column."""
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.withMetadata(key, {WHOLE: n}).repartition(n, key)


def whole(df: DataFrame, keys) -> bool:
    """Do all rows of one item fit a task?"""
    return any(WHOLE in df.schema[k].metadata for k in keys)


def hashed(df: DataFrame, *keys: str) -> DataFrame:
    """The smaller side of a join. Where items fit a task it is held as a hash table there, so that the other side, often all
    words, is not sorted for the join; other tables are left to Spark."""
    return df.hint("shuffle_hash") if whole(df, keys) else df


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a derived table to the shared folder and read it back: the plan above starts from the files, so a table
    used several times is computed once, and a lost executor costs only a re-read. A table that was dealt is dealt again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    dealt = [(f.name, f.metadata[WHOLE]) for f in df.schema if WHOLE in f.metadata]
    return deal(back, *dealt[0]) if dealt else back


def before_scan(df: DataFrame, key: str, name: str) -> DataFrame:
    """Scans by blocks read their input twice, so it is staged. Whole items are read once and stay where they are."""
    return df if whole(df, [key]) else stage(df, name)


def once(df: DataFrame, key: str, name: str) -> DataFrame:
    """A small table derived from whole items, for several uses: each would make all words anew, so it is staged."""
    return stage(df, name) if whole(df, [key]) else df
