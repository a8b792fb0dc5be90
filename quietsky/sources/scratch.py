"""Tables that an iterated job writes and reads back, in the folder that the cluster names for them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; it goes when the application ends. Without that setting only a local session has one."""
    place = spark.conf.get("quietsky.scratch.dir", None)
    if not place:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="quietsky-")
        place = f"{top}/scratch-{spark.sparkContext.applicationId}"
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        spark.conf.set("quietsky.scratch.dir", place)
    return place


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes df and reads it back: lineage ends there, a lost executor costs a read, and Spark knows the table's size."""
    path = f"{folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """The session's setting has this value within, and its own again afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
