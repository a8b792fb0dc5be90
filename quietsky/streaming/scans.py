"""Scans as they arrive: each is a group of its own, so micro-batches of whole scans can be flagged one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quietsky.sources.tables import GROUP, folders, remove, write_flags


def flag_scans(rows: DataFrame, flagger: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, lateness: float | None = None) -> StreamingQuery:
    """Flags a stream of main-table rows scan by scan and writes the flags by group, a folder for each.

    Files of whole scans may come in any batch. A scan that comes in several batches is flagged again with all that has come of it: its rows
    are kept beside the checkpoint, by group, and each batch's groups are read whole from there. So the last flags of
    a scan are those of the whole scan. A batch that is repeated keeps and writes the same rows once: they are kept by batch.

    With lateness, in units of time, a scan is over once its last time lies further than that behind the newest time of all earlier batches. Its
    kept rows are let go then, so what is kept has the size of the open scans. Rows that still come for it are not flagged, as the scan is no longer whole: late_rows() has
    them, and its flags stay. What is over follows from earlier batches alone, so a repeated batch decides alike.
    """
    kept, seen, late = (f"{checkpoint}-{x}" for x in ("rows", "seen", "late"))

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark, own = batch.sparkSession, batch.withColumn("_batch", F.lit(number))
        before = None if lateness is None else _seen(spark, seen, number)
        if before is not None:
            over = F.broadcast(before.where("over").select(*GROUP))  # a row for each scan
            _write(own.join(over, GROUP, "left_semi"), late, ["_batch"])
            own = own.join(over, GROUP, "left_anti")
        _write(own, kept, [*GROUP, "_batch"])
        groups = own.select(*GROUP).distinct()  # a few scans
        if not groups.isEmpty():
            whole = spark.read.schema(own.schema).parquet(kept).where(F.col("_batch") <= number)
            write_flags(flagger(whole.join(F.broadcast(groups), GROUP, "left_semi").select(*batch.columns)), path)
        if lateness is not None:
            _let_go(spark, before, kept)
            last = own.groupBy(*GROUP).agg(F.max("time").alias("last")).withColumn("gone", F.lit(False))
            every = last if before is None else last.unionByName(before.select(*GROUP, "last", F.col("over").alias("gone")))
            every = every.groupBy(*GROUP).agg(F.max("last").alias("last"), F.max("gone").alias("gone"))
            newest = F.lit(every.agg(F.max("last")).first()[0])
            every.withColumn("over", F.col("gone") | F.coalesce(F.col("last") < newest - lateness, F.lit(False))).coalesce(1).write.mode("overwrite").parquet(f"{seen}/_batch={number}")
            for n in _numbers(spark, seen, number)[:-1]:
                remove(spark, f"{seen}/_batch={n}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def _write(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _numbers(spark: SparkSession, seen: str, number: int) -> list[int]:
    """Batches before this one of which scans are on record, in order."""
    return sorted(n for f in folders(spark, seen) if f.startswith("_batch=") and (n := int(f.removeprefix("_batch="))) < number)


def _seen(spark: SparkSession, seen: str, number: int) -> DataFrame | None:
    """GROUP, last, over and gone of all scans of earlier batches: its last time, whether it is over, and whether its rows have been let go; None without any."""
    known = _numbers(spark, seen, number)
    return spark.read.parquet(f"{seen}/_batch={known[-1]}") if known else None


def _let_go(spark: SparkSession, before: DataFrame | None, kept: str) -> None:
    """Removes the rows of scans that are over since the batch before; flags of this batch do not come from them."""
    for r in before.where("over and not gone").select(*GROUP).collect() if before is not None else ():  # a few scans
        remove(spark, "/".join([kept, *[f"{c}={r[c]}" for c in GROUP]]))


def late_rows(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """Rows that came for scans that were over, with their batch; None while there are none."""
    return spark.read.parquet(f"{checkpoint}-late") if any(f.startswith("_batch=") for f in folders(spark, f"{checkpoint}-late")) else None


def running_counts(samples: DataFrame) -> DataFrame:
    """Flagged samples and all of them, so far, by group and baseline."""
    return samples.groupBy(*GROUP, "antenna1", "antenna2").agg(F.sum(F.col("flag").cast("long")).alias("flagged"), F.count("*").alias("size"))
