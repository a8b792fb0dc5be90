"""What the operators share: tables, the shared folder, and the word pattern."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Logarithm of the most bits of a bitmap that is sent to all tasks.
MOST_BITS = 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder within spark.checkpoint.dir, which the driver and all executors see; it goes when the application ends.

    Where that is unset, a local session has a folder of its own, and any other is refused: executors would not find each other's files.
    """
    place = spark.conf.get("quietsky.shared.dir", None)
    if not place:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="quietsky-")
        place = f"{top}/quietsky-{spark.sparkContext.applicationId}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(place)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
        spark.conf.set("quietsky.shared.dir", place)
    return place


def cut(df: DataFrame, what: str, compression: str = "none") -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage ends there, and a lost executor costs a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    # mostly uncompressed: these tables are light, and the codecs' direct buffers outlive their tasks
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, column: str, compression: str = "zstd") -> DataFrame:
    """As cut(), as a table dealt by the hash of a column into as many buckets as a shuffle has parts, so that a join on it need not shuffle the table.

    Only a catalog can describe buckets, so the table has an entry there until it has been looked up; its files stay in the shared folder, as those of cut() do.
    """
    spark = df.sparkSession
    name = f"quietsky_{what}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", compression).option("path", f"{shared_dir(spark)}/{name}").bucketBy(parts, column).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"drop table {name}")  # of a table with a path of its own the files stay


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


def apart(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose key, a hash, may be among keys (one column of hashes), and rows whose key is not, null ones with these.

    A bitmap of sixteen bits for each of keys, and of 32 MB at most, goes to all tasks, so df is not shuffled to find out; where it is
    full it only lets more through. The first rows are a superset, to be joined with keys.
    """
    size = 1 << min(MOST_BITS, max(20, (16 * keys.count()).bit_length()))
    slot = lambda h: F.pmod(h, F.lit(size)) + 1
    ones = keys.select(slot(F.col(keys.columns[0])).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    at = F.bitmap_bit_position("s").cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = df.select(F.struct(*df.columns).alias("row"), slot(key).alias("s")).withColumn("bucket", F.bitmap_bucket_number("s")).join(F.broadcast(ones), "bucket", "left")
    hit = F.coalesce(F.bit_get(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False))
    return rows.where(hit).select("row.*"), rows.where(~hit).select("row.*")


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def give_back() -> None:
    """Returns what this worker has freed to the system: workers live on after a task, and the next stage's need the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, which gives memory back when its task ends."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner
