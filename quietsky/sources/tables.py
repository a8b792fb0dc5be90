"""Visibility tables, their side tables, masks, strategies, and the flags that go back."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietsky.functions.grammar import dilation

#: A group is one independent observation.
GROUP = ["field_id", "data_desc_id", "scan_number"]
#: A window is made of the rows of one of these.
BASELINE = [*GROUP, "antenna1", "antenna2"]
SIDE_TABLES = ("antenna", "field", "data_description", "spectral_window", "polarization")


def read_visibilities(spark: SparkSession, path: str, data_column: str = "data", model_column: str | None = None) -> DataFrame:
    """The main table, only the columns that flagging needs; partitioned by GROUP, selections prune its files.

    row_id is the table's own, or, without one, text of the row's file and its place there: the same in every read.
    """
    return _needed(spark.read.parquet(path), data_column, model_column)


def store_visibilities(rows: DataFrame, name: str, path: str, buckets: int) -> None:
    """Rows of a main table as the table `name` of the catalog, its files in `path`: a file for each bucket of baselines, sorted by baseline and time.

    A bucket holds whole baselines of groups, so flagging such a table `in_place` moves no data. A baseline with a third of all rows
    is in one bucket, as it is in one task of any flagging. Repeated and null rows are kept; no rows make an empty table. A table of that name raises.
    """
    dealt = rows.repartition(buckets, *BASELINE)
    dealt.write.bucketBy(buckets, *BASELINE).sortBy(*BASELINE, "time").option("path", path).saveAsTable(name)


def read_stored(spark: SparkSession, name: str, data_column: str = "data", model_column: str | None = None) -> DataFrame:
    """The columns that flagging needs of a table of the catalog, in its buckets."""
    return _needed(spark.table(name), data_column, model_column)


def _needed(df: DataFrame, data_column: str, model_column: str | None) -> DataFrame:
    place = F.concat(F.col("_metadata.file_path"), F.lit(":"), F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"))
    row_id = F.col("row_id") if "row_id" in df.columns else place.alias("row_id")
    columns = [row_id, *GROUP, "time", "antenna1", "antenna2", F.col(data_column).alias("data"), "flag"]
    if model_column:
        columns.append(F.col(model_column).alias("model"))
    return df.select(*columns)


def read_side_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Side tables by name, each a row for each antenna, field, data description, window or polarization:

    antenna(antenna_id, name, position), field(field_id, name), data_description(data_desc_id, spectral_window_id, polarization_id),
    spectral_window(spectral_window_id, chan_freq, chan_width: arrays), polarization(polarization_id, corr_type: an array).
    """
    return {name: spark.read.parquet(f"{path}/{name}") for name in SIDE_TABLES}


def channels_of(side: dict[str, DataFrame]) -> DataFrame:
    """data_desc_id, chan, chan_freq and chan_width of all data descriptions, each with its window's channels."""
    described = side["data_description"].join(side["spectral_window"], "spectral_window_id")
    each = described.select("data_desc_id", F.posexplode(F.arrays_zip("chan_freq", "chan_width")).alias("chan", "_w"))
    return each.select("data_desc_id", "chan", "_w.chan_freq", "_w.chan_width")


def correlations_of(side: dict[str, DataFrame]) -> dict[int, list[int]]:
    """The correlations of each data description, read on the driver."""
    rows = side["data_description"].join(side["polarization"], "polarization_id").select("data_desc_id", "corr_type").collect()
    return {r["data_desc_id"]: list(r["corr_type"]) for r in rows}


def find_masks(filename: str = "", folders: tuple[str, ...] = ()) -> list[str]:
    """The given file alone, or all mask files of the folders, sorted within each; a folder may be a file."""
    if filename:
        return [filename]
    out = []
    for f in map(Path, folders):
        out += [str(f)] if f.is_file() else sorted(str(p) for p in f.iterdir() if p.suffix in (".staticmask", ".npy")) if f.is_dir() else []
    return out


def load_mask(spark: SparkSession, filename: str, mask_id: int = 0, dilate: int | str | None = None) -> DataFrame:
    """mask_id, chan_idx, freq_hz, masked of a mask file: records of (bool, float64), the flag and the channel's frequency.

    A mask has a row for each channel, so it is read on the driver, and dilated there; read_masks() reads many in tasks.
    """
    masked, freq = parsed_mask(Path(filename).read_bytes(), filename, dilate)
    return spark.createDataFrame([(mask_id, i, float(f), bool(m)) for i, (m, f) in enumerate(zip(masked, freq, strict=True))], "mask_id int, chan_idx int, freq_hz double, masked boolean")


def parsed_mask(content: bytes, filename: str, dilate: int | str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Flags, dilated, and frequencies of a mask file's content."""
    raw = np.load(io.BytesIO(content))
    kinds = [raw.dtype[i] for i in range(len(raw.dtype))] if raw.dtype.names else []
    if kinds != [np.dtype(bool), np.dtype(np.float64)]:
        raise ValueError(f"{filename} has no records of a boolean and a double")
    masked, freq = raw[raw.dtype.names[0]].astype(bool), raw[raw.dtype.names[1]]
    reach = dilation(dilate, float(freq[1] - freq[0]) if len(freq) > 1 else 1.0)
    if reach:
        masked = np.convolve(masked, np.ones(2 * reach + 1), "same") > 0.5 if len(masked) > 2 * reach else np.full(len(masked), masked.any()) & np.array([masked[max(0, i - reach) : i + reach + 1].any() for i in range(len(masked))])
    return masked, freq


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, wherever Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A new file; one that is there raises."""
    place, fs = _hadoop(spark, path)
    out = fs.create(place, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    place, fs = _hadoop(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder and all in it, if it is there."""
    place, fs = _hadoop(spark, path)
    fs.delete(place, True)


def read_masks(spark: SparkSession, files: list[str], dilate: int | str | None = None) -> DataFrame:
    """mask_id, chan_idx, freq_hz and masked of mask files, numbered in the order of the list; read and dilated in tasks, from any store that Spark reads.

    A file without such records fails the job by a ValueError with its name. No files give no rows.
    """
    kind = "mask_id int, chan_idx int, freq_hz double, masked boolean"
    if not files:
        return spark.createDataFrame([], kind)
    names = []
    for i, name in enumerate(files):
        place, fs = _hadoop(spark, name)
        names.append((i, fs.makeQualified(place).toUri().getPath()))
    number = F.broadcast(spark.createDataFrame(names, "mask_id int, _at string"))  # a row for each file
    content = spark.read.format("binaryFile").load(files).select(F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "").alias("_at"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content, at in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                masked, freq = parsed_mask(content, at, dilate)
                columns = [np.full(len(freq), i, dtype=np.int32), np.arange(len(freq), dtype=np.int32), freq, masked]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["mask_id", "chan_idx", "freq_hz", "masked"])

    return content.join(number, "_at").select("mask_id", "content", "_at").mapInArrow(run, kind)


def load_strategies(filename: str) -> list[dict]:
    """The `strategies` list of a YAML file: name, task and kwargs of each step. Without that list, or with another kind of thing in its place, ValueError."""
    import yaml

    found = yaml.safe_load(Path(filename).read_text())
    steps = found.get("strategies") if isinstance(found, dict) else None
    if not isinstance(steps, list) or not all(isinstance(s, dict) for s in steps):
        raise ValueError(f"{filename} has no list of strategies")
    return steps


def write_flags(flags: DataFrame, path: str) -> None:
    """Writes flags beside the input, over the groups that they hold and no others."""
    flags.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*GROUP).parquet(path)


def commit_flags(flags: DataFrame, path: str) -> str:
    """Writes flags as a new version of their groups, and then commits it; returns the version's name.

    Until the commit, which is one new file, readers see what they saw before, so a job that fails or is lost changes nothing. Of two writers that
    commit at once one raises. An earlier version stays as it is for whoever reads it.
    """
    spark, version = flags.sparkSession, uuid.uuid4().hex
    before = [n for n, _ in commits(spark, path)]
    flags.write.partitionBy(*GROUP).parquet(f"{path}/version={version}")
    write_bytes(spark, f"{path}/_commits/{max(before, default=0) + 1:012d}", version.encode())
    return version


def read_counts(spark: SparkSession, path: str, version: str) -> DataFrame:
    """BASELINE, chan, before, after and size, in samples of windows, of one version of flags that were counted; nothing else of the version is read."""
    each = spark.read.parquet(f"{path}/version={version}").where("counts is not null").select(*BASELINE, F.posexplode("counts").alias("chan", "_c"))
    return each.select(*BASELINE, "chan", "_c.before", "_c.after", "_c.size")


def commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Numbers and versions of what has been committed, in order."""
    place, fs = _hadoop(spark, f"{path}/_commits")
    files = fs.listStatus(place) if fs.exists(place) else []
    text = spark._jvm.org.apache.commons.io.IOUtils
    out = []
    for f in files:
        name = f.getPath().getName()
        if name.isdigit():
            stream = fs.open(f.getPath())
            try:
                out.append((int(name), text.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return sorted(out)


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """Of each group the flags of the last committed version that holds it, without the counts. Without a commit FileNotFoundError."""
    known = commits(spark, path)
    if not known:
        raise FileNotFoundError(f"no flags have been committed to {path}")
    every = spark.read.option("basePath", path).parquet(*[f"{path}/version={v}" for _, v in known])
    order = F.broadcast(spark.createDataFrame(known, "_n long, version string"))  # a row for each commit
    last = every.select("version", *GROUP).distinct().join(order, "version").groupBy(*GROUP).agg(F.max_by("version", "_n").alias("version"))
    return every.join(last, [*GROUP, "version"]).drop("version", "counts")
