"""Views of the test tables in the shape of visibilities."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietsky.sources.tables import write_bytes

#: Baselines of four antennas, by number.
PAIRS = [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2), (0, 3), (1, 3), (2, 3), (3, 3)]
N_CHAN = 64
FIRST_FREQ, FREQ_STEP = 0.856e9, 13375000.0
#: Positions in metres, 144 m apart on a line.
ANTENNAS = [(i, f"A{i + 1}", [144.0 * i, 0.0, 0.0]) for i in range(4)]
#: mask_id, frequency: on the edges and the middles of channels of spectra().
MASKS = [(0, FIRST_FREQ + 2 * FREQ_STEP + 128), (0, FIRST_FREQ + 10 * FREQ_STEP), (1, FIRST_FREQ + 4 * FREQ_STEP - 64), (1, FIRST_FREQ + 11 * FREQ_STEP + 64), (1, FIRST_FREQ + 5 * FREQ_STEP - 128)]


def _pair(bl: Column, which: int) -> Column:
    return F.element_at(F.array(*[F.lit(p[which]) for p in PAIRS]), bl + 1)


def antennas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANTENNAS, "antenna_id int, name string, position array<double>")


def channels(spark: SparkSession) -> DataFrame:
    return spark.range(N_CHAN).select(F.col("id").cast("int").alias("chan"), (F.lit(FIRST_FREQ) + F.col("id") * F.lit(FREQ_STEP)).alias("chan_freq"), F.lit(FREQ_STEP).alias("chan_width"))


def masks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MASKS, "mask_id int, freq_hz double")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten baselines of 64 channels and one correlation, with planted interference, NaN and zeros."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    order = W.partitionBy("label").orderBy("vec_id")
    rows = e.withColumn("time_idx", F.row_number().over(order) - 1).select("vec_id", F.col("label").alias("bl"), "time_idx", F.posexplode("embedding").alias("chan", "x"))
    t, c = F.col("time_idx"), F.col("chan")
    amp = F.abs(2 + F.col("x").cast("double"))
    amp = amp + F.when(c == 17, 3.0).otherwise(0.0) + F.when(t.between(20, 24) & c.between(40, 43), 1.5).otherwise(0.0) + F.when((t % 13 == 7) & (c == t * 5 % 64), 2.0).otherwise(0.0)
    re = F.when((F.col("vec_id") % 37 == 0) & (c == 5), float("nan")).when((F.col("vec_id") % 41 == 0) & (c == 9), 0.0).otherwise(amp)
    group = [F.lit(0).alias(g) for g in ("field_id", "data_desc_id", "scan_number")]
    return rows.select(*group, "bl", _pair(F.col("bl"), 0).alias("antenna1"), _pair(F.col("bl"), 1).alias("antenna2"), F.lit(0).alias("corr"), "time_idx", "chan", re.alias("re"), F.lit(0.0).alias("im"), ((c >= 60) & (t % 2 == 0)).alias("flag"))


def spectra_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of spectra() as rows, with data and flag as [chan][corr]; each baseline is a scan, so that its window has its own times alone."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    t, v = F.col("time_idx"), F.col("vec_id")
    numbered = e.withColumn("time_idx", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1)

    def sample(x: Column, c: Column) -> Column:
        amp = F.abs(2 + x.cast("double")) + F.when(c == 17, 3.0).otherwise(0.0) + F.when(t.between(20, 24) & c.between(40, 43), 1.5).otherwise(0.0) + F.when((t % 13 == 7) & (c == t * 5 % 64), 2.0).otherwise(0.0)
        return F.array(F.struct(F.when((v % 37 == 0) & (c == 5), float("nan")).when((v % 41 == 0) & (c == 9), 0.0).otherwise(amp).alias("re"), F.lit(0.0).alias("im")))

    group = [F.lit(0).alias("field_id"), F.lit(0).alias("data_desc_id"), F.col("label").alias("scan_number")]
    flag = F.transform("embedding", lambda x, c: F.array((c >= 60) & (t % 2 == 0)))
    return numbered.select(*group, F.col("label").alias("bl"), _pair(F.col("label"), 0).alias("antenna1"), _pair(F.col("label"), 1).alias("antenna2"), "time_idx", v.alias("row_id"), t.cast("double").alias("time"), F.transform("embedding", sample).alias("data"), flag.alias("flag"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main-table rows of 8 channels and 4 correlations, with missing and repeated times: row_id, and data and flag as [chan][corr]."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    v = F.col("vec_id")

    def sample(c: Column, k: Column) -> Column:
        x = [F.element_at("embedding", c * 8 + k * 2 + j + 1).cast("double") for j in (0, 1)]
        return F.struct(*[F.when((v % 37 == 0) & (c == 5), float("nan")).when((v % 41 == 0) & (c == 6), 0.0).otherwise(y).alias(n) for n, y in zip(("re", "im"), x, strict=True)])

    data = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: sample(c, k)))
    flag = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (v + c * 3 + k) % 11 == 0))
    scan = F.floor(v / 125).cast("int")
    return e.select((scan % 2).alias("field_id"), F.lit(0).alias("data_desc_id"), scan.alias("scan_number"), v.alias("row_id"), F.floor(v % 125 / 5).cast("double").alias("time"), _pair(F.col("label"), 0).alias("antenna1"), _pair(F.col("label"), 1).alias("antenna2"), data.alias("data"), flag.alias("flag"))


def described_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows() in two data descriptions by scan: eight channels and four correlations, and four channels and two correlations."""
    d = F.col("scan_number") % 2
    few = lambda c: F.when(d == 0, F.col(c)).otherwise(F.transform(F.slice(c, 1, 4), lambda k: F.slice(k, 1, 2)))
    own = rows(spark, sf_dir)
    return own.withColumns({"data_desc_id": d, "data": few("data"), "flag": few("flag")})


def side_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Side tables of described_rows()."""
    freq = [FIRST_FREQ + i * FREQ_STEP for i in range(8)]
    return {
        "antenna": antennas(spark),
        "field": spark.createDataFrame([(0, "3C286"), (1, "PKS1934-63")], "field_id int, name string"),
        "data_description": spark.createDataFrame([(0, 3, 5), (1, 4, 6)], "data_desc_id int, spectral_window_id int, polarization_id int"),
        "spectral_window": spark.createDataFrame([(3, freq, [FREQ_STEP] * 8), (4, freq[1:5], [FREQ_STEP] * 4)], "spectral_window_id int, chan_freq array<double>, chan_width array<double>"),
        "polarization": spark.createDataFrame([(5, [9, 10, 11, 12]), (6, [9, 12])], "polarization_id int, corr_type array<int>"),
    }


def mask_files(spark: SparkSession, place: str) -> list[str]:
    """Files of masks(): of each mask the frequencies of all of them, of which its own are masked."""
    kinds = np.dtype([("masked", bool), ("freq", np.float64)])
    names = []
    for mask in sorted({m for m, _ in MASKS}):
        content = io.BytesIO()
        np.save(content, np.array([(m == mask, f) for m, f in MASKS], dtype=kinds))
        names.append(f"{place}/{mask}.npy")
        write_bytes(spark, names[-1], content.getvalue())
    return names


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sparse samples: a mean value for each baseline, kind, hour and channel."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts", "value")
    kinds = W.orderBy("event_type")
    corr = e.select("event_type").distinct().withColumn("corr", F.dense_rank().over(kinds) - 1)
    u = F.col("user_id")
    joined = e.join(F.broadcast(corr), "event_type")  # a row for each kind
    return joined.groupBy((u % 10).cast("int").alias("bl"), "corr", F.date_trunc("hour", "ts").alias("time"), (F.floor(u / 10) % 15).cast("int").alias("chan")).agg(F.avg("value").alias("amp"))


def lineitem_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flagged samples."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_shipdate", "l_linestatus", "l_returnflag")
    return line.select((F.col("l_suppkey") % 10).cast("int").alias("bl"), (F.col("l_linenumber") - 1).cast("int").alias("chan"), F.year("l_shipdate").alias("scan"), F.col("l_linestatus").alias("field"), (F.col("l_returnflag") == "R").alias("flag"))
