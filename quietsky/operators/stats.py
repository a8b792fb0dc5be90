"""Counts of flagged samples by antenna, baseline, field, scan and stretch of frequency."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietsky.sources.tables import BASELINE


def window_stats(df: DataFrame, antennas: DataFrame, channels: DataFrame, fields: DataFrame | None = None, n_bins: int = 10) -> DataFrame:
    """dim, key, flagged, size of samples: dimensions() of them. They are summed once, by group, baseline and channel; all counts come from that small table."""
    base = df.groupBy(*BASELINE, "chan").agg(F.sum(F.col("flag").cast("long")).alias("flagged"), F.count("*").alias("size"))
    return dimensions(base, antennas, channels, fields, n_bins)


def dimensions(base: DataFrame, antennas: DataFrame, channels: DataFrame, fields: DataFrame | None = None, n_bins: int = 10) -> DataFrame:
    """dim, key, flagged, size of base(BASELINE, chan, flagged, size). dim: antenna, baseline, field, scan, ddid_bin.

    A baseline counts for both of its antennas, an autocorrelation once. Frequency bins have n_bins edges from the lowest to the
    highest channel; the highest one, and the last bin, are in none, and a bin's size is that of its whole data description.
    """
    sums = [F.sum("flagged").alias("flagged"), F.sum("size").alias("size")]
    names = F.broadcast(antennas.select("antenna_id", "name"))  # a row for each antenna
    by_pair = base.groupBy("antenna1", "antenna2").agg(*sums)
    ends = by_pair.select(F.explode(F.array_distinct(F.array("antenna1", "antenna2"))).alias("antenna_id"), "flagged", "size")
    antenna = ends.groupBy("antenna_id").agg(*sums).join(names, "antenna_id").select(F.lit("antenna").alias("dim"), F.col("name").alias("key"), "flagged", "size")
    one, two = (F.broadcast(antennas.select(F.col("antenna_id").alias(f"antenna{i}"), F.col("name").alias(f"_n{i}"))) for i in (1, 2))
    baseline = by_pair.join(one, "antenna1").join(two, "antenna2").select(F.lit("baseline").alias("dim"), F.concat_ws("&", "_n1", "_n2").alias("key"), "flagged", "size")
    both = base.groupBy("field_id", "scan_number").agg(*sums)
    both = both.groupingSets([["field_id"], ["scan_number"]], "field_id", "scan_number").agg(*sums, F.grouping("field_id").alias("_g"))
    if fields is not None:
        both = both.join(F.broadcast(fields.select("field_id", F.col("name").alias("_name"))), "field_id", "left")
    name = F.col("field_id").cast("string") if fields is None else F.coalesce("_name", F.col("field_id").cast("string"))
    group = both.select(F.when(F.col("_g") == 0, "field").otherwise("scan").alias("dim"), F.when(F.col("_g") == 0, name).otherwise(F.col("scan_number").cast("string")).alias("key"), "flagged", "size")
    return antenna.unionByName(baseline).unionByName(group).unionByName(_bins(base, channels, n_bins))


def _bins(base: DataFrame, channels: DataFrame, n_bins: int) -> DataFrame:
    """Counts by stretch of frequency; channels are those of every data description, or, with data_desc_id, of each. Without channels there are none."""
    by = ["data_desc_id", "chan"] if "data_desc_id" in channels.columns else ["chan"]
    where = []
    for d, (by_chan, edges) in _edges(channels, n_bins).items():
        where += [(*d, c, b) for c, f in by_chan.items() if (b := int(np.searchsorted(edges, f, side="right")) - 1) < n_bins - 1]
    places = base.sparkSession.createDataFrame(where, ", ".join(f"{c} int" for c in by) + ", bin int")
    whole = base.groupBy("data_desc_id").agg(F.sum("size").alias("size"))
    hits = base.join(F.broadcast(places), by).groupBy("data_desc_id", "bin").agg(F.sum("flagged").alias("flagged"))
    every = whole.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1)))).join(hits, ["data_desc_id", "bin"], "left")
    return every.select(F.lit("ddid_bin").alias("dim"), F.concat_ws(":", "data_desc_id", "bin").alias("key"), F.coalesce("flagged", F.lit(0)).alias("flagged"), "size")


def _edges(channels: DataFrame, n_bins: int) -> dict[tuple, tuple[dict[int, float], np.ndarray]]:
    """Frequencies by channel, and edges of bins, of each data description, or, without data_desc_id, of (); read on the driver."""
    by = ["data_desc_id"] if "data_desc_id" in channels.columns else []
    freq: dict[tuple, dict[int, float]] = {}
    for r in channels.select(*by, "chan", "chan_freq").collect():  # a row for each channel of an instrument
        freq.setdefault(tuple(r[:-2]), {})[r["chan"]] = r["chan_freq"]
    return {d: (by_chan, np.linspace(min(by_chan.values()), max(by_chan.values()), n_bins)) for d, by_chan in freq.items()}


def edge_lines(channels: DataFrame, n_bins: int = 10) -> list[str]:
    """The edges of the bins of each data description, in MHz, as a line of text."""
    return [f"edges of ddid {':'.join(map(str, d)) or '0'}: {' '.join(f'{e / 1e6:.1f}' for e in edges)} MHz" for d, (_, edges) in sorted(_edges(channels, n_bins).items())]


def merged(stats: list[DataFrame]) -> DataFrame:
    """The sums of several tables of counts."""
    every = stats[0]
    for s in stats[1:]:
        every = every.unionByName(s)
    return every.groupBy("dim", "key").agg(F.sum("flagged").alias("flagged"), F.sum("size").alias("size"))


def summary(final: DataFrame, original: DataFrame) -> DataFrame:
    """dim, key, line: shares in per cent now and before, null for what has no samples."""
    o = original.select("dim", "key", F.col("flagged").alias("_f"), F.col("size").alias("_s"))
    a, b = F.try_divide(F.col("flagged") * 100.0, F.col("size")), F.try_divide(F.col("_f") * 100.0, F.col("_s"))
    places = F.when(F.col("dim") == "ddid_bin", F.format_string("%.2f%%", a)).otherwise(F.format_string("%.3f%%, original %.3f%%", a, b))
    return final.join(o, ["dim", "key"]).select("dim", "key", F.when(a.isNotNull() & b.isNotNull(), places).alias("line"))


def report(final: DataFrame, original: DataFrame) -> list[str]:
    """The summary as text, for a log: a line for each antenna, baseline, field, scan and bin."""
    rows = summary(final, original).orderBy("dim", "key").collect()
    return [f"{r['dim']} {r['key']}: {r['line']}" for r in rows]
