"""Rows to windows of baseline, correlation, time and channel, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietsky.sources.tables import BASELINE, GROUP


def unique_baselines(df: DataFrame) -> DataFrame:
    """bl, antenna1, antenna2 of each group; numbered by the second antenna, then the first."""
    order = W.partitionBy(*GROUP).orderBy("antenna2", "antenna1")
    return df.select(*GROUP, "antenna1", "antenna2").distinct().withColumn("bl", F.dense_rank().over(order) - 1)


def unique_times(df: DataFrame) -> DataFrame:
    """time_idx of each distinct time of a group."""
    return df.select(*GROUP, "time").distinct().withColumn("time_idx", F.dense_rank().over(W.partitionBy(*GROUP).orderBy("time")) - 1)


def indexed(df: DataFrame) -> DataFrame:
    """Adds bl and time_idx to rows: small tables of distinct values join back, so no group is sorted whole."""
    return df.join(unique_baselines(df), [*GROUP, "antenna1", "antenna2"]).join(unique_times(df), [*GROUP, "time"])


def samples(df: DataFrame) -> DataFrame:
    """A row for each channel and correlation of rows with data and flag as [chan][corr]."""
    by_chan = df.select("*", F.posexplode(F.arrays_zip("data", "flag")).alias("chan", "_c")).drop("data", "flag")
    both = by_chan.select("*", F.posexplode(F.arrays_zip(F.col("_c.data").alias("d"), F.col("_c.flag").alias("f"))).alias("corr", "_k")).drop("_c")
    return both.withColumns({"re": F.col("_k.d.re"), "im": F.col("_k.d.im"), "flag": F.col("_k.f")}).drop("_k")


def packed(df: DataFrame, n_chan: int, n_corr: int) -> DataFrame:
    """All cells of the windows of df(row_id, ..., bl, time_idx, data, flag): what has no row is NaN and flagged.

    Of several rows of one baseline and time the one with the highest row_id stays. The grid has, in each group, its
    baselines times its times; rows keep their arrays until they have met it, so only cells are shuffled, not samples.
    """
    cell = [*GROUP, "bl", "antenna1", "antenna2", "time_idx"]
    last = df.groupBy(*cell).agg(F.max_by(F.struct("data", "flag"), "row_id").alias("_v"))
    lines = df.select(*GROUP, "bl", "antenna1", "antenna2").distinct()
    times = df.groupBy(*GROUP).agg(F.array_sort(F.collect_set("time_idx")).alias("_t"))
    grid = lines.join(times, GROUP).withColumn("time_idx", F.explode("_t")).drop("_t")
    full = grid.join(last, cell, "left")
    nan = F.struct(F.lit(float("nan")).alias("re"), F.lit(float("nan")).alias("im"))
    data = F.coalesce("_v.data", F.array_repeat(F.array_repeat(nan, n_corr), n_chan))
    flag = F.coalesce("_v.flag", F.array_repeat(F.array_repeat(F.lit(True), n_corr), n_chan))
    return samples(full.select(*cell, data.alias("data"), flag.alias("flag")))


def as_rows(df: DataFrame) -> DataFrame:
    """Rows with data and flag as [chan][corr] of dense samples: what samples() makes of them is df. row_id and time are the time's number."""
    cell = [*GROUP, "bl", "antenna1", "antenna2", "time_idx"]
    sample = F.struct(F.col("corr"), F.struct(F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im")).alias("v"), F.col("flag").alias("f"))
    by_chan = df.groupBy(*cell, "chan").agg(F.array_sort(F.collect_list(sample)).alias("_k"))
    rows = by_chan.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("chan", "_k"))).alias("_c"))
    each = lambda name: F.transform("_c", lambda c: F.transform(c["_k"], lambda k: k[name]))
    number = F.col("time_idx")
    return rows.select(*cell, number.alias("row_id"), number.cast("double").alias("time"), each("v").alias("data"), each("f").alias("flag"))


def flag_samples(df: DataFrame) -> DataFrame:
    """A row for each channel and correlation of rows with flag as [chan][corr], without row_id and time."""
    by_chan = df.select("*", F.posexplode("flag").alias("chan", "_f")).drop("flag", "row_id", "time")
    return by_chan.select("*", F.posexplode("_f").alias("corr", "flag")).drop("_f")


def gathered(df: DataFrame, keep: list[str]) -> DataFrame:
    """df(row_id, GROUP, time, antenna1, antenna2, data, flag, and keep), and one more row for each baseline of a group, with the group's times as `times`.

    What a window of a baseline is made of: its rows, with their arrays, and the times that other baselines have. Rows are not joined
    with anything, so their arrays are shuffled only when a baseline's rows are brought together.
    """
    return df.select(*BASELINE, "row_id", "time", *keep, "data", "flag").unionByName(lines(df), allowMissingColumns=True)


def lines(df: DataFrame) -> DataFrame:
    """Each baseline of a group, with the group's times as `times`."""
    times = df.groupBy(*GROUP).agg(F.collect_set("time").alias("times"))
    return df.select(*BASELINE).distinct().join(times, GROUP).select(*BASELINE, "times")


def unpacked(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """flag as [chan][corr] for each of rows(row_id, ..., bl, time_idx); false where no window has the row.

    Windows are dense, so the samples of a cell in the order of channel and correlation, brought together once, are its rows of correlations end to end.
    """
    cell = [*GROUP, "bl", "time_idx"]
    cells = windows.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("chan", "corr", "flag"))).alias("_s"), (F.max("corr") + 1).cast("int").alias("_n"))
    channels = F.sequence(F.lit(0), (F.size("_s") / F.col("_n")).cast("int") - 1)
    nested = F.transform(channels, lambda c: F.transform(F.slice("_s", c * F.col("_n") + 1, F.col("_n")), lambda x: x["flag"]))
    none = F.transform(F.col("data"), lambda c: F.transform(c, lambda k: F.lit(False)))
    flags = cells.select(*cell, nested.alias("_f"))
    return rows.join(flags, cell, "left").withColumn("flag", F.coalesce("_f", none)).drop("_f")


def equalised(df: DataFrame) -> DataFrame:
    """Rows of which a channel is flagged in all correlations if it is in one; flag is [chan][corr]."""
    return df.withColumn("flag", F.transform("flag", lambda c: F.transform(c, lambda k: F.exists(c, lambda x: x))))


def merged_chunks(df: DataFrame, by: list[str], order: str, sizes: dict[str, int]) -> DataFrame:
    """by, chunk and the summed sizes: neighbours, in order, of df(by, order, sizes) joined while no sum is above its maximum; greedily, as grammar.merged_chunks().

    df has a row for each chunk of a group, such as a scan's times, not for each sample; these lie in one array.
    """
    one = F.struct(F.col(order).alias("at"), *[F.col(c).cast("long").alias(c) for c in sizes])
    lists = df.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("_c"))
    kind = f"struct<{', '.join(f'{c}:bigint' for c in sizes)}>"
    empty = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("held"))

    def step(so_far, c):
        held = so_far["held"]
        fits = held.isNotNull()
        for name, most in sizes.items():
            fits = fits & (held[name] + c[name] <= most)
        joined = F.struct(*[(held[n] + c[n]).alias(n) for n in sizes])
        alone = F.struct(*[c[n].alias(n) for n in sizes])
        done = F.when(fits | held.isNull(), so_far["done"]).otherwise(F.concat(so_far["done"], F.array(held)))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(alone).alias("held"))

    out = F.aggregate("_c", empty, step, lambda a: F.concat(a["done"], F.array(a["held"])))
    return lists.select(*by, F.posexplode(out).alias("chunk", "_s")).select(*by, "chunk", *[F.col(f"_s.{c}").alias(c) for c in sizes])
