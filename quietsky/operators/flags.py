"""Flags that need no neighbours: missing values, autocorrelations, static masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietsky.functions.complexes import missing
from quietsky.operators.selection import baselines_in_range


def flag_nans_and_zeros(df: DataFrame) -> DataFrame:
    return df.withColumn("flag", F.col("flag") | missing(F.col("re"), F.col("im")))


def flag_autos(df: DataFrame) -> DataFrame:
    return df.withColumn("flag", F.col("flag") | (F.col("antenna1") == F.col("antenna2")))


def unflag(df: DataFrame) -> DataFrame:
    return df.withColumn("flag", F.lit(False))


def combine_with_input(df: DataFrame) -> DataFrame:
    """Adds the flags that a strategy began with, kept as flag_orig."""
    return df.withColumn("flag", F.col("flag") | F.col("flag_orig"))


def dilated(mask: DataFrame, reach: int) -> DataFrame:
    """mask(mask_id, chan_idx, masked) with reach channels more on each side of what is masked."""
    near = W.partitionBy("mask_id").orderBy("chan_idx").rowsBetween(-reach, reach)
    return mask.withColumn("masked", F.max("masked").over(near))


def masked_channels(channels: DataFrame, masks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, mask_id, chan: channels(chan, chan_freq, chan_width) that hold a frequency of a mask, their lower edges included.

    Both sides are dealt to bins of the widest channel's width, a channel to each that it reaches, and joined by bin.
    """
    half = 0.5 * F.col("chan_width")
    width = channels.agg(F.max(F.abs("chan_width"))).first()[0] or 1.0
    reach = [F.floor((F.col("chan_freq") + sign * F.abs(half)) / width) for sign in (-1, 1)]
    own = channels.withColumn("_bin", F.explode(F.sequence(*reach)))
    dealt = masks.withColumn("_bin", F.floor(F.col("freq_hz") / width))
    inside = (F.col("freq_hz") >= F.col("chan_freq") - half) & (F.col("freq_hz") < F.col("chan_freq") + half)
    return own.join(dealt, "_bin").where(inside).select(*by, "mask_id", "chan").distinct()


def apply_static_mask(df: DataFrame, channels: DataFrame, masks: DataFrame, antennas: DataFrame | None = None, mode: str = "or", uvrange: str = "") -> DataFrame:
    """Flags masked channels on the baselines that uvrange selects. `override` replaces their flags by the last mask's."""
    mode = mode.strip()
    if mode not in ("or", "override"):
        raise ValueError(f"no accumulation mode {mode!r}")
    if antennas is None and uvrange.strip() not in ("", "*"):
        raise ValueError("a range of baselines needs the antennas' positions")
    known = [r[0] for r in masks.select("mask_id").distinct().orderBy("mask_id").collect()]  # a row for each mask
    if not known:
        return df
    hit = masked_channels(channels, masks if mode == "or" else masks.where(F.col("mask_id") == known[-1])).select("chan").distinct().withColumn("_hit", F.lit(True))
    out = df.join(F.broadcast(hit), "chan", "left")
    on = F.lit(True)
    if uvrange.strip() not in ("", "*"):
        lines = baselines_in_range(df.select("antenna1", "antenna2").distinct(), antennas, uvrange).withColumn("_on", F.lit(True))
        out = out.join(F.broadcast(lines), ["antenna1", "antenna2"], "left")  # pairs of antennas
        on = F.coalesce("_on", F.lit(False))
    masked = F.coalesce("_hit", F.lit(False))
    return out.withColumn("flag", F.when(on, masked if mode == "override" else F.col("flag") | masked).otherwise(F.col("flag"))).select(df.columns)
