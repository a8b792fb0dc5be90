"""Single steps of the SumThreshold and fit-and-clip flaggers on samples in long form, as DataFrame operations.

Samples have the columns of PRODUCT, time_idx, chan, amp and flag; amp is null where there is no number. Moving windows are
Window frames over one partitioning by PRODUCT, which every finer one accepts. Filters are passes of a box, each a moving sum. The iterated flaggers are in quietsky.operators.kernels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietsky.functions.boxes import PASSES, radius
from quietsky.operators.kernels import MAD_NORMAL
from quietsky.operators.medians import medians
from quietsky.sources.scratch import cut
from quietsky.sources.tables import GROUP

PRODUCT = [*GROUP, "bl", "corr"]
#: Places up to which a moving sum adds its values anew.
SLIDING = 64
#: The column that runs along an axis, and the one that stays.
AXES = {"time": ("time_idx", "chan"), "freq": ("chan", "time_idx")}


def by_lines(df: DataFrame, axis: str) -> DataFrame:
    """df dealt by its lines along an axis, so that no task holds a product, into as many parts as a shuffle has.

    Filters add places to lines, so parts are not joined, however few their bytes. The group is left out: where it is constant the optimizer drops it from windows, which would then deal anew.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bl", AXES[axis][1])


def amplitude() -> Column:
    """From re and im, null where either is NaN."""
    return F.when(~F.isnan("re") & ~F.isnan("im"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))


def amplitudes(df: DataFrame, axis: str | None = None) -> DataFrame:
    """amp from re and im, null where either is NaN. Samples lie by product from here on, or by the lines along an axis, if all that follows is along it."""
    return (by_lines(df, axis) if axis else df.repartition(*PRODUCT)).withColumn("amp", amplitude())


def average_freq(df: DataFrame, k: int) -> DataFrame:
    """Means over k channels of what is unflagged; 0 and flagged where there is nothing."""
    mean = F.avg(F.when(~F.col("flag"), F.col("amp")))
    out = df.groupBy(*PRODUCT, "time_idx", F.floor(F.col("chan") / k).cast("int").alias("chan")).agg(mean.alias("amp"))
    return out.withColumn("flag", F.col("amp").isNull()).withColumn("amp", F.coalesce("amp", F.lit(0.0)))


def time_median(df: DataFrame) -> DataFrame:
    """Median over time of what is unflagged; 0 and flagged where there is nothing."""
    out = medians(df, [*PRODUCT, "chan"], F.when(~F.col("flag"), F.col("amp"))).withColumnRenamed("median", "amp")
    return out.withColumn("flag", F.col("amp").isNull()).withColumn("amp", F.coalesce("amp", F.lit(0.0)))


def median_abs(df: DataFrame, by: list[str]) -> DataFrame:
    """Median of the absolute values of what is unflagged; null where there is nothing."""
    return medians(df, by, F.when(~F.col("flag"), F.abs("amp"))).withColumnRenamed("median", "median_abs")


def interpolated(df: DataFrame, column: str) -> DataFrame:
    """Fills nulls along frequency: straight lines between neighbours, the nearest value at the edges, 0 if there is none."""
    line = W.partitionBy(*PRODUCT, "time_idx").orderBy("chan")
    back, ahead = line.rowsBetween(W.unboundedPreceding, 0), line.rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("chan").alias("at"), F.col(column).alias("y")))
    out = df.withColumns({"_a": F.last(known, True).over(back), "_b": F.first(known, True).over(ahead)})
    a, b = F.col("_a"), F.col("_b")
    between = a["y"] + (b["y"] - a["y"]) * (F.col("chan") - a["at"]) / (b["at"] - a["at"])
    filled = F.when(a.isNull(), b["y"]).when(b.isNull() | (a["at"] == b["at"]), a["y"]).otherwise(between)
    return out.withColumn(column, F.coalesce(filled, F.lit(0.0))).drop("_a", "_b")


def blurred(df: DataFrame, axis: str, r: int, sums: list[str], counts: list[str], passes: int = PASSES) -> DataFrame:
    """df with sums along an axis, weighted by the box kernel, and plain counts over its support, in place of these columns; samples are dense.

    A pass is a moving sum over 2 r + 1 places up to SLIDING, and beyond one of tiles of that size: any stretch of so many places is the end of a tile and the
    beginning of the next. Either way nothing is added but the stretch's own values, so a large one elsewhere costs no digits, and a pass is linear in the line. Each line gets as many
    empty places beyond its ends as the passes reach, made from its first and last sample, for what leaves the line in one pass and comes back in the next. All passes of a line share one
    sort; wide ones turn it once each.
    """
    if r == 0:
        return df
    along, across = AXES[axis]
    beyond = r * passes
    line = W.partitionBy(*PRODUCT, across).orderBy(along)
    zero, reach = F.array(F.lit(0)), lambda a, b: F.sequence(F.lit(a), F.lit(b))
    places = F.concat(F.when(F.lag(along).over(line).isNull(), reach(-beyond, -1)).otherwise(F.array().cast("array<int>")), zero, F.when(F.lead(along).over(line).isNull(), reach(1, beyond)).otherwise(F.array().cast("array<int>")))
    out = df.withColumn("_places", places).withColumn("_to", F.explode("_places")).drop("_places")
    there = F.col("_to") == 0
    out = out.withColumns({along: F.col(along) + F.col("_to"), **{c: F.when(there, F.col(c)).otherwise(F.lit(0).cast(df.schema[c].dataType)) for c in (*sums, *counts)}})
    if counts:
        out = out.withColumns({c: F.sum(c).over(line.rowsBetween(-beyond, beyond)).cast("long") if 2 * beyond < SLIDING else _difference(out, c, line, beyond) for c in counts})
    for _ in range(passes):
        if 2 * r < SLIDING:
            out = out.withColumns({c: F.sum(c).over(line.rowsBetween(-r, r)) / (2.0 * r + 1) for c in sums})
        else:
            out = _tiled(out, axis, r, sums)
    return out.where("_to = 0").drop("_to")


def _tiled(df: DataFrame, axis: str, r: int, sums: list[str]) -> DataFrame:
    """Means over r places to each side, from running sums within tiles of 2 r + 1 places; wrong within r places of a line's ends, where blurred() has empty places that nothing reads."""
    along, across = AXES[axis]
    size = 2 * r + 1
    tile = W.partitionBy(*PRODUCT, across, "_tile")
    line = W.partitionBy(*PRODUCT, across).orderBy("_tile", along)  # a tile's own order, so these share a sort
    out = df.withColumn("_tile", F.floor(F.col(along) / size))
    out = out.withColumns({f"_end_{c}": F.sum(c).over(tile.orderBy(F.desc(along)).rowsBetween(W.unboundedPreceding, 0)) for c in sums})
    out = out.withColumns({f"_begin_{c}": F.sum(c).over(tile.orderBy(along).rowsBetween(W.unboundedPreceding, 0)) for c in sums})
    whole = F.pmod(F.col(along) - r, F.lit(size)) == 0
    nothing = lambda c: F.coalesce(c, F.lit(0.0))
    means = {c: (F.when(whole, F.lit(0.0)).otherwise(nothing(F.lag(f"_end_{c}", r).over(line))) + nothing(F.lead(f"_begin_{c}", r).over(line))) / size for c in sums}
    return out.withColumns(means).drop("_tile", *[f"{x}_{c}" for c in sums for x in ("_end", "_begin")])


def _difference(df: DataFrame, column: str, line: W, reach: int) -> Column:
    """The sum of whole numbers over `reach` places to each side, from running sums."""
    upto = F.sum(column).over(line.rowsBetween(W.unboundedPreceding, reach))
    before = F.coalesce(F.sum(column).over(line.rowsBetween(W.unboundedPreceding, -reach - 1)), F.lit(0))
    return (upto - before).cast(df.schema[column].dataType)


def masked_gaussian(df: DataFrame, sigma: tuple[float, float], passes: int = PASSES) -> DataFrame:
    """Adds smooth: a weighted mean over time and frequency of what is unflagged, null where the support has nothing. Samples are dense."""
    ok = ~F.col("flag")
    out = df.withColumns({"_v": F.when(ok, F.coalesce("amp", F.lit(0.0))).otherwise(0.0), "_u": F.when(ok, 1.0).otherwise(0.0), "_n": F.when(ok, 1).otherwise(0).cast("long")})
    for axis, s in zip(("time", "freq"), sigma, strict=True):
        out = blurred(out, axis, radius(s, passes), ["_v", "_u"], ["_n"], passes)
    return out.withColumn("smooth", F.when(F.col("_n") > 0, F.try_divide("_v", "_u"))).drop("_v", "_u", "_n")


def chunk_of(chan: Column, ends: list[int]) -> Column:
    """The number of the stretch of channels."""
    out = F.lit(0)
    for e in ends[1:-1]:
        out = out + (chan >= e).cast("int")
    return out


def background(df: DataFrame, iterations: int, spike: tuple[float, float], reject: float, ends: list[int]) -> DataFrame:
    """Adds background, as the kernel of the same name. df's columns go through all filters, so nothing is joined."""
    now = df.withColumn("_flag", F.col("flag"))
    for wide in range(iterations, 0, -1):
        smooth = masked_gaussian(now, (wide * spike[0], wide * spike[1]))
        away = F.abs(F.col("amp") - F.col("smooth"))
        stretch = W.partitionBy(*PRODUCT, chunk_of(F.col("chan"), ends))
        limit = MAD_NORMAL * reject * F.median(F.when(~F.col("flag"), away)).over(stretch)
        now = smooth.withColumn("flag", F.col("flag") | F.coalesce(away > limit, F.lit(False))).drop("smooth")
    smooth = interpolated(masked_gaussian(now, spike), "smooth").withColumn("flag", F.col("_flag"))
    return smooth.withColumnRenamed("smooth", "background").drop("_flag")


def convolve_flags(df: DataFrame, axis: str, w: int, threshold: float, keys: list[str] = PRODUCT) -> DataFrame:
    """Adds hit: whether a sample is in a full window of w whose mean is above the threshold."""
    along, across = AXES[axis]
    line = W.partitionBy(*keys, across).orderBy(along)
    ahead = line.rowsBetween(0, w - 1)
    over = (F.count("*").over(ahead) == w) & (F.sum("amp").over(ahead) / w > threshold)
    return df.withColumn("_over", F.coalesce(over, F.lit(False))).withColumn("hit", F.max("_over").over(line.rowsBetween(1 - w, 0))).drop("_over")


def sum_threshold(df: DataFrame, axis: str, windows: list[int], nsigma: float, rho: float, ends: list[int], slice_: int | None = None) -> DataFrame:
    """Adds hit by SumThreshold along an axis; ends are the ends of its stretches, from 0 to the number of places.

    A sample is sent to the stretches whose windows reach it; each has its own limit. Flags count only for the limit.
    With slice_, each stretch is cut into slices of so many places, solved in tasks of their own with as many neighbours as all windows together reach, under the
    limit of the whole stretch; the hits are the same, and no task holds a line.
    """
    along, across = AXES[axis]
    n, reach = ends[-1], max(windows, default=1) - 1
    windows = [w for w in windows if w <= n]
    if not windows:
        return df.withColumn("hit", F.lit(False))
    place = F.col(along)
    stretches = [(k, a, b, max(a - reach, 0), min(b + reach, n)) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
    to = F.array(*[F.when((place >= lo) & (place < hi), F.struct(F.lit(k).alias("k"), ((place >= a) & (place < b)).alias("own"))) for k, a, b, lo, hi in stretches])
    sent = df.withColumn("_s", F.explode(F.filter(to, lambda s: s.isNotNull())))
    counts = F.when(~F.col("flag") & F.col("_s.own"), F.abs("amp"))
    keys = [*PRODUCT, across, F.col("_s.k")]
    if slice_ is None:
        middle = F.median(counts).over(W.partitionBy(*keys))
        mine = F.col("_s.own")
    else:
        far = sum(w - 1 for w in windows)
        by = [*PRODUCT, across, "_k"]
        sent = sent.withColumn("_k", F.col("_s.k"))
        limits = medians(sent, by, counts).withColumnRenamed("median", "_mid")
        cuts = F.sequence(F.floor(F.greatest(place - far, F.lit(0)) / slice_), F.floor((place + far) / slice_))
        sent = sent.join(limits, by).withColumn("_cut", F.explode(cuts)).repartition(*by, "_cut")
        keys, middle = [*by, "_cut"], F.col("_mid")
        mine = F.col("_s.own") & (F.floor(place / slice_) == F.col("_cut"))
    line = W.partitionBy(*keys).orderBy(along)
    now = sent.withColumns({"_t0": F.coalesce(nsigma * MAD_NORMAL * middle, F.lit(float("inf"))), "_high": F.lit(False), "_low": F.lit(False)})
    for w in windows:
        t, x = F.col("_t0") / rho ** math.log2(w), F.col("amp")
        y = F.when(F.col("_high") & (x > t), t).when(F.col("_low") & (x < -t), -t).otherwise(x)
        ahead, behind = line.rowsBetween(0, w - 1), line.rowsBetween(1 - w, 0)
        now = now.withColumns({"_y": y, "_t": t})
        now = now.withColumn("_m", F.when(F.count("*").over(ahead) == w, F.sum("_y").over(ahead) / w))
        now = now.withColumns({"_h": F.coalesce(F.col("_m") > F.col("_t"), F.lit(False)), "_l": F.coalesce(-F.col("_m") > F.col("_t"), F.lit(False))})
        now = now.withColumns({"_high": F.col("_high") | F.max("_h").over(behind), "_low": F.col("_low") | F.max("_l").over(behind)})
    return now.where(mine).withColumn("hit", F.col("_high") | F.col("_low")).select(*df.columns, "hit")


def smeared(df: DataFrame, axis: str, extend: int) -> DataFrame:
    """flag taken from extend // 2 places before to extend places in all; an extend of 0 clears everything."""
    if extend == 0:
        return df.withColumn("flag", F.lit(False))
    along, across = AXES[axis]
    frame = W.partitionBy(*PRODUCT, across).orderBy(along).rowsBetween(-(extend // 2), extend - 1 - extend // 2)
    return df.withColumn("flag", F.max("flag").over(frame))


def unaveraged(df: DataFrame, flags: DataFrame, k: int, extend: int, time_frac: float, freq_frac: float) -> DataFrame:
    """Flags of the averaged channels on df's own, smeared; then whole times and channels of which more than a part is flagged, counted before either is filled."""
    coarse = flags.select(*PRODUCT, "time_idx", F.col("chan").alias("_bin"), F.col("flag").alias("_f"))
    full = df.drop("flag").withColumn("_bin", F.floor(F.col("chan") / k).cast("int")).join(coarse, [*PRODUCT, "time_idx", "_bin"]).withColumn("flag", F.col("_f")).drop("_bin", "_f")
    full = smeared(full, "freq", extend)
    part = lambda c: F.avg(F.col("flag").cast("double")).over(W.partitionBy(*PRODUCT, c))
    full = full.withColumns({"_row": part("time_idx"), "_col": part("chan")})
    return full.withColumn("flag", F.col("flag") | (F.col("_row") > freq_frac) | (F.col("_col") > time_frac)).drop("_row", "_col")


def low_terms(mean: DataFrame, n_chan: int, degrees: int) -> DataFrame:
    """PRODUCT and _terms: the first Fourier coefficients of mean(PRODUCT, chan, re, im), each a sum over channels: a row for each plane."""
    turn = lambda k: 2 * math.pi / n_chan * F.pmod(F.col("chan") * k, F.lit(n_chan))
    parts = []
    for k in range(min(degrees, n_chan)):
        c, s = F.cos(turn(k)), F.sin(turn(k))
        parts.append(F.struct(F.sum(F.col("re") * c + F.col("im") * s).alias("re"), F.sum(F.col("im") * c - F.col("re") * s).alias("im")))
    return mean.groupBy(*PRODUCT).agg(F.array(*parts).alias("_terms"))


def _clipped(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the median of what is unflagged as a column, joined by plane."""
    return df.join(medians(df, by, F.when(~F.col("flag"), F.col(value))).withColumnRenamed("median", name), by)


def fit_and_clip(df: DataFrame, n_chan: int, degrees: int, sigma: float, keep: bool) -> DataFrame:
    """One cycle of the fit-and-clip flagger on samples with re and im; new flags are added if keep, else they replace the old ones.

    Means by channel give each plane's low Fourier terms as sums, from which every channel's mean is made again; medians are selected. So
    there is no row but the samples, a mean for each channel and one row of terms for each plane.
    """
    ok = ~F.col("flag") & ~F.isnan("re") & ~F.isnan("im")
    mean = df.groupBy(*PRODUCT, "chan").agg(*[F.coalesce(F.avg(F.when(ok, F.col(p))), F.lit(0.0)).alias(p) for p in ("re", "im")], F.min("flag").alias("_all"))
    terms = low_terms(mean, n_chan, degrees).join(mean.groupBy(*PRODUCT).agg(F.min("_all").alias("_done")), PRODUCT)
    angle = lambda k: 2 * math.pi / n_chan * F.pmod(F.col("chan") * k, F.lit(n_chan))
    turned = F.transform("_terms", lambda z, k: F.struct((z["re"] * F.cos(angle(k)) - z["im"] * F.sin(angle(k))).alias("re"), (z["re"] * F.sin(angle(k)) + z["im"] * F.cos(angle(k))).alias("im")))
    total = lambda part: F.aggregate("_z", F.lit(0.0), lambda a, z: a + z[part]) / n_chan
    smooth = mean.select(*PRODUCT, "chan").join(terms, PRODUCT).withColumn("_z", turned).select(*PRODUCT, "chan", "_done", total("re").alias("_sr"), total("im").alias("_si"))
    dr, di = F.col("re") - F.col("_sr"), F.col("im") - F.col("_si")
    away = F.when(~F.isnan("re") & ~F.isnan("im"), F.sqrt(dr * dr + di * di))
    out = cut(df.join(smooth, [*PRODUCT, "chan"]).withColumn("_away", away).drop("_sr", "_si"), "away")
    out = _clipped(out, PRODUCT, "_away", "_mid").withColumn("_off", F.abs(F.col("_away") - F.col("_mid")))
    out = _clipped(out, PRODUCT, "_off", "_mad")
    new = F.coalesce(F.col("_away") > sigma * F.col("_mad"), F.lit(False))
    # a plane that is flagged whole stays so
    return out.withColumn("flag", F.col("_done") | (F.col("flag") | new if keep else new)).select(df.columns)
