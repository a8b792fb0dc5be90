"""Exact medians of groups of any size, by distributed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietsky.sources.scratch import cut

#: Values of a group that may meet in one buffer.
MOST = 4096
#: Stretches of equal share into which a round divides a group's values.
SHARES = 256


def medians(df: DataFrame, by: list[str], value: Column, most: int = MOST) -> DataFrame:
    """by and median of each group of df; null values do not count, a group without others has null. Keys must not be null.

    Groups are counted first. Up to `most` values, which is checked by that count, are sorted together. Of a larger group no task reads more than partial sums: a
    round sketches its values, counts exactly how many lie below and at the two limits around the wanted place, and leaves what lies
    strictly between them, about 3 in SHARES, to the next round. NaN is above all numbers, as in Spark's own median, and equal to itself.
    """
    x = cut(df.select(*by, value.cast("double").alias("_x")), "values")
    sizes = cut(x.groupBy(*by).agg(F.count("_x").alias("_n")), "sizes")
    few = sizes.where(f"_n <= {most}").select(*by)
    small = x.join(few, by).groupBy(*by).agg(F.median("_x").alias("median"))
    many = sizes.where(f"_n > {most}")
    if many.isEmpty():
        return small
    own = x.join(many.select(*by), by).where("_x is not null")
    lower = cut(kth(own, many.select(*by, F.floor((F.col("_n") - 1) / 2).alias("_k")), by, most), "lower")
    above = F.min(F.when(F.col("_x") > F.col("_v"), F.col("_x")))
    near = own.join(lower, by).groupBy(*by, "_v").agg(F.count_if(F.col("_x") <= F.col("_v")).alias("_c"), above.alias("_u"))
    upper = F.when(F.col("_c") > F.floor(F.col("_n") / 2), F.col("_v")).otherwise(F.col("_u"))
    return small.unionByName(near.join(many, by).select(*by, ((F.col("_v") + upper) / 2).alias("median")))


def kth(rows: DataFrame, wanted: DataFrame, by: list[str], most: int = MOST) -> DataFrame:
    """by and _v: of each group of rows(by, _x) the value at place _k from 0, in order, of wanted(by, _k)."""
    found = None
    while True:
        sketch = F.percentile_approx("_x", [i / SHARES for i in range(SHARES + 1)], 10_000)
        limits = rows.groupBy(*by).agg(F.count("*").alias("_n"), sketch.alias("_p")).join(wanted, by)
        at = F.floor(F.col("_k") * SHARES / F.col("_n")).cast("int")
        limits = limits.select(*by, "_k", F.get("_p", F.greatest(at - 1, F.lit(0))).alias("_a"), F.get("_p", F.least(at + 2, F.lit(SHARES))).alias("_b"))
        limits = cut(limits, "limits")  # a row for each large group
        count = lambda c, name: F.count_if(c).alias(name)
        x, a, b, k = (F.col(c) for c in ("_x", "_a", "_b", "_k"))
        placed = cut(rows.join(limits, by).groupBy(*by, "_k", "_a", "_b").agg(count(x < a, "_1"), count(x <= a, "_2"), count(x < b, "_3"), count(x <= b, "_4"), F.count("*").alias("_5")), "placed")
        exact = placed.where("(_1 <= _k and _k < _2) or (_3 <= _k and _k < _4)").select(*by, F.when(k < F.col("_2"), a).otherwise(b).alias("_v"))
        found = exact if found is None else found.unionByName(exact)
        below, between = k < F.col("_1"), (k >= F.col("_2")) & (k < F.col("_3"))
        left = placed.where(below | between | (k >= F.col("_4"))).select(
            *by,
            F.when(between, a).when(~below, b).alias("_lo"),
            F.when(between, b).when(below, a).alias("_hi"),
            F.when(below, k).when(between, k - F.col("_2")).otherwise(k - F.col("_4")).alias("_k"),
            F.when(below, F.col("_1")).when(between, F.col("_3") - F.col("_2")).otherwise(F.col("_5") - F.col("_4")).alias("_m"),
        )
        left = cut(left, "left")
        if left.isEmpty():
            return found
        inside = (F.col("_lo").isNull() | (x > F.col("_lo"))) & (F.col("_hi").isNull() | (x < F.col("_hi")))
        rows = cut(rows.join(left, by).where(inside).select(*by, "_x", "_k", "_m"), "inside")
        few = rows.where(f"_m <= {most}").groupBy(*by, "_k").agg(F.sort_array(F.collect_list("_x")).alias("_l"))
        found = found.unionByName(few.select(*by, F.get("_l", F.col("_k").cast("int")).alias("_v")))
        wanted = left.where(f"_m > {most}").select(*by, "_k")
        if wanted.isEmpty():
            return found
        rows = rows.where(f"_m > {most}").select(*by, "_x")
