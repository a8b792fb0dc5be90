"""The catalogue: one query for each operator over the test tables, with the SQL that gives the same rows.

Doubles are rounded to six places on both sides, and NaN is null in what a query returns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietsky.functions import boxes, grammar, stokes
from quietsky.functions.complexes import residual
from quietsky.operators import flags, iterated, packing, selection, stats
from quietsky.operators import threshold as th
from quietsky.plans import application, strategy
from quietsky.sources import fixtures, tables
from quietsky.sources.scratch import folder

LINEAR, CIRCULAR = [9, 10, 11, 12], [5, 6, 7, 8]
CELL = ["bl", "time_idx", "chan"]
ENDS = [0, 16, 32, 48, 64]


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.nanvl(c, F.lit(None).cast("double")), 6) + 0.0


# SQL views that the queries below share
_E1 = f"""e0 as (select vec_id, label::int bl, (row_number() over (partition by label order by vec_id) - 1)::int time_idx, embedding from embeddings),
e1r as (select vec_id, bl, time_idx, c::int chan, abs(2 + embedding[c + 1]::double) + case when c = 17 then 3.0 else 0.0 end
  + case when time_idx between 20 and 24 and c between 40 and 43 then 1.5 else 0.0 end + case when time_idx % 13 = 7 and c = time_idx * 5 % 64 then 2.0 else 0.0 end amp from e0, range(64) r(c)),
e1 as (select bl, {[p[0] for p in fixtures.PAIRS]}[bl + 1]::int antenna1, {[p[1] for p in fixtures.PAIRS]}[bl + 1]::int antenna2, time_idx, chan,
  case when vec_id % 37 = 0 and chan = 5 then null when vec_id % 41 = 0 and chan = 9 then 0.0 else amp end re, chan >= 60 and time_idx % 2 = 0 flag from e1r)"""
_E2 = f"""e2 as (select vec_id row_id, (vec_id // 125)::int scan_number, ((vec_id // 125) % 2)::int field_id, ((vec_id % 125) // 5)::double t,
  {[p[0] for p in fixtures.PAIRS]}[label + 1]::int antenna1, {[p[1] for p in fixtures.PAIRS]}[label + 1]::int antenna2, embedding from embeddings),
e2s as (select row_id, scan_number, field_id, t, antenna1, antenna2, c::int chan, k::int corr,
  case when row_id % 37 = 0 and c = 5 then null when row_id % 41 = 0 and c = 6 then 0.0 else embedding[c * 8 + k * 2 + 1]::double end re,
  case when row_id % 37 = 0 and c = 5 then null when row_id % 41 = 0 and c = 6 then 0.0 else embedding[c * 8 + k * 2 + 2]::double end im,
  (row_id + c * 3 + k) % 11 = 0 flag from e2, range(8) a(c), range(4) b(k))"""
_E2I = (
    _E2
    + """,
b2 as (select scan_number, antenna1, antenna2, (dense_rank() over (partition by scan_number order by antenna2, antenna1) - 1)::int bl from (select distinct scan_number, antenna1, antenna2 from e2)),
t2 as (select scan_number, t, (dense_rank() over (partition by scan_number order by t) - 1)::int time_idx from (select distinct scan_number, t from e2)),
e2i as (select e2s.*, bl, time_idx from e2s join b2 using (scan_number, antenna1, antenna2) join t2 using (scan_number, t)),
last as (select scan_number, bl, time_idx, max(row_id) row_id from e2i group by all),
grid as (select b2.scan_number, bl, antenna1, antenna2, time_idx, c::int chan, k::int corr from b2 join t2 using (scan_number), range(8) a(c), range(4) b(k)),
packed as (select g.*, l.row_id, s.re, s.im, coalesce(s.flag, true) flag from grid g left join last l using (scan_number, bl, time_idx) left join e2i s on s.row_id = l.row_id and s.chan = g.chan and s.corr = g.corr)"""
)

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query of that name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _e1(spark: SparkSession, d: str, axis: str | None = None) -> DataFrame:
    return th.amplitudes(fixtures.spectra(spark, d), axis)


def _long(spark: SparkSession, d: str) -> DataFrame:
    return packing.samples(fixtures.rows(spark, d))


def _vis(spark: SparkSession, d: str) -> DataFrame:
    """A row for each row and channel: vis over correlations, and f."""
    both = fixtures.rows(spark, d).select("row_id", F.posexplode(F.arrays_zip("data", "flag")).alias("chan", "c"))
    return both.select("row_id", "chan", F.col("c.data").alias("vis"), F.col("c.flag").alias("f"))


@query(f"with {_E2} select row_id, chan, corr, flag or re is null or (re = 0 and im = 0) flag from e2s")
def nan_zero_flags(spark, d):
    return flags.flag_nans_and_zeros(_long(spark, d)).select("row_id", "chan", "corr", "flag")


@query(f"with {_E1} select bl, time_idx, chan, flag or antenna1 = antenna2 flag from e1")
def auto_flags(spark, d):
    return flags.flag_autos(fixtures.spectra(spark, d)).select(*CELL, "flag")


@query(
    f"with {_E2}, p as (select s.*, m.re mr, m.im mi from e2s s left join e2s m on m.row_id = s.row_id - 1 and m.chan = s.chan and m.corr = s.corr) "
    "select row_id, chan, corr, round(re - coalesce(case when row_id > 0 then mr end, case when row_id = 0 then 0.0 end), 6) + 0.0 re, round(sqrt(pow(re - case when row_id = 0 then 0.0 else mr end, 2) + pow(im - case when row_id = 0 then 0.0 else mi end, 2)), 6) amp from p"
)
def residual_model(spark, d):
    rows = fixtures.rows(spark, d)
    zero = F.transform("data", lambda c: F.transform(c, lambda k: F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))))
    model = rows.select((F.col("row_id") + 1).alias("row_id"), F.col("data").alias("model"))
    both = rows.join(model, "row_id", "left").withColumn("model", F.coalesce("model", zero))
    less = packing.samples(both.withColumn("data", F.zip_with("data", "model", residual)).drop("model"))
    return less.select("row_id", "chan", "corr", r6("re").alias("re"), r6(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("amp"))


_P = "select row_id, chan, max(case when corr = 0 then re end) r0, max(case when corr = 0 then im end) i0, max(case when corr = 1 then re end) r1, max(case when corr = 1 then im end) i1, max(case when corr = 2 then re end) r2, max(case when corr = 2 then im end) i2, max(case when corr = 3 then re end) r3, max(case when corr = 3 then im end) i3 from e2s group by all"
_PI = "0.25 * (pow(r0 + r3, 2) + pow(i0 + i3, 2))"
_PQ = "0.25 * (pow(r0 - r3, 2) + pow(i0 - i3, 2))"
_PU = "0.25 * (pow(r1 + r2, 2) + pow(i1 + i2, 2))"
_PV = "0.25 * (pow(r1 - r2, 2) + pow(i1 - i2, 2))"


@query(f"with {_E2}, p as ({_P}) select row_id, chan, round(sqrt({_PQ} + {_PU} + {_PV}), 6) amp from p")
def stokes_polarised_linear(spark, d):
    return _vis(spark, d).select("row_id", "chan", r6(stokes.polarised(F.col("vis"), LINEAR)).alias("amp"))


@query(f"with {_E2}, p as ({_P}) select row_id, chan, round(sqrt({_PU} + {_PV} + {_PQ}), 6) amp from p")
def stokes_polarised_circular(spark, d):
    return _vis(spark, d).select("row_id", "chan", r6(stokes.polarised(F.col("vis"), CIRCULAR)).alias("amp"))


@query(f"with {_E2}, p as ({_P}) select row_id, chan, round(sqrt({_PI} + {_PQ} + {_PU} + {_PV}), 6) amp from p")
def stokes_total_power(spark, d):
    return _vis(spark, d).select("row_id", "chan", r6(stokes.total_power(F.col("vis"), LINEAR)).alias("amp"))


@query(f"with {_E2}, p as ({_P}) select row_id, chan, round(sqrt({_PI}) - sqrt({_PQ} + {_PU} + {_PV}), 6) + 0.0 amp from p")
def stokes_unpolarised(spark, d):
    return _vis(spark, d).select("row_id", "chan", r6(stokes.unpolarised(F.col("vis"), LINEAR)).alias("amp"))


@query(f"with {_E2} select row_id, chan, corr, bool_or(flag) over (partition by row_id, chan) flag from e2s")
def corr_any_flag(spark, d):
    return packing.samples(packing.equalised(fixtures.rows(spark, d))).select("row_id", "chan", "corr", "flag")


@query(f"with {_E2I} select scan_number, antenna1, antenna2, bl from b2")
def unique_baselines_index(spark, d):
    return packing.unique_baselines(fixtures.rows(spark, d)).select("scan_number", "antenna1", "antenna2", "bl")


@query(f"with {_E2I} select scan_number, t \"time\", time_idx from t2")
def time_index(spark, d):
    return packing.unique_times(fixtures.rows(spark, d)).select("scan_number", "time", "time_idx")


@query(f"with {_E2I} select scan_number, bl, time_idx, chan, corr, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im, flag from packed")
def pack_grid(spark, d):
    full = packing.packed(packing.indexed(fixtures.rows(spark, d)), 8, 4)
    return full.select("scan_number", *CELL, "corr", r6("re").alias("re"), r6("im").alias("im"), "flag")


@query(f"with {_E2I} select e.row_id, e.chan, e.corr, p.flag from e2i e join packed p on e.scan_number = p.scan_number and e.bl = p.bl and e.time_idx = p.time_idx and e.chan = p.chan and e.corr = p.corr")
def unpack_roundtrip(spark, d):
    rows = packing.indexed(fixtures.rows(spark, d))
    return packing.samples(packing.unpacked(rows, packing.packed(rows, 8, 4))).select("row_id", "chan", "corr", "flag")


@query(f"with {_E2} select row_id, scan_number from e2 where scan_number in (1, 2, 3)")
def scan_filter(spark, d):
    return selection.by_scan(fixtures.rows(spark, d), "1~3").select("row_id", "scan_number")


@query(f"with {_E2} select row_id, field_id from e2 where field_id = 1")
def field_filter(spark, d):
    fields = spark.createDataFrame([(0, "3C286"), (1, "PKS1934-63")], "field_id int, name string")
    return selection.by_field(fixtures.rows(spark, d), fields, ["PKS1934-63"]).select("row_id", "field_id")


_D2 = "0.5 * pow(144.0 * (antenna2 - antenna1), 2)"


@query(f"with {_E1} select distinct antenna1, antenna2 from e1 where {_D2} between 0 and 150.0 * 150.0")
def uvrange_baselines(spark, d):
    lines = fixtures.spectra(spark, d).select("antenna1", "antenna2").distinct()
    return selection.baselines_in_range(lines, fixtures.antennas(spark), "0~150")


_MASK = f"m(mask_id, freq_hz) as (values {', '.join(f'({k}, {f!r}::double)' for k, f in fixtures.MASKS)}), h as (select distinct mask_id, chan from (select distinct chan, 0.856e9::double + chan * 13375000.0::double f from e1) x join m on freq_hz >= f - 0.5 * 13375000.0 and freq_hz < f + 0.5 * 13375000.0)"


@query(f"with {_E1}, {_MASK} select bl, time_idx, chan, flag or chan in (select chan from h) flag from e1")
def static_mask_or(spark, d):
    return flags.apply_static_mask(fixtures.spectra(spark, d), fixtures.channels(spark), fixtures.masks(spark)).select(*CELL, "flag")


@query(f"with {_E1}, {_MASK} select bl, time_idx, chan, case when {_D2} between 0 and 150.0 * 150.0 then chan in (select chan from h where mask_id = 1) else flag end flag from e1")
def static_mask_override(spark, d):
    return flags.apply_static_mask(fixtures.spectra(spark, d), fixtures.channels(spark), fixtures.masks(spark), fixtures.antennas(spark), "override", "0~150").select(*CELL, "flag")


@query(
    f"with {_E1}, m as (select bl mask_id, chan chan_idx, coalesce(bool_or(re > 4.4), false) masked from e1 group by all) "
    "select mask_id, chan_idx, bool_or(masked) over (partition by mask_id order by chan_idx rows between 3 preceding and 3 following) masked from m"
)
def mask_dilate(spark, d):
    """A mask for each baseline: channels that had a high sample, and three more to each side."""
    high = F.coalesce(F.max(F.col("amp") > 4.4), F.lit(False))
    mask = _e1(spark, d).groupBy(F.col("bl").alias("mask_id"), F.col("chan").alias("chan_idx")).agg(high.alias("masked"))
    return flags.dilated(mask, grammar.dilation("30MHz", fixtures.FREQ_STEP))


@query(f"with {_E1} select bl, time_idx, (chan // 4)::int chan, round(coalesce(avg(case when not flag then re end), 0), 6) amp, count(case when not flag then re end) = 0 flag from e1 group by all")
def average_freq_k4(spark, d):
    return th.average_freq(_e1(spark, d), 4).select(*CELL, r6("amp").alias("amp"), "flag")


@query(f"with {_E1} select bl, chan, round(coalesce(median(case when not flag then re end), 0), 6) amp, count(case when not flag then re end) = 0 flag from e1 group by all")
def time_median(spark, d):
    return th.time_median(_e1(spark, d)).select("bl", "chan", r6("amp").alias("amp"), "flag")


@query(f"with {_E1} select bl, round(median(case when not flag then abs(re) end), 6) median_abs from e1 group by all")
def median_abs_global(spark, d):
    return th.median_abs(_e1(spark, d), ["bl"]).select("bl", r6("median_abs").alias("median_abs"))


@query(f"with {_E1} select bl, chan, round(median(case when not flag then abs(re) end), 6) median_abs from e1 group by all")
def median_abs_chan(spark, d):
    return th.median_abs(_e1(spark, d), ["bl", "chan"]).select("bl", "chan", r6("median_abs").alias("median_abs"))


_LERP = """{out} as (select {cols}, coalesce(case when ac is null then by_ when bc is null or ac = bc then ay else ay + (by_ - ay) * (chan - ac) / (bc - ac) end, 0) y from (
  select *, last_value(case when {v} is not null then chan end ignore nulls) over a ac, last_value({v} ignore nulls) over a ay,
  first_value(case when {v} is not null then chan end ignore nulls) over b bc, first_value({v} ignore nulls) over b by_ from {src}
  window a as (partition by bl, time_idx order by chan rows between unbounded preceding and current row), b as (partition by bl, time_idx order by chan rows between current row and unbounded following)))"""


@query(f"with {_E1}, {_LERP.format(out='l', cols='bl, time_idx, chan', v='re', src='e1')} select bl, time_idx, chan, round(y, 6) amp from l")
def interp_nans(spark, d):
    return th.interpolated(_e1(spark, d, "freq"), "amp").select(*CELL, r6("amp").alias("amp"))


def _kernel(r: int, name: str) -> str:
    return f"{name}(o, w) as (values {', '.join(f'({i - r * boxes.PASSES}, {w!r}::double)' for i, w in enumerate(boxes.kernel(r)))})"


@query(f"with {_E1}, {_kernel(2, 'k')} select bl, time_idx, chan + o chan, round(sum(coalesce(re, 0) * w), 6) + 0.0 amp from e1, k where chan + o between 0 and 63 group by all")
def box_filter_freq(spark, d):
    src = _e1(spark, d, "freq").withColumn("amp", F.coalesce("amp", F.lit(0.0)))
    return th.blurred(src, "freq", 2, ["amp"], []).where("chan between 0 and 63").select(*CELL, r6("amp").alias("amp"))


@query(f"with {_E1}, {_kernel(32, 'k')} select bl, time_idx, chan + o chan, round(sum(coalesce(re, 0) * w), 6) + 0.0 amp from e1, k where chan + o between 0 and 63 group by all")
def box_filter_wide(spark, d):
    """A box wider than a line, in tiles."""
    src = _e1(spark, d, "freq").withColumn("amp", F.coalesce("amp", F.lit(0.0)))
    return th.blurred(src, "freq", 32, ["amp"], []).select(*CELL, r6("amp").alias("amp"))


def _smooth(src: str, out: str, k1: str, k2: str, flag: str = "flag") -> str:
    return f"""{out}t as materialized (select bl, chan, time_idx + o time_idx, sum(coalesce(re, 0) * w) v, sum(w) u, count(*) n from {src}, {k1} where not {flag} group by bl, chan, time_idx + o),
{out}f as materialized (select bl, time_idx, chan + o chan, sum(v * w) v, sum(u * w) u, sum(n) n from {out}t, {k2} group by bl, time_idx, chan + o),
{out} as materialized (select e.*, case when n > 0 then v / u end bg from {src} e left join {out}f f using (bl, time_idx, chan))"""


@query(f"with {_E1}, own as materialized (select * from e1), {_kernel(1, 'k1')}, {_kernel(2, 'k2')}, {_smooth('own', 's', 'k1', 'k2')} select bl, time_idx, chan, round(bg, 6) smooth from s")
def masked_gaussian(spark, d):
    return th.masked_gaussian(_e1(spark, d), (2.0, 3.0)).select(*CELL, r6("smooth").alias("smooth"))


@query(
    f"""with {_E1}, {_kernel(1, "k1")}, {_kernel(2, "k2")}, {_smooth("e1", "s", "k1", "k2")},
x as (select bl, time_idx, chan, re, flag or coalesce(abs(re - bg) > 1.4826 * 2.0 * median(case when not flag then abs(re - bg) end) over (partition by bl, chan // 16), false) flag from s),
{_smooth("x", "z", "k1", "k2")}, {_LERP.format(out="l", cols="bl, time_idx, chan", v="bg", src="z")} select bl, time_idx, chan, round(y, 6) background from l"""
)
def background_1iter(spark, d):
    return th.background(_e1(spark, d), 1, (2.0, 3.0), 2.0, ENDS).select(*CELL, r6("background").alias("background"))


@query(
    f"""with {_E1}, o as (select *, count(*) over w = 4 and coalesce(sum(re) over w / 4 > 2.3, false) over_ from e1 window w as (partition by bl, chan order by time_idx rows between current row and 3 following))
select bl, time_idx, chan, bool_or(over_) over (partition by bl, chan order by time_idx rows between 3 preceding and current row) hit from o"""
)
def convolve_flags(spark, d):
    return th.convolve_flags(_e1(spark, d, "time"), "time", 4, 2.3).select(*CELL, "hit")


def _sum_threshold_sql(part: str, along: str) -> str:
    steps = [
        f"""m0 as (select bl, time_idx, chan, flag, re - coalesce(median(case when not flag then re end) over (partition by bl, time_idx), 0) x from e1),
h0 as (select *, coalesce(4.5 * 1.4826 * median(case when not flag then abs(x) end) over (partition by {part}), 'inf'::double) t0, false hi, false lo from m0)"""
    ]
    for i, w in enumerate((1, 2, 4, 8)):
        steps.append(
            f"""a{i} as (select *, t0 / pow(1.3, {i}) t, case when hi and x > t0 / pow(1.3, {i}) then t0 / pow(1.3, {i}) when lo and x < -t0 / pow(1.3, {i}) then -t0 / pow(1.3, {i}) else x end y from h{i}),
b{i} as (select *, case when count(*) over w = {w} then sum(y) over w / {w} end m from a{i} window w as (partition by {part} order by {along} rows between current row and {w - 1} following)),
h{i + 1} as (select bl, time_idx, chan, flag, x, t0, hi or bool_or(coalesce(m > t, false)) over w hi, lo or bool_or(coalesce(-m > t, false)) over w lo from b{i} window w as (partition by {part} order by {along} rows between {w - 1} preceding and current row))"""
        )
    return f"with {_E1}, {', '.join(steps)} select bl, time_idx, chan, hi or lo hit from h4"


def _levelled(spark: SparkSession, d: str) -> DataFrame:
    """Amplitudes less the median of their time."""
    line = W.partitionBy(*th.PRODUCT, "time_idx")
    return _e1(spark, d).withColumn("amp", F.col("amp") - F.coalesce(F.median(F.when(~F.col("flag"), F.col("amp"))).over(line), F.lit(0.0)))


@query(_sum_threshold_sql("bl, time_idx", "chan"))
def sum_threshold_freq(spark, d):
    return th.sum_threshold(_levelled(spark, d), "freq", [1, 2, 4, 8], 4.5, 1.3, [0, fixtures.N_CHAN]).select(*CELL, "hit")


@query(_sum_threshold_sql("bl, chan", "time_idx"))
def sum_threshold_time(spark, d):
    return th.sum_threshold(_levelled(spark, d), "time", [1, 2, 4, 8], 4.5, 1.3, [0, 1 << 30]).select(*CELL, "hit")


@query(f"with {_E1} select bl, time_idx, chan, bool_or(flag or coalesce(re > 3, false)) over (partition by bl, chan order by time_idx rows between 1 preceding and 1 following) flag from e1")
def combine_time_smear(spark, d):
    both = _e1(spark, d, "time").withColumn("flag", F.col("flag") | F.coalesce(F.col("amp") > 3, F.lit(False)))
    return th.smeared(both, "time", 3).select(*CELL, "flag")


@query(
    f"""with {_E1}, c as (select bl, time_idx, chan // 4 bin, avg(re) > 2.2 f from e1 group by all),
s as (select e.bl, e.time_idx, e.chan, bool_or(f) over (partition by e.bl, e.time_idx order by e.chan rows between 1 preceding and 1 following) flag from e1 e join c on e.bl = c.bl and e.time_idx = c.time_idx and e.chan // 4 = c.bin)
select bl, time_idx, chan, flag or avg(flag::int::double) over (partition by bl, time_idx) > 0.3 or avg(flag::int::double) over (partition by bl, chan) > 0.2 flag from s"""
)
def unaverage_extend(spark, d):
    own = _e1(spark, d)
    coarse = own.groupBy(*th.PRODUCT, "time_idx", F.floor(F.col("chan") / 4).cast("int").alias("chan")).agg((F.avg("amp") > 2.2).alias("flag"))
    return th.unaveraged(own, coarse, 4, 3, 0.2, 0.3).select(*CELL, "flag")


def _low_pass_sql(n: int, degrees: int) -> str:
    h = boxes.low_pass(n, degrees)
    return f"h(m, hr, hi) as (values {', '.join(f'({m}, {float(z.real)!r}::double, {float(z.imag)!r}::double)' for m, z in enumerate(h))})"


@query(
    f"""with {_E1}, {_low_pass_sql(64, 20)}, a as (select bl, chan, coalesce(avg(case when not flag then re end), 0) r from e1 group by all),
s as (select bl, (chan + m) % 64 chan, sum(r * hr) sr, sum(r * hi) si from a, h group by bl, (chan + m) % 64),
w as (select e.*, sqrt(pow(re - sr, 2) + si * si) away from e1 e join s using (bl, chan)),
o as (select *, abs(away - median(case when not flag then away end) over (partition by bl)) off_ from w)
select bl, time_idx, chan, flag or coalesce(away > 13 * median(case when not flag then off_ end) over (partition by bl), false) flag from o"""
)
def uvcontsub_1cycle(spark, d):
    return th.fit_and_clip(fixtures.spectra(spark, d), fixtures.N_CHAN, 20, 13.0, True).select(*CELL, "flag")


def _kernel_run(spark: SparkSession, d: str, steps: list[dict]) -> DataFrame:
    known = strategy.instrument(fixtures.channels(spark), fixtures.masks(spark), fixtures.antennas(spark))
    out = strategy.flag_baselines(fixtures.spectra_rows(spark, d), steps, known, ["bl", "time_idx"])
    return packing.flag_samples(out).select(*CELL, "flag")


@query()
def sum_threshold_full(spark, d):
    return _kernel_run(spark, d, [{"name": "st", "task": "sum_threshold", "kwargs": {"outlier_nsigma": 10, "background_iterations": 5}}])


def _fit_cycles(src: str, plane: str, n_chan: int, degrees: int, sigma: float, cycles: int, keep_from: int) -> str:
    """CTEs c0 to c{cycles}: src(plane, time_idx, chan, re, flag) after each cycle of fit and clip; re is null where there is no number."""
    steps = [_low_pass_sql(n_chan, degrees), f"c0 as materialized (select * from {src})"]
    for i in range(cycles):
        new = f"coalesce(away > {sigma} * median(case when not flag then off_ end) over (partition by {plane}), false)"
        steps.append(
            f"""a{i} as (select {plane}, chan, coalesce(avg(case when not flag then re end), 0) r from c{i} group by all),
s{i} as (select {plane}, (chan + m) % {n_chan} chan, sum(r * hr) sr, sum(r * hi) si from a{i}, h group by all),
w{i} as (select e.*, sqrt(pow(re - sr, 2) + si * si) away from c{i} e join s{i} using ({plane}, chan)),
o{i} as (select *, abs(away - median(case when not flag then away end) over (partition by {plane})) off_ from w{i}),
c{i + 1} as materialized (select * exclude (away, off_) replace (bool_and(flag) over (partition by {plane}) or {"flag or " if i >= keep_from else ""}{new} as flag) from o{i})"""
        )
    return ", ".join(steps)


@query(f"with {_E1}, {_fit_cycles('(select bl, time_idx, chan, re, flag from e1)', 'bl', 64, 20, 13.0, 5, 1)} select bl, time_idx, chan, flag from c5")
def uvcontsub_full(spark, d):
    return _kernel_run(spark, d, [{"name": "fit", "task": "uvcontsub_flagger", "kwargs": {"sigma": 13.0}}])


def _threshold_ctes(name: str, src: str, keys: str, part: str, along: str, ends: list[int]) -> str:
    """CTEs up to {name}(keys, hit): SumThreshold of src(keys, x, flag) by windows of 1, 2, 4 and 8 along an axis, with a limit for each stretch between ends."""
    stretches = ", ".join(f"({k}, {a}, {b}, {max(a - 7, 0)}, {min(b + 7, ends[-1])})" for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)))
    part = f"{part}, k"
    steps = [
        f"""{name}_m as (select {keys}, x, flag, k, {along} >= a and {along} < b own from {src} join (values {stretches}) z(k, a, b, lo, hi) on {along} >= z.lo and {along} < z.hi),
{name}_h0 as materialized (select *, coalesce(4.5 * 1.4826 * median(case when not flag and own then abs(x) end) over (partition by {part}), 'inf'::double) t0, false hi, false lo from {name}_m)"""
    ]
    for i, w in enumerate((1, 2, 4, 8)):
        t = f"t0 / pow(1.3, {i})"
        steps.append(
            f"""{name}_a{i} as (select *, case when hi and x > {t} then {t} when lo and x < -{t} then -{t} else x end y from {name}_h{i}),
{name}_b{i} as (select *, case when count(*) over w = {w} then sum(y) over w / {w} end m from {name}_a{i} window w as (partition by {part} order by {along} rows between current row and {w - 1} following)),
{name}_h{i + 1} as materialized (select {keys}, x, flag, k, own, t0, hi or bool_or(coalesce(m > {t}, false)) over w hi, lo or bool_or(coalesce(-m > {t}, false)) over w lo from {name}_b{i} window w as (partition by {part} order by {along} rows between {w - 1} preceding and current row))"""
        )
    return ", ".join([*steps, f"{name} as materialized (select {keys}, hi or lo hit from {name}_h4 where own)"])


def _background_ctes(name: str, src: str, k1: str, k2: str) -> str:
    """CTEs up to {name}(bl, time_idx, chan, x, flag): what of src's re stands out from its background, after one iteration."""
    return f"""{_smooth(src, f"{name}_s", k1, k2)},
{name}_x as materialized (select bl, time_idx, chan, re, flag kept, flag or coalesce(abs(re - bg) > 1.4826 * 2.0 * median(case when not flag then abs(re - bg) end) over (partition by bl, chan // 16), false) flag from {name}_s),
{_smooth(f"{name}_x", f"{name}_z", k1, k2)}, {_LERP.format(out=f"{name}_l", cols="bl, time_idx, chan, re, kept", v="bg", src=f"{name}_z")},
{name} as materialized (select bl, time_idx, chan, re - y x, kept flag from {name}_l)"""


def _major(p: str, src: str) -> str:
    """CTEs up to {p}new(bl, time_idx, chan, new): what one major iteration finds in src(bl, time_idx, chan, re, flag)."""
    return f"""{p}i0 as materialized (select bl, time_idx, chan, re is null missing, flag or re is null flag, case when flag or re is null then 0 else re end re from {src}),
{p}v as materialized (select bl, 0 time_idx, chan, coalesce(median(case when not flag then re end), 0) re, count(*) filter (not flag) = 0 flag from {p}i0 group by bl, chan),
{_background_ctes(f"{p}p", f"{p}v", "k0", "k2")}, {_threshold_ctes(f"{p}ps", f"{p}p", "bl, time_idx, chan", "bl, time_idx", "chan", ENDS)},
{p}i1 as materialized (select i.bl, i.time_idx, i.chan, re, missing, flag or hit flag, hit from {p}i0 i join {p}ps ps on ps.bl = i.bl and ps.chan = i.chan),
{_background_ctes(f"{p}b", f"(select bl, time_idx, chan, re, flag from {p}i1)", "k1", "k2")},
{_threshold_ctes(f"{p}ts", f"{p}b", "bl, time_idx, chan", "bl, chan", "time_idx", [0, 1 << 30])},
{p}b2 as materialized (select b.bl, b.time_idx, b.chan, x, flag or hit flag from {p}b b join {p}ts ts using (bl, time_idx, chan)),
{_threshold_ctes(f"{p}fs", f"{p}b2", "bl, time_idx, chan", "bl, time_idx", "chan", ENDS)},
{p}g as (select i1.bl, i1.time_idx, i1.chan, missing, i1.hit or ts.hit or fs.hit g from {p}i1 i1 join {p}ts ts using (bl, time_idx, chan) join {p}fs fs using (bl, time_idx, chan)),
{p}g1 as materialized (select *, bool_or(g) over (partition by bl, chan order by time_idx rows between 1 preceding and 1 following) a from {p}g),
{p}g2 as materialized (select *, bool_or(a) over (partition by bl, time_idx order by chan rows between 1 preceding and 1 following) f from {p}g1),
{p}new as materialized (select bl, time_idx, chan, f or missing or avg(f::int::double) over (partition by bl, time_idx) > 0.8 or avg(f::int::double) over (partition by bl, chan) > 0.6 new from {p}g2)"""


_KERNELS = f"{_kernel(0, 'k0')}, {_kernel(1, 'k1')}, {_kernel(2, 'k2')}"
_SMALL_STEPS = {"freq_chunks": 4, "spike_width_time": 2.0, "spike_width_freq": 3.0}


@query(
    f"""with {_E1}, {_KERNELS}, {_major("x", "(select bl, time_idx, chan, re, flag from e1)")},
seen as materialized (select bl, time_idx, chan, re, flag or new flag from e1 join xnew using (bl, time_idx, chan)), {_major("y", "seen")}
select bl, time_idx, chan, new flag from ynew"""
)
def sum_threshold_two_majors(spark, d):
    """The whole SumThreshold flagger over tiles of the planes, in two major iterations with four stretches of channels: the new flags."""
    samples = fixtures.spectra(spark, d).withColumn("amp", th.amplitude())
    found = iterated.sum_threshold_flagger(samples, fixtures.N_CHAN, num_major_iterations=2, **_SMALL_STEPS)
    return found.select(*CELL, "flag")


@query(
    f"with {_E1}, {_KERNELS}, {_major('x', '(select bl, time_idx, chan, re, flag from e1)')} select bl, time_idx, chan, flag or new flag from e1 join xnew using (bl, time_idx, chan)"
)
def sum_threshold_one_major(spark, d):
    """The whole SumThreshold flagger, in one major iteration with four stretches of channels; the input's flags stay."""
    own = {"num_major_iterations": 1, **_SMALL_STEPS}
    known = strategy.instrument(fixtures.channels(spark), None, None)
    rows = fixtures.spectra_rows(spark, d)
    new = strategy.flag_baselines(rows, [{"name": "st", "task": "sum_threshold", "kwargs": own}], known, ["bl", "time_idx"])
    return packing.flag_samples(new).select(*CELL, "flag")


@query()
def strategy_default(spark, d):
    return _kernel_run(spark, d, strategy.DEFAULT)


_POWER = f"""l as (select row_id, scan_number, antenna1, antenna2, t, max(row_id) over (partition by scan_number, antenna1, antenna2, t) last_id from e2),
p as ({_P}), f as (select row_id, chan, bool_or(flag) f from e2s group by all),
q as (select scan_number, antenna1, antenna2, t time_idx, chan, sqrt({_PI} + {_PQ} + {_PU} + {_PV}) re, f from l join p using (row_id) join f using (row_id, chan) where row_id = last_id)"""


@query(
    f"""with {_E2}, {_POWER}, {_fit_cycles("(select * exclude (f), f or re is null or re = 0 or antenna1 = antenna2 flag from q)", "scan_number, antenna1, antenna2", 8, 3, 5.0, 5, 0)}
select l.row_id, chan, corr::int corr, flag from l join c5 c on c.scan_number = l.scan_number and c.antenna1 = l.antenna1 and c.antenna2 = l.antenna2 and c.time_idx = l.t, range(4) k(corr)"""
)
def flag_rows(spark, d):
    """The whole way from rows to rows, on total power."""
    steps = [s for s in strategy.DEFAULT if s["task"] in ("flag_nans_zeros", "flag_autos", "combine_with_input_flags")] + [{"name": "fit", "task": "uvcontsub_flagger", "kwargs": {"taylor_degrees": 3, "or_original_from_cycle": 0}}]
    channels = fixtures.channels(spark).where("chan < 8")
    out = strategy.flag(fixtures.rows(spark, d), channels, LINEAR, strategies=steps, mode="total_power")
    return out.select("row_id", F.posexplode("flag").alias("chan", "f")).select("row_id", "chan", F.posexplode("f").alias("corr", "flag"))


#: Steps that SQL can follow row by row.
_PLAIN = [
    {"name": "missing", "task": "flag_nans_zeros"},
    {"name": "masks", "task": "apply_static_mask", "kwargs": {"accumulation_mode": "or", "uvrange": "150~0"}},
    {"name": "autocorrelations", "task": "flag_autos"},
]

_TABLES = f"""{_E2}, m(freq_hz) as (values {', '.join(f'({f!r}::double)' for _, f in fixtures.MASKS)}),
last as (select *, max(row_id) over (partition by scan_number, antenna1, antenna2, t) last_id from e2s where scan_number % 2 = 0 or (chan < 4 and corr < 2)),
hit as (select distinct d, c from (select d, c, 0.856e9::double + (c + d) * 13375000.0::double f from range(2) x(d), range(8) y(c)) join m on freq_hz >= f - 0.5 * 13375000.0 and freq_hz < f + 0.5 * 13375000.0)"""


def _tables(spark: SparkSession, d: str, mode: str) -> DataFrame:
    options = application.Options(mode=mode, scans="0~3", field_names=["3C286", "1"])
    out = application.flag_tables(fixtures.described_rows(spark, d), fixtures.side_tables(spark), options, fixtures.masks(spark), _PLAIN)
    both = out.select("row_id", "data_desc_id", F.posexplode("flag").alias("chan", "f"))
    return both.select("row_id", "data_desc_id", "chan", F.posexplode("f").alias("corr", "flag"))


_ON = f"(antenna1 = antenna2 or ({_D2} between 0 and 150.0 * 150.0 and exists (from hit where d = scan_number % 2 and c = l.chan)))"


@query(
    f"""with {_TABLES}, f as (select row_id, chan, bool_or(flag or re is null or (re = 0 and im = 0)) f from e2s where scan_number % 2 = 0 or (chan < 4 and corr < 2) group by all)
select l.row_id, (scan_number % 2)::int data_desc_id, l.chan, corr, f or {_ON} flag from last l join f on f.row_id = last_id and f.chan = l.chan where scan_number between 0 and 3"""
)
def tables_to_flags_standard(spark, d):
    """Rows of two data descriptions, with their side tables and masks, each correlation flagged by itself."""
    return _tables(spark, d, "standard")


#: Either amplitude is zero only where all parts are.
_AMPLITUDE = f"""with {_TABLES}, p as (select row_id, chan, bool_or(flag) or bool_or(re is null) or bool_and(coalesce(re = 0 and im = 0, false)) f
  from e2s where scan_number % 2 = 0 or (chan < 4 and corr < 2) group by row_id, chan)
select l.row_id, (scan_number % 2)::int data_desc_id, l.chan, corr, f or {_ON} flag from last l join p on p.row_id = last_id and p.chan = l.chan where scan_number between 0 and 3"""


@query(_AMPLITUDE)
def tables_to_flags_total_power(spark, d):
    return _tables(spark, d, "total_power")


@query(_AMPLITUDE)
def tables_to_flags_polarisation(spark, d):
    return _tables(spark, d, "polarisation")


def _observation(spark: SparkSession) -> str:
    """A new folder with the side tables."""
    place = f"{folder(spark)}/observation-{uuid.uuid4().hex}"
    for name, side in fixtures.side_tables(spark).items():
        side.write.parquet(f"{place}/{name}")
    return place


@query(_AMPLITUDE)
def flags_through_files(spark, d):
    """Tables and mask files that are written, read, flagged and committed twice; what is read back are the last flags of each group."""
    place = _observation(spark)
    fixtures.described_rows(spark, d).write.partitionBy(*tables.GROUP).parquet(f"{place}/main")
    masks = fixtures.mask_files(spark, f"{place}/masks")
    main, side = tables.read_visibilities(spark, f"{place}/main"), tables.read_side_tables(spark, place)
    options = application.Options(scans="0~3", field_names=["3C286", "1"])
    found = tables.read_masks(spark, masks).where("masked").select("mask_id", "freq_hz")
    tables.commit_flags(application.flag_tables(main, side, options, found, []), f"{place}/flags")
    tables.commit_flags(application.flag_tables(main, side, options, found, _PLAIN), f"{place}/flags")
    both = tables.read_flags(spark, f"{place}/flags").select("row_id", "data_desc_id", F.posexplode("flag").alias("chan", "f"))
    return both.select("row_id", "data_desc_id", "chan", F.posexplode("f").alias("corr", "flag"))


def _stored_run(spark: SparkSession, d: str) -> tuple[str, str]:
    """Folder and version of the flags of a main table that lies in buckets of baselines; the table leaves the catalog again, its files stay."""
    place, name = _observation(spark), f"quietsky_{uuid.uuid4().hex}"
    masks = fixtures.mask_files(spark, f"{place}/masks")
    tables.store_visibilities(fixtures.described_rows(spark, d), name, f"{place}/main", 8)
    try:
        options = application.Options(scans="0~3", field_names=["3C286", "1"], mask_folders=(f"{place}/masks",), stored=name)
        version = application.flag_and_commit(spark, place, f"{place}/flags", options, _PLAIN)
    finally:
        spark.sql(f"drop table {name}")
    return place, version


@query(_AMPLITUDE)
def flags_of_a_stored_table(spark, d):
    """The same flags from a table in buckets of baselines, which are flagged where they lie."""
    place, _ = _stored_run(spark, d)
    both = tables.read_flags(spark, f"{place}/flags").select("row_id", "data_desc_id", F.posexplode("flag").alias("chan", "f"))
    return both.select("row_id", "data_desc_id", "chan", F.posexplode("f").alias("corr", "flag"))


_NAMES = "['A1', 'A2', 'A3', 'A4']"
_S = "sum(flag::int)::bigint flagged, count(*)::bigint size"


def _stats(spark: SparkSession, d: str) -> DataFrame:
    flagged = flags.flag_autos(flags.flag_nans_and_zeros(fixtures.spectra(spark, d)))
    return stats.window_stats(flagged, fixtures.antennas(spark), fixtures.channels(spark))


_FLAGGED = f"{_E1}, g as (select * replace (flag or re is null or re = 0 or antenna1 = antenna2 as flag) from e1)"
_BASELINE = f"select 'baseline' dim, {_NAMES}[antenna1 + 1] || '&' || {_NAMES}[antenna2 + 1] \"key\", {_S} from g group by all"
_ANTENNA = f"select 'antenna' dim, {_NAMES}[a + 1] \"key\", {_S} from (select unnest(list_distinct([antenna1, antenna2])) a, flag from g) group by all"


@query(f"with {_FLAGGED} {_BASELINE}")
def stats_baseline(spark, d):
    return _stats(spark, d).where("dim = 'baseline'")


@query(f"with {_FLAGGED} {_ANTENNA}")
def stats_antenna(spark, d):
    return _stats(spark, d).where("dim = 'antenna'")


@query(
    f"with {_E2} select case when grouping(field_id) = 0 then 'field' else 'scan' end dim, case when grouping(field_id) = 0 then field_id else scan_number end::varchar \"key\", {_S} from e2s group by grouping sets ((field_id), (scan_number))"
)
def stats_field_scan(spark, d):
    return stats.window_stats(_long(spark, d), fixtures.antennas(spark), fixtures.channels(spark)).where("dim in ('field', 'scan')")


@query(
    f"with {_FLAGGED}, b as (select *, floor(chan * 9 / 63)::int bin from g) select 'ddid_bin' dim, '0:' || k.b \"key\", coalesce((select sum(flag::int) from b where bin = k.b and chan < 63), 0)::bigint flagged, (select count(*) from g)::bigint size from range(10) k(b)"
)
def stats_ddid_bins(spark, d):
    return _stats(spark, d).where("dim = 'ddid_bin'")


@query(f"with {_FLAGGED} select dim, \"key\", (2 * flagged)::bigint flagged, (2 * size)::bigint size from ({_BASELINE} union all {_ANTENNA})")
def stats_merged(spark, d):
    one = _stats(spark, d).where("dim in ('baseline', 'antenna')")
    return stats.merged([one, one])


@query(
    f"""with {_FLAGGED}, f as ({_BASELINE} union all {_ANTENNA}), o as (select * from ({_BASELINE.replace("from g", "from e1")} union all {_ANTENNA.replace("from g", "from e1")}))
select f.dim, f."key", printf('%.3f%%, original %.3f%%', f.flagged * 100.0::double / f.size, o.flagged * 100.0::double / o.size) line from f join o on f.dim = o.dim and f."key" = o."key\""""
)
def flag_summary_report(spark, d):
    before = stats.window_stats(fixtures.spectra(spark, d), fixtures.antennas(spark), fixtures.channels(spark))
    return stats.summary(_stats(spark, d), before).where("dim in ('baseline', 'antenna')")


#: Windows of all baselines by all times of a scan; what has no row is flagged, and stays so.
_WINDOWS = f"""{_TABLES}, p as (select row_id, chan, bool_or(flag) b, bool_or(flag) or bool_or(re is null) or bool_and(coalesce(re = 0 and im = 0, false)) f
  from e2s where scan_number % 2 = 0 or (chan < 4 and corr < 2) group by row_id, chan),
own as (select distinct l.scan_number, l.antenna1, l.antenna2, l.t, l.chan, p.b, p.f or {_ON} f from last l join p on p.row_id = last_id and p.chan = l.chan),
cells as (select b.scan_number, b.antenna1, b.antenna2, t.t, c chan, coalesce(own.b, true) b, coalesce(own.f, true) f
  from (select distinct scan_number, antenna1, antenna2 from e2 where scan_number between 0 and 3) b join (select distinct scan_number, t from e2) t using (scan_number), range(8) r(c)
  left join own on own.scan_number = b.scan_number and own.antenna1 = b.antenna1 and own.antenna2 = b.antenna2 and own.t = t.t and own.chan = c where scan_number % 2 = 0 or c < 4)"""
_COUNTED = "sum(b::int)::bigint before, sum(f::int)::bigint flagged, count(*)::bigint size"


@query(
    f"""with {_WINDOWS},
n as (select 'antenna' dim, {_NAMES}[a + 1] "key", {_COUNTED} from (select unnest(list_distinct([antenna1, antenna2])) a, b, f from cells) group by all
  union all select 'baseline', {_NAMES}[antenna1 + 1] || '&' || {_NAMES}[antenna2 + 1], {_COUNTED} from cells group by all
  union all select 'field', ['3C286', 'PKS1934-63'][scan_number % 2 + 1], {_COUNTED} from cells group by all
  union all select 'scan', scan_number::varchar, {_COUNTED} from cells group by all
  union all select 'ddid_bin', (scan_number % 2) || ':' || k, coalesce(sum(b::int) filter (bin = k), 0)::bigint, coalesce(sum(f::int) filter (bin = k), 0)::bigint, count(*)::bigint
    from (select *, case when scan_number % 2 = 0 then case when chan < 7 then floor(chan * 9 / 7) end when chan < 3 then chan * 3 end bin from cells), range(10) r(k) group by all)
select dim, "key", before, flagged, size from n"""
)
def run_report(spark, d):
    """All five reports of a whole run, from the counts that its tasks made; the main table is not read again."""
    place, version = _stored_run(spark, d)
    after, before = application.counts(spark, place, f"{place}/flags", version)
    return after.join(before.select("dim", "key", F.col("flagged").alias("before")), ["dim", "key"]).select("dim", "key", "before", "flagged", "size")


@query(f"with {_E2} select row_id, chan, corr, re is null or (re = 0 and im = 0) flag from e2s")
def ignore_flags(spark, d):
    return flags.flag_nans_and_zeros(flags.unflag(_long(spark, d))).select("row_id", "chan", "corr", "flag")


@query(f"with {_E2} select row_id, chan, corr, false flag from e2s")
def unflag(spark, d):
    return flags.unflag(_long(spark, d)).select("row_id", "chan", "corr", "flag")


@query(f"with {_E2} select row_id, chan, corr, flag or re is null or (re = 0 and im = 0) flag from e2s")
def combine_input(spark, d):
    kept = _long(spark, d).withColumn("flag_orig", F.col("flag"))
    return flags.combine_with_input(flags.flag_nans_and_zeros(flags.unflag(kept))).select("row_id", "chan", "corr", "flag")


@query(
    f"""with recursive {_E2}, c as (select scan_number, t, count(*) n, count(*) filter (row_id % 3 = 0) kept, row_number() over (partition by scan_number order by t) i from e2 group by scan_number, t),
r as (select scan_number, i, n, kept, 0 chunk from c where i = 1
  union all select c.scan_number, c.i, case when r.n + c.n <= 17 and r.kept + c.kept <= 6 then r.n + c.n else c.n end, case when r.n + c.n <= 17 and r.kept + c.kept <= 6 then r.kept + c.kept else c.kept end,
    case when r.n + c.n <= 17 and r.kept + c.kept <= 6 then r.chunk else r.chunk + 1 end from r join c on c.scan_number = r.scan_number and c.i = r.i + 1)
select scan_number, chunk, max(n)::bigint n, max(kept)::bigint kept from r group by all"""
)
def chunk_aggregate(spark, d):
    """Times of a scan joined to chunks of at most 17 rows, six of them of one kind."""
    times = fixtures.rows(spark, d).groupBy("scan_number", "time").agg(F.count("*").alias("n"), F.count_if(F.col("row_id") % 3 == 0).alias("kept"))
    return packing.merged_chunks(times, ["scan_number"], "time", {"n": 17, "kept": 6})


_EV = """k as (select event_type, (dense_rank() over (order by event_type) - 1)::int corr from (select distinct event_type from events)),
ev as (select (user_id % 10)::int bl, corr, date_trunc('hour', ts) t, ((user_id // 10) % 15)::int chan, avg(value) amp from events join k using (event_type) group by all)"""


@query(
    f"""with {_EV}, l as (select bl, corr, chan, t, amp, amp > 2.0 * median(amp) over (partition by bl, corr, chan) high from ev)
select bl, corr, chan, strftime(t, '%Y-%m-%d %H') "hour", round(amp, 6) amp, coalesce(bool_or(high) over (partition by bl, corr, chan order by t rows between 1 preceding and 1 following), false) flag from l"""
)
def events_time_chan_flags(spark, d):
    part = W.partitionBy("bl", "corr", "chan")
    grid = fixtures.event_grid(spark, d).withColumn("high", F.col("amp") > 2.0 * F.median("amp").over(part))
    flag = F.coalesce(F.max("high").over(part.orderBy("time").rowsBetween(-1, 1)), F.lit(False))
    return grid.select("bl", "corr", "chan", F.date_format("time", "yyyy-MM-dd HH").alias("hour"), r6("amp").alias("amp"), flag.alias("flag"))


@query(
    f"""with l as (select (l_suppkey % 10)::int bl, (l_linenumber - 1)::int chan, year(l_shipdate)::int scan, l_linestatus field, l_returnflag = 'R' flag from lineitem)
select bl, chan, scan, field, {_S} from l group by grouping sets ((bl), (chan), (scan, field), (field))"""
)
def lineitem_flag_stats(spark, d):
    line = fixtures.lineitem_flags(spark, d)
    sums = [F.sum(F.col("flag").cast("long")).alias("flagged"), F.count("*").alias("size")]
    cells = line.groupBy("bl", "chan", "scan", "field").agg(*sums)  # sums first, so the sets expand few rows
    again = [F.sum("flagged").alias("flagged"), F.sum("size").alias("size")]
    return cells.groupingSets([["bl"], ["chan"], ["scan", "field"], ["field"]], "bl", "chan", "scan", "field").agg(*again)
