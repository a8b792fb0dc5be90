"""Steps that hold no plane in one task, against the plain ones."""

import math
import random
import statistics
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietsky import queries
from quietsky.functions import grammar
from quietsky.operators import flags, iterated, kernels, medians, packing
from quietsky.operators import threshold as th
from quietsky.plans import application, strategy
from quietsky.sources import fixtures, tables

from .test_flagging import long, noisy, plane

OPTIONS = {"freq_chunks": 4, "spike_width_time": 2.0, "spike_width_freq": 3.0, "background_iterations": 1}


def test_medians_of_any_size(spark):
    rng = random.Random(4)
    groups = {
        "few": [1.0, None, 3.0],
        "none": [None, None],
        "ties": [5.0] * 400 + [6.0] * 400,
        "tied middle": [5.0] * 399 + [6.0] * 401 + [None] * 9,
        "even": [rng.gauss(0, 1) for _ in range(1000)],
        "odd": [rng.lognormvariate(0, 30) * rng.choice([-1, 1]) for _ in range(1001)],
        "numbers": [float(rng.randint(0, 3)) for _ in range(777)],
        "wide": [1e300, -1e300, *(i / 7 for i in range(600))],
        "lone": [7.0] * 900,
    }
    df = spark.createDataFrame([(g, v) for g, own in groups.items() for v in own], "g string, v double").repartition(3)
    got = {r["g"]: r["median"] for r in medians.medians(df, ["g"], F.col("v"), most=20).collect()}
    known = {g: [v for v in own if v is not None] for g, own in groups.items()}
    want = {g: statistics.median(own) if own else None for g, own in known.items()}
    assert got == want
    assert got == {r["g"]: r["median"] for r in df.groupBy("g").agg(F.median("v").alias("median")).collect()}


def test_medians_take_nan_for_the_largest(spark):
    df = spark.createDataFrame([(1, math.nan)] * 30 + [(1, float(i)) for i in range(40)] + [(2, math.nan)] * 60, "g int, v double")
    got = {r["g"]: r["median"] for r in medians.medians(df, ["g"], F.col("v"), most=5).collect()}
    assert got[1] == 34.5 and math.isnan(got[2])
    assert medians.medians(df.limit(0), ["g"], F.col("v")).collect() == []


def test_large_groups_meet_in_no_buffer(spark, monkeypatch):
    gathered = []
    lists = F.collect_list
    monkeypatch.setattr(medians.F, "collect_list", lambda c: gathered.append(c) or lists(c))
    df = spark.range(50_000).select((F.col("id") % 2).alias("g"), F.sin("id").alias("v"))
    rows = df.select("g", F.col("v").alias("_x"))
    out = medians.kth(rows, spark.createDataFrame([(0, 12_499), (1, 12_499)], "g long, _k long"), ["g"], 100)
    want = df.groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("l")).select("g", F.get("l", F.lit(12_499)).alias("v"))
    assert {tuple(r) for r in out.select("g", "_v").collect()} == {tuple(r) for r in want.collect()}
    assert "percentile(" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("size", [1, 7, 16, 1000])
def test_slices_give_the_same_hits(spark, size):
    amp, flag = noisy((61, 13))
    amp[20:29, 3] += 0.8
    amp = amp - np.median(amp, axis=0)
    df = long(spark, amp, flag)
    for axis, ends in (("time", [0, 1 << 30]), ("freq", [0, 5, 13])):
        whole = plane(th.sum_threshold(df, axis, [1, 2, 4, 8], 3.0, 1.3, ends), "hit", amp.shape)
        sliced = th.sum_threshold(df, axis, [1, 2, 4, 8], 3.0, 1.3, ends, size)
        assert sliced.count() == amp.size
        assert (plane(sliced, "hit", amp.shape) == whole).all() and whole.any() and not whole.all()


@pytest.mark.parametrize("more", [{"num_major_iterations": 3}, {"num_major_iterations": 2, "average_freq": 3, "time_slice": 9}, {"num_major_iterations": 0}])
def test_plan_equals_kernel(spark, more):
    amp, flag = noisy((30, 40))
    amp[3, 5] = np.nan
    amp[:, 22] = np.nan
    options = {**OPTIONS, **more}
    want = kernels.sum_threshold_flags(amp, flag, **{k: v for k, v in options.items() if k != "time_slice"})
    got = plane(iterated.sum_threshold_flagger(long(spark, amp, flag), 40, **options), "flag", amp.shape)
    assert (got.astype(bool) == want).all()
    assert want.any() == (more["num_major_iterations"] > 0) and not want.all()


def test_plan_stops_when_nothing_changes(spark, monkeypatch):
    turns = []
    once = iterated.one_pass
    monkeypatch.setattr(iterated, "one_pass", lambda *a: turns.append(1) or once(*a))
    quiet = np.full((12, 16), 5.0) + np.random.default_rng(0).normal(0, 0.1, (12, 16))
    options = {**OPTIONS, "outlier_nsigma": 1e6}
    out = iterated.sum_threshold_flagger(long(spark, quiet, np.zeros(quiet.shape, bool)), 16, **options)
    assert len(turns) == 1 and out.where("flag").count() == 0
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_low_terms_equal_fourier(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=24) + 1j * rng.normal(size=24)
    keys = dict.fromkeys(th.PRODUCT, 0)
    df = spark.createDataFrame([(*keys.values(), c, float(v.real), float(v.imag)) for c, v in enumerate(z)], ", ".join(f"{k} int" for k in keys) + ", chan int, re double, im double")
    got = th.low_terms(df, 24, 7).first()["_terms"]
    assert np.allclose([t["re"] + 1j * t["im"] for t in got], np.fft.fft(z)[:7])


def test_wide_fit_makes_few_rows(spark):
    n = 512
    keys = ", ".join(f"0 as {k}" for k in th.PRODUCT)
    df = spark.range(2 * n).selectExpr("cast(id % 512 as int) as chan", "cast(id div 512 as int) as time_idx", "sin(id) as re", "cos(id) as im", "false as flag", *(keys.split(", ")))
    out = th.fit_and_clip(df, n, 20, 3.0, True)
    assert out.count() == 2 * n and "Generate" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("radius", [2, 40])
def test_filters_equal_the_kernel_at_any_radius(spark, radius):
    rng = np.random.default_rng(radius)
    x = rng.normal(2, 1, (3, 150))
    df = long(spark, x, np.zeros(x.shape, bool))
    for axis, number in (("freq", 1), ("time", 0)):
        got = plane(th.blurred(df, axis, radius, ["amp"], []), "amp", x.shape).astype(float)
        assert np.allclose(got, kernels.box(x, radius, 4, number), rtol=1e-12, atol=1e-12)


def test_a_large_spike_costs_its_neighbours_no_digits(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(2, 1, (1, 300))
    plain = plane(th.blurred(long(spark, x, np.zeros(x.shape, bool)), "freq", 3, ["amp"], []), "amp", x.shape).astype(float)
    x[0, 20] = 1e12
    spiked = plane(th.blurred(long(spark, x, np.zeros(x.shape, bool)), "freq", 3, ["amp"], []), "amp", x.shape).astype(float)
    assert (spiked[0, 33:] == plain[0, 33:]).all() and spiked[0, 20] > 1e9


@pytest.mark.parametrize("axis", ["freq", "time"])
def test_wide_filters_add_only_what_is_near(spark, axis):
    """A spike of 1e12 beyond the reach of four passes leaves every bit of the means as it was, through tiles as through moving frames."""
    rng = np.random.default_rng(11)
    x = rng.normal(2, 1, (1, 500)) if axis == "freq" else rng.normal(2, 1, (500, 1))
    of = lambda: plane(th.blurred(long(spark, x, np.zeros(x.shape, bool)), axis, 33, ["amp"], []), "amp", x.shape).astype(float).ravel()
    plain = of()
    x.flat[20] = 1e12
    spiked = of()
    assert (spiked[20 + 4 * 33 + 1 :] == plain[20 + 4 * 33 + 1 :]).all() and spiked[20] > 1e8
    assert np.allclose(spiked, kernels.box(x, 33, 4, 1 if axis == "freq" else 0).ravel(), rtol=1e-12, atol=1e-3)


def test_committed_flags_survive_a_failed_run(spark, tmp_path):
    path = str(tmp_path / "flags")
    kind = "field_id int, data_desc_id int, scan_number int, row_id long, flag boolean"
    old = spark.createDataFrame([(0, 0, s, i, False) for s in (1, 2) for i in range(50)], kind)
    with pytest.raises(FileNotFoundError):
        tables.read_flags(spark, path)
    tables.commit_flags(old, path)
    before = sorted(map(tuple, tables.read_flags(spark, path).select(*old.columns).collect()))
    assert before == sorted(map(tuple, old.collect()))

    def fails(batches):
        for batch in batches:
            yield batch
        raise RuntimeError("this task is lost")

    with pytest.raises(Exception, match="this task is lost"):
        tables.commit_flags(old.withColumn("flag", F.lit(True)).mapInArrow(fails, kind), path)
    assert sorted(map(tuple, tables.read_flags(spark, path).select(*old.columns).collect())) == before
    tables.commit_flags(old.where("scan_number = 2").withColumn("flag", F.lit(True)), path)
    got = tables.read_flags(spark, path)
    assert {(r["scan_number"], r["flag"]) for r in got.collect()} == {(1, False), (2, True)} and got.count() == 100
    with pytest.raises(Exception, match="exist"):
        tables.write_bytes(spark, f"{path}/_commits/{2:012d}", b"x")


def test_masks_are_read_in_tasks(spark, tmp_path):
    kinds = np.dtype([("m", bool), ("f", np.float64)])
    files = []
    for name, hit in (("b one", 3), ("a", 7)):
        files.append(str(tmp_path / f"{name}.npy"))
        np.save(files[-1], np.array([(i == hit, 1e6 * i) for i in range(12)], dtype=kinds))
    got = tables.read_masks(spark, files, 1)
    assert {(r["mask_id"], r["chan_idx"]) for r in got.where("masked").collect()} == {(0, 2), (0, 3), (0, 4), (1, 6), (1, 7), (1, 8)}
    for i, f in enumerate(files):
        same = tables.load_mask(spark, f, i, 1)
        assert got.where(F.col("mask_id") == i).exceptAll(same).count() == 0
    assert tables.read_masks(spark, []).count() == 0
    np.save(tmp_path / "bad.npy", np.zeros(3))
    with pytest.raises(Exception, match="bad.npy has no records"):
        tables.read_masks(spark, [str(tmp_path / "bad.npy")]).collect()


def test_masks_meet_channels_by_bins(spark):
    channels = spark.createDataFrame([(0, c, 1e6 * c, w) for c, w in enumerate([1e6, 1e6, 3e6, -1e6, 0.0, 1e6])], "data_desc_id int, chan int, chan_freq double, chan_width double")
    masks = spark.createDataFrame([(0, f) for f in (-0.5e6, 0.5e6, 1.4999e6, 3.4999e6, 5.5e6, 3e6, 4e6)], "mask_id int, freq_hz double")
    out = flags.masked_channels(channels, masks, ("data_desc_id",))
    want = {c for c, w in enumerate([1e6, 1e6, 3e6, -1e6, 0.0, 1e6]) if any(1e6 * c - w / 2 <= f < 1e6 * c + w / 2 for (f,) in masks.select("freq_hz").collect())}
    assert {r["chan"] for r in out.collect()} == want == {0, 1, 2}
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    assert flags.masked_channels(channels.limit(0), masks).count() == 0


def test_chunks_equal_the_plain_list(spark):
    rng = random.Random(3)
    a, b = [rng.randint(1, 9) for _ in range(60)], [rng.randint(0, 3) for _ in range(60)]
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "g int, t int, a int, b int")
    got = packing.merged_chunks(df, ["g"], "t", {"a": 20, "b": 5}).orderBy("chunk").collect()
    want = grammar.merged_chunks([tuple(a), tuple(b)], [20, 5])
    assert (tuple(r["a"] for r in got), tuple(r["b"] for r in got)) == tuple(want)


def test_an_empty_list_has_no_steps_and_null_data_is_flagged(spark):
    rows = fixtures.rows(spark, "/root/testdata/sf0.001").where("scan_number = 0")
    channels = fixtures.channels(spark).where("chan < 8")
    run = lambda df, steps: strategy.flag(df, channels, [9, 10, 11, 12], strategies=steps)
    count = lambda df: df.select(F.sum(F.size(F.filter(F.flatten("flag"), lambda f: f)))).first()[0]
    own = rows.withColumn("flag", F.transform("flag", lambda c: F.transform(c, lambda k: F.exists(c, lambda x: x))))
    last = rows.groupBy("antenna1", "antenna2", "time").agg(F.max("row_id").alias("row_id"))
    kept = run(rows, []).join(last, "row_id", "left_semi")
    assert count(kept) == count(own.join(last, "row_id", "left_semi"))
    empty = application.flag_tables(fixtures.described_rows(spark, "/root/testdata/sf0.001"), fixtures.side_tables(spark), application.Options(scans="0"), None, [])
    assert 0 < count(empty) < empty.count() * 32

    one = rows.agg(F.max("row_id")).first()[0]
    for column in ("data", "flag"):
        nulled = rows.withColumn(column, F.when(F.col("row_id") != one, F.col(column)))
        got = run(nulled, [{"name": "n", "task": "flag_nans_zeros"}])
        assert got.count() == rows.count() and all(map(all, got.where(F.col("row_id") == one).first()["flag"]))
    part = rows.withColumn("data", F.when(F.col("row_id") == one, F.transform("data", lambda c, i: F.when(i != 2, c))).otherwise(F.col("data")))
    got = run(part, []).where(F.col("row_id") == one).first()["flag"]
    assert all(got[2]) and not all(map(all, got))
    mixed = rows.withColumn("data", F.when(F.col("row_id") == one, F.slice("data", 1, 3)).otherwise(F.col("data")))
    with pytest.raises(Exception, match="several shapes"):
        run(mixed, []).collect()


WIDE = {"windows_freq": [32, 48], "spike_width_time": 6.5, "spike_width_freq": 64.0, "background_iterations": 5, "num_major_iterations": 1}


def test_kernels_hold_few_planes_however_wide_a_filter_is():
    amp, flag = noisy((4000, 64))
    vis = amp.astype(complex)
    for run in (lambda: kernels.sum_threshold_flags(amp, flag, **WIDE), lambda: kernels.uvcontsub_flags(vis, flag, major_cycles=2)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 6 * amp.nbytes + (10 << 20)


def test_slabs_change_no_flag(monkeypatch):
    amp, flag = noisy((150, 40))
    amp[3, 5] = np.nan
    vis = amp * np.exp(1j * np.arange(40))
    runs = lambda: [kernels.sum_threshold_flags(amp, flag, **OPTIONS), kernels.sum_threshold_flags(amp, flag, **WIDE), kernels.sum_threshold_flags(amp, flag, average_freq=3), kernels.uvcontsub_flags(vis, flag, sigma=3.0)]
    monkeypatch.setattr(kernels, "SLAB", 1 << 30)
    whole = runs()
    monkeypatch.setattr(kernels, "SLAB", 1)
    for fewest in (1, 7):
        monkeypatch.setattr(kernels, "FEWEST", fewest)
        assert all((a == b).all() for a, b in zip(whole, runs(), strict=True))
    assert all(a.any() and not a.all() for a in whole)


def test_batches_of_a_window_change_no_flag(spark):
    rows = fixtures.rows(spark, "/root/testdata/sf0.001").withColumn("data", F.expr("if(row_id % 7 = 0, null, data)"))
    steps = [{"task": "flag_nans_zeros"}, {"task": "uvcontsub_flagger", "kwargs": {"sigma": 3.0, "taylor_degrees": 3}}]
    known = strategy.instrument(fixtures.channels(spark), None, None)
    of = lambda: sorted((r["row_id"], str(r["flag"]), str(r["counts"])) for r in strategy.flag_baselines(rows, steps, known, counted=True).collect())
    whole = of()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert of() == whole and len(whole) == 500
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["box_filter_wide", "box_filter_freq", "interp_nans", "convolve_flags", "combine_time_smear"])
def test_queries_along_one_axis_deal_a_product_over_tasks(spark, name):
    out = getattr(queries, name)(spark, "/root/testdata/sf0.001")
    parts = out.select("bl", F.spark_partition_id().alias("p")).groupBy("bl").agg(F.countDistinct("p").alias("n")).collect()
    assert len(parts) == 10 and all(r["n"] > 1 for r in parts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in x for x in plan.splitlines()) == 2  # numbering the times, and this


def test_plane_medians_are_exact(spark):
    rng = np.random.default_rng(3)
    planes = {0: rng.normal(0, 1, (301, 6)), 1: rng.integers(-2, 3, (40, 6)).astype(float), 2: np.full((5, 6), np.nan), 3: rng.lognormal(0, 30, (64, 6)) * rng.choice([-1, 1], (64, 6))}
    planes[0][:, 2], planes[0][7, 3], planes[1][:, 4] = np.nan, np.nan, -0.0
    rows = [(0, 0, 0, bl, 0, i, x[a : a + 50].tobytes()) for bl, x in planes.items() for i, a in enumerate(range(0, len(x), 50))]
    df = spark.createDataFrame(rows, ", ".join(f"{k} int" for k in th.PRODUCT) + ", tile int, x binary").repartition(3)
    to = np.array([0, 0, 1, 2, 3, 3])
    for group in (np.arange(6), to):
        found = iterated.plane_medians(df, lambda r: np.frombuffer(r["x"]).reshape(-1, 6), group)
        got = {r["bl"]: iterated._medians(r.asDict(), 6) for r in found.collect()}
        assert 2 not in got
        for bl, own in got.items():
            for g in range(6):
                v = planes[bl][:, group == g]
                v = v[~np.isnan(v)]
                assert np.isnan(own[g]) if not v.size else own[g] == np.median(v), (bl, g)


@pytest.mark.parametrize("samples", [1, 1 << 16])
def test_planes_are_dealt_by_tiles(spark, monkeypatch, samples):
    """Several planes at once, of more times than a tile has and of fewer than a window."""
    monkeypatch.setattr(iterated, "SAMPLES", samples)
    options = {**OPTIONS, "num_major_iterations": 2, "background_iterations": 2, "average_freq": 2}
    planes = {b: noisy((n, 24), seed=b) for b, n in enumerate((150, 64, 5, 1))}
    planes[1][0][20, 4] = 1e9
    df = None
    for b, (amp, flag) in planes.items():
        own = long(spark, amp, flag).withColumn("bl", F.lit(b))
        df = own if df is None else df.unionByName(own)
    out = iterated.sum_threshold_flagger(df, 24, **options)
    for b, (amp, flag) in planes.items():
        got = plane(out.where(F.col("bl") == b), "flag", amp.shape).astype(bool)
        assert (got == kernels.sum_threshold_flags(amp, flag, **options)).all(), b
    sizes = iterated.tiles(df, 24, max(64, samples // 24)).select(F.length("flag")).collect()
    assert max(n for (n,) in sizes) == (64 if samples == 1 else 150) * 24
    assert iterated.sum_threshold_flagger(df.limit(0), 24, **options).count() == 0
    with pytest.raises(Exception, match="not dense"):
        iterated.sum_threshold_flagger(df.where("bl > 0 or chan <> 3"), 24, **options)


@pytest.mark.parametrize("r", [3, 33])
def test_tiles_add_only_what_is_near(r):
    x = np.random.default_rng(12).normal(2, 1, (500, 2))
    plain = kernels.box(x, r, 4, 0, kernels.near_sums)
    assert np.allclose(plain, kernels.box(x, r, 4, 0), rtol=1e-12)
    assert (kernels.box(x[40:], r, 4, 0, kernels.near_sums)[4 * r :] == plain[40 + 4 * r :]).all()
    x[20] = 1e12
    assert (kernels.box(x, r, 4, 0, kernels.near_sums)[20 + 4 * r + 1 :] == plain[20 + 4 * r + 1 :]).all()
